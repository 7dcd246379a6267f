"""Cleaning-job keys."""

from __future__ import annotations

from ..functions.quality import generated_image_allowed
from ..operators import quality as qa
from .registry import query
from .sqlbits import WS_CLASS, email_ok, jt, phone


@query("phone_normalize", ["v_registrations"], f"""
SELECT event_id, ts, identifier, {phone('identifier')} AS phone FROM v_registrations""")
def phone_normalize(t):
    return qa.phone_normalize(t.v_registrations)


@query("identity_parse", ["v_registrations"], f"""
WITH q AS (SELECT event_id, ts, identifier, lower({jt('identifier')}) AS v FROM v_registrations),
r AS (SELECT event_id, ts, identifier, CASE WHEN strpos(v, '@') > 0 THEN v END AS email,
    CASE WHEN strpos(v, '@') = 0 THEN {phone('identifier')} END AS phone FROM q)
SELECT *, CASE WHEN email IS NOT NULL THEN {email_ok('email')} ELSE phone IS NOT NULL END AS valid,
  CASE WHEN email IS NOT NULL THEN 'email' ELSE 'phone' END AS kind
FROM r""")
def identity_parse(t):
    return qa.identity_parse(t.v_registrations)


# --- URLs: the same parse in DuckDB, step by step -----------------------------------------------
_SPECIAL = "scheme IN ('http', 'https', 'ws', 'wss', 'ftp')"
_ENC = "path0"
for _c, _e in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{{", "%7B"), ("}}", "%7D"), ("^", "%5E")):
    _ENC = f"replace({_ENC}, '{_c.replace('{{', '{').replace('}}', '}')}', '{_e}')"


def url_steps(source: str, col: str) -> str:
    """CTEs that add protocol, host and path of ``col`` to ``source``; the last one is ``u``."""
    clean = "regexp_replace(regexp_replace(" + col + ", '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g')"
    seg = "regexp_replace(x, '(?i)%2e', '.', 'g')"
    return f"""u0 AS (SELECT *, {clean} AS cu FROM {source}),
u1 AS (SELECT *, lower(regexp_extract(cu, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
  regexp_extract(regexp_replace(cu, '^[A-Za-z][A-Za-z0-9+.\\-]*:', ''), '^([^?#]*)', 1) AS rest FROM u0),
u2 AS (SELECT *, CASE WHEN {_SPECIAL} THEN '//' || regexp_replace(replace(rest, chr(92), '/'), '^/+', '') ELSE rest END AS opened FROM u1),
u3 AS (SELECT *, regexp_replace(regexp_extract(opened, '^//([^/]*)', 1), '^.*@', '') AS hostport,
  regexp_replace(opened, '^//[^/]*', '') AS raw FROM u2),
u4 AS (SELECT *, regexp_extract(hostport, ':([0-9]*)$', 1) AS port, lower(regexp_replace(hostport, ':[0-9]*$', '')) AS host0,
  list_slice(string_split(raw, '/'), 2, len(string_split(raw, '/'))) AS segs FROM u3),
u5 AS (SELECT *, CASE WHEN {_SPECIAL} AND contains(host0, '%') THEN lower(url_decode(host0)) ELSE host0 END AS host1,
  CASE WHEN len(segs) = 0 THEN '/' ELSE list_reduce(list_transform(segs, lambda x: x), lambda a, x: CASE WHEN {seg} = '..' THEN
      regexp_replace(a, '/[^/]*$', '') WHEN {seg} = '.' THEN a ELSE a || '/' || x END, '')
    || CASE WHEN regexp_replace(segs[-1], '(?i)%2e', '.', 'g') IN ('.', '..') THEN '/' ELSE '' END END AS path0 FROM u4),
u6 AS (SELECT *, scheme <> '' AND (NOT {_SPECIAL} OR (host1 <> '' AND NOT regexp_matches(host1, '[\\x00-\\x20#%/:<>?@\\[\\\\\\]^|]')
    AND COALESCE(TRY_CAST(NULLIF(port, '') AS BIGINT), 0) <= 65535)) AS good,
  {_ENC} AS path1 FROM u5),
u AS (SELECT *, CASE WHEN good THEN scheme || ':' END AS protocol, CASE WHEN good THEN host1 END AS host,
  CASE WHEN good THEN CASE WHEN {_SPECIAL} THEN list_aggregate(list_transform(string_split(path1, ''),
    lambda c: CASE WHEN regexp_matches(c, '[^\\x00-\\x7F]') THEN url_encode(c) ELSE c END), 'string_agg', '') ELSE raw END END AS path FROM u6)"""


@query("url_allowlist", ["v_page_links"], f"""
WITH {url_steps('v_page_links', 'url')}
SELECT page_id, url, protocol, host, path,
  COALESCE(protocol = 'https:' AND host = 'thther.example.org' AND strpos(path, '/en/') > 0, FALSE) AS allowed FROM u""")
def url_allowlist(t):
    return qa.url_allowlist(t.v_page_links, "url", "thther.example.org", "/en/")


@query("generated_image_rule", ["v_generated_images"], f"""
WITH {url_steps('v_generated_images', 'url')}
SELECT request_id, pos, url, public_id, COALESCE(url <> '' AND protocol = 'https:' AND host = 'res.cloudinary.com'
  AND starts_with(COALESCE(public_id, ''), 'shop/ai-generated/') AND strpos(public_id, '..') = 0, FALSE) AS allowed FROM u""")
def generated_image_rule(t):
    return t.v_generated_images.select("request_id", "pos", "url", "public_id", generated_image_allowed("url", "public_id").alias("allowed"))


@query("alert_intake", ["v_alert_requests"], f"""
WITH {url_steps('v_alert_requests', 'image_url')}
SELECT page_id, image_url, substr(COALESCE(product_description, ''), 1, 2000) AS product_description,
  {jt('contact')} AS contact,
  CASE WHEN strpos({jt('contact')}, '@') > 0 THEN 'email' ELSE 'phone' END AS contact_type
FROM u WHERE COALESCE(image_url, '') <> '' AND COALESCE(contact, '') <> ''
  AND protocol = 'https:' AND host = 'res.cloudinary.com' AND strpos(path, '/shop/image-search/') > 0
  AND length({jt('contact')}) BETWEEN 5 AND 150""")
def alert_intake(t):
    return qa.alert_intake(t.v_alert_requests)


# (DuckDB accepts a comma before the last brace, strict JSON does not)
SPAN = f"""s0 AS (SELECT doc_id, {jt("replace(regexp_replace(raw, '```json', '', 'gi'), '```', '')")} AS s
  FROM v_llm_outputs),
s1 AS (SELECT doc_id, CASE WHEN strpos(s, '{{') > 0 AND length(s) - strpos(reverse(s), '}}') + 1 >= strpos(s, '{{') AND strpos(reverse(s), '}}') > 0
    THEN substring(s, strpos(s, '{{'), length(s) - strpos(reverse(s), '}}') + 1 - strpos(s, '{{') + 1) END AS span FROM s0),
y AS (SELECT doc_id, span, COALESCE(json_valid(span) AND NOT suffix(span, ',}}'), FALSE) AS ok FROM s1),
x AS (SELECT doc_id, ok, CASE WHEN ok THEN CAST(span AS JSON) END AS j FROM y),
k AS (SELECT doc_id, ok, j, json_type(j, '$.productName') AS t1, json_type(j, '$.category') AS t2, json_type(j, '$.description') AS t3,
    json_type(j, '$.confidence') AS t4, json_type(j, '$.identifiedFeatures') AS t5 FROM x),
e AS (SELECT doc_id, ok, json_extract_string(j, '$.productName') AS product_name, {{k1}} AS product_name_kind,
    json_extract_string(j, '$.category') AS category, {{k2}} AS category_kind,
    json_extract_string(j, '$.description') AS description, {{k3}} AS description_kind,
    json_extract_string(j, '$.confidence') AS confidence_raw, {{k4}} AS confidence_raw_kind,
    CASE WHEN t5 = 'ARRAY' THEN CAST(json_extract(j, '$.identifiedFeatures') AS VARCHAR) END AS identified_features FROM k)"""
for _i in range(1, 5):
    SPAN = SPAN.replace(f"{{k{_i}}}", f"CASE t{_i} WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' "
                        f"WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE CASE WHEN t{_i} IS NOT NULL THEN 'number' END END")
JSON_COLUMNS = ("doc_id", "ok", "product_name", "product_name_kind", "category", "category_kind", "description", "description_kind",
                "confidence_raw", "confidence_raw_kind", "identified_features")


@query("llm_json_extract", ["v_llm_outputs"], f"WITH {SPAN} SELECT * FROM e")
def llm_json_extract(t):
    return qa.llm_json_extract(t.v_llm_outputs).select(*JSON_COLUMNS)


def _js_true(c: str) -> str:
    return (f"COALESCE(CASE {c}_kind WHEN 'string' THEN {c} <> '' WHEN 'number' THEN CAST({c} AS DOUBLE) <> 0 "
            f"WHEN 'boolean' THEN {c} = 'true' ELSE {c}_kind IN ('array', 'object') END, FALSE)")


@query("llm_json_gate", ["v_llm_outputs"], f"""
WITH {SPAN},
g AS (SELECT *, CASE WHEN description_kind = 'string' THEN
      CAST(len(string_split_regex({jt('description')}, '[{WS_CLASS}]+')) AS INTEGER) END AS words
  FROM e)
SELECT doc_id, words,
  ok AND {_js_true('product_name')} AND {_js_true('category')} AND {_js_true('description')} AND COALESCE(words >= 100, FALSE) AS passed,
  GREATEST(0.0, LEAST(1.0, COALESCE(CASE WHEN confidence_raw_kind = 'boolean' THEN CASE WHEN confidence_raw = 'true' THEN 1.0 ELSE 0.0 END
    WHEN confidence_raw_kind IN ('string', 'number')
      AND regexp_matches({jt('confidence_raw')}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
      THEN TRY_CAST({jt('confidence_raw')} AS DOUBLE) END, 0.0))) AS confidence,
  COALESCE(identified_features, '[]') AS features
FROM g""")
def llm_json_gate(t):
    return qa.llm_json_gate(qa.llm_json_extract(t.v_llm_outputs)).select(
        "doc_id", "words", "passed", "confidence", "features")


@query("dedupe_sources", ["v_grounding_sources"], """
WITH s AS (SELECT * FROM v_grounding_sources WHERE COALESCE(uri, '') <> ''),
r AS (SELECT response_id, uri, MIN(pos) OVER (PARTITION BY response_id, uri) AS first_pos,
    COALESCE(title, '') AS title, row_number() OVER (PARTITION BY response_id, uri ORDER BY pos DESC) AS rn FROM s)
SELECT response_id, uri, first_pos, title FROM r WHERE rn = 1""")
def dedupe_sources(t):
    return qa.dedupe_sources(t.v_grounding_sources)
