"""Registered corpus queries: one ``opN_<name>`` per operator, with production
parameters, over whole tables.  ``QUERIES`` maps name -> (spark, sf_dir) -> DataFrame;
``ORACLES`` holds DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table

#: Key of the registered pseudonym query; a real run passes its own secret.
PSEUDONYM_KEY = b"registered query: not a secret"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return put


@query("op7_minhash_dedup")
def op7_minhash_dedup(spark, sf_dir):
    from .dedup import near_duplicates
    r = near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_quality_knn")
def op6_quality_knn(spark, sf_dir):
    from .quality import quality_scores
    r = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return r.select("doc_id", "held_out", "score", "predicted")


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    from .decontam import decontaminate
    r = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "contaminated", "item_ids", "similarity")


@query("op10_mix_sources")
def op10_mix_sources(spark, sf_dir):
    from .mixing import mix
    r = mix(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_shards")
def op5_token_shards(spark, sf_dir):
    from .tokens import token_shards
    return token_shards(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    from .token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op9_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS rank FROM s
) WHERE rank <= 20
""")
def op9_exact_topk(spark, sf_dir):
    from .topk import exact_topk
    return exact_topk(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    from .conversations import audits, damage
    r = audits(damage(table(spark, sf_dir, "conversations")))
    return r.withColumnRenamed("conv", "conv_id")


@query("op13_fill_in_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a,
         greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(us, 1, a), '') AS pre,
         array_to_string(list_slice(us, a + 1, b), '') AS mid, array_to_string(list_slice(us, b + 1, n), '') AS suf
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op13_fill_in_middle(spark, sf_dir):
    from .fim import fill_in_middle, restored
    r = fill_in_middle(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op11_quality_rules")
def op11_quality_rules(spark, sf_dir):
    from .rules import OUT, fit, quality_rules
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", *OUT)


@query("op1_main_text")
def op1_main_text(spark, sf_dir):
    from .html_extract import extract, fit, labelled_blocks
    r = extract(table(spark, sf_dir, "pages"), fit(labelled_blocks(spark)))
    return r.select("page_id", "url", "text", "n_chars")


@query("op3_pseudonyms")
def op3_pseudonyms(spark, sf_dir):
    from .pii import OUT, pseudonyms
    return pseudonyms(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", *OUT)


@query("op4_page_language")
def op4_page_language(spark, sf_dir):
    from .html_extract import fit, labelled_blocks
    from .langid import identify
    r = identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), fit(labelled_blocks(spark)))
    return r.select("page_id", "host", "declared", "text_lang", "lang", F.round("confidence", 6).alias("confidence"))
