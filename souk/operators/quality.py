"""Cleaning jobs over whole tables (column expressions only, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import js_trim
from ..functions.quality import (clamp01, contact_type, js_number, normalize_phone, strip_fences, url_allowed,
                                 url_parts, word_count)
from .changes import parse_identifier

MIN_DESCRIPTION_WORDS = 100


def phone_normalize(df: DataFrame, col: str = "identifier") -> DataFrame:
    """C1 as a job: the normalised phone (NULL when invalid) next to the input."""
    return df.withColumn("phone", normalize_phone(F.col(col)))


def identity_parse(df: DataFrame, col: str = "identifier") -> DataFrame:
    """Kind, e-mail or phone, and validity of each identifier."""
    p = parse_identifier(df, col)
    return p.withColumn("kind", F.when(F.col("email").isNotNull(), F.lit("email")).otherwise(F.lit("phone")))


def url_allowlist(df: DataFrame, col: str, host: str, path_part: str) -> DataFrame:
    """URL parts and the allow-list verdict per row."""
    p = url_parts(F.col(col))
    return df.select("*", p["protocol"].alias("protocol"), p["host"].alias("host"),
                     p["path"].alias("path"), url_allowed(F.col(col), host, path_part).alias("allowed"))


def alert_intake(requests: DataFrame, host: str | None = None, path_part: str | None = None) -> DataFrame:
    """Image search alerts: image URL and contact required, URL allowed,
    contact 5..150 after trim, description cut to 2,000 characters."""
    kw = {}
    if host:
        kw["host"] = host
    if path_part:
        kw["path_part"] = path_part
    contact = js_trim("contact")
    ok = (F.coalesce(F.col("image_url"), F.lit("")) != "") & (F.coalesce(F.col("contact"), F.lit("")) != "") \
        & url_allowed(F.col("image_url"), **kw) & (F.length(contact) >= 5) & (F.length(contact) <= 150)
    return requests.where(ok).select(
        *[c for c in requests.columns if c not in ("image_url", "product_description", "contact")],
        "image_url",
        F.substring(F.coalesce(F.col("product_description"), F.lit("")), 1, 2000).alias("product_description"),
        contact.alias("contact"), contact_type(contact).alias("contact_type"))


def _json_kind(v: Column) -> Column:
    """JSON type of a VARIANT value: string, number, boolean, null, array or object (NULL when absent)."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number"))


def llm_json_extract(df: DataFrame, col: str = "raw") -> DataFrame:
    """The JSON object inside a model answer (from the first '{' to the last '}'
    after the fences are dropped); ``ok`` when that text is strict JSON and nothing follows it.

    The text is parsed once, as a VARIANT, inside brackets: one element then
    means that no second value stands behind the object.  Fields come out as text with their
    JSON type (``product_name_kind``, ...): a number where a text is expected does not lose the
    row, it is judged by the gate.  ``identified_features``: the list as JSON text when it is a list.
    """
    s = df.withColumn("_s", strip_fences(F.col(col)))
    s = s.withColumn("_a", F.instr("_s", "{")).withColumn("_z", F.instr(F.reverse("_s"), "}"))
    s = s.withColumn("_e", F.length("_s") - F.col("_z") + 1)
    s = s.withColumn("_span", F.when((F.col("_a") > 0) & (F.col("_z") > 0) & (F.col("_e") >= F.col("_a")),
                                     F.substring("_s", F.col("_a"), F.col("_e") - F.col("_a") + 1)))
    s = s.withColumn("_v", F.try_parse_json(F.concat(F.lit("["), F.col("_span"), F.lit("]"))))
    one = F.try_variant_get("_v", "$[0]", "variant")
    s = s.withColumn("ok", F.coalesce(one.isNotNull() & F.try_variant_get("_v", "$[1]", "variant").isNull()
                                      & (_json_kind(one) == "object"), F.lit(False)))
    fields = {"product_name": "productName", "category": "category", "description": "description", "confidence_raw": "confidence"}
    out = []
    for name, key in fields.items():
        v = F.try_variant_get("_v", f"$[0].{key}", "variant")
        out += [F.when(F.col("ok"), F.try_variant_get("_v", f"$[0].{key}", "string")).alias(name),
                F.when(F.col("ok"), _json_kind(v)).alias(f"{name}_kind")]
    feats = F.try_variant_get("_v", "$[0].identifiedFeatures", "variant")
    return s.select(*df.columns, "ok", *out,
                    F.when(F.col("ok") & (_json_kind(feats) == "array"), F.to_json(feats)).alias("identified_features"))


def _truthy(name: str) -> Column:
    """JavaScript truth of a JSON value: not absent, null, false, 0 or ''."""
    v, kind = F.col(name), F.col(f"{name}_kind")
    return F.coalesce(F.when(kind == "string", v != "").when(kind == "number", v.try_cast("double") != 0)
                      .when(kind == "boolean", v == "true").otherwise(kind.isin("array", "object")), F.lit(False))


def llm_json_gate(extracted: DataFrame) -> DataFrame:
    """C11: complete answers: name, category and description truthy, the
    description a text of at least 100 words (counted once, from the blanks between them);
    confidence ``Number(x) || 0`` clamped to [0, 1]; features default []."""
    e = extracted.withColumn("words", F.when(F.col("description_kind") == "string", word_count(F.col("description"))))
    return e.select(
        "*", (F.col("ok") & _truthy("product_name") & _truthy("category") & _truthy("description")
              & F.coalesce(F.col("words") >= MIN_DESCRIPTION_WORDS, F.lit(False))).alias("passed"),
        clamp01(js_number("confidence_raw", "confidence_raw_kind")).alias("confidence"),
        F.coalesce("identified_features", F.lit("[]")).alias("features"))


def dedupe_sources(sources: DataFrame, group: str = "response_id", pos: str = "pos") -> DataFrame:
    """Sources with a uri, one per (group, uri): first position,
    title of the last occurrence ('' when missing)."""
    s = sources.where(F.coalesce(F.col("uri"), F.lit("")) != "")
    return (s.groupBy(group, "uri")
            .agg(F.min(pos).alias("first_pos"),
                 F.max_by(F.coalesce(F.col("title"), F.lit("")), F.col(pos)).alias("title")))
