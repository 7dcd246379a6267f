"""Corpus pipeline: quality filter, near-dedup, decontamination, mixing, token shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that the
runner writes as Parquet and reads again as the next stage's ``docs``.  All
but the last return the columns of ``documents``; each works on every row its
predecessor kept and its decision takes effect:

1. quality (operator 6): documents scored below the threshold go;
2. near_dedup (operator 7): one document of each near-duplicate group stays
   (the smallest id);
3. decontaminate (operator 2): documents holding a benchmark passage go;
4. mix (operator 10): the mixed text of each document, with the words its blocks
   are drawn for, as often as they are drawn (none: the document goes);
5. tokens (operator 5): the kept documents as token-id shards, read back:
   doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import scratch_path, table
from souk.llm.decontam import decontaminate
from souk.llm.dedup import near_duplicates
from souk.llm.mixing import mixed_documents
from souk.llm.quality import quality_scores
from souk.llm.tokens import token_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates(docs).where("kept").select(*docs.columns)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixed_documents(docs)
    return out.withColumns({"n_chars": F.length("text")} if "n_chars" in docs.columns else {}).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontam),
          ("mix", mixing), ("tokens", tokens)]

#: The stages use a trained model, components and random draws: no SQL oracle;
#: tests/llm/test_pipeline.py compares every stage with an independent version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        out = f(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
