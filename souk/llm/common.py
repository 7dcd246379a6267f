"""Helpers shared by the corpus operators: words, shared folders, reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white-space class that separates words, and A-Z folding.
WS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_az(c: Column) -> Column:
    """Lower-case A-Z only (other letters stay as they are)."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the non-white-space runs of ``text`` (null text: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of non-white-space runs (null text: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``).

    The session's setting is used as it is.  Only when neither the conf nor
    the context names one does this fail: a machine-local folder would be
    invisible to other executors, so none is made here (tests set one).
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder all executors share")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: cuts lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    return f"{shared_dir(spark).rstrip('/')}/souk-{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as a table into the shared folder and read again: cuts lineage, has its real size."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release_memory(cycles: bool = True) -> None:
    """Give memory a finished task has freed back to the system.

    Python workers live on from task to task and stage to stage; without this
    each keeps the peak of everything it has run.  Looking for cycles walks
    through all that a worker remembers: short tasks that make none leave it out.
    """
    import ctypes
    import gc
    import sys

    import pyarrow as pa
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def packed(df: DataFrame, *cols: Column, drop: tuple = ()) -> DataFrame:
    """``df`` as one struct column ``row`` (without the ``drop`` columns) plus the named ``cols``.

    The operators work on ``row`` and their own columns only, so an input
    column of any name cannot clash with theirs; ``unpacked`` opens it again.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in drop]).alias("row"), *cols)


def unpacked(df: DataFrame, *cols: str) -> DataFrame:
    """The columns inside ``row``, then ``cols``."""
    return df.select("row.*", *cols)
