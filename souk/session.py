"""Session helpers: the configuration every souk job expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for deterministic, scalable plans.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Casts of dates to TIMESTAMP stay zone-free, as in the source tables.
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}


def build_session(master: str | None = None, app: str = "souk",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with souk's settings; the UI stays off."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Apply the runtime-settable part of SESSION_CONF to an existing session."""
    for k, v in SESSION_CONF.items():
        if spark.conf.isModifiable(k):  # static settings are left as the cluster set them
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A folder already given to the context, or named by ``spark.checkpoint.dir``,
    is used as it is; the conf is never written (Spark refuses to change it at
    run time).  Only a local-mode session without either gets a scratch folder;
    on a cluster a missing setting is an error, since a driver-local folder is
    invisible to the executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder all executors share")
        d = tempfile.mkdtemp(prefix="souk-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared checkpoint folder and read again.

    For loops: a checkpoint keeps the size estimate of the plan it cut, and
    estimates of joins multiply from round to round; a table has its real size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
