"""Incremental variants of two batch operators (Structured Streaming).

* :func:`daily_orders_stream` -- A6 over a stream of orders: event-time day
  windows with a watermark, so each day's row is final (append mode) once
  the watermark passes it and the state for that day is dropped.
* :func:`cart_upsert_stream` -- M1 as ``foreachBatch``: every micro-batch of
  add requests becomes a small delta (its own valid adds, folded per cart line),
  written as the partition of its epoch.  A batch costs what it holds, not
  what the carts hold; running an epoch again after a failure replaces its
  partition.  :func:`read_cart` folds the last compacted base and the deltas behind
  it; :func:`compact_cart` writes a new base.  The stream checkpoint lives in the
  shared checkpoint folder of the session.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import CANCELLED, DELIVERED, SHIPPING, not_cancelled, status_key
from ..operators.changes import cart_upsert, upsert_agg
from ..session import ensure_checkpoint_dir

CART_SCHEMA = ("cart_id bigint, offer_id bigint, quantity int, created_at timestamp_ntz, "
               "updated_at timestamp_ntz")


def daily_orders_stream(orders: DataFrame, watermark: str = "1 day", ts: str = "created_at") -> DataFrame:
    """Per-day order measures over a streaming frame of orders."""
    k = status_key("status")
    # watermarks need a zone-aware event time; the session zone (UTC) keeps
    # the wall-clock day of the zone-free column
    return (orders.withColumn("_event_time", F.col(ts).cast("timestamp_ltz"))
            .withWatermark("_event_time", watermark)
            .groupBy(F.window("_event_time", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 F.coalesce(F.sum(F.when(not_cancelled(), F.col("total")).otherwise(F.lit(0))),
                            F.lit(0)).cast("decimal(24,2)").alias("revenue"),
                 F.count(F.when(k == CANCELLED, 1)).alias("cancelled_orders"),
                 F.count(F.when(k.isin(DELIVERED), 1)).alias("delivered_orders"),
                 F.count(F.when(k.isin(SHIPPING), 1)).alias("shipping_orders"))
            .select(F.to_date(F.col("w.start")).alias("date"), "orders", "revenue", "cancelled_orders",
                    "delivered_orders", "shipping_orders"))


def _part(table_dir: str, kind: str) -> str:
    return posixpath.join(table_dir, kind)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by epoch; empty before its first write."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CART_SCHEMA + ", epoch bigint")
    return spark.read.schema(CART_SCHEMA + ", epoch bigint").parquet(path)


def _write(df: DataFrame, path: str, epoch: int) -> None:
    (df.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("epoch").parquet(path))


def read_cart(spark: SparkSession, table_dir: str, upto: int | None = None) -> DataFrame:
    """The carts after epoch ``upto`` (the last one): the newest base at or before it and the deltas behind that base.

    Adding up is associative, so deltas may be folded in any order.
    """
    base, delta = _read(spark, _part(table_dir, "base")), _read(spark, _part(table_dir, "delta"))
    if upto is not None:
        base, delta = base.where(F.col("epoch") <= upto), delta.where(F.col("epoch") <= upto)
    top = base.agg(F.coalesce(F.max("epoch"), F.lit(-1)).alias("top")).first()["top"]  # partition values only
    rows = base.where(F.col("epoch") == top).unionByName(delta.where(F.col("epoch") > top)).drop("epoch")
    keyed = upsert_agg(rows.where("offer_id is not null"), rows.limit(0), ["cart_id", "offer_id"],
                       [F.sum("quantity").cast("int").alias("quantity"), F.min("created_at").alias("created_at"),
                        F.max("updated_at").alias("updated_at")])
    return keyed.unionByName(rows.where("offer_id is null"))


def compact_cart(spark: SparkSession, table_dir: str, upto: int) -> None:
    """Write the carts after epoch ``upto`` as a new base; deltas up to it are not read any more."""
    _write(read_cart(spark, table_dir, upto), _part(table_dir, "base"), upto)


def cart_upsert_stream(spark: SparkSession, adds: DataFrame, offers: DataFrame, table_dir: str,
                       name: str = "cart_upsert", trigger: dict | None = None):
    """Start the incremental cart upsert; returns the StreamingQuery.

    ``adds`` is a streaming frame with cart_id, offer_id, quantity, ts,
    event_id.  Epoch N writes the delta of batch N.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        _write(cart_upsert(s.createDataFrame([], CART_SCHEMA), batch, offers), _part(table_dir, "delta"), epoch)

    ckpt = posixpath.join(ensure_checkpoint_dir(spark), "streams", name)
    w = adds.writeStream.foreachBatch(merge).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
