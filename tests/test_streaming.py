"""Streaming variants agree with their batch operators."""

import tempfile
import uuid

from pyspark.sql import functions as F

from souk.operators import changes, sales
from souk.sources import Tables
from souk.streaming import cart_upsert_stream, compact_cart, daily_orders_stream, read_cart

SF = "/root/testdata/sf0.001"


def test_daily_orders_stream_matches_batch(spark):
    t = Tables(spark, SF)
    src = tempfile.mkdtemp(prefix="souk-stream-src-")
    t.v_orders.select("id", "status", "total", "created_at").repartition(4).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("id bigint, status string, total decimal(14,2), created_at timestamp_ntz") \
        .option("maxFilesPerTrigger", 1).parquet(src)
    # a watermark wider than the data span: no row is late, so the stream
    # must equal the batch aggregate (late rows are dropped by design)
    q = (daily_orders_stream(stream, watermark="3000 days").writeStream.outputMode("update").format("memory")
         .queryName("souk_daily_stream").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("SELECT * FROM souk_daily_stream")
    # last update per day = the complete day
    latest = {r.date: (r.orders, r.revenue) for r in got.collect()}
    batch = sales.daily_orders(t.v_orders, "2001-08-31", 3000, upper_bound=False).collect()
    want = {r.date: (r.orders, r.revenue) for r in batch}
    assert latest == want


def test_cart_upsert_stream_matches_batch(spark):
    t = Tables(spark, SF)
    adds = t.v_cart_adds.select(F.col("user_id").alias("cart_id"), "offer_id", "quantity", "ts", "event_id")
    src = tempfile.mkdtemp(prefix="souk-stream-adds-")
    adds.repartition(3).write.mode("overwrite").parquet(src)
    table = tempfile.mkdtemp(prefix="souk-cart-table-")
    stream = spark.readStream.schema(adds.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = cart_upsert_stream(spark, stream, t.v_offers, table, name=f"cart_test_{uuid.uuid4().hex}")
    q.awaitTermination(300)
    last = q.lastProgress["batchId"]
    assert last >= 2
    empty = spark.createDataFrame([], "cart_id bigint, offer_id bigint, quantity int, "
                                      "created_at timestamp_ntz, updated_at timestamp_ntz")
    want = {(r.cart_id, r.offer_id): (r.quantity, r.created_at, r.updated_at)
            for r in changes.cart_upsert(empty, adds, t.v_offers).collect()}

    def rows(df):
        return {(r.cart_id, r.offer_id): (r.quantity, r.created_at, r.updated_at) for r in df.collect()}

    assert rows(read_cart(spark, table)) == want
    before = rows(read_cart(spark, table, upto=1))
    compact_cart(spark, table, 1)
    compact_cart(spark, table, 1)  # again: nothing changes
    assert rows(read_cart(spark, table)) == want and rows(read_cart(spark, table, upto=1)) == before
    compact_cart(spark, table, last)
    assert rows(read_cart(spark, table)) == want and read_cart(spark, table + "/none").count() == 0
