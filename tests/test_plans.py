"""Plan checks: no Python UDFs, no nested-loop joins except bounded ones,
filters and column pruning reach the Parquet scan."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from souk.operators import catalog, changes, common
from souk.plans import load_all

SF = "/root/testdata/sf0.001"
CORE = load_all()[0]
# one-row cross joins (highest id, range bounds, four totals) and the date spine (<= days rows)
NESTED_LOOP_OK = {"ads_active_daily", "cart_touch", "dashboard_totals", "identity_register", "invoice_admin_notes", "invoice_alerts",
                  "invoice_create", "invoice_create_lines", "invoice_stock_check", "offer_create_generated",
                  "offer_create_generated_images", "offers_page", "offers_page_window", "order_place_guest",
                  "order_place_guest_lines", "order_place_user", "order_place_user_lines", "report_document", "stock_alert_resolution"}


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(CORE))
def test_plan_shape(spark, key):
    p = plan(CORE[key](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p
    if key not in NESTED_LOOP_OK:
        assert "BroadcastNestedLoopJoin" not in p


def test_period_filter_pushed_to_scan(spark):
    p = plan(E.queries()["daily_timeline"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    # only the columns the report needs are read from orders
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz," \
           "o_orderpriority:string>" in p


def test_page_equals_offset_limit(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 500).alias("k"), F.col("id"),
                                     F.when(F.col("id") % 9 != 0, (F.col("id") % 40).cast("decimal(10,2)")).alias("d"))
    for order, exprs in (([common.desc("k"), common.asc("id")], [F.col("k").desc_nulls_first(), F.col("id")]),
                         ([common.asc("d"), common.desc("id")], [F.col("d").asc_nulls_last(), F.col("id").desc()]),
                         ([common.desc("d", nulls_first=False), common.desc("id")], [F.col("d").desc_nulls_last(), F.col("id").desc()])):
        for no, size in ((3, 700), (1, 5), (8, 700), (9, 700), (1, 1_000_000)):
            want = [tuple(r) for r in df.orderBy(*exprs).offset((no - 1) * size).limit(size).collect()]
            for ranges in (4, 1024):
                got = common.page(df.repartition(7), order, no, size, ranges=ranges).orderBy("position").collect()
                assert [tuple(r)[:3] for r in got] == want
                assert [r.position for r in got] == list(range((no - 1) * size, (no - 1) * size + len(want)))


def test_global_position_is_dense(spark):
    df = spark.range(0, 3000).repartition(5)
    for ranges in (1, 16, 1024):
        rows = common.global_position(df, [common.desc("id")], ranges=ranges).select("id", "_pos").collect()
        assert sorted(r._pos for r in rows) == list(range(3000))
        assert all(r._pos == 2999 - r.id for r in rows)
    assert common.global_position(df.limit(0), [common.asc("id")]).count() == 0


def test_ranges_are_balanced_under_a_hot_first_key(spark):
    df = spark.range(0, 20000).select(F.when(F.col("id") % 3 != 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    sizes = [r["count"] for r in common.range_bucket(df, [common.asc("k"), common.asc("id")], 64).groupBy("_bucket").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 20000 / 64 * 8


def test_building_numbered_frames_starts_no_job(spark):
    """Positions need neither a job while the frame is built nor a checkpoint folder."""
    t = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "numbered frames")
    users = spark.createDataFrame([(1, "a@b.c", "771111111")], "id bigint, email string, phone string")
    regs = spark.createDataFrame([(1, "N", "772222222")], "event_id bigint, full_name string, identifier string") \
        .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    changes.identity_register(users, regs)
    df = spark.range(10).select("id", F.lit(1).alias("new_price"), F.lit("active").alias("status"), F.lit(3).alias("quantity"))
    images = spark.createDataFrame([], "id bigint, offer_id bigint, image_url string, is_main boolean, sort_order int")
    catalog.offers_page(df, images, sort="price-low", page=2, limit=3)
    assert list(t.getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("rest", "rest")


def test_page_order_holds_without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        offers = spark.range(500).select("id", (F.col("id") * 31 % 17).alias("new_price"), F.lit("active").alias("status"), F.lit(3).alias("quantity"))
        images = spark.range(1000).select("id", (F.col("id") % 200).alias("offer_id"), F.lit("u").alias("image_url"),
                                          F.lit(False).alias("is_main"), F.lit(0).alias("sort_order"))
        rows = catalog.offers_page(offers, images, sort="price-low", page=2, limit=50).collect()
        assert [r.position for r in rows] == list(range(50, 100))
        want = sorted(range(500), key=lambda i: (i * 31 % 17, -i))[50:100]
        assert [r.id for r in rows] == want and all(len(r["images"]) == (5 if r.id < 200 else 0) for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_search_sends_no_table_to_the_driver(spark, tmp_path):
    """A broadcast is collected on the driver: grams of offers and terms of queries outgrow their size estimates."""
    schema = "id bigint, product_name string, category string, description string, new_price decimal(14,2), status string, quantity int, created_at timestamp_ntz"
    spark.range(300).selectExpr("id", "concat('bolt ', id % 7)", "if(id % 3 = 0, null, 'tool')", "concat('made ', id % 11)", "cast(1 as decimal(14,2))",
                                "if(id % 10 = 0, 'inactive', 'active')", "1", "timestamp_ntz'2001-01-01' + make_dt_interval(id % 50)") \
        .toDF(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{tmp_path}/offers")
    spark.range(90).selectExpr("id as query_id", "concat(' bolt ', id % 9)", "if(id % 2 = 0, 'TOOL', '')", "array('', 'de_' || id % 13, null)") \
        .toDF("query_id", "product_name", "category", "search_terms").write.parquet(f"{tmp_path}/analyses")
    offers, analyses = spark.read.parquet(f"{tmp_path}/offers"), spark.read.parquet(f"{tmp_path}/analyses")
    out = catalog.image_search(analyses, offers, top=4)
    rows = out.collect()
    final = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final and "Broadcast" not in final
    terms = catalog.clean_terms(analyses).select("query_id", F.explode("terms").alias("term"))
    assert "Broadcast" not in plan(catalog.term_search(terms, offers))
    got, texts = {}, {o.id: (o, [x.lower() for x in (o.product_name, o.category, o.description) if x]) for o in catalog.sellable(offers).collect()}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.offer_id, r.description))
    for q in range(90):
        any_of = [re.compile(t) for t in (f"bolt {q % 9}", *["tool"] * (q % 2 == 0), f"de.{q % 13}")]
        best = sorted((o for o, low in texts.values() if any(t.search(x) for t in any_of for x in low)), key=lambda o: (o.created_at, o.id), reverse=True)[:4]
        assert got.get(q, []) == [(i, o.id, o.description) for i, o in enumerate(best, 1)]
    assert got
