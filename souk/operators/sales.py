"""Sales analytics: period overview, timelines, delivery funnel, rankings.

All reports are aggregates over whole tables.  Orders are read once for the
overview, previous-period and delivery figures (one fused ``agg``), with the
period's lower bound added as a WHERE so that the scan can skip row groups.
Top-k reports end in ``orderBy().limit()`` (TakeOrderedAndProject, k rows per
task) and every ordering carries a unique last key so results are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import date_spine, period_start, previous_start
from ..functions.exprs import (CANCELLED, DELIVERED, FAILED, OFFER_WITHDRAWN, PENDING,
                               SHIPPING, as_of_date, day_after, is_cancelled,
                               not_cancelled, person_label, status_key)
from .common import has_cols, with_columns_or_null

MONEY_SUM = "decimal(24,2)"


def _zero():
    return F.lit(0).cast(MONEY_SUM)


def _cnt(cond):
    return F.count(F.when(cond, F.lit(1)))


def _sum_if(cond, value):
    return F.coalesce(F.sum(F.when(cond, F.col(value)).otherwise(F.lit(0))), _zero()).cast(MONEY_SUM)


# ---------------------------------------------------------------------------
# Fused period statistics over orders (A1, A2, A10 in one scan)
# ---------------------------------------------------------------------------
def order_period_stats(orders: DataFrame, as_of, days: int) -> DataFrame:
    """One row: current-period, previous-period and delivery counts.

    Bounded measures (revenue, orders, cancelled) use ``[start, as_of+1d)``;
    the delivery-state counts have only the lower bound.
    """
    start = period_start(as_of, days).cast("timestamp_ntz")
    prev = previous_start(as_of, days).cast("timestamp_ntz")
    end = day_after(as_of)
    ts, k = F.col("created_at"), status_key("status")
    cur = (ts >= start) & (ts < end)
    since = ts >= start
    before = (ts >= prev) & (ts < start)
    return (orders.select("created_at", "status", "total")
            .where(ts >= prev)  # implied by every branch below
            .agg(
                _sum_if(cur & not_cancelled(), "total").alias("revenue"),
                _cnt(cur).alias("orders"),
                _cnt(cur & is_cancelled()).alias("cancelled_orders"),
                _cnt(since & k.isin(DELIVERED)).alias("delivered_orders"),
                _cnt(since & k.isin(SHIPPING)).alias("shipping_orders"),
                _cnt(since & k.isin(PENDING)).alias("pending_orders"),
                _cnt(since & k.isin(FAILED)).alias("failed_orders"),
                _cnt(since & (k == CANCELLED)).alias("cancelled_since_start"),
                _sum_if(before & not_cancelled(), "total").alias("previous_revenue"),
                _cnt(before).alias("previous_orders"),
                _cnt(before & is_cancelled()).alias("previous_cancelled_orders"),
            ))


def _ratio(num, den):
    """num/den as double; 0 when den is 0 (JS guard), never a division error."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def sales_overview(orders: DataFrame, as_of, days: int) -> DataFrame:
    """A1 + A12: revenue, order counts by state, average order and daily revenue."""
    s = order_period_stats(orders, as_of, days)
    return s.select(
        F.lit(days).alias("days"),
        "revenue", "orders", "cancelled_orders", "delivered_orders",
        "shipping_orders", "failed_orders",
        F.when(F.col("orders") > 0, _ratio(F.col("revenue"), F.col("orders")))
         .otherwise(F.lit(0.0)).alias("average_order"),
        _ratio(F.col("revenue"), F.lit(days)).alias("average_daily_revenue"),
        F.lit(0.0).alias("conversion_rate"),
    )


def sales_previous(orders: DataFrame, as_of, days: int) -> DataFrame:
    """A2: the period before; ``offers_cancelled`` is really cancelled orders."""
    s = order_period_stats(orders, as_of, days)
    return s.select(
        F.col("previous_revenue").alias("revenue"),
        F.col("previous_orders").alias("orders"),
        F.lit(0).cast("bigint").alias("users"),
        F.lit(0).cast("bigint").alias("items_sold"),
        F.lit(0).cast("bigint").alias("products_added"),
        F.col("previous_cancelled_orders").alias("offers_cancelled"),
    )


def delivery_summary(orders: DataFrame, as_of, days: int) -> DataFrame:
    """A10 + A11: bucket counts since the period start and the delivery rate."""
    s = order_period_stats(orders, as_of, days)
    den = (F.col("delivered_orders") + F.col("shipping_orders")
           + F.col("pending_orders") + F.col("failed_orders"))
    return s.select(
        F.col("delivered_orders").alias("delivered"),
        F.col("shipping_orders").alias("shipping"),
        F.col("pending_orders").alias("pending"),
        F.col("failed_orders").alias("failed"),
        F.col("cancelled_since_start").alias("cancelled"),
        F.when(den > 0, F.col("delivered_orders").cast("double") * F.lit(100.0) / den.cast("double"))
         .otherwise(F.lit(0.0)).alias("rate"),
    )


def user_growth(users: DataFrame, as_of, days: int) -> DataFrame:
    """A3: users created since the period start, and all users."""
    start = period_start(as_of, days).cast("timestamp_ntz")
    return users.select("created_at").agg(
        _cnt(F.col("created_at") >= start).alias("new_users"),
        F.count(F.lit(1)).alias("total_users"))


def offer_activity(offers: DataFrame, as_of, days: int) -> DataFrame:
    """A4: offers created in the period, and those among them withdrawn."""
    start = period_start(as_of, days).cast("timestamp_ntz")
    since = F.col("created_at") >= start
    return offers.select("created_at", "status").agg(
        _cnt(since).alias("products_added"),
        _cnt(since & status_key("status").isin(OFFER_WITHDRAWN)).alias("offers_cancelled"))


def items_sold(order_items: DataFrame | None, orders: DataFrame, as_of, days: int,
               spark: SparkSession | None = None) -> DataFrame:
    """A5: quantity sold on not-cancelled orders since the period start.

    No upper bound.  The orders side is filtered first
    (pushed to the scan); the join is a semi join on the order key, so Spark
    may build a runtime bloom filter to cut the order-line side before the
    shuffle.  A missing order-lines table yields 0.
    """
    if order_items is None:
        spark = spark or orders.sparkSession
        return spark.range(1).select(F.lit(0).cast("bigint").alias("items_sold"))
    start = period_start(as_of, days).cast("timestamp_ntz")
    keep = (orders.where((F.col("created_at") >= start) & not_cancelled())
            .select(F.col("id").alias("order_id")))
    return (order_items.select("order_id", "quantity")
            .join(keep, "order_id", "left_semi")
            .agg(F.coalesce(F.sum("quantity").cast("bigint"), F.lit(0).cast("bigint")).alias("items_sold")))


def daily_new_users(users: DataFrame, as_of, days: int) -> DataFrame:
    """Users per creation date since the period start (no upper bound)."""
    start = period_start(as_of, days).cast("timestamp_ntz")
    return (users.where(F.col("created_at") >= start)
            .groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count(F.lit(1)).alias("users")))


def daily_orders(orders: DataFrame, as_of, days: int, upper_bound: bool = True) -> DataFrame:
    """Per-day order measures since the period start.

    With ``upper_bound`` the days after ``as_of`` are dropped at the scan: the
    date spine would drop them anyway, and the result then has at most
    ``days`` rows, which makes it a proven-small join side.
    """
    start = period_start(as_of, days).cast("timestamp_ntz")
    cond = F.col("created_at") >= start
    if upper_bound:
        cond = cond & (F.col("created_at") < day_after(as_of))
    k = status_key("status")
    return (orders.where(cond)
            .groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 _sum_if(not_cancelled(), "total").alias("revenue"),
                 _cnt(k == CANCELLED).alias("cancelled_orders"),
                 _cnt(k.isin(DELIVERED)).alias("delivered_orders"),
                 _cnt(k.isin(SHIPPING)).alias("shipping_orders")))


def daily_timeline(spark: SparkSession, orders: DataFrame, users: DataFrame | None,
                   as_of, days: int) -> DataFrame:
    """A6 + J2 + J3: gap-filled daily series of the period, with new users.

    Both per-day aggregates are bounded to the spine's days before the join,
    so each side holds at most ``days`` (<= 365) rows; the broadcast hint is
    backed by that bound.
    """
    spine = date_spine(spark, as_of, days)
    daily = daily_orders(orders, as_of, days, upper_bound=True)
    out = spine.join(F.broadcast(daily), "date", "left")
    if users is not None:
        nu = (users.where((F.col("created_at") >= period_start(as_of, days).cast("timestamp_ntz"))
                          & (F.col("created_at") < day_after(as_of)))
              .groupBy(F.to_date("created_at").alias("date"))
              .agg(F.count(F.lit(1)).alias("new_users")))
        out = out.join(F.broadcast(nu), "date", "left")
    else:
        out = out.withColumn("new_users", F.lit(None).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "date",
        F.coalesce("orders", zero).alias("orders"),
        F.coalesce("revenue", _zero()).alias("revenue"),
        F.coalesce("cancelled_orders", zero).alias("cancelled_orders"),
        F.coalesce("delivered_orders", zero).alias("delivered_orders"),
        F.coalesce("shipping_orders", zero).alias("shipping_orders"),
        F.coalesce("new_users", zero).alias("new_users"),
    ).orderBy("date")


def dashboard_activity(spark: SparkSession, orders: DataFrame, as_of, days: int) -> DataFrame:
    """Orders and revenue per day; raw ``status != 'cancelled'`` drops NULL."""
    start = period_start(as_of, days).cast("timestamp_ntz")
    daily = (orders.where((F.col("created_at") >= start) & (F.col("created_at") < day_after(as_of))
                          & (F.col("status") != F.lit(CANCELLED)))
             .groupBy(F.to_date("created_at").alias("date"))
             .agg(F.count(F.lit(1)).alias("orders"),
                  F.coalesce(F.sum("total"), _zero()).cast(MONEY_SUM).alias("revenue")))
    return (date_spine(spark, as_of, days).join(F.broadcast(daily), "date", "left")
            .select("date", F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"),
                    F.coalesce("revenue", _zero()).alias("revenue"))
            .orderBy("date"))


def dashboard_totals(orders: DataFrame, users: DataFrame, offers: DataFrame) -> DataFrame:
    """Four one-row totals side by side (one-row cross joins only)."""
    o = orders.select("status", "total").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.coalesce(F.sum(F.when(F.col("status") != F.lit(CANCELLED), F.col("total"))), _zero())
         .cast(MONEY_SUM).alias("revenue"))
    u = users.select(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("total_users"))
    f = offers.select(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("total_offers"))
    return o.crossJoin(u).crossJoin(f).select("total_orders", "total_users", "total_offers", "revenue")


def category_performance(offers: DataFrame, categories: DataFrame | None, top: int = 10,
                         fallback: str = "Sans catégorie") -> DataFrame:
    """List value of offers per category name, top ``top``.

    "revenue" is the sum of ``price`` of offers whose status is not cancelled
    (list value, not sales), over all offers.  Offers are
    pre-aggregated per ``category_id`` before the join, so the join sees one
    row per category id whatever the size of the offers table.  Without a
    ``category_id`` column (or categories table) the report is empty.
    """
    schema = "name string, revenue decimal(24,2), offers bigint"
    if not has_cols(offers, "category_id") or categories is None:
        return offers.sparkSession.createDataFrame([], schema)
    price = "price" if "price" in offers.columns else "new_price"
    per_id = (offers.groupBy("category_id")
              .agg(_sum_if(not_cancelled(), price).alias("revenue"),
                   F.count("id").alias("offers")))
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("cname"))
    joined = per_id.join(cats, "category_id", "left")
    return (joined.groupBy("cname")
            .agg(F.coalesce(F.sum("revenue"), _zero()).cast(MONEY_SUM).alias("revenue"),
                 F.sum("offers").cast("bigint").alias("offers"))
            .orderBy(F.col("revenue").desc_nulls_first(), F.col("cname").asc_nulls_last())
            .limit(top)
            .select(F.coalesce("cname", F.lit(fallback)).alias("name"), "revenue", "offers"))


def _recent(orders: DataFrame, k: int) -> DataFrame:
    return orders.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(k)


def _order_ref(orders: DataFrame):
    ref = F.col("id").cast("string")
    if "reference" in orders.columns:
        ref = F.coalesce(F.nullif(F.col("reference"), F.lit("")), ref)
    return ref


def recent_orders(orders: DataFrame, k: int = 12) -> DataFrame:
    """O3: latest ``k`` orders with a reference and a customer label."""
    return _recent(orders, k).select(
        "id", _order_ref(orders).alias("reference"),
        person_label("first_name", "last_name").alias("customer"),
        "total", "status", "created_at")


def dashboard_recent_orders(orders: DataFrame, k: int = 6) -> DataFrame:
    """O3 (dashboard): latest ``k`` orders keyed by reference."""
    return _recent(orders, k).select(
        _order_ref(orders).alias("id"),
        person_label("first_name", "last_name").alias("customer"),
        "total", "status", "created_at")


def dashboard_recent_users(users: DataFrame, k: int = 6) -> DataFrame:
    """O3 (dashboard): latest ``k`` users with label defaults."""
    return (users.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()).limit(k)
            .select("id",
                    F.coalesce(F.nullif(F.col("full_name"), F.lit("")), F.lit("Utilisateur")).alias("full_name"),
                    F.coalesce(F.col("email"), F.lit("")).alias("email"),
                    "created_at"))


USER_COLUMNS = {"id": "bigint", "full_name": "string", "phone": "string", "email": "string",
                "role": "string", "profile_image": "string", "is_active": "boolean",
                "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}


def users_list(users: DataFrame) -> DataFrame:
    """The nine public user columns, newest first."""
    return (with_columns_or_null(users, USER_COLUMNS)
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id").desc()))


def sales_report(spark: SparkSession, orders, users, offers, order_items, categories,
                 as_of, period=None) -> dict[str, DataFrame]:
    """The whole analytics document as named DataFrames."""
    from ..functions.exprs import clamp_days
    days = clamp_days(period, 7, 365)
    return {
        "overview": sales_overview(orders, as_of, days),
        "previous": sales_previous(orders, as_of, days),
        "users": user_growth(users, as_of, days),
        "offers": offer_activity(offers, as_of, days),
        "items_sold": items_sold(order_items, orders, as_of, days, spark),
        "timeline": daily_timeline(spark, orders, users, as_of, days),
        "categories": category_performance(offers, categories),
        "delivery": delivery_summary(orders, as_of, days),
        "recent_orders": recent_orders(orders),
    }
