"""Stock: invoice batches checked against stock, decrements, alert resolution.

A web shop checks and decrements stock invoice by invoice.  Decrements are
clamped at 0 (``GREATEST(q - n, 0)``) and, with decrements only, repeated
clamping equals one clamp of the sum, so the stock an invoice sees is
``greatest(q0 - demand of earlier invoices, 0)``: a running sum per offer.
The running sum is computed in two levels -- totals per offer and key range
with a prefix over the ranges, plus a running sum inside each range -- so an
offer that appears on a huge share of invoices is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import as_of_ts, js_or_num, js_or_str
from .common import asc, global_position, range_bucket

STATUS_SHORT = "stock_insuffisant"
STATUS_OK = "verified"
DEFAULT_PRODUCT = "Produit"
DEFAULT_PAYMENT = "Espèces"


def requested_qty(q="quantity") -> Column:
    """max(1, Number(q) || 1)."""
    return F.greatest(F.lit(1), js_or_num(F.col(q) if isinstance(q, str) else q, 1))


def valid_invoice_lines(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Lines of invoices whose every product exists (one unknown product
    refuses the whole invoice, which then takes no stock)."""
    known = offers.select(F.col("id").alias("offer_id"))
    bad = items.join(known, "offer_id", "left_anti").select("invoice_id").distinct()
    return items.join(bad, "invoice_id", "left_anti")


def _prior_demand(g: DataFrame, lines: DataFrame, order_ts: str = "created_at", ranges: int = 1024) -> DataFrame:
    """Add ``prior``: demand of earlier invoices of the same offer.

    ``g`` is at (offer_id, invoice_id) grain with ``demand`` and the invoice
    time.  Invoices are ordered by (time, invoice_id).  The rows fall into
    key ranges of (offer, time, invoice) of about equal size; an offer's demand before a range
    is a running sum over its ranges (at most ``ranges`` rows), the rest a running
    sum inside the range.  An offer on a third of a day's invoices thus
    spreads over a third of the ranges.
    """
    order = [asc("offer_id"), asc(order_ts), asc("invoice_id")]
    g = range_bucket(g, order, ranges, "_range", keys=lines.select("offer_id", order_ts, "invoice_id"))
    blocks = g.groupBy("offer_id", "_range").agg(F.sum("demand").alias("_bt"))
    blocks = blocks.select("offer_id", "_range", (F.sum("_bt").over(W.partitionBy("offer_id").orderBy("_range")) - F.col("_bt")).alias("_before"))
    inner = W.partitionBy("_range", "offer_id").orderBy(order_ts, "invoice_id").rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("_in", F.sum("demand").over(inner) - F.col("demand"))
    return (g.join(blocks, ["offer_id", "_range"]).withColumn("prior", (F.col("_before") + F.col("_in")).cast("bigint"))
            .drop("_range", "_before", "_in"))


def invoice_stock_check(items: DataFrame, offers: DataFrame, order_ts: str = "created_at") -> DataFrame:
    """Every line of the valid invoices with ``requested``,
    ``available`` (stock before its invoice, clamped), ``alert`` and
    ``missing`` (NULL without alert).  All lines of one invoice for one offer
    see the same stock.  ``items`` carries the invoice time ``order_ts``.
    """
    return _stock_seen(valid_invoice_lines(items, offers), offers, items, order_ts)


def _stock_seen(lines: DataFrame, offers: DataFrame, items: DataFrame, order_ts: str = "created_at") -> DataFrame:
    """The lines of admitted invoices with the stock each sees; ``items``: the table they come from."""
    lines = lines.withColumn("requested", requested_qty("quantity"))
    g = lines.groupBy("offer_id", "invoice_id", order_ts).agg(F.sum("requested").alias("demand"))
    g = _prior_demand(g, items, order_ts).select("offer_id", "invoice_id", "prior")
    stock = offers.select(F.col("id").alias("offer_id"), F.col("quantity").alias("_q0"),
                          F.col("product_name").alias("offer_product_name"))
    return (lines.join(g, ["offer_id", "invoice_id"]).join(stock, "offer_id")
            .withColumn("available", F.greatest(F.coalesce("_q0", F.lit(0)) - F.col("prior"), F.lit(0)).cast("bigint"))
            .withColumn("alert", F.col("requested") > F.col("available"))
            .withColumn("missing", F.when(F.col("alert"), F.col("requested") - F.col("available")))
            .drop("_q0", "prior"))


def alert_note(product: Column, available: Column, requested: Column, missing: Column) -> Column:
    """Text of one shortage alert (fixed wording of the admin note)."""
    return F.format_string(
        "⚠️ Stock insuffisant — %s : %s disponible(s), %s demandé(s), manque %s. Stock final : 0.",
        product, available.cast("string"), requested.cast("string"), missing.cast("string"))


def invoice_stock_headers(checked: DataFrame, line_order: list) -> DataFrame:
    """M9 header fields per valid invoice: alert array (line order), admin
    note (one line per alert, joined by newline), stock status, resolved flag.

    One grouped aggregate; only the lines with an alert are collected.
    """
    alert = F.struct(*[F.col(c) for c in line_order], F.struct(
        F.col("offer_id").alias("offerId"), F.col("offer_product_name").alias("productName"),
        F.col("requested").cast("int").alias("requested"), F.col("available").cast("int").alias("available"),
        F.col("missing").cast("int").alias("missing"), F.lit(False).alias("resolved")).alias("_a"))
    h = checked.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.when(F.col("alert"), alert))).alias("_l"))
    h = h.select("invoice_id", F.transform("_l", lambda x: x["_a"]).alias("stock_alerts"))
    note = F.array_join(F.transform("stock_alerts", lambda x: alert_note(
        x["productName"], x["available"], x["requested"], x["missing"])), "\n")
    has = F.size("stock_alerts") > 0
    return h.select("invoice_id",
                    F.when(has, F.lit(STATUS_SHORT)).otherwise(F.lit(STATUS_OK)).alias("stock_status"),
                    "stock_alerts", F.size("stock_alerts").alias("n_alerts"),
                    F.when(has, note).alias("admin_note"),
                    (~has).alias("stock_alert_resolved"), F.lit("confirmed").alias("status"))


def invoice_admission(requests: DataFrame, items: DataFrame, offers: DataFrame, existing: DataFrame | None = None,
                      order: tuple = ("created_at", "invoice_id")) -> DataFrame:
    """M9, first stage: the requests that may become invoices, decided before any stock is looked at.

    A request needs a number and lines, every product must exist, and its number must
    not be taken: not by an ``existing`` invoice, nor by an earlier request of the batch that is
    itself admitted (the first otherwise valid one per number wins).  Refused requests take no stock.
    """
    r = requests.where(F.coalesce(F.col("number"), F.lit("")) != "")
    r = r.join(items.select("invoice_id").distinct(), "invoice_id", "left_semi")
    unknown = items.join(offers.select(F.col("id").alias("offer_id")), "offer_id", "left_anti").select("invoice_id").distinct()
    r = r.join(unknown, "invoice_id", "left_anti")
    if existing is not None:
        r = r.join(existing.select(F.col("invoice_number").alias("number")), "number", "left_anti")
    first = r.groupBy("number").agg(F.min(F.struct(*order)).alias("_first"))
    return r.join(first, "number").where(F.struct(*order) == F.col("_first")).drop("_first").select(*requests.columns)


def invoice_create(requests: DataFrame, items: DataFrame, offers: DataFrame, existing: DataFrame,
                   line_order: list, default_payment: str = DEFAULT_PAYMENT) -> tuple[DataFrame, DataFrame]:
    """M9: invoices of a batch: (headers, checked lines).

    Admission first (:func:`invoice_admission`), then the stock check among
    the admitted ones only, then header fields: numbers ``Number(x) || 0``, texts
    ``x || null``, payment ``x || default_payment``; ids follow the highest
    existing id in batch order.
    """
    ok = invoice_admission(requests, items, offers, existing)
    checked = _stock_seen(items.join(ok.select("invoice_id"), "invoice_id", "left_semi"), offers, items)
    h = ok.join(invoice_stock_headers(checked, line_order), "invoice_id")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    h = global_position(h, [asc("created_at"), asc("invoice_id")], keys=requests).crossJoin(top)
    money = {c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(14,2)").alias(c)
             for c in ("subtotal", "discount", "total", "amount_received", "change_amount")}
    texts = {c: F.nullif(c, F.lit("")).alias(c) for c in ("customer_name", "customer_phone", "customer_address", "note")}
    h = h.select((F.col("_max") + F.col("_pos") + 1).alias("id"), "invoice_id", F.col("number").alias("invoice_number"),
                 *[texts[c] for c in ("customer_name", "customer_phone", "customer_address")], *money.values(),
                 js_or_str("payment_method", default_payment).alias("payment_method"), texts["note"], "admin_note", "stock_status",
                 "stock_alerts", "stock_alert_resolved", "status", "created_at")
    return h, checked


def invoice_items_priced(items: DataFrame, name_col: str = "name",
                         price_col: str = "unit_price") -> DataFrame:
    """M9 lines: quantity max(1, q||1), unit price max(0, p||0), total = p x q,
    name || 'Produit'."""
    q = requested_qty("quantity")
    p = F.greatest(F.lit(0), js_or_num(F.col(price_col), 0))
    out = items.withColumn("quantity", q).withColumn(price_col, p) \
        .withColumn("total_price", (F.col(price_col) * F.col("quantity")).cast("decimal(24,2)"))
    if name_col in items.columns:
        out = out.withColumn("product_name", F.coalesce(F.nullif(name_col, F.lit("")),
                                                        F.lit(DEFAULT_PRODUCT)))
    return out


def stock_after_invoices(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers after all valid invoices: ``greatest(q - total, 0)`` for
    offers on an invoice (NULL stock becomes 0), unchanged otherwise."""
    lines = valid_invoice_lines(items, offers).withColumn("requested", requested_qty("quantity"))
    tot = lines.groupBy("offer_id").agg(F.sum("requested").alias("_t"))
    o = offers.join(tot, offers["id"] == tot["offer_id"], "left")
    return o.select(*[F.when(F.col("_t").isNotNull(),
                             F.greatest(F.col("quantity") - F.col("_t"), F.lit(0)).cast(
                                 offers.schema["quantity"].dataType))
                      .otherwise(F.col("quantity")).alias("quantity")
                      if c == "quantity" else offers[c] for c in offers.columns])


def stock_alert_resolution(invoices: DataFrame, offers: DataFrame, now) -> DataFrame:
    """Invoices with unresolved, non-empty alerts whose every
    alert is covered (offer exists and current stock >= missing) become
    resolved at ``now``, with each alert marked resolved.

    One pass: alerts are exploded with their place, joined to the stock once, and one
    grouped aggregate puts each invoice together again (row, alerts in order, all covered).
    """
    keep = [c for c in invoices.columns if c not in ("id", "stock_alerts")]
    ex = invoices.select("id", F.struct(*keep).alias("_row"), F.col("stock_alerts").isNull().alias("_none"),
                         F.posexplode_outer("stock_alerts").alias("_pos", "_a"))
    cur = offers.select(F.col("id").alias("_oid"), F.col("quantity").alias("_q"))
    covered = F.coalesce(F.col("_oid").isNotNull() & (F.coalesce(F.col("_q"), F.lit(0)) >= F.col("_a.missing")), F.lit(False))
    g = (ex.join(cur, F.col("_a.offerId") == F.col("_oid"), "left").groupBy("id")
         .agg(F.first("_row").alias("_row"), F.first("_none").alias("_none"), F.bool_and(covered).alias("_ok"),
              F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_a")))).alias("_l")))
    g = g.withColumn("_done", F.col("_ok") & (F.size("_l") > 0) & ~F.coalesce(F.col("_row.stock_alert_resolved"), F.lit(False)))
    done = F.col("_done")
    cols = {"id": F.col("id")} | {c: F.col("_row")[c] for c in keep}
    cols["stock_alerts"] = F.when(~F.col("_none"), F.transform("_l", lambda x: x["_a"].withField(
        "resolved", F.when(done, F.lit(True)).otherwise(x["_a"]["resolved"]))))
    cols["stock_alert_resolved"] = F.when(done, F.lit(True)).otherwise(F.col("_row.stock_alert_resolved"))
    old = F.col("_row.stock_alert_resolved_at") if "stock_alert_resolved_at" in keep else F.lit(None).cast("timestamp_ntz")
    cols["stock_alert_resolved_at"] = F.when(done, as_of_ts(now)).otherwise(old)
    order = invoices.columns + [c for c in cols if c not in invoices.columns]
    return g.select(*[cols[c].alias(c) for c in order])


def stock_after_events(offers: DataFrame, demand: DataFrame, sets: DataFrame) -> DataFrame:
    """M10 + M14: stock after clamped decrements mixed with absolute sets.

    ``demand``: offer_id, ts, requested (decrements); ``sets``: offer_id, ts,
    event_id, quantity (absolute ``SET quantity``).  An absolute set starts a
    new segment and, with only decrements inside a segment, repeated clamping
    is one clamp of the sum: the final stock is
    ``greatest(last set (else q0) - decrements after it, 0)``, with NULL
    stock read as 0 once decremented.  Aggregates only (partial aggregation,
    no window over an offer), so a hot offer is no single task.  A set and a
    decrement at the same instant: the set is applied first.
    """
    last = (sets.groupBy("offer_id")
            .agg(F.max_by(F.struct("quantity"), F.struct("ts", "event_id")).alias("_s"),
                 F.max("ts").alias("_set_ts")))
    d = demand.join(last.select("offer_id", "_set_ts"), "offer_id", "left") \
        .where(F.col("_set_ts").isNull() | (F.col("ts") >= F.col("_set_ts")))
    dec = d.groupBy("offer_id").agg(F.sum("requested").alias("_dec"))
    o = offers.join(last, offers["id"] == last["offer_id"], "left").drop("offer_id") \
        .join(dec, offers["id"] == dec["offer_id"], "left").drop("offer_id")
    start = F.when(F.col("_set_ts").isNotNull(), F.col("_s.quantity")).otherwise(F.col("quantity"))
    new_q = F.when(F.col("_dec").isNotNull(), F.greatest(start - F.col("_dec"), F.lit(0))).otherwise(start)
    return o.select(*[new_q.cast(offers.schema["quantity"].dataType).alias("quantity") if c == "quantity"
                      else F.col(c) for c in offers.columns])
