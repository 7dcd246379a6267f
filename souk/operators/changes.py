"""Batches of changes applied to table snapshots: ``apply(base, changes) -> new``.

Four generic patterns carry almost every write:
:func:`upsert_agg` (additive merge), :func:`insert_if_absent`,
:func:`latest_wins` (keyed overwrite, last change by time wins) and
:func:`anti_delete`.  Each instance below adds its own validation filter.
No mutable table and no per-row loop: joins, windows and aggregates only;
new ids come from :func:`global_position` (distributed), never from a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import (WRITABLE_ORDER_STATUSES, as_of_date, as_of_ts, blank_to_null,
                               js_or_num, js_or_str, js_trim, not_expired, reference_number)
from ..functions.quality import generated_image_allowed, is_email, normalize_phone
from .catalog import DEFAULT_IMAGE, main_image
from .common import asc, global_position
from .graph import connected_components

MAX_LINE_QTY = 100
MAX_IMAGES = 8


def _desc(order):
    return [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in order]


def _asc(order):
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


# ---------------------------------------------------------------------------
# Generic patterns
# ---------------------------------------------------------------------------
def latest_per_key(chg: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last change per key (``order`` ascending = application order)."""
    w = W.partitionBy(*keys).orderBy(*_desc(order))
    return chg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def first_per_key(chg: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*_asc(order))
    return chg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert_agg(base: DataFrame, chg: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Union of base and changes, folded per key with ``aggs`` (partial agg)."""
    return base.unionByName(chg, allowMissingColumns=True).groupBy(*keys).agg(*aggs)


def insert_if_absent(base: DataFrame, chg: DataFrame, keys: list[str], order: list) -> DataFrame:
    """ON CONFLICT DO NOTHING: first change per key, only for keys not in base."""
    new = first_per_key(chg, keys, order).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(new.select(*base.columns))


def latest_wins(base: DataFrame, chg: DataFrame, keys: list[str], order: list,
                columns: dict[str, Column | str]) -> DataFrame:
    """Keyed overwrite of existing rows; ``columns`` maps a base column to the
    change column (or expression over ``chg`` columns, prefixed ``c_``)."""
    last = latest_per_key(chg, keys, order)
    last = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                       *[F.col(c).alias(f"c_{c}") for c in chg.columns if c not in keys],
                       F.lit(True).alias("_hit"))
    cond = None
    for k in keys:
        c = base[k] == last[f"_k_{k}"]
        cond = c if cond is None else cond & c
    j = base.join(last, cond, "left")
    out = []
    for c in base.columns:
        if c in columns:
            v = columns[c]
            v = F.col(f"c_{v}") if isinstance(v, str) else v
            out.append(F.when(F.col("_hit"), v).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def anti_delete(base: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE ... WHERE key IN (batch): a left anti join."""
    return base.join(deletes.select(*keys).dropDuplicates(), keys, "left_anti")


# ---------------------------------------------------------------------------
# Cart and favourites (M1-M5)
# ---------------------------------------------------------------------------
def _valid_line(offer="offer_id", qty="quantity") -> Column:
    return (F.col(offer).isNotNull() & (F.col(offer) > 0) & F.col(qty).isNotNull()
            & (F.col(qty) >= 1) & (F.col(qty) <= MAX_LINE_QTY))


def cart_upsert(cart: DataFrame, adds: DataFrame, offers: DataFrame) -> DataFrame:
    """M1: add ``quantity`` (default 1) of an active offer to (cart, offer).

    Invalid requests (quantity outside 1..100, bad offer id, offer not
    active) are dropped; existing lines grow, the sum is not capped.  Lines
    with a NULL offer are outside the unique key and never merged.
    Columns: cart_id, offer_id, quantity, created_at, updated_at.
    """
    a = adds.withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    a = a.where(_valid_line()).join(
        offers.where(F.col("status") == F.lit("active")).select(F.col("id").alias("offer_id")),
        "offer_id", "left_semi")
    add = a.groupBy("cart_id", "offer_id").agg(F.sum("quantity").alias("_add"),
                                               F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    keyed = cart.where(F.col("offer_id").isNotNull())
    merged = (keyed.join(add, ["cart_id", "offer_id"], "full")
              .select("cart_id", "offer_id",
                      (F.coalesce("quantity", F.lit(0)) + F.coalesce("_add", F.lit(0))).cast("int").alias("quantity"),
                      # least/greatest: batches applied out of time order give the same row
                      F.least("created_at", "_first").alias("created_at"),
                      F.greatest("_last", "updated_at").alias("updated_at")))
    return merged.unionByName(cart.where(F.col("offer_id").isNull())
                              .select("cart_id", "offer_id", "quantity", "created_at", "updated_at"))


def cart_set_quantity(cart: DataFrame, sets: DataFrame) -> DataFrame:
    """M2: absolute quantity 1..100 on existing lines; last set wins."""
    s = sets.where(_valid_line()).select("cart_id", "offer_id", "quantity", "ts", "event_id")
    return latest_wins(cart, s, ["cart_id", "offer_id"], ["ts", "event_id"],
                       {"quantity": "quantity", "updated_at": "ts"})


def cart_delete(cart: DataFrame, deletes: DataFrame, by_owner: bool = False) -> DataFrame:
    """M3: remove (cart, offer) lines, or whole carts with ``by_owner``."""
    return anti_delete(cart, deletes, ["cart_id"] if by_owner else ["cart_id", "offer_id"])


def cart_touch(carts: DataFrame, touches: DataFrame) -> DataFrame:
    """M4: one cart per user; touching sets ``updated_at``, new users get a
    new cart id (max id + position among new users by first touch)."""
    t = touches.groupBy("user_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    known = (carts.join(t, "user_id", "left")
             .select("id", "user_id", F.coalesce("_last", "updated_at").alias("updated_at")))
    new = t.join(carts.select("user_id"), "user_id", "left_anti")
    top = carts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    new = global_position(new, [asc("_first"), asc("user_id")], keys=touches.select(F.col("ts").alias("_first"), "user_id"))
    new = new.crossJoin(top).select((F.col("_max") + F.col("_pos") + 1).alias("id"), "user_id",
                                    F.col("_last").alias("updated_at"))
    return known.unionByName(new)


def favorites_add(favorites: DataFrame, adds: DataFrame) -> DataFrame:
    """M5: ON CONFLICT (user, offer) DO NOTHING; the first add of a batch wins."""
    a = adds.where(F.col("offer_id").isNotNull() & (F.col("offer_id") != 0))
    return insert_if_absent(favorites, a.select(*favorites.columns, "event_id"),
                            ["user_id", "offer_id"], ["created_at", "event_id"])


def favorites_added(favorites: DataFrame, adds: DataFrame) -> DataFrame:
    """M5, the answer to each add: ``added`` is true for the first add of a (user, offer) not in the list yet."""
    a = adds.where(F.col("offer_id").isNotNull() & (F.col("offer_id") != 0))
    rank = F.row_number().over(W.partitionBy("user_id", "offer_id").orderBy("created_at", "event_id"))
    old = favorites.select("user_id", "offer_id", F.lit(True).alias("_old")).distinct()
    return (a.withColumn("_rn", rank).join(old, ["user_id", "offer_id"], "left")
            .withColumn("added", (F.col("_rn") == 1) & F.col("_old").isNull()).drop("_rn", "_old"))


def favorites_delete(favorites: DataFrame, deletes: DataFrame, by_owner: bool = False) -> DataFrame:
    return anti_delete(favorites, deletes, ["user_id"] if by_owner else ["user_id", "offer_id"])


# ---------------------------------------------------------------------------
# Orders (M6-M8, A19, A21, C7)
# ---------------------------------------------------------------------------
def _number_orders(headers: DataFrame, orders: DataFrame, order: list, as_of,
                   prefix: str, keys: DataFrame) -> DataFrame:
    top = orders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    h = global_position(headers, order, keys=keys).crossJoin(top)
    h = h.withColumn("id", F.col("_max") + F.col("_pos") + 1).drop("_max", "_pos")
    return h.withColumn("reference", reference_number(prefix, F.year(as_of_date(as_of)), F.col("id")))


def _price_lines(lines: DataFrame) -> DataFrame:
    q = js_or_num(F.col("quantity"), 1)
    return lines.withColumn("_amount", F.coalesce("unit_price", F.lit(0)) * q)


HEADER_TEXTS = ("first_name", "last_name", "phone", "email", "delivery_method", "address", "city", "district", "payment_method")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def valid_headers(headers: DataFrame) -> DataFrame:
    """Order headers that pass validation: first and last name, phone, delivery
    and payment method given (not empty, untrimmed); home delivery needs
    address and city."""
    ok = F.lit(True)
    for c in ("first_name", "last_name", "phone", "delivery_method", "payment_method"):
        ok = ok & (_text(c) != "")
    return headers.where(ok & ((F.col("delivery_method") != "home") | ((_text("address") != "") & (_text("city") != ""))))


def _orders_from(lines: DataFrame, headers: DataFrame | None, key: str, orders: DataFrame, as_of, prefix: str, keys: DataFrame) -> DataFrame:
    """Numbered order rows, one per ``key`` with lines: header texts (address parts for home delivery
    only, ``email || null``, ``district || null``), sums, status pending."""
    h = lines.groupBy(key).agg(F.sum("_amount").cast("decimal(24,2)").alias("subtotal"))
    if headers is not None:
        h = h.join(headers.select(key, *HEADER_TEXTS), key)
        home = F.col("delivery_method") == "home"
        h = h.withColumns({c: F.when(home, F.col(c)) for c in ("address", "city")}
                          | {"district": F.when(home, F.nullif("district", F.lit(""))), "email": F.nullif("email", F.lit(""))})
    h = _number_orders(h, orders, [asc(key)], as_of, prefix, keys)
    return h.select("id", key, "reference", *(HEADER_TEXTS if headers is not None else ()), "subtotal",
                    F.lit(0).cast("decimal(24,2)").alias("delivery_price"), F.col("subtotal").alias("total"),
                    F.lit("pending").alias("status"), as_of_ts(as_of).alias("created_at"))


def order_place_guest(requests: DataFrame, offers: DataFrame, images: DataFrame, orders: DataFrame,
                      as_of, headers: DataFrame | None = None, prefix: str = "REF",
                      default_image: str = DEFAULT_IMAGE) -> tuple[DataFrame, DataFrame]:
    """M6: guest orders from item requests (``request_id, offer_id, quantity``
    and a line order column ``line_no``) and their ``headers`` (one row per request).

    A request is refused whole when its header is invalid or missing, a line
    is invalid (offer id <= 0, quantity outside 1..100) or one of its offers
    is not active.  Lines copy name and price at order time and the main
    image; subtotal = sum(price or 0 x quantity), delivery 0.  Accepted
    requests are numbered after the highest order id, in request order.
    Returns (orders, order_items).
    """
    r = requests
    bad_line = r.where(~F.coalesce(_valid_line(), F.lit(False))).select("request_id")
    active = offers.where(F.col("status") == F.lit("active"))
    missing = r.join(active.select(F.col("id").alias("offer_id")), "offer_id", "left_anti").select("request_id")
    refused = bad_line.unionByName(missing).distinct()
    if headers is not None:
        headers = valid_headers(headers)
        r = r.join(headers.select("request_id"), "request_id", "left_semi")
    ok = r.join(refused, "request_id", "left_anti")
    mi = main_image(offers, images, default_image)
    lines = (ok.join(active.select(F.col("id").alias("offer_id"), "product_name",
                                   F.col("new_price").alias("unit_price")), "offer_id")
             .join(mi, "offer_id", "left"))
    lines = _price_lines(lines)
    h = _orders_from(lines, headers, "request_id", orders, as_of, prefix, requests.select("request_id"))
    items = (lines.join(h.select(F.col("id").alias("order_id"), "request_id"), "request_id")
             .select("order_id", "line_no", "offer_id", "product_name", "quantity", "unit_price",
                     "image_url"))
    return h, items


def order_place_user(cart: DataFrame, carts: DataFrame, offers: DataFrame, images: DataFrame,
                     orders: DataFrame, as_of, headers: DataFrame | None = None, prefix: str = "REF",
                     default_image: str = DEFAULT_IMAGE) -> tuple[DataFrame, DataFrame]:
    """M7: one order per user from the user's cart (no active check), for users
    with a valid header (``headers``: one row per ``user_id``).

    Basket = cart lines joined to offers (inner: lines of deleted offers
    vanish) in the order they were put in; quantities are taken as stored.
    Returns (orders, order_items).
    """
    mi = main_image(offers, images, default_image)
    owners = carts.select(F.col("id").alias("cart_id"), "user_id")
    if headers is not None:
        headers = valid_headers(headers)
        owners = owners.join(headers.select("user_id"), "user_id", "left_semi")
    lines = (cart.join(owners, "cart_id")
             .join(offers.select(F.col("id").alias("offer_id"), "product_name",
                                 F.col("new_price").alias("unit_price")), "offer_id")
             .join(mi, "offer_id", "left"))
    lines = _price_lines(lines)
    h = _orders_from(lines, headers, "user_id", orders, as_of, prefix, carts.select("user_id"))
    in_cart = W.partitionBy("user_id").orderBy(F.col("created_at").asc_nulls_last(), "offer_id")
    items = (lines.withColumn("line_no", F.row_number().over(in_cart))
             .join(h.select(F.col("id").alias("order_id"), "user_id"), "user_id")
             .select("order_id", "line_no", "offer_id", "product_name", "quantity", "unit_price", "image_url"))
    return h, items


def order_status_apply(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """M8: only the six writable statuses (exact spelling); last change per
    order wins and sets ``updated_at``; unknown orders are unaffected."""
    c = changes.where(F.col("status").isin(WRITABLE_ORDER_STATUSES))
    base = orders if "updated_at" in orders.columns else \
        orders.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return latest_wins(base, c.withColumnRenamed("order_id", "id"), ["id"], ["ts", "event_id"],
                       {"status": "status", "updated_at": "ts"})


def reference_numbers(df: DataFrame, as_of, prefix: str = "REF", key: str = "id") -> DataFrame:
    """``PREFIX-YYYY-000123`` for every row (year of ``as_of``)."""
    return df.select(key, reference_number(prefix, F.year(as_of_date(as_of)), F.col(key)).alias("reference"))


# ---------------------------------------------------------------------------
# Offers and images
# ---------------------------------------------------------------------------
def offer_defaults(requests: DataFrame, as_of, prefix: str = "REF", ai_path: bool = False) -> DataFrame:
    """Accepted create requests with defaults and reference.

    Required (truthy, untrimmed): product_name, category, description,
    new_price.  ``old_price || null``, ``discount || null`` (AI path: 0),
    ``quantity || 1``, ``status || 'active'``.
    """
    ok = (F.coalesce(F.col("product_name"), F.lit("")) != "") & (F.coalesce(F.col("category"), F.lit("")) != "") \
        & (F.coalesce(F.col("description"), F.lit("")) != "") & F.col("new_price").isNotNull() \
        & (F.col("new_price") != 0)
    r = requests.where(ok)
    def opt(c, typ):
        return F.col(c) if c in r.columns else F.lit(None).cast(typ)
    return r.select(
        "id", reference_number(prefix, F.year(as_of_date(as_of)), F.col("id")).alias("reference"),
        "product_name", "category", "description",
        F.nullif(opt("old_price", "decimal(14,2)"), F.lit(0)).alias("old_price"),
        (js_or_num(opt("discount", "int"), 0) if ai_path else F.nullif(opt("discount", "int"), F.lit(0)))
        .alias("discount"),
        "new_price",
        F.nullif(opt("wholesale_price", "decimal(14,2)"), F.lit(0)).alias("wholesale_price"),
        js_or_num(F.col("quantity"), 1).alias("quantity"),
        js_or_str(F.col("status"), "active").alias("status"))


def image_numbering(existing: DataFrame | None, uploads: DataFrame,
                    upload_order: list | None = None) -> DataFrame:
    """New images continue their offer's numbering; the image at
    position 0 is the main one.  An offer whose images would exceed 8 gets
    none of the batch.  ``uploads`` has offer_id, id and an order column."""
    order = upload_order or ["id"]
    n_old = (existing.groupBy("offer_id").agg(F.count(F.lit(1)).alias("_old"))
             if existing is not None else None)
    u = uploads.withColumn("_i", F.row_number().over(W.partitionBy("offer_id").orderBy(*_asc(order))) - 1)
    n_new = uploads.groupBy("offer_id").agg(F.count(F.lit(1)).alias("_new"))
    u = u.join(n_new, "offer_id")
    if n_old is not None:
        u = u.join(n_old, "offer_id", "left")
    else:
        u = u.withColumn("_old", F.lit(0))
    u = u.withColumn("_old", F.coalesce("_old", F.lit(0)))
    u = u.where(F.col("_old") + F.col("_new") <= MAX_IMAGES)
    return u.select(*[c for c in uploads.columns if c not in ("is_main", "sort_order")],
                    (F.col("_old") + F.col("_i")).cast("int").alias("sort_order"),
                    ((F.col("_old") + F.col("_i")) == 0).alias("is_main"))


def within_image_cap(updates: DataFrame, images: DataFrame, cap: int = MAX_IMAGES) -> DataFrame:
    """The updates (id, ts, event_id, new_images) that keep their offer at ``cap`` images or fewer,
    counting the images of earlier accepted updates of the batch.

    The count only grows, so once an update of n images is refused every later
    one of n is: the accepted ones are among the first ``cap div n`` per offer
    and n.  At most 20 rows per offer then decide by a left fold in order; updates without
    images always pass.
    """
    n = F.col("new_images")
    few = updates.where((n >= 1) & (n <= cap)).withColumn(
        "_r", F.row_number().over(W.partitionBy("id", "new_images").orderBy("ts", "event_id"))).where(F.col("_r") <= F.floor(F.lit(cap) / n))
    have = images.groupBy(F.col("offer_id").alias("id")).agg(F.count(F.lit(1)).alias("_have"))
    row = F.struct("ts", "event_id", F.col("new_images").cast("long").alias("n"))
    seq = few.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("_u")).join(have, "id", "left")
    start = F.struct(F.coalesce("_have", F.lit(0)).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ok"))
    took = F.aggregate("_u", start, lambda acc, x: F.when(acc["at"] + x["n"] <= cap, F.struct(
        (acc["at"] + x["n"]).alias("at"), F.array_append(acc["ok"], x["event_id"]).alias("ok"))).otherwise(acc))
    ok = seq.select("id", F.explode(took["ok"]).alias("event_id"))
    return updates.where(F.coalesce(n, F.lit(0)) <= 0).unionByName(updates.where(n >= 1).join(ok, ["id", "event_id"], "left_semi"))


def offer_update_apply(offers: DataFrame, updates: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Valid updates (trimmed name and category non-empty, price finite
    > 0, existing offer, image cap over the batch) overwrite the whole
    editable row; last valid one wins."""
    ok = (blank_to_null("product_name").isNotNull() & blank_to_null("category").isNotNull()
          & F.col("new_price").isNotNull() & (F.col("new_price") > 0))
    u = updates.where(ok).withColumnRenamed("offer_id", "id")
    if images is not None and "new_images" in u.columns:
        u = within_image_cap(u.join(offers.select("id"), "id", "left_semi"), images)
    def opt(c, typ):
        return F.col(c) if c in u.columns else F.lit(None).cast(typ)
    u = u.select("id", "ts", "event_id",
                 js_trim("product_name").alias("product_name"), js_trim("category").alias("category"),
                 F.coalesce(F.nullif(opt("description", "string"), F.lit("")), F.lit("")).alias("description"),
                 F.nullif(opt("old_price", "decimal(14,2)"), F.lit(0)).alias("old_price"),
                 js_or_num(opt("discount", "int"), 0).alias("discount"),
                 F.col("new_price").cast("decimal(14,2)").alias("new_price"),
                 F.nullif(opt("wholesale_price", "decimal(14,2)"), F.lit(0)).alias("wholesale_price"),
                 js_or_num(opt("quantity", "int"), 0).alias("quantity"),
                 js_or_str(opt("status", "string"), "active").alias("status"))
    cols = {c: c for c in ["product_name", "category", "description", "old_price", "discount",
                           "new_price", "wholesale_price", "quantity", "status"] if c in offers.columns}
    out = latest_wins(offers, u, ["id"], ["ts", "event_id"], cols)
    return out.select(*[F.col(c).cast(offers.schema[c].dataType).alias(c) for c in offers.columns])


def offer_create_generated(requests: DataFrame, images: DataFrame, offers: DataFrame, as_of,
                           prefix: str = "REF") -> tuple[DataFrame, DataFrame]:
    """M12, second path: offers created with generated images: (offers, images).

    A request needs name, category, description and a price above 0, one to
    eight images (generated ones plus ``n_files`` uploaded ones), and every generated
    image must pass its rule; one bad image refuses the request.  Missing
    quantity counts 0, discount 0, ``status || 'active'``.  New ids follow the highest
    offer id in request order; the images keep their order, the first is the main one.
    ``images``: request_id, pos, url, public_id.
    """
    ok = (_text("product_name") != "") & (_text("category") != "") & (_text("description") != "") & (F.col("new_price") > 0)
    marked = images.withColumn("_ok", generated_image_allowed("url", "public_id"))
    per = marked.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("_ok").alias("_all"))
    r = requests.where(F.coalesce(ok, F.lit(False))).join(per, "request_id", "left")
    n = F.coalesce("_n", F.lit(0)) + F.coalesce("n_files", F.lit(0))
    r = r.where((n >= 1) & (n <= MAX_IMAGES) & F.coalesce("_all", F.lit(True)))
    top = offers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    r = global_position(r, [asc("request_id")], keys=requests.select("request_id")).crossJoin(top).withColumn("id", F.col("_max") + F.col("_pos") + 1)
    made = r.select("id", "request_id", reference_number(prefix, F.year(as_of_date(as_of)), F.col("id")).alias("reference"),
                    "product_name", "category", "description", F.nullif("old_price", F.lit(0)).alias("old_price"),
                    js_or_num("discount", 0).alias("discount"), "new_price", F.nullif("wholesale_price", F.lit(0)).alias("wholesale_price"),
                    F.coalesce("quantity", F.lit(0)).alias("quantity"), js_or_str("status", "active").alias("status"))
    at = F.row_number().over(W.partitionBy("request_id").orderBy("pos")) - 1  # at most eight per request here
    pics = (images.join(made.select("request_id", F.col("id").alias("offer_id")), "request_id").withColumn("sort_order", at)
            .select("offer_id", "public_id", F.col("url").alias("image_url"), "sort_order", (F.col("sort_order") == 0).alias("is_main")))
    return made, pics


def offer_delete_cascade(offers: DataFrame, images: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete offers and their images (order and invoice lines stay)."""
    d = (deletes.select(F.col("id").alias("offer_id")).dropDuplicates()
         .join(offers.select(F.col("id").alias("offer_id")), "offer_id", "left_semi"))
    return (offers.join(d.withColumnRenamed("offer_id", "id"), "id", "left_anti"),
            images.join(d, "offer_id", "left_anti"))


def main_image_reelect(images: DataFrame, deletes: DataFrame) -> DataFrame:
    """Delete images; where a deleted image was main, the first
    remaining image (``sort_order, id``) of that offer becomes main."""
    gone = images.join(deletes.select("id").dropDuplicates(), "id", "left_semi")
    lost_main = gone.where(F.coalesce("is_main", F.lit(False))).select("offer_id").distinct()
    left = images.join(deletes.select("id").dropDuplicates(), "id", "left_anti")
    first = (left.join(lost_main, "offer_id", "left_semi")
             .withColumn("_rn", F.row_number().over(
                 W.partitionBy("offer_id").orderBy(F.col("sort_order").asc_nulls_last(), F.col("id").asc())))
             .where(F.col("_rn") == 1).select(F.col("id").alias("_first")))
    return (left.join(first, left["id"] == first["_first"], "left")
            .withColumn("is_main", F.when(F.col("_first").isNotNull(), F.lit(True)).otherwise(F.col("is_main")))
            .drop("_first"))


# ---------------------------------------------------------------------------
# Ads (M20)
# ---------------------------------------------------------------------------
def ad_defaults(requests: DataFrame) -> DataFrame:
    """M20 create: trimmed title required; width||170, height||108,
    display_order||0, ``is_active != "false"``, link and dates || NULL."""
    r = requests.where(blank_to_null("title").isNotNull())
    def opt(c, typ):
        return F.col(c) if c in r.columns else F.lit(None).cast(typ)
    return r.select(
        "id", js_trim("title").alias("title"),
        F.nullif(opt("link_url", "string"), F.lit("")).alias("link_url"),
        js_or_num(opt("width", "int"), 170).alias("width"),
        js_or_num(opt("height", "int"), 108).alias("height"),
        js_or_num(opt("display_order", "int"), 0).alias("display_order"),
        F.coalesce(opt("is_active", "string") != F.lit("false"), F.lit(True)).alias("is_active"),
        opt("starts_at", "timestamp_ntz").alias("starts_at"),
        opt("ends_at", "timestamp_ntz").alias("ends_at"))


def ad_delete(ads: DataFrame, deletes: DataFrame) -> DataFrame:
    """M20 delete: ads without those named by ``deletes.id``."""
    return anti_delete(ads, deletes, ["id"])


def ad_update_apply(ads: DataFrame, updates: DataFrame, now) -> DataFrame:
    """M20 update: blank title or zero numbers keep the old value; link,
    dates and the active flag are overwritten; ``updated_at`` = ``now``.
    Last update per ad wins."""
    u = updates.select(
        "id", "ts", "event_id",
        js_trim("title").alias("u_title"), "link_url", "width", "height", "display_order",
        (F.coalesce(F.col("is_active"), F.lit("")) != F.lit("false")).alias("u_active"),
        "starts_at", "ends_at")
    last = latest_per_key(u, ["id"], ["ts", "event_id"]).drop("ts", "event_id")
    last = last.select(*[F.col(c).alias(f"n_{c}") for c in last.columns])
    j = ads.join(last, ads["id"] == last["n_id"], "left")
    hit = F.col("n_id").isNotNull()

    def keep_or(new, old):
        return F.when(hit, F.coalesce(new, F.col(old))).otherwise(F.col(old))
    out = []
    for c in ads.columns:
        if c == "title":
            v = keep_or(F.nullif("n_u_title", F.lit("")), "title")
        elif c in ("width", "height", "display_order"):
            v = keep_or(F.nullif(f"n_{c}", F.lit(0)), c)
        elif c == "link_url":
            v = F.when(hit, F.nullif("n_link_url", F.lit(""))).otherwise(F.col(c))
        elif c in ("starts_at", "ends_at"):
            v = F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c))
        elif c == "is_active":
            v = F.when(hit, F.col("n_u_active")).otherwise(F.col(c))
        elif c == "updated_at":
            v = F.when(hit, as_of_ts(now)).otherwise(F.col(c))
        else:
            v = F.col(c)
        out.append(v.cast(ads.schema[c].dataType).alias(c))
    return j.select(*out)


# ---------------------------------------------------------------------------
# Identities
# ---------------------------------------------------------------------------
def parse_identifier(df: DataFrame, col: str = "identifier") -> DataFrame:
    """Identifier -> email (trimmed, lower, when it has '@') or phone."""
    v = F.lower(js_trim(col))
    has_at = F.instr(v, "@") > 0
    return df.select("*", F.when(has_at, v).alias("email"),
                     F.when(~has_at, normalize_phone(F.col(col))).alias("phone"),
                     F.when(has_at, is_email(v)).otherwise(normalize_phone(F.col(col)).isNotNull())
                     .alias("valid"))


def identity_conflicts(users: DataFrame, probes: DataFrame, key: str = "event_id") -> DataFrame:
    """Existing users matching ``lower(email) = email OR phone = phone``.

    Two equi-joins and a union instead of an OR join (which would be a
    nested loop); each side is armed only when its probe value is not NULL.
    """
    u = users.select(F.col("id").alias("user_id"), F.lower("email").alias("_email"),
                     F.col("phone").alias("_phone"))
    by_mail = probes.where(F.col("email").isNotNull()).join(
        u, F.col("email") == F.col("_email")).select(key, "user_id")
    by_phone = probes.where(F.col("phone").isNotNull()).join(
        u, F.col("phone") == F.col("_phone")).select(key, "user_id")
    return by_mail.unionByName(by_phone).distinct()


def identity_register(users: DataFrame, registrations: DataFrame) -> DataFrame:
    """Valid registrations (name 1..150 after trim; valid e-mail or
    phone) not clashing with an existing user nor with an earlier
    registration of the batch; new ids follow the highest user id."""
    p = parse_identifier(registrations)
    name = js_trim("full_name")
    p = p.where(F.col("valid") & (F.length(name) >= 1) & (F.length(name) <= 150))
    clash = identity_conflicts(users, p).select("event_id").distinct()
    p = p.join(clash, "event_id", "left_anti")
    p = p.withColumn("_k", F.coalesce(F.concat(F.lit("e:"), "email"), F.concat(F.lit("p:"), "phone")))
    p = first_per_key(p, ["_k"], ["ts", "event_id"]).drop("_k")
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    p = global_position(p, [asc("ts"), asc("event_id")], keys=registrations).crossJoin(top)
    return p.select((F.col("_max") + F.col("_pos") + 1).alias("id"), "event_id",
                    name.alias("full_name"), "email", "phone", F.col("ts").alias("created_at"))


def tokens_valid(tokens: DataFrame, probes: DataFrame, now) -> DataFrame:
    """Which probes (event_id, user_id, token_hash) hold a token of their user that has not expired at
    ``now``; a semi join, so several equal tokens give one row."""
    live = tokens.where(not_expired("expires_at", now)).select("user_id", "token_hash")
    return probes.join(live, ["user_id", "token_hash"], "left_semi")


def _profile_replay():
    """The replay of :func:`profile_updates_accepted` as a function that travels to the tasks by value."""

    def replay(batches):
        """Updates of a component in order, against the phones its users hold: (kind, user, event, phone) rows
        sorted by component; yields (event_id) of the accepted updates."""
        import pyarrow as pa
        comp, holders, phone_of = None, {}, {}
        for b in batches:
            out = []
            for c, kind, user, event, phone in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if c != comp:
                    comp, holders, phone_of = c, {}, {}
                old = phone_of.get(user)
                if kind and phone is not None and holders.get(phone, set()) - {user}:
                    continue  # held by another user at this moment
                if old is not None:
                    holders[old].discard(user)
                phone_of[user] = phone
                if phone is not None:
                    holders.setdefault(phone, set()).add(user)
                if kind:
                    out.append(event)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["event_id"])

    return replay


def profile_updates_accepted(users: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates that pass, applied one by one in (ts, event_id) order.

    An update needs a name and an existing user, and a given phone must
    normalise; it is refused when another user holds that phone at its time.
    Phones are freed and taken by the accepted updates themselves, so an
    order matters -- but only between users who ever share a phone.  Phones that
    one user alone holds or asks for can refuse nobody: their updates pass without
    further work (NULL phones in particular meet nowhere).  The others form
    components over (user, shared phone); each is replayed in order by a task
    that streams over its rows and keeps the phones of its users only.
    ``updates``: event_id, user_id, ts, full_name, phone[, gender, address].
    """
    u = updates.withColumn("_phone", normalize_phone(F.col("phone")))
    ok = blank_to_null("full_name").isNotNull() & (F.col("phone").isNull() | (F.col("phone") == "") | F.col("_phone").isNotNull())
    u = u.where(ok).join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    held = users.where(F.col("phone").isNotNull()).select(F.col("id").alias("user_id"), F.col("phone").alias("_phone"))
    claims = held.unionByName(u.where(F.col("_phone").isNotNull()).select("user_id", "_phone")).distinct()
    shared = (claims.groupBy("_phone").agg(F.min("user_id").alias("a"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    edges = claims.join(shared, "_phone").select("a", F.col("user_id").alias("b")).distinct()
    comp = connected_components(edges).withColumnRenamed("node", "user_id")
    rows = (held.join(comp, "user_id")
            .select("component", F.lit(0).alias("kind"), "user_id", F.lit(None).cast("timestamp_ntz").alias("ts"),
                    F.lit(None).cast("long").alias("event_id"), "_phone")
            .unionByName(u.join(comp, "user_id").select("component", F.lit(1).alias("kind"), "user_id",
                                                        F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "_phone")))
    rows = rows.repartition("component").sortWithinPartitions("component", "kind", "ts", "event_id")
    passed = rows.select("component", "kind", "user_id", "event_id", "_phone").mapInArrow(_profile_replay(), "event_id long")
    free = u.join(comp.select("user_id"), "user_id", "left_anti")
    return free.unionByName(u.join(passed, "event_id", "left_semi").select(*free.columns))


def profile_update_apply(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Users after the accepted updates (:func:`profile_updates_accepted`); the
    last one per user overwrites name (trimmed), phone (normalised or NULL), gender
    and address (``x ? x.trim() : null``) where those columns exist."""
    u = profile_updates_accepted(users, updates)
    cols = {"full_name": js_trim("full_name"), "phone": F.col("_phone")}
    for c in ("gender", "address"):
        if c in users.columns:
            cols[c] = F.when(_text(c) != "", js_trim(c)) if c in u.columns else F.lit(None).cast("string")
    u = u.select(F.col("user_id").alias("id"), "ts", "event_id", *[v.alias(f"n_{c}") for c, v in cols.items()])
    base = users if "updated_at" in users.columns else users.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return latest_wins(base, u, ["id"], ["ts", "event_id"], {c: f"n_{c}" for c in cols} | {"updated_at": "ts"})
