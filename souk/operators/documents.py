"""Documents: orders, invoices, carts and favourites with their lines.

A web shop loads lines with one statement per parent (N+1); here every
document type is one join of parents with pre-aggregated or ranked lines.
``nested=True`` gives an array-of-struct column per parent (lines sorted by
their position); ``nested=False`` gives one row per line (parents without
lines keep one row of NULL line fields), which is what the SQL oracle checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import address_label, js_or_num, js_trim
from .catalog import DEFAULT_IMAGE, main_image, with_images

PICKUP_LABEL = "Retrait en magasin"
HOME_LABEL = "Livraison à domicile"


def _order_cols(cols):
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def attach_lines(parents: DataFrame, lines: DataFrame, parent_key: str, line_fk: str,
                 line_order: list, name: str = "lines", nested: bool = True,
                 prefix: str = "line_") -> DataFrame:
    """Attach each parent's lines (matched ``parents[parent_key] == lines[line_fk]``).

    Positions come from ``row_number`` over the line order; ``line_order``
    must end in a unique key so positions are stable.
    """
    ranked = lines.withColumn(
        "_pos", F.row_number().over(W.partitionBy(line_fk).orderBy(*_order_cols(line_order))) - 1)
    fields = [c for c in lines.columns if c != line_fk]
    if nested:
        agg = (ranked.groupBy(line_fk)
               .agg(F.array_sort(F.collect_list(F.struct("_pos", *fields))).alias("_arr"))
               .select(F.col(line_fk).alias("_fk"),
                       F.transform("_arr", lambda x: x.dropFields("_pos")).alias(name)))
        out = parents.join(agg, parents[parent_key] == agg["_fk"], "left").drop("_fk")
        return out.withColumn(name, F.coalesce(name, F.array().cast(agg.schema[name].dataType)))
    flat = ranked.select(F.col(line_fk).alias("_fk"), F.col("_pos").alias(f"{prefix}pos"),
                         *[F.col(c).alias(f"{prefix}{c}") for c in fields])
    return parents.join(flat, parents[parent_key] == flat["_fk"], "left").drop("_fk")


# ---------------------------------------------------------------------------
# Orders
# ---------------------------------------------------------------------------
ORDER_HEADER = ["id", "reference", "user_id", "first_name", "last_name", "phone", "email",
                "delivery_method", "address", "city", "district", "payment_method", "subtotal",
                "delivery_price", "total", "status", "created_at", "updated_at"]


def newest() -> list:
    """Newest first, as every list of orders and invoices comes (PostgreSQL puts NULL times first)."""
    return [F.col("created_at").desc_nulls_first(), F.col("id").desc()]


def _present(df, cols):
    return [c for c in cols if c in df.columns]


def orders_admin(orders: DataFrame, items: DataFrame, nested: bool = True) -> DataFrame:
    """Every order with its number of lines (int).

    Lines are counted per order first (partial aggregation before the
    shuffle), then left-joined: orders without lines count 0.
    """
    counts = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    base = (orders.select(*_present(orders, ORDER_HEADER))
            .join(counts, orders["id"] == counts["order_id"], "left").drop("order_id")
            .withColumn("items_count", F.coalesce("_n", F.lit(0)).cast("int")).drop("_n"))
    base = base.orderBy(*newest())
    if not nested:
        return base
    def s(*names):
        return F.struct(*[(F.col(n) if n in base.columns else F.lit(None).cast("string")).alias(a)
                          for n, a in names])
    return base.select(
        "id", *_present(base, ["reference", "user_id"]),
        s(("first_name", "firstName"), ("last_name", "lastName"), ("phone", "phone"),
          ("email", "email")).alias("customer"),
        s(("delivery_method", "method"), ("address", "address"), ("city", "city"),
          ("district", "district")).alias("delivery"),
        *_present(base, ["payment_method", "subtotal", "delivery_price", "total", "status",
                         "created_at", "updated_at"]), "items_count")


def order_lines(items: DataFrame, default_image: str = DEFAULT_IMAGE) -> DataFrame:
    """Order lines with the image default of the reports (JS ``||``)."""
    if "image_url" in items.columns:
        items = items.withColumn("image_url", F.coalesce(F.nullif("image_url", F.lit("")),
                                                         F.lit(default_image)))
    return items


def order_detail(orders: DataFrame, items: DataFrame, ids: DataFrame | None = None,
                 line_order: list | None = None, nested: bool = True) -> DataFrame:
    """R8 (one order): orders restricted to ``ids.id`` (semi join) with lines."""
    o = orders.select(*_present(orders, ORDER_HEADER))
    if ids is not None:
        o = o.join(ids.select("id"), "id", "left_semi")
    return attach_lines(o, order_lines(items), "id", "order_id", line_order or ["id"],
                        "products", nested)


def order_history(orders: DataFrame, items: DataFrame, users: DataFrame | None = None,
                  line_order: list | None = None, nested: bool = True) -> DataFrame:
    """Each customer's orders (newest first) with labels and lines.

    For all users at once (``users`` restricts to a key set by semi join).
    """
    o = orders.where(F.col("user_id").isNotNull())
    if users is not None:
        o = o.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    pickup = F.col("delivery_method") == F.lit("pickup")
    o = o.select(
        *_present(o, ["id", "user_id", "reference"]), F.col("created_at").alias("date"), "status",
        "total", *_present(o, ["subtotal", "delivery_price", "payment_method"]),
        F.when(pickup, F.lit(PICKUP_LABEL)).otherwise(F.lit(HOME_LABEL)).alias("delivery"),
        F.when(pickup, F.lit(PICKUP_LABEL))
         .otherwise(address_label("city", "district", "address")).alias("address_label"),
        *_present(o, ["first_name", "last_name", "phone", "email"]))
    out = attach_lines(o, order_lines(items), "id", "order_id", line_order or ["id"], "products", nested)
    return out.orderBy("user_id", F.col("date").desc_nulls_first(), F.col("id").desc(), *([] if nested else ["line_pos"]))


def guest_order_lookup(orders: DataFrame, items: DataFrame, requests: DataFrame,
                       line_order: list | None = None, nested: bool = True) -> DataFrame:
    """Guest orders found by (trimmed reference, trimmed phone).

    ``requests`` has ``reference`` and ``phone``; the match is an equi-join
    on both with ``user_id IS NULL``; unmatched requests give no row.
    """
    req = requests.select(js_trim("reference").alias("reference"),
                          js_trim("phone").alias("phone")).dropDuplicates()
    o = orders.where(F.col("user_id").isNull()).join(req, ["reference", "phone"], "left_semi")
    o = o.select("id", "reference", F.col("created_at").alias("date"), "status", "total",
                 *_present(o, ["payment_method", "delivery_method"]),
                 address_label("city", "district", "address").alias("address_label"))
    return attach_lines(o, order_lines(items), "id", "order_id", line_order or ["id"],
                        "products", nested)


def lookup_by_key(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """S3: rows whose ``key`` is in ``keys`` (0..1 row per key; semi join)."""
    return df.join(keys.select(key).dropDuplicates(), key, "left_semi")


# ---------------------------------------------------------------------------
# Carts, favourites, baskets
# ---------------------------------------------------------------------------
def cart_view(cart_items: DataFrame, carts: DataFrame, offers: DataFrame, images: DataFrame,
              default_image: str = DEFAULT_IMAGE) -> DataFrame:
    """Cart lines of every user with offer fields and main image.

    Inner joins (no status filter); the main image is
    one ``row_number() == 1`` frame joined once, not a per-row subquery.
    """
    mi = main_image(offers, images, default_image)
    c = carts.select(F.col("id").alias("cart_id"), "user_id")
    o = offers.select(F.col("id").alias("offer_id"), "product_name", "category", "new_price",
                      *_present(offers, ["old_price"]))
    return (cart_items.select(F.col("id").alias("cart_item_id"), "cart_id", "offer_id", "quantity",
                              "created_at", *_present(cart_items, ["updated_at"]))
            .join(c, "cart_id").join(o, "offer_id").join(mi, "offer_id", "left")
            .orderBy(F.col("user_id"), F.col("created_at").desc_nulls_first(), F.col("cart_item_id")))


def favorites_list(favorites: DataFrame, offers: DataFrame, images: DataFrame,
                   nested: bool = True) -> DataFrame:
    """Favourites with the whole offer row (no status filter) and images
    ordered ``is_main DESC, sort_order``."""
    f = favorites.select(F.col("id").alias("favorite_id"), "user_id", "offer_id",
                         F.col("created_at").alias("favorite_created_at"))
    o = offers.withColumnRenamed("id", "offer_id")
    out = with_images(f.join(o, "offer_id"), images, nested=nested, main_first=True, key="offer_id")
    return out.orderBy("user_id", F.col("favorite_created_at").desc_nulls_first(), F.col("favorite_id").desc(),
                       *([] if nested else ["image_pos"]))


def basket_totals(lines: DataFrame, offers: DataFrame, basket_key: str = "basket_id") -> DataFrame:
    """Per basket, subtotal = sum(price or 0 x (quantity or 1)); delivery 0.

    Zero or NULL quantity counts as 1 (JS ``||``); NULL price as 0.
    """
    q = js_or_num(F.col("quantity"), 1)
    priced = lines.join(offers.select(F.col("id").alias("offer_id"), "new_price"), "offer_id")
    return (priced.groupBy(basket_key)
            .agg(F.sum(F.coalesce("new_price", F.lit(0)) * q).cast("decimal(24,2)").alias("subtotal"))
            .select(basket_key, "subtotal", F.lit(0).cast("decimal(24,2)").alias("delivery_price"),
                    F.col("subtotal").alias("total")))


# ---------------------------------------------------------------------------
# Invoices
# ---------------------------------------------------------------------------
def invoices_with_items(invoices: DataFrame, items: DataFrame, offers: DataFrame | None = None,
                        line_order: list | None = None, nested: bool = True) -> DataFrame:
    """Invoices with their lines; with ``offers`` each line carries
    ``current_stock`` = the offer's quantity, 0 when the offer is gone."""
    if offers is not None:
        stock = offers.select(F.col("id").alias("_oid"), F.col("quantity").alias("_q"))
        items = (items.join(stock, items["offer_id"] == stock["_oid"], "left")
                 .withColumn("current_stock", F.coalesce("_q", F.lit(0))).drop("_oid", "_q"))
    out = attach_lines(invoices, items, "id", "invoice_id", line_order or ["id"], "items", nested)
    return out.orderBy(*newest(), *([] if nested else ["line_pos"]))


def invoice_detail(invoices: DataFrame, items: DataFrame, ids: DataFrame | None = None,
                   line_order: list | None = None, nested: bool = True) -> DataFrame:
    """R9 (one invoice): invoices restricted to ``ids.id`` with their lines."""
    if ids is not None:
        invoices = invoices.join(ids.select("id"), "id", "left_semi")
    return invoices_with_items(invoices, items, None, line_order, nested)


def invoice_count(invoices: DataFrame) -> DataFrame:
    """Number of invoices (int)."""
    return invoices.agg(F.count(F.lit(1)).cast("int").alias("total"))
