"""Document keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, sales
from ..operators import documents as docs
from ..sources import documents, report_document
from .registry import AS_OF, DAYS, ORACLES, query

LINE_ORDER = ["line_no", "offer_id", "tie1", "quantity", "line_total"]
OI_RANK = """SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id
      ORDER BY line_no, offer_id, tie1, quantity, line_total) - 1 AS INTEGER) AS line_pos,
    offer_id AS line_offer_id, line_no AS line_line_no, tie1 AS line_tie1, quantity AS line_quantity,
    line_total AS line_line_total FROM v_order_items"""
OI_FLAT = "l.line_pos, l.line_offer_id, l.line_line_no, l.line_tie1, l.line_quantity, l.line_line_total"


@query("orders_admin", ["v_orders", "v_order_items"], """
SELECT o.id, o.user_id, o.first_name, o.last_name, o.phone, o.delivery_method, o.address, o.city,
  o.district, o.total, o.status, o.created_at, CAST(COALESCE(n.c, 0) AS INTEGER) AS items_count
FROM v_orders o LEFT JOIN (SELECT order_id, COUNT(*) AS c FROM v_order_items GROUP BY order_id) n
  ON n.order_id = o.id""")
def orders_admin(t):
    return docs.orders_admin(t.v_orders, t.v_order_items, nested=False)


@query("order_detail", ["v_orders", "v_order_items", "v_status_changes"], f"""
WITH l AS ({OI_RANK})
SELECT o.*, {OI_FLAT} FROM v_orders o LEFT JOIN l ON l.order_id = o.id
WHERE o.id IN (SELECT order_id FROM v_status_changes)""")
def order_detail(t):
    """Orders opened by the admin (those with a status change) with their lines."""
    ids = t.v_status_changes.select(F.col("order_id").alias("id"))
    return docs.order_detail(t.v_orders, t.v_order_items, ids, LINE_ORDER, nested=False)


@query("order_history", ["v_orders", "v_order_items"], f"""
WITH l AS ({OI_RANK})
SELECT o.id, o.user_id, o.created_at AS date, o.status, o.total,
  CASE WHEN o.delivery_method = 'pickup' THEN 'Retrait en magasin' ELSE 'Livraison à domicile' END AS delivery,
  CASE WHEN o.delivery_method = 'pickup' THEN 'Retrait en magasin'
       ELSE concat_ws(', ', NULLIF(o.city, ''), NULLIF(o.district, ''), NULLIF(o.address, '')) END AS address_label,
  o.first_name, o.last_name, o.phone, {OI_FLAT}
FROM v_orders o LEFT JOIN l ON l.order_id = o.id WHERE o.user_id IS NOT NULL""")
def order_history(t):
    return docs.order_history(t.v_orders, t.v_order_items, None, LINE_ORDER, nested=False)


@query("guest_order_lookup", ["v_orders_ref", "v_order_items", "v_guest_requests"], f"""
WITH l AS ({OI_RANK})
SELECT o.id, o.reference, o.created_at AS date, o.status, o.total, o.delivery_method,
  concat_ws(', ', NULLIF(o.city, ''), NULLIF(o.district, ''), NULLIF(o.address, '')) AS address_label, {OI_FLAT}
FROM v_orders_ref o LEFT JOIN l ON l.order_id = o.id
WHERE o.user_id IS NULL AND EXISTS (SELECT 1 FROM v_guest_requests r
  WHERE trim(r.reference) = o.reference AND trim(r.phone) = o.phone)""")
def guest_order_lookup(t):
    return docs.guest_order_lookup(t.v_orders_ref, t.v_order_items, t.v_guest_requests,
                                   LINE_ORDER, nested=False)


@query("lookup_by_key", ["v_users", "v_favorite_adds"], """
SELECT * FROM v_users WHERE id IN (SELECT user_id FROM v_favorite_adds)""")
def lookup_by_key(t):
    """Users looked up by the ids of a batch of requests (favourite events)."""
    return docs.lookup_by_key(t.v_users, t.v_favorite_adds.select(F.col("user_id").alias("id")))


def cart_tables(t):
    """Cart lines and carts from the click events (cart = user)."""
    items = t.v_cart_adds.select(F.col("event_id").alias("id"), F.col("user_id").alias("cart_id"),
                                 "offer_id", "quantity", F.col("ts").alias("created_at"))
    carts = t.v_cart_adds.select(F.col("user_id").alias("id"), "user_id").dropDuplicates(["id"])
    return items, carts


@query("cart_view", ["v_cart_adds", "v_offers", "v_offer_images"], """
SELECT c.event_id AS cart_item_id, c.user_id AS cart_id, c.offer_id, c.quantity, c.ts AS created_at,
  c.user_id, o.product_name, o.category, o.new_price, COALESCE(m.image_url, 'default.png') AS image_url
FROM v_cart_adds c JOIN v_offers o ON o.id = c.offer_id
LEFT JOIN (SELECT offer_id, image_url, row_number() OVER (PARTITION BY offer_id
    ORDER BY is_main DESC NULLS FIRST, sort_order ASC NULLS LAST, id ASC) AS rn FROM v_offer_images) m
  ON m.offer_id = o.id AND m.rn = 1""")
def cart_view(t):
    items, carts = cart_tables(t)
    return docs.cart_view(items, carts, t.v_offers, t.v_offer_images)


@query("favorites_list", ["v_favorite_adds", "v_offers", "v_offer_images"], """
WITH img AS (SELECT offer_id, CAST(row_number() OVER (PARTITION BY offer_id
      ORDER BY is_main DESC NULLS FIRST, sort_order ASC NULLS LAST, id ASC) - 1 AS INTEGER) AS image_pos,
    id AS image_id, image_url, is_main, sort_order FROM v_offer_images)
SELECT f.offer_id, f.event_id AS favorite_id, f.user_id, f.ts AS favorite_created_at,
  o.product_name, o.category, o.category_id, o.description, o.new_price, o.price, o.discount, o.quantity,
  o.status, o.created_at, img.image_pos, img.image_id, img.image_url, img.is_main, img.sort_order
FROM v_favorite_adds f JOIN v_offers o ON o.id = f.offer_id LEFT JOIN img ON img.offer_id = o.id""")
def favorites_list(t):
    fav = t.v_favorite_adds.select(F.col("event_id").alias("id"), "user_id", "offer_id",
                                   F.col("ts").alias("created_at"))
    return docs.favorites_list(fav, t.v_offers, t.v_offer_images, nested=False)


@query("basket_totals", ["v_cart_adds", "v_offers"], """
SELECT c.user_id AS basket_id,
  CAST(SUM(COALESCE(o.new_price, 0) * CASE WHEN c.quantity IS NULL OR c.quantity = 0 THEN 1 ELSE c.quantity END)
    AS DECIMAL(24,2)) AS subtotal,
  CAST(0 AS DECIMAL(24,2)) AS delivery_price,
  CAST(SUM(COALESCE(o.new_price, 0) * CASE WHEN c.quantity IS NULL OR c.quantity = 0 THEN 1 ELSE c.quantity END)
    AS DECIMAL(24,2)) AS total
FROM v_cart_adds c JOIN v_offers o ON o.id = c.offer_id GROUP BY c.user_id""")
def basket_totals(t):
    lines = t.v_cart_adds.select(F.col("user_id").alias("basket_id"), "offer_id", "quantity")
    return docs.basket_totals(lines, t.v_offers)


II_RANK = """SELECT ii.invoice_id, CAST(row_number() OVER (PARTITION BY ii.invoice_id
      ORDER BY ii.line_no, ii.offer_id, ii.tie1, ii.quantity, ii.line_total) - 1 AS INTEGER) AS line_pos,
    ii.created_at AS line_created_at, ii.offer_id AS line_offer_id, ii.line_no AS line_line_no,
    ii.tie1 AS line_tie1, ii.quantity AS line_quantity, ii.line_total AS line_line_total{extra}
  FROM v_invoice_items ii{join}"""


@query("invoices_with_items", ["v_invoices", "v_invoice_items", "v_offers"], f"""
WITH l AS ({II_RANK.format(extra=', COALESCE(o.quantity, 0) AS line_current_stock',
                           join=' LEFT JOIN v_offers o ON o.id = ii.offer_id')})
SELECT i.*, l.line_pos, l.line_created_at, l.line_offer_id, l.line_line_no, l.line_tie1, l.line_quantity,
  l.line_line_total, l.line_current_stock
FROM v_invoices i LEFT JOIN l ON l.invoice_id = i.id""")
def invoices_with_items(t):
    return docs.invoices_with_items(t.v_invoices, t.v_invoice_items, t.v_offers, LINE_ORDER, nested=False)


@query("invoice_detail", ["v_invoices", "v_invoice_items", "v_status_changes"], f"""
WITH l AS ({II_RANK.format(extra='', join='')})
SELECT i.*, l.line_pos, l.line_created_at, l.line_offer_id, l.line_line_no, l.line_tie1, l.line_quantity,
  l.line_line_total
FROM v_invoices i LEFT JOIN l ON l.invoice_id = i.id WHERE i.id IN (SELECT order_id FROM v_status_changes)""")
def invoice_detail(t):
    ids = t.v_status_changes.select(F.col("order_id").alias("id"))
    return docs.invoice_detail(t.v_invoices, t.v_invoice_items, ids, LINE_ORDER, nested=False)


@query("invoice_count", ["v_invoices"], "SELECT CAST(COUNT(*) AS INTEGER) AS total FROM v_invoices")
def invoice_count(t):
    return docs.invoice_count(t.v_invoices)


# --- whole documents as JSON text ---------------------------------------------------------------
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')"
LINE_JSON = ("{{'offer_id': {a}.offer_id, 'line_no': {a}.line_no, 'tie1': {a}.tie1, 'quantity': {a}.quantity, "
             "'line_total': CAST({a}.line_total AS VARCHAR)}}")


@query("order_documents", ["v_orders", "v_order_items"], f"""
WITH l AS (SELECT order_id, list({LINE_JSON.format(a='i')} ORDER BY line_no, offer_id, tie1, quantity, line_total) AS products
  FROM v_order_items i GROUP BY order_id)
SELECT o.id, CAST(to_json({{'id': o.id, 'user_id': o.user_id, 'first_name': o.first_name, 'last_name': o.last_name, 'phone': o.phone,
  'delivery_method': o.delivery_method, 'address': o.address, 'city': o.city, 'district': o.district, 'total': CAST(o.total AS VARCHAR),
  'status': o.status, 'created_at': {ISO.format(c='o.created_at')}, 'products': COALESCE(l.products, [])}}) AS VARCHAR) AS document
FROM v_orders o LEFT JOIN l ON l.order_id = o.id""")
def order_documents(t):
    """Every order as one JSON document with its lines in order."""
    return documents(docs.order_detail(t.v_orders, t.v_order_items, None, LINE_ORDER), "id")


@query("invoice_documents", ["v_invoices", "v_invoice_items", "v_offers"], f"""
WITH l AS (SELECT invoice_id, list({{'created_at': {ISO.format(c='i.created_at')}, 'offer_id': i.offer_id, 'line_no': i.line_no, 'tie1': i.tie1,
    'quantity': i.quantity, 'line_total': CAST(i.line_total AS VARCHAR), 'current_stock': COALESCE(o.quantity, 0)}}
    ORDER BY i.line_no, i.offer_id, i.tie1, i.quantity, i.line_total) AS items
  FROM v_invoice_items i LEFT JOIN v_offers o ON o.id = i.offer_id GROUP BY invoice_id)
SELECT v.id, CAST(to_json({{'id': v.id, 'invoice_number': v.invoice_number, 'total': CAST(v.total AS VARCHAR),
  'created_at': {ISO.format(c='v.created_at')}, 'items': COALESCE(l.items, [])}}) AS VARCHAR) AS document
FROM v_invoices v LEFT JOIN l ON l.invoice_id = v.id""")
def invoice_documents(t):
    """Every invoice as one JSON document, lines with the current stock."""
    return documents(docs.invoices_with_items(t.v_invoices, t.v_invoice_items, t.v_offers, LINE_ORDER), "id")


@query("offer_documents", ["v_offers", "v_offer_images"], f"""
WITH g AS (SELECT offer_id, list({{'id': id, 'image_url': image_url, 'is_main': is_main, 'sort_order': sort_order}}
    ORDER BY sort_order NULLS LAST, id) AS images FROM v_offer_images GROUP BY offer_id)
SELECT o.id, CAST(to_json({{'id': o.id, 'product_name': o.product_name, 'category': o.category, 'description': o.description,
  'discount': o.discount, 'new_price': CAST(o.new_price AS VARCHAR), 'quantity': o.quantity, 'status': o.status,
  'created_at': {ISO.format(c='o.created_at')}, 'images': COALESCE(g.images, [])}}) AS VARCHAR) AS document
FROM v_offers o LEFT JOIN g ON g.offer_id = o.id WHERE o.status = 'active' AND o.quantity > 0""")
def offer_documents(t):
    """Every sellable offer as one JSON document with its images in order ([] when there is none)."""
    return documents(catalog.offer_detail(t.v_offers, t.v_offer_images), "id")


@query("favorite_documents", ["v_favorite_adds", "v_offers", "v_offer_images"], f"""
WITH g AS (SELECT offer_id, list({{'id': id, 'image_url': image_url, 'is_main': is_main, 'sort_order': sort_order}}
    ORDER BY is_main DESC NULLS FIRST, sort_order NULLS LAST, id) AS images FROM v_offer_images GROUP BY offer_id)
SELECT f.event_id AS favorite_id, CAST(to_json({{'favorite_id': f.event_id, 'user_id': f.user_id, 'offer_id': f.offer_id,
  'favorite_created_at': {ISO.format(c='f.ts')}, 'product_name': o.product_name, 'new_price': CAST(o.new_price AS VARCHAR),
  'images': COALESCE(g.images, [])}}) AS VARCHAR) AS document
FROM v_favorite_adds f JOIN v_offers o ON o.id = f.offer_id LEFT JOIN g ON g.offer_id = o.id""")
def favorite_documents(t):
    """Favourites as JSON documents, main image first."""
    fav = t.v_favorite_adds.select(F.col("event_id").alias("id"), "user_id", "offer_id", F.col("ts").alias("created_at"))
    d = docs.favorites_list(fav, t.v_offers, t.v_offer_images)
    return documents(d.select("favorite_id", "user_id", "offer_id", "favorite_created_at", "product_name", "new_price", "images"), "favorite_id")


def _report_oracle() -> str:
    from . import q_sales  # noqa: F401  (its oracles are parts of this one)
    o, t, d = (ORACLES[k] for k in ("sales_previous", "daily_timeline", "delivery_summary"))
    return f"""
SELECT '{{"previous":' || (SELECT CAST(to_json({{'revenue': CAST(revenue AS VARCHAR), 'orders': orders}}) AS VARCHAR) FROM ({o}) x)
  || ',"timeline":' || (SELECT CAST(to_json(list({{'date': CAST(date AS VARCHAR), 'orders': orders, 'revenue': CAST(revenue AS VARCHAR),
       'cancelled_orders': cancelled_orders, 'delivered_orders': delivered_orders, 'shipping_orders': shipping_orders,
       'new_users': new_users}} ORDER BY date)) AS VARCHAR) FROM ({t}) x)
  || ',"delivery":' || (SELECT CAST(to_json({{'delivered': delivered, 'shipping': shipping, 'pending': pending, 'failed': failed,
       'cancelled': cancelled}}) AS VARCHAR) FROM ({d}) x) || '}}' AS document"""


@query("report_document", [], _report_oracle())
def sales_report_document(t):
    """The analytics answer as one JSON document: previous period, gap-filled days in order, delivery."""
    r = sales.sales_report(t.spark, t.v_orders, t.v_users, t.v_offers, t.v_order_items, t.v_categories, AS_OF, DAYS)
    return report_document({"previous": r["previous"].select("revenue", "orders"), "timeline": r["timeline"],
                            "delivery": r["delivery"].drop("rate")}, {"timeline": ["date"]})
