"""Sales analytics keys."""

from __future__ import annotations

from ..operators import sales
from .registry import AS_OF, DAYS, d, query, ts

START, PREV, END = ts(-(DAYS - 1)), ts(-(2 * DAYS - 1)), ts(1)
SK = "lower(coalesce(status, ''))"
DELIV = "('delivered', 'livree', 'livré', 'completed', 'complete')"
SHIP = "('shipping', 'shipped', 'in_delivery', 'in delivery', 'transit', 'en_livraison', 'en livraison')"
PEND = "('pending', 'processing', 'confirmed', 'en_attente', 'en attente')"
FAIL = "('failed', 'delivery_failed', 'non_livree', 'non livrée', 'undelivered')"
SPINE = (f"SELECT CAST(generate_series AS DATE) AS date FROM generate_series("
         f"{ts(-(DAYS - 1))}, {ts(0)}, INTERVAL 1 DAY)")


@query("daily_timeline", ["v_orders", "v_users"], f"""
WITH dates AS ({SPINE}),
daily AS (
  SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS orders,
    CAST(COALESCE(SUM(CASE WHEN {SK} <> 'cancelled' THEN total ELSE 0 END), 0) AS DECIMAL(24,2)) AS revenue,
    COUNT(CASE WHEN {SK} = 'cancelled' THEN 1 END) AS cancelled_orders,
    COUNT(CASE WHEN {SK} IN {DELIV} THEN 1 END) AS delivered_orders,
    COUNT(CASE WHEN {SK} IN {SHIP} THEN 1 END) AS shipping_orders
  FROM v_orders WHERE created_at >= {START} GROUP BY CAST(created_at AS DATE)),
nu AS (SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS users
  FROM v_users WHERE created_at >= {START} GROUP BY CAST(created_at AS DATE))
SELECT dates.date, COALESCE(daily.orders, 0) AS orders,
  CAST(COALESCE(daily.revenue, 0) AS DECIMAL(24,2)) AS revenue,
  COALESCE(daily.cancelled_orders, 0) AS cancelled_orders,
  COALESCE(daily.delivered_orders, 0) AS delivered_orders,
  COALESCE(daily.shipping_orders, 0) AS shipping_orders,
  COALESCE(nu.users, 0) AS new_users
FROM dates LEFT JOIN daily ON daily.date = dates.date LEFT JOIN nu ON nu.date = dates.date
ORDER BY dates.date""")
def daily_timeline(t):
    """Gap-filled daily orders/revenue/state counts + new users (flagship)."""
    return sales.daily_timeline(t.spark, t.v_orders, t.v_users, AS_OF, DAYS)


_OVERVIEW = f"""
SELECT CAST(COALESCE(SUM(CASE WHEN created_at >= {START} AND created_at < {END} AND {SK} <> 'cancelled'
         THEN total ELSE 0 END), 0) AS DECIMAL(24,2)) AS revenue,
  COUNT(CASE WHEN created_at >= {START} AND created_at < {END} THEN 1 END) AS orders,
  COUNT(CASE WHEN created_at >= {START} AND created_at < {END} AND {SK} = 'cancelled' THEN 1 END) AS cancelled_orders,
  COUNT(CASE WHEN created_at >= {START} AND {SK} IN {DELIV} THEN 1 END) AS delivered_orders,
  COUNT(CASE WHEN created_at >= {START} AND {SK} IN {SHIP} THEN 1 END) AS shipping_orders,
  COUNT(CASE WHEN created_at >= {START} AND {SK} IN {FAIL} THEN 1 END) AS failed_orders
FROM v_orders"""


@query("sales_overview", ["v_orders"], f"""
WITH s AS ({_OVERVIEW})
SELECT {DAYS} AS days, revenue, orders, cancelled_orders, delivered_orders, shipping_orders, failed_orders,
  CASE WHEN orders > 0 THEN CAST(revenue AS DOUBLE) / CAST(orders AS DOUBLE) ELSE 0.0 END AS average_order,
  CAST(revenue AS DOUBLE) / CAST({DAYS} AS DOUBLE) AS average_daily_revenue,
  CAST(0.0 AS DOUBLE) AS conversion_rate
FROM s""")
def sales_overview(t):
    return sales.sales_overview(t.v_orders, AS_OF, DAYS)


@query("sales_previous", ["v_orders"], f"""
SELECT CAST(COALESCE(SUM(CASE WHEN created_at >= {PREV} AND created_at < {START} AND {SK} <> 'cancelled'
         THEN total ELSE 0 END), 0) AS DECIMAL(24,2)) AS revenue,
  COUNT(CASE WHEN created_at >= {PREV} AND created_at < {START} THEN 1 END) AS orders,
  CAST(0 AS BIGINT) AS users, CAST(0 AS BIGINT) AS items_sold, CAST(0 AS BIGINT) AS products_added,
  COUNT(CASE WHEN created_at >= {PREV} AND created_at < {START} AND {SK} = 'cancelled' THEN 1 END) AS offers_cancelled
FROM v_orders""")
def sales_previous(t):
    return sales.sales_previous(t.v_orders, AS_OF, DAYS)


@query("delivery_summary", ["v_orders"], f"""
WITH s AS (
  SELECT COUNT(CASE WHEN {SK} IN {DELIV} THEN 1 END) AS delivered,
    COUNT(CASE WHEN {SK} IN {SHIP} THEN 1 END) AS shipping,
    COUNT(CASE WHEN {SK} IN {PEND} THEN 1 END) AS pending,
    COUNT(CASE WHEN {SK} IN {FAIL} THEN 1 END) AS failed,
    COUNT(CASE WHEN {SK} = 'cancelled' THEN 1 END) AS cancelled
  FROM v_orders WHERE created_at >= {START})
SELECT delivered, shipping, pending, failed, cancelled,
  CASE WHEN delivered + shipping + pending + failed > 0
    THEN CAST(delivered AS DOUBLE) * 100.0 / CAST(delivered + shipping + pending + failed AS DOUBLE)
    ELSE 0.0 END AS rate
FROM s""")
def delivery_summary(t):
    return sales.delivery_summary(t.v_orders, AS_OF, DAYS)


@query("user_growth", ["v_users"], f"""
SELECT COUNT(*) FILTER (WHERE created_at >= {START}) AS new_users, COUNT(*) AS total_users FROM v_users""")
def user_growth(t):
    return sales.user_growth(t.v_users, AS_OF, DAYS)


@query("offer_activity", ["v_offers"], f"""
SELECT COUNT(*) FILTER (WHERE created_at >= {START}) AS products_added,
  COUNT(*) FILTER (WHERE created_at >= {START}
    AND {SK} IN ('cancelled', 'cancelled_offer', 'deleted', 'inactive')) AS offers_cancelled
FROM v_offers""")
def offer_activity(t):
    return sales.offer_activity(t.v_offers, AS_OF, DAYS)


@query("items_sold", ["v_orders", "v_order_items"], f"""
SELECT CAST(COALESCE(SUM(oi.quantity), 0) AS BIGINT) AS items_sold
FROM v_order_items oi JOIN v_orders o ON o.id = oi.order_id
WHERE o.created_at >= {START} AND lower(coalesce(o.status, '')) <> 'cancelled'""")
def items_sold(t):
    return sales.items_sold(t.v_order_items, t.v_orders, AS_OF, DAYS)


@query("daily_new_users", ["v_users"], f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS users
FROM v_users WHERE created_at >= {START} GROUP BY CAST(created_at AS DATE)""")
def daily_new_users(t):
    return sales.daily_new_users(t.v_users, AS_OF, DAYS)


@query("dashboard_activity", ["v_orders"], f"""
WITH dates AS ({SPINE}),
daily AS (SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS orders,
    CAST(COALESCE(SUM(total), 0) AS DECIMAL(24,2)) AS revenue
  FROM v_orders WHERE created_at >= {START} AND status <> 'cancelled' GROUP BY CAST(created_at AS DATE))
SELECT dates.date, COALESCE(daily.orders, 0) AS orders, CAST(COALESCE(daily.revenue, 0) AS DECIMAL(24,2)) AS revenue
FROM dates LEFT JOIN daily ON daily.date = dates.date ORDER BY dates.date""")
def dashboard_activity(t):
    return sales.dashboard_activity(t.spark, t.v_orders, AS_OF, DAYS)


@query("dashboard_totals", ["v_orders", "v_users", "v_offers"], """
SELECT (SELECT COUNT(*) FROM v_orders) AS total_orders, (SELECT COUNT(*) FROM v_users) AS total_users,
  (SELECT COUNT(*) FROM v_offers) AS total_offers,
  (SELECT CAST(COALESCE(SUM(total), 0) AS DECIMAL(24,2)) FROM v_orders WHERE status <> 'cancelled') AS revenue""")
def dashboard_totals(t):
    return sales.dashboard_totals(t.v_orders, t.v_users, t.v_offers)


@query("category_performance", ["v_offers", "v_categories"], f"""
SELECT COALESCE(c.name, 'Sans catégorie') AS name,
  CAST(COALESCE(SUM(CASE WHEN {SK.replace('status', 'o.status')} <> 'cancelled' THEN o.price ELSE 0 END), 0)
    AS DECIMAL(24,2)) AS revenue,
  COUNT(o.id) AS offers
FROM v_offers o LEFT JOIN v_categories c ON c.id = o.category_id
GROUP BY c.name ORDER BY revenue DESC NULLS FIRST, c.name ASC NULLS LAST LIMIT 10""")
def category_performance(t):
    return sales.category_performance(t.v_offers, t.v_categories)


_LABEL = ("COALESCE(NULLIF(concat_ws(' ', NULLIF(first_name, ''), NULLIF(last_name, '')), ''), 'Client')")


@query("recent_orders", ["v_orders"], f"""
SELECT id, CAST(id AS VARCHAR) AS reference, {_LABEL} AS customer, total, status, created_at
FROM v_orders ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 12""")
def recent_orders(t):
    return sales.recent_orders(t.v_orders, 12)


@query("dashboard_recent_orders", ["v_orders"], f"""
SELECT CAST(id AS VARCHAR) AS id, {_LABEL} AS customer, total, status, created_at
FROM (SELECT * FROM v_orders ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 6) o""")
def dashboard_recent_orders(t):
    return sales.dashboard_recent_orders(t.v_orders, 6)


@query("dashboard_recent_users", ["v_users"], """
SELECT id, COALESCE(NULLIF(full_name, ''), 'Utilisateur') AS full_name, COALESCE(email, '') AS email, created_at
FROM v_users ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 6""")
def dashboard_recent_users(t):
    return sales.dashboard_recent_users(t.v_users, 6)


@query("users_list", ["v_users"], """
SELECT id, full_name, phone, email, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS profile_image,
  CAST(NULL AS BOOLEAN) AS is_active, created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM v_users ORDER BY created_at DESC NULLS FIRST, id DESC""")
def users_list(t):
    return sales.users_list(t.v_users)

