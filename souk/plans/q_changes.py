"""Change-batch keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as ch
from .registry import AS_OF, query, ts
from .sqlbits import SPLIT, email_ok, jt, phone, ref

CART_SCHEMA = "cart_id bigint, offer_id bigint, quantity int, created_at timestamp_ntz, updated_at timestamp_ntz"
VALID_ADD = ("COALESCE(quantity, 1) BETWEEN 1 AND 100 AND offer_id IS NOT NULL AND offer_id > 0 "
             "AND offer_id IN (SELECT id FROM v_offers WHERE status = 'active')")
CART_ALL = f"""cart AS (SELECT user_id AS cart_id, offer_id, CAST(SUM(COALESCE(quantity, 1)) AS INTEGER) AS quantity,
    MIN(ts) AS created_at, MAX(ts) AS updated_at
  FROM v_cart_adds WHERE {VALID_ADD} GROUP BY user_id, offer_id)"""


def _adds(t, cond=None):
    a = t.v_cart_adds
    if cond is not None:
        a = a.where(cond)
    return a.select(F.col("user_id").alias("cart_id"), "offer_id", "quantity", "ts", "event_id")


def _cart(t):
    empty = t.spark.createDataFrame([], CART_SCHEMA)
    return ch.cart_upsert(empty, _adds(t), t.v_offers)


@query("cart_upsert", ["v_cart_adds", "v_offers"], f"WITH {CART_ALL} SELECT * FROM cart")
def cart_upsert(t):
    """Cart built from the adds before the split, then the later adds merged in."""
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    empty = t.spark.createDataFrame([], CART_SCHEMA)
    base = ch.cart_upsert(empty, _adds(t, F.col("ts") < split), t.v_offers)
    return ch.cart_upsert(base, _adds(t, F.col("ts") >= split), t.v_offers)


@query("cart_set_quantity", ["v_cart_adds", "v_offers", "v_cart_sets"], f"""
WITH {CART_ALL},
s AS (SELECT user_id AS cart_id, offer_id, quantity, ts,
    row_number() OVER (PARTITION BY user_id, offer_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM v_cart_sets WHERE offer_id IS NOT NULL AND offer_id > 0 AND quantity BETWEEN 1 AND 100)
SELECT c.cart_id, c.offer_id, CASE WHEN s.cart_id IS NOT NULL THEN s.quantity ELSE c.quantity END AS quantity,
  c.created_at, CASE WHEN s.cart_id IS NOT NULL THEN s.ts ELSE c.updated_at END AS updated_at
FROM cart c LEFT JOIN s ON s.cart_id = c.cart_id AND s.offer_id = c.offer_id AND s.rn = 1""")
def cart_set_quantity(t):
    sets = t.v_cart_sets.select(F.col("user_id").alias("cart_id"), "offer_id", "quantity", "ts", "event_id")
    return ch.cart_set_quantity(_cart(t), sets)


@query("cart_delete", ["v_cart_adds", "v_offers", "v_cart_deletes"], f"""
WITH {CART_ALL}
SELECT * FROM cart c WHERE NOT EXISTS (SELECT 1 FROM v_cart_deletes d
  WHERE d.user_id = c.cart_id AND d.offer_id = c.offer_id)""")
def cart_delete(t):
    dels = t.v_cart_deletes.select(F.col("user_id").alias("cart_id"), "offer_id")
    return ch.cart_delete(_cart(t), dels)


@query("cart_touch", ["v_cart_adds"], f"""
WITH b AS (SELECT user_id AS id, user_id, MAX(ts) AS updated_at FROM v_cart_adds WHERE ts < {SPLIT} GROUP BY user_id),
tt AS (SELECT user_id, MIN(ts) AS f, MAX(ts) AS l FROM v_cart_adds WHERE ts >= {SPLIT} GROUP BY user_id),
mx AS (SELECT COALESCE(MAX(id), 0) AS m FROM b)
SELECT b.id, b.user_id, COALESCE(tt.l, b.updated_at) AS updated_at FROM b LEFT JOIN tt ON tt.user_id = b.user_id
UNION ALL
SELECT mx.m + row_number() OVER (ORDER BY tt.f, tt.user_id), tt.user_id, tt.l
FROM tt CROSS JOIN mx WHERE tt.user_id NOT IN (SELECT user_id FROM b)""")
def cart_touch(t):
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    a = t.v_cart_adds
    carts = (a.where(F.col("ts") < split).groupBy("user_id").agg(F.max("ts").alias("updated_at"))
             .select(F.col("user_id").alias("id"), "user_id", "updated_at"))
    return ch.cart_touch(carts, a.where(F.col("ts") >= split).select("user_id", "ts"))


FAV_SCHEMA = "id bigint, user_id bigint, offer_id bigint, created_at timestamp_ntz"
FAV_ALL = """fav AS (SELECT event_id AS id, user_id, offer_id, ts AS created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, offer_id ORDER BY ts, event_id) AS rn
    FROM v_favorite_adds WHERE offer_id IS NOT NULL AND offer_id <> 0) x WHERE rn = 1)"""


def _fav_adds(t, cond=None):
    a = t.v_favorite_adds
    if cond is not None:
        a = a.where(cond)
    return a.select(F.col("event_id").alias("id"), "user_id", "offer_id", F.col("ts").alias("created_at"),
                    "event_id")


@query("favorites_add", ["v_favorite_adds"], f"WITH {FAV_ALL} SELECT * FROM fav")
def favorites_add(t):
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    empty = t.spark.createDataFrame([], FAV_SCHEMA)
    base = ch.favorites_add(empty, _fav_adds(t, F.col("ts") < split))
    return ch.favorites_add(base, _fav_adds(t, F.col("ts") >= split))


@query("favorites_delete", ["v_favorite_adds", "v_cart_deletes"], f"""
WITH {FAV_ALL}
SELECT * FROM fav f WHERE NOT EXISTS (SELECT 1 FROM v_cart_deletes d
  WHERE d.user_id = f.user_id AND d.offer_id = f.offer_id)""")
def favorites_delete(t):
    empty = t.spark.createDataFrame([], FAV_SCHEMA)
    fav = ch.favorites_add(empty, _fav_adds(t))
    return ch.favorites_delete(fav, t.v_cart_deletes.select("user_id", "offer_id"))


MAIN_IMG = """mi AS (SELECT o.id AS offer_id, COALESCE(m.image_url, 'default.png') AS image_url FROM v_offers o
  LEFT JOIN (SELECT offer_id, image_url, row_number() OVER (PARTITION BY offer_id
      ORDER BY is_main DESC NULLS FIRST, sort_order ASC NULLS LAST, id ASC) AS rn FROM v_offer_images) m
    ON m.offer_id = o.id AND m.rn = 1)"""
HEADER = "first_name, last_name, phone, email, delivery_method, address, city, district, payment_method"
HEADER_OUT = """h.first_name, h.last_name, h.phone, NULLIF(h.email, '') AS email, h.delivery_method,
  CASE WHEN h.delivery_method = 'home' THEN h.address END AS address, CASE WHEN h.delivery_method = 'home' THEN h.city END AS city,
  CASE WHEN h.delivery_method = 'home' THEN NULLIF(h.district, '') END AS district, h.payment_method"""
VALID_HEADER = """COALESCE(first_name, '') <> '' AND COALESCE(last_name, '') <> '' AND COALESCE(phone, '') <> ''
  AND COALESCE(delivery_method, '') <> '' AND COALESCE(payment_method, '') <> ''
  AND (delivery_method <> 'home' OR (COALESCE(address, '') <> '' AND COALESCE(city, '') <> ''))"""
GUEST = f"""refused AS (
  SELECT request_id FROM v_order_requests
  WHERE NOT (offer_id IS NOT NULL AND offer_id > 0 AND quantity IS NOT NULL AND quantity BETWEEN 1 AND 100)
  UNION SELECT request_id FROM v_order_requests r
  WHERE NOT EXISTS (SELECT 1 FROM v_offers o WHERE o.id = r.offer_id AND o.status = 'active')
  UNION SELECT request_id FROM v_order_headers WHERE NOT ({VALID_HEADER})),
{MAIN_IMG},
ok AS (SELECT r.*, o.product_name, o.new_price AS unit_price, mi.image_url FROM v_order_requests r
  JOIN v_offers o ON o.id = r.offer_id AND o.status = 'active' LEFT JOIN mi ON mi.offer_id = r.offer_id
  WHERE r.request_id NOT IN (SELECT request_id FROM refused)),
s AS (SELECT request_id, CAST(SUM(COALESCE(unit_price, 0) * CASE WHEN quantity IS NULL OR quantity = 0 THEN 1
    ELSE quantity END) AS DECIMAL(24,2)) AS subtotal FROM ok GROUP BY request_id),
n AS (SELECT (SELECT COALESCE(MAX(id), 0) FROM v_orders) + row_number() OVER (ORDER BY request_id) AS id,
    request_id, subtotal FROM s)"""
GUEST_VIEWS = ["v_order_requests", "v_order_headers", "v_offers", "v_offer_images", "v_orders"]


def _guest(t):
    return ch.order_place_guest(t.v_order_requests, t.v_offers, t.v_offer_images, t.v_orders, AS_OF, t.v_order_headers)


@query("order_place_guest", GUEST_VIEWS, f"""
WITH {GUEST}
SELECT n.id, n.request_id, {ref('REF', AS_OF.year, 'n.id')} AS reference, {HEADER_OUT}, n.subtotal,
  CAST(0 AS DECIMAL(24,2)) AS delivery_price, n.subtotal AS total, 'pending' AS status, {ts(0)} AS created_at
FROM n JOIN v_order_headers h ON h.request_id = n.request_id""")
def order_place_guest(t):
    return _guest(t)[0]


@query("order_place_guest_lines", GUEST_VIEWS, f"""
WITH {GUEST}
SELECT n.id AS order_id, ok.line_no, ok.offer_id, ok.product_name, ok.quantity, ok.unit_price, ok.image_url
FROM ok JOIN n ON n.request_id = ok.request_id""")
def order_place_guest_lines(t):
    return _guest(t)[1]


USER_ORDERS = f"""{CART_ALL}, {MAIN_IMG},
l AS (SELECT c.cart_id AS user_id, c.offer_id, c.quantity, o.product_name, o.new_price AS unit_price, mi.image_url,
    CAST(row_number() OVER (PARTITION BY c.cart_id ORDER BY c.created_at, c.offer_id) AS INTEGER) AS line_no
  FROM cart c JOIN v_offers o ON o.id = c.offer_id LEFT JOIN mi ON mi.offer_id = c.offer_id
  WHERE c.cart_id IN (SELECT user_id FROM v_user_headers WHERE {VALID_HEADER})),
s AS (SELECT user_id, CAST(SUM(COALESCE(unit_price, 0) * CASE WHEN quantity IS NULL OR quantity = 0 THEN 1
    ELSE quantity END) AS DECIMAL(24,2)) AS subtotal FROM l GROUP BY user_id),
n AS (SELECT (SELECT COALESCE(MAX(id), 0) FROM v_orders) + row_number() OVER (ORDER BY user_id) AS id,
    user_id, subtotal FROM s)"""
USER_VIEWS = ["v_cart_adds", "v_user_headers", "v_offers", "v_offer_images", "v_orders"]


def _user_orders(t):
    carts = t.v_cart_adds.select(F.col("user_id").alias("id"), "user_id").dropDuplicates(["id"])
    return ch.order_place_user(_cart(t), carts, t.v_offers, t.v_offer_images, t.v_orders, AS_OF, t.v_user_headers)


@query("order_place_user", USER_VIEWS, f"""
WITH {USER_ORDERS}
SELECT n.id, n.user_id, {ref('REF', AS_OF.year, 'n.id')} AS reference, {HEADER_OUT}, n.subtotal,
  CAST(0 AS DECIMAL(24,2)) AS delivery_price, n.subtotal AS total, 'pending' AS status, {ts(0)} AS created_at
FROM n JOIN v_user_headers h ON h.user_id = n.user_id""")
def order_place_user(t):
    return _user_orders(t)[0]


@query("order_place_user_lines", USER_VIEWS, f"""
WITH {USER_ORDERS}
SELECT n.id AS order_id, l.line_no, l.offer_id, l.product_name, l.quantity, l.unit_price, l.image_url
FROM l JOIN n ON n.user_id = l.user_id""")
def order_place_user_lines(t):
    return _user_orders(t)[1]


@query("order_status_apply", ["v_orders", "v_status_changes"], """
WITH c AS (SELECT order_id, status, ts, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM v_status_changes WHERE status IN ('pending', 'confirmed', 'processing', 'shipped', 'delivered', 'cancelled'))
SELECT o.id, o.user_id, o.first_name, o.last_name, o.phone, o.delivery_method, o.address, o.city, o.district,
  o.total, CASE WHEN c.order_id IS NOT NULL THEN c.status ELSE o.status END AS status, o.created_at,
  c.ts AS updated_at
FROM v_orders o LEFT JOIN c ON c.order_id = o.id AND c.rn = 1""")
def order_status_apply(t):
    return ch.order_status_apply(t.v_orders, t.v_status_changes)


@query("reference_number", ["v_offers"], f"SELECT id, {ref('REF', AS_OF.year, 'id')} AS reference FROM v_offers")
def reference_number(t):
    return ch.reference_numbers(t.v_offers, AS_OF)


@query("offer_defaults", ["v_offer_creates"], f"""
SELECT id, {ref('REF', AS_OF.year, 'id')} AS reference, product_name, category, description,
  CAST(NULL AS DECIMAL(14,2)) AS old_price, CAST(NULL AS INTEGER) AS discount, new_price,
  CAST(NULL AS DECIMAL(14,2)) AS wholesale_price, COALESCE(NULLIF(quantity, 0), 1) AS quantity,
  COALESCE(NULLIF(status, ''), 'active') AS status
FROM v_offer_creates
WHERE COALESCE(product_name, '') <> '' AND COALESCE(category, '') <> '' AND COALESCE(description, '') <> ''
  AND new_price IS NOT NULL AND new_price <> 0""")
def offer_defaults(t):
    return ch.offer_defaults(t.v_offer_creates.drop("offer_id"), AS_OF)


@query("offer_update_apply", ["v_offers", "v_offer_creates", "v_offer_images"], f"""
WITH RECURSIVE ok AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY ts, event_id) AS i
  FROM v_offer_creates WHERE {jt('product_name')} <> '' AND {jt('category')} <> ''
    AND new_price IS NOT NULL AND new_price > 0 AND offer_id IN (SELECT id FROM v_offers)),
st AS (
  SELECT offer_id, CAST(0 AS BIGINT) AS i, (SELECT COUNT(*) FROM v_offer_images m WHERE m.offer_id = o.offer_id) AS at, FALSE AS pass
  FROM (SELECT DISTINCT offer_id FROM ok) o
  UNION ALL
  SELECT st.offer_id, ok.i, CASE WHEN ok.new_images > 0 AND st.at + ok.new_images <= 8 THEN st.at + ok.new_images ELSE st.at END,
    ok.new_images <= 0 OR st.at + ok.new_images <= 8
  FROM st JOIN ok ON ok.offer_id = st.offer_id AND ok.i = st.i + 1),
u AS (SELECT ok.*, row_number() OVER (PARTITION BY ok.offer_id ORDER BY ok.i DESC) AS rn
  FROM ok JOIN st ON st.offer_id = ok.offer_id AND st.i = ok.i AND st.pass)
SELECT o.id,
  CASE WHEN u.offer_id IS NOT NULL THEN {jt('u.product_name')} ELSE o.product_name END AS product_name,
  CASE WHEN u.offer_id IS NOT NULL THEN {jt('u.category')} ELSE o.category END AS category,
  o.category_id,
  CASE WHEN u.offer_id IS NOT NULL THEN COALESCE(NULLIF(u.description, ''), '') ELSE o.description END AS description,
  CASE WHEN u.offer_id IS NOT NULL THEN CAST(u.new_price AS DECIMAL(14,2)) ELSE o.new_price END AS new_price,
  o.price,
  CASE WHEN u.offer_id IS NOT NULL THEN 0 ELSE o.discount END AS discount,
  CASE WHEN u.offer_id IS NOT NULL THEN COALESCE(NULLIF(u.quantity, 0), 0) ELSE o.quantity END AS quantity,
  CASE WHEN u.offer_id IS NOT NULL THEN COALESCE(NULLIF(u.status, ''), 'active') ELSE o.status END AS status,
  o.created_at
FROM v_offers o LEFT JOIN u ON u.offer_id = o.id AND u.rn = 1""")
def offer_update_apply(t):
    u = t.v_offer_creates.drop("id")
    return ch.offer_update_apply(t.v_offers, u, t.v_offer_images)


GENERATED = f"""im AS (SELECT request_id, pos, url, public_id, COALESCE(url LIKE 'https://res.cloudinary.com/%'
    AND starts_with(COALESCE(public_id, ''), 'shop/ai-generated/') AND strpos(public_id, '..') = 0, FALSE) AS ok FROM v_generated_images),
per AS (SELECT request_id, COUNT(*) AS n, bool_and(ok) AS every FROM im GROUP BY request_id),
r AS (SELECT q.* FROM v_generated_requests q LEFT JOIN per ON per.request_id = q.request_id
  WHERE COALESCE(product_name, '') <> '' AND COALESCE(category, '') <> '' AND COALESCE(description, '') <> '' AND new_price > 0
    AND COALESCE(per.n, 0) + n_files BETWEEN 1 AND 8 AND COALESCE(per.every, TRUE)),
made AS (SELECT (SELECT COALESCE(MAX(id), 0) FROM v_offers) + row_number() OVER (ORDER BY request_id) AS id, * FROM r)"""
GENERATED_VIEWS = ["v_generated_requests", "v_generated_images", "v_offers"]


@query("offer_create_generated", GENERATED_VIEWS, f"""
WITH {GENERATED}
SELECT id, request_id, {ref('REF', AS_OF.year, 'id')} AS reference, product_name, category, description, NULLIF(old_price, 0) AS old_price,
  COALESCE(NULLIF(discount, 0), 0) AS discount, new_price, wholesale_price, COALESCE(quantity, 0) AS quantity,
  COALESCE(NULLIF(status, ''), 'active') AS status FROM made""")
def offer_create_generated(t):
    return ch.offer_create_generated(t.v_generated_requests, t.v_generated_images, t.v_offers, AS_OF)[0]


@query("offer_create_generated_images", GENERATED_VIEWS, f"""
WITH {GENERATED},
p AS (SELECT made.id AS offer_id, im.public_id, im.url AS image_url,
    CAST(row_number() OVER (PARTITION BY im.request_id ORDER BY im.pos) - 1 AS INTEGER) AS sort_order
  FROM im JOIN made ON made.request_id = im.request_id)
SELECT *, sort_order = 0 AS is_main FROM p""")
def offer_create_generated_images(t):
    return ch.offer_create_generated(t.v_generated_requests, t.v_generated_images, t.v_offers, AS_OF)[1]


@query("offer_delete_cascade", ["v_offers", "v_offer_images", "v_favorite_adds"], """
SELECT * FROM v_offer_images WHERE offer_id NOT IN (
  SELECT d.offer_id FROM v_favorite_adds d JOIN v_offers o ON o.id = d.offer_id WHERE d.event_id % 29 = 0)""")
def offer_delete_cascade(t):
    """Images left after deleting the offers named in the favourite events."""
    dels = t.v_favorite_adds.where("event_id % 29 = 0").select(F.col("offer_id").alias("id"))
    return ch.offer_delete_cascade(t.v_offers, t.v_offer_images, dels)[1]


@query("image_numbering", ["v_offer_images"], """
WITH u AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY id) - 1 AS i,
    COUNT(*) OVER (PARTITION BY offer_id) AS n FROM v_offer_images)
SELECT id, offer_id, image_url, CAST(i AS INTEGER) AS sort_order, i = 0 AS is_main FROM u WHERE n <= 8""")
def image_numbering(t):
    """The image rows taken as one upload batch per offer (create path)."""
    return ch.image_numbering(None, t.v_offer_images.drop("is_main", "sort_order"))


@query("main_image_reelect", ["v_offer_images", "v_cart_deletes"], """
WITH d AS (SELECT DISTINCT offer_id AS id FROM v_cart_deletes),
lost AS (SELECT DISTINCT offer_id FROM v_offer_images WHERE id IN (SELECT id FROM d) AND is_main),
lft AS (SELECT * FROM v_offer_images WHERE id NOT IN (SELECT id FROM d)),
fst AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY offer_id ORDER BY sort_order ASC NULLS LAST, id)
    AS rn FROM lft WHERE offer_id IN (SELECT offer_id FROM lost)) x WHERE rn = 1)
SELECT l.id, l.offer_id, l.image_url, CASE WHEN l.id IN (SELECT id FROM fst) THEN TRUE ELSE l.is_main END AS is_main,
  l.sort_order
FROM lft l""")
def main_image_reelect(t):
    """Images after deleting those whose id appears in the delete events."""
    dels = t.v_cart_deletes.select(F.col("offer_id").alias("id"))
    return ch.main_image_reelect(t.v_offer_images, dels)


@query("ad_defaults", ["v_ad_requests"], f"""
SELECT id, {jt('title')} AS title, NULLIF(link_url, '') AS link_url, COALESCE(NULLIF(width, 0), 170) AS width,
  COALESCE(NULLIF(height, 0), 108) AS height, COALESCE(NULLIF(display_order, 0), 0) AS display_order,
  COALESCE(is_active <> 'false', TRUE) AS is_active, starts_at, ends_at
FROM v_ad_requests WHERE {jt('title')} <> ''""")
def ad_defaults(t):
    return ch.ad_defaults(t.v_ad_requests)


@query("ad_update_apply", ["v_site_ads", "v_ad_updates"], f"""
WITH u AS (SELECT * FROM v_ad_updates)
SELECT a.id,
  CASE WHEN u.id IS NOT NULL THEN COALESCE(NULLIF({jt('u.title')}, ''), a.title) ELSE a.title END AS title,
  CASE WHEN u.id IS NOT NULL THEN NULLIF(u.link_url, '') ELSE a.link_url END AS link_url,
  COALESCE(NULLIF(u.width, 0), a.width) AS width, COALESCE(NULLIF(u.height, 0), a.height) AS height,
  CASE WHEN u.id IS NOT NULL THEN COALESCE(NULLIF(u.display_order, 0), a.display_order) ELSE a.display_order END
    AS display_order,
  CASE WHEN u.id IS NOT NULL THEN COALESCE(u.is_active, '') <> 'false' ELSE a.is_active END AS is_active,
  CASE WHEN u.id IS NOT NULL THEN u.starts_at ELSE a.starts_at END AS starts_at,
  CASE WHEN u.id IS NOT NULL THEN u.ends_at ELSE a.ends_at END AS ends_at,
  a.created_at
FROM v_site_ads a LEFT JOIN u ON u.id = a.id""")
def ad_update_apply(t):
    return ch.ad_update_apply(t.v_site_ads, t.v_ad_updates, AS_OF)


@query("ad_delete", ["v_site_ads", "v_status_changes"], "SELECT * FROM v_site_ads WHERE id NOT IN (SELECT order_id FROM v_status_changes)")
def ad_delete(t):
    """Ads left after a batch of deletes (unknown ids delete nothing)."""
    return ch.ad_delete(t.v_site_ads, t.v_status_changes.select(F.col("order_id").alias("id")))


@query("cart_delete_owner", ["v_cart_adds", "v_offers", "v_cart_deletes"], f"""
WITH {CART_ALL} SELECT * FROM cart WHERE cart_id NOT IN (SELECT user_id FROM v_cart_deletes WHERE event_id % 3 = 0)""")
def cart_delete_owner(t):
    """Carts left after emptying those of the owners in a batch."""
    gone = t.v_cart_deletes.where("event_id % 3 = 0").select(F.col("user_id").alias("cart_id"))
    return ch.cart_delete(_cart(t), gone, by_owner=True)


@query("favorites_added", ["v_favorite_adds"], f"""
WITH old AS (SELECT DISTINCT user_id, offer_id FROM v_favorite_adds WHERE ts < {SPLIT} AND offer_id IS NOT NULL AND offer_id <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, offer_id ORDER BY ts, event_id) AS rn FROM v_favorite_adds
  WHERE ts >= {SPLIT} AND offer_id IS NOT NULL AND offer_id <> 0)
SELECT a.event_id, a.user_id, a.offer_id, a.rn = 1 AND old.user_id IS NULL AS added
FROM a LEFT JOIN old ON old.user_id = a.user_id AND old.offer_id = a.offer_id""")
def favorites_added(t):
    """The answer to each add request of a batch: whether it put something new into the list."""
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = ch.favorites_add(t.spark.createDataFrame([], FAV_SCHEMA), _fav_adds(t, F.col("ts") < split))
    return ch.favorites_added(old, _fav_adds(t, F.col("ts") >= split)).select("event_id", "user_id", "offer_id", "added")


PARSED = f"""p AS (SELECT event_id, ts, full_name, identifier, lower({jt('identifier')}) AS v FROM v_registration_requests),
q AS (SELECT *, CASE WHEN strpos(v, '@') > 0 THEN v END AS email,
    CASE WHEN strpos(v, '@') = 0 THEN {phone('identifier')} END AS phone FROM p),
q2 AS (SELECT *, CASE WHEN email IS NOT NULL THEN {email_ok('email')} ELSE phone IS NOT NULL END AS valid FROM q),
conf AS (SELECT DISTINCT q2.event_id, u.id AS user_id FROM q2 JOIN v_users u ON lower(u.email) = q2.email
  UNION SELECT DISTINCT q2.event_id, u.id FROM q2 JOIN v_users u ON u.phone = q2.phone)"""


@query("identity_conflicts", ["v_registration_requests", "v_users"], f"WITH {PARSED} SELECT * FROM conf")
def identity_conflicts(t):
    probes = ch.parse_identifier(t.v_registration_requests)
    return ch.identity_conflicts(t.v_users, probes)


@query("identity_register", ["v_registration_requests", "v_users"], f"""
WITH {PARSED},
ok AS (SELECT * FROM q2 WHERE valid AND length({jt('full_name')}) BETWEEN 1 AND 150
  AND event_id NOT IN (SELECT event_id FROM conf)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY COALESCE('e:' || email, 'p:' || phone)
    ORDER BY ts, event_id) AS rn FROM ok) x WHERE rn = 1)
SELECT (SELECT COALESCE(MAX(id), 0) FROM v_users) + row_number() OVER (ORDER BY ts, event_id) AS id, event_id,
  {jt('full_name')} AS full_name, email, phone, ts AS created_at
FROM f""")
def identity_register(t):
    return ch.identity_register(t.v_users, t.v_registration_requests)


# The updates one by one: phones that several users hold or ask for, their holders and the users' phones
# of that kind are carried from row to row; all other phones can refuse nobody.
PROFILES = f"""RECURSIVE u AS (SELECT *, {phone('phone')} AS np FROM v_profile_updates),
ok AS MATERIALIZED (SELECT * FROM u WHERE {jt('full_name')} <> '' AND (phone IS NULL OR phone = '' OR np IS NOT NULL)
  AND user_id IN (SELECT id FROM v_users)),
cl AS MATERIALIZED (SELECT id AS user_id, phone AS np FROM v_users WHERE phone IS NOT NULL
  UNION SELECT user_id, np FROM ok WHERE np IS NOT NULL),
sh AS MATERIALIZED (SELECT np FROM cl GROUP BY np HAVING COUNT(*) > 1),
q AS MATERIALIZED (SELECT event_id, user_id, CASE WHEN np IN (SELECT np FROM sh) THEN np END AS sp,
    row_number() OVER (ORDER BY ts, event_id) AS rn FROM ok WHERE user_id IN (SELECT user_id FROM cl WHERE np IN (SELECT np FROM sh))),
st AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, TRUE AS pass,
    (SELECT map_from_entries(list((phone, id))) FROM v_users WHERE phone IN (SELECT np FROM sh)) AS holder,
    (SELECT map_from_entries(list((id, phone))) FROM v_users WHERE phone IN (SELECT np FROM sh)) AS own
  UNION ALL
  SELECT i, event_id, pass,
    CASE WHEN NOT pass OR (sp IS NOT DISTINCT FROM own[user_id]) THEN holder
      ELSE map_concat(holder, CASE WHEN own[user_id] IS NOT NULL THEN map([own[user_id]], [CAST(-1 AS BIGINT)]) ELSE holder END,
                      CASE WHEN sp IS NOT NULL THEN map([sp], [user_id]) ELSE map([''], [CAST(-1 AS BIGINT)]) END) END,
    CASE WHEN NOT pass THEN own ELSE map_concat(own, map([user_id], [sp])) END
  FROM (SELECT q.rn AS i, q.event_id, q.user_id, q.sp, st.holder, st.own,
      q.sp IS NULL OR COALESCE(st.holder[q.sp], -1) IN (-1, q.user_id) AS pass
    FROM st JOIN q ON q.rn = st.i + 1) x),
acc AS (SELECT ok.* FROM ok WHERE event_id NOT IN (SELECT event_id FROM st WHERE event_id IS NOT NULL AND NOT pass))"""


@query("profile_update_apply", ["v_user_profiles", "v_users", "v_profile_updates"], f"""
WITH {PROFILES},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM acc) x WHERE rn = 1)
SELECT v.id, CASE WHEN l.user_id IS NOT NULL THEN {jt('l.full_name')} ELSE v.full_name END AS full_name, v.email,
  CASE WHEN l.user_id IS NOT NULL THEN l.np ELSE v.phone END AS phone, v.created_at,
  CASE WHEN l.user_id IS NULL THEN v.gender WHEN COALESCE(l.gender, '') <> '' THEN {jt('l.gender')} END AS gender,
  CASE WHEN l.user_id IS NULL THEN v.address WHEN COALESCE(l.address, '') <> '' THEN {jt('l.address')} END AS address,
  l.ts AS updated_at
FROM v_user_profiles v LEFT JOIN last l ON l.user_id = v.id""")
def profile_update_apply(t):
    return ch.profile_update_apply(t.v_user_profiles, t.v_profile_updates)


@query("profile_updates_accepted", ["v_users", "v_profile_updates"], f"""
WITH {PROFILES}
SELECT event_id, user_id, np AS phone FROM acc""")
def profile_updates_accepted(t):
    """Which updates pass when they are applied one by one."""
    return ch.profile_updates_accepted(t.v_users, t.v_profile_updates).select("event_id", "user_id", F.col("_phone").alias("phone"))


@query("tokens_valid", ["v_reset_tokens", "v_token_probes"], """
SELECT * FROM v_token_probes p WHERE EXISTS (SELECT 1 FROM v_reset_tokens t
  WHERE t.user_id = p.user_id AND t.token_hash = p.token_hash AND t.expires_at > TIMESTAMP '2024-01-16 00:00:00')""")
def tokens_valid(t):
    return ch.tokens_valid(t.v_reset_tokens, t.v_token_probes, "2024-01-16 00:00:00")
