"""Catalogue keys."""

from __future__ import annotations

from ..operators import catalog
from .registry import AS_OF, DAYS, query, ts

OFFER_COLS = "id, product_name, category, description, discount, new_price, quantity, status, created_at"
SELLABLE = "status = 'active' AND quantity > 0"
IMG_RANKED = """SELECT offer_id, CAST(row_number() OVER (PARTITION BY offer_id
      ORDER BY sort_order ASC NULLS LAST, id ASC) - 1 AS INTEGER) AS image_pos,
    id AS image_id, image_url, is_main, sort_order FROM v_offer_images"""
FLAT_IMAGES = "img.image_pos, img.image_id, img.image_url, img.is_main, img.sort_order"


@query("offers_page", ["v_offers", "v_offer_images"], f"""
WITH pg AS (SELECT {OFFER_COLS}, row_number() OVER (ORDER BY discount DESC NULLS LAST, created_at DESC NULLS FIRST, id DESC) - 1
    AS position FROM v_offers WHERE {SELLABLE} ORDER BY position LIMIT 1000000 OFFSET 0),
img AS ({IMG_RANKED})
SELECT pg.*, {FLAT_IMAGES} FROM pg LEFT JOIN img ON img.offer_id = pg.id""")
def offers_page(t):
    """Whole default page (limit 1,000,000), sort by discount, images flat."""
    return catalog.offers_page(t.v_offers, t.v_offer_images, sort="discount", nested=False)


@query("offers_page_info", ["v_offers"], f"""
WITH c AS (SELECT COUNT(*) AS total FROM v_offers WHERE {SELLABLE}
  AND (product_name ILIKE '%red%' OR category ILIKE '%red%' OR description ILIKE '%red%'))
SELECT 3 AS page, 400 AS "limit", total, 800 + LEAST(400, GREATEST(total - 800, 0)) < total AS has_more FROM c""")
def offers_page_info(t):
    return catalog.offers_page_info(t.v_offers, page=3, limit=400, search=" RED ")


@query("offers_page_window", ["v_offers"], f"""
SELECT {OFFER_COLS}, row_number() OVER (ORDER BY new_price ASC NULLS LAST, id DESC) - 1 AS position
FROM v_offers WHERE {SELLABLE} ORDER BY position LIMIT 400 OFFSET 800""")
def offers_page_window(t):
    """Page 3 of 400 by ascending price (the offset/limit path), no images."""
    return catalog.offers_page(t.v_offers, t.v_offer_images, page=3, limit=400, sort="price-low",
                               nested=True).drop("images")


@query("offers_search", ["v_offers"], f"""
SELECT {OFFER_COLS} FROM v_offers WHERE {SELLABLE}
  AND (product_name ILIKE '%sma_l%' OR category ILIKE '%sma_l%' OR description ILIKE '%sma_l%')""")
def offers_search(t):
    """Search with a user '_' acting as a wildcard; category 'all' = no filter."""
    return catalog.offers_filter(t.v_offers, category="all", search="  Sma_l ").select(
        *OFFER_COLS.split(", "))


@query("offers_by_category", ["v_offers"], f"""
SELECT {OFFER_COLS} FROM v_offers WHERE {SELLABLE} AND category = 'PROMO'""")
def offers_by_category(t):
    """Sellable offers of exactly one category (trimmed parameter)."""
    return catalog.offers_filter(t.v_offers, category=" PROMO ").select(*OFFER_COLS.split(", "))


@query("offer_detail", ["v_offers", "v_offer_images"], f"""
WITH img AS ({IMG_RANKED})
SELECT o.id, o.product_name, o.category, o.description, o.discount, o.new_price, o.quantity, o.status,
  o.created_at, {FLAT_IMAGES}
FROM v_offers o LEFT JOIN img ON img.offer_id = o.id WHERE o.{SELLABLE.replace(' AND ', ' AND o.')}""")
def offer_detail(t):
    return catalog.offer_detail(t.v_offers, t.v_offer_images, nested=False)


@query("main_image", ["v_offers", "v_offer_images"], """
SELECT o.id AS offer_id, COALESCE(m.image_url, 'default.png') AS image_url
FROM v_offers o LEFT JOIN (SELECT offer_id, image_url, row_number() OVER (PARTITION BY offer_id
    ORDER BY is_main DESC NULLS FIRST, sort_order ASC NULLS LAST, id ASC) AS rn FROM v_offer_images) m
  ON m.offer_id = o.id AND m.rn = 1""")
def main_image(t):
    return catalog.main_image(t.v_offers, t.v_offer_images)


@query("images_per_offer", ["v_offers", "v_offer_images"], """
SELECT o.id AS offer_id, CAST(COALESCE(n.c, 0) AS INTEGER) AS images
FROM v_offers o LEFT JOIN (SELECT offer_id, COUNT(*) AS c FROM v_offer_images GROUP BY offer_id) n
  ON n.offer_id = o.id""")
def images_per_offer(t):
    return catalog.images_per_offer(t.v_offers, t.v_offer_images)


@query("categories_distinct", ["v_offers"], """
SELECT DISTINCT category FROM v_offers WHERE category IS NOT NULL AND TRIM(category) <> '' ORDER BY category""")
def categories_distinct(t):
    return catalog.categories_distinct(t.v_offers)


@query("term_search", ["v_search_terms", "v_offers"], f"""
WITH m AS (SELECT DISTINCT s.query_id, o.id AS offer_id, o.created_at
  FROM v_search_terms s JOIN v_offers o ON o.status = 'active' AND o.quantity > 0
   AND (o.product_name ILIKE '%' || s.term || '%' OR o.category ILIKE '%' || s.term || '%'
        OR o.description ILIKE '%' || s.term || '%')),
r AS (SELECT query_id, offer_id, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY created_at DESC NULLS FIRST, offer_id DESC) AS INTEGER) AS rank FROM m)
SELECT query_id, offer_id, rank FROM r WHERE rank <= 20""")
def term_search(t):
    return catalog.term_search(t.v_search_terms, t.v_offers, top=20)


TRIM_X = "regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')"


@query("image_search", ["v_product_analyses", "v_offers"], f"""
WITH c AS (SELECT query_id, list_slice(list_filter(list_transform(list_filter(list_concat([product_name, category], search_terms),
      lambda x: x IS NOT NULL AND x <> ''), lambda x: {TRIM_X}), lambda x: length(x) >= 2), 1, 10) AS ts FROM v_product_analyses),
u AS (SELECT DISTINCT query_id, unnest(ts) AS term FROM c),
p AS (SELECT t.term, o.id, o.created_at FROM (SELECT DISTINCT term FROM u) t JOIN v_offers o ON o.status = 'active' AND o.quantity > 0
   AND (o.product_name ILIKE '%' || t.term || '%' OR o.category ILIKE '%' || t.term || '%' OR o.description ILIKE '%' || t.term || '%')),
m AS (SELECT DISTINCT u.query_id, p.id AS offer_id, p.created_at FROM u JOIN p ON p.term = u.term),
r AS (SELECT query_id, offer_id, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY created_at DESC NULLS FIRST, offer_id DESC) AS INTEGER) AS rank FROM m)
SELECT r.offer_id, r.query_id, r.rank, o.product_name, o.category, o.description, o.new_price, o.discount, o.quantity
FROM r JOIN v_offers o ON o.id = r.offer_id WHERE r.rank <= 20""")
def image_search(t):
    """Terms of every product analysis cleaned, then the newest matching offers with their columns."""
    return catalog.image_search(t.v_product_analyses, t.v_offers)


@query("ads_list", ["v_site_ads"], """
SELECT * FROM v_site_ads ORDER BY display_order ASC NULLS LAST, created_at DESC NULLS FIRST, id""")
def ads_list(t):
    return catalog.ads_list(t.v_site_ads)


_ACTIVE = "is_active AND (starts_at IS NULL OR starts_at <= {n}) AND (ends_at IS NULL OR ends_at >= {n})"


@query("ads_active", ["v_site_ads"], f"""
SELECT id, title, link_url, width, height, display_order, created_at FROM v_site_ads WHERE {_ACTIVE.format(n=ts(0))}
ORDER BY display_order, created_at DESC, id""")
def ads_active(t):
    return catalog.ads_active(t.v_site_ads, AS_OF)


@query("ads_active_daily", ["v_site_ads"], f"""
WITH dates AS (SELECT CAST(generate_series AS DATE) AS date FROM generate_series({ts(-(DAYS - 1))}, {ts(0)}, INTERVAL 1 DAY))
SELECT dates.date, a.id AS ad_id, a.display_order FROM dates JOIN v_site_ads a
  ON {_ACTIVE.format(n='CAST(dates.date AS TIMESTAMP)').replace('is_active', 'a.is_active').replace('starts_at', 'a.starts_at').replace('ends_at', 'a.ends_at')}""")
def ads_active_daily(t):
    return catalog.ads_active_daily(t.spark, t.v_site_ads, AS_OF, DAYS)
