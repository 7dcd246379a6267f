"""Stock keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stock
from .registry import AS_OF, query, ts
from .sqlbits import jt

LINE_ORDER = ["line_no", "offer_id", "tie1", "quantity", "line_total"]
AVAIL = "GREATEST(COALESCE(o.quantity, 0) - p.prior, 0)"
CHECKED = f"""bad AS (SELECT DISTINCT ii.invoice_id FROM v_invoice_items ii LEFT JOIN v_offers o ON o.id = ii.offer_id
  WHERE o.id IS NULL),
li AS (SELECT ii.*, GREATEST(1, COALESCE(NULLIF(ii.quantity, 0), 1)) AS requested FROM v_invoice_items ii
  WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.invoice_id = ii.invoice_id)),
g AS (SELECT offer_id, invoice_id, created_at, SUM(requested) AS demand FROM li
  GROUP BY offer_id, invoice_id, created_at),
p AS (SELECT offer_id, invoice_id, COALESCE(SUM(demand) OVER (PARTITION BY offer_id ORDER BY created_at, invoice_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM g),
c AS (SELECT li.offer_id, li.invoice_id, li.created_at, li.line_no, li.tie1, li.quantity, li.line_total,
    li.requested, o.product_name AS offer_product_name, CAST({AVAIL} AS BIGINT) AS available,
    li.requested > {AVAIL} AS alert,
    CASE WHEN li.requested > {AVAIL} THEN CAST(li.requested - {AVAIL} AS BIGINT) END AS missing
  FROM li JOIN p ON p.offer_id = li.offer_id AND p.invoice_id = li.invoice_id
  JOIN v_offers o ON o.id = li.offer_id)"""
VIEWS = ["v_invoice_items", "v_offers"]


def _checked(t):
    return stock.invoice_stock_check(t.v_invoice_items, t.v_offers)


@query("invoice_stock_check", VIEWS, f"WITH {CHECKED} SELECT * FROM c")
def invoice_stock_check(t):
    """Every line of the valid invoices with the stock it saw and its alert."""
    return _checked(t)


NOTE = ("'⚠️ Stock insuffisant — ' || offer_product_name || ' : ' || CAST(available AS VARCHAR)"
        " || ' disponible(s), ' || CAST(requested AS VARCHAR) || ' demandé(s), manque '"
        " || CAST(missing AS VARCHAR) || '. Stock final : 0.'")


@query("invoice_admin_notes", VIEWS, f"""
WITH {CHECKED}
SELECT invoice_id, CASE WHEN bool_or(alert) THEN 'stock_insuffisant' ELSE 'verified' END AS stock_status,
  CAST(COUNT(*) FILTER (WHERE alert) AS INTEGER) AS n_alerts,
  string_agg(CASE WHEN alert THEN {NOTE} END, chr(10) ORDER BY line_no, offer_id, tie1, quantity, line_total)
    AS admin_note,
  NOT bool_or(alert) AS stock_alert_resolved, 'confirmed' AS status
FROM c GROUP BY invoice_id""")
def invoice_admin_notes(t):
    """Invoice header fields: status, alert count, admin note (C14)."""
    h = stock.invoice_stock_headers(_checked(t), LINE_ORDER)
    return h.drop("stock_alerts")


@query("invoice_alerts", VIEWS, f"""
WITH {CHECKED}
SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id
    ORDER BY line_no, offer_id, tie1, quantity, line_total) - 1 AS INTEGER) AS alert_pos,
  offer_id AS "offerId", offer_product_name AS "productName", CAST(requested AS INTEGER) AS requested,
  CAST(available AS INTEGER) AS available, CAST(missing AS INTEGER) AS missing, FALSE AS resolved
FROM c WHERE alert""")
def invoice_alerts(t):
    """The JSON alert array of each invoice, one row per element."""
    h = stock.invoice_stock_headers(_checked(t), LINE_ORDER)
    return h.select("invoice_id", F.posexplode("stock_alerts").alias("alert_pos", "a")) \
        .select("invoice_id", "alert_pos", "a.*")


@query("stock_after_invoices", VIEWS, f"""
WITH {CHECKED}, tot AS (SELECT offer_id, SUM(requested) AS t FROM li GROUP BY offer_id)
SELECT o.id, o.product_name, o.category, o.category_id, o.description, o.new_price, o.price, o.discount,
  CASE WHEN tot.t IS NOT NULL THEN CAST(GREATEST(o.quantity - tot.t, 0) AS INTEGER) ELSE o.quantity END
    AS quantity, o.status, o.created_at
FROM v_offers o LEFT JOIN tot ON tot.offer_id = o.id""")
def stock_after_invoices(t):
    return stock.stock_after_invoices(t.v_invoice_items, t.v_offers)


@query("invoice_items_priced", VIEWS, f"""
WITH {CHECKED}
SELECT invoice_id, created_at, offer_id, line_no, tie1, GREATEST(1, COALESCE(NULLIF(quantity, 0), 1)) AS quantity,
  CAST(GREATEST(0, COALESCE(NULLIF(line_total, 0), 0)) AS DECIMAL(14,2)) AS unit_price,
  CAST(GREATEST(0, COALESCE(NULLIF(line_total, 0), 0)) * GREATEST(1, COALESCE(NULLIF(quantity, 0), 1))
    AS DECIMAL(24,2)) AS total_price
FROM li""")
def invoice_items_priced(t):
    lines = stock.valid_invoice_lines(t.v_invoice_items, t.v_offers) \
        .withColumnRenamed("line_total", "unit_price")
    out = stock.invoice_items_priced(lines)
    return out.withColumn("unit_price", F.col("unit_price").cast("decimal(14,2)"))


ALERT_LIST = """list({{'offerId': c.offer_id, 'productName': c.offer_product_name, 'requested': CAST(c.requested AS INTEGER),
    'available': CAST(c.available AS INTEGER), 'missing': CAST(c.missing AS INTEGER), 'resolved': {r}}}
    ORDER BY line_no, c.offer_id, tie1, c.quantity, line_total) FILTER (WHERE c.alert)"""


@query("stock_alert_resolution", VIEWS, f"""
WITH {CHECKED},
inv AS (SELECT c.invoice_id AS id, bool_or(c.alert) AS has,
    bool_and(o.id IS NOT NULL AND COALESCE(o.quantity, 0) >= c.missing) FILTER (WHERE c.alert) AS ok,
    {ALERT_LIST.format(r='FALSE')} AS al, {ALERT_LIST.format(r='TRUE')} AS al2
  FROM c LEFT JOIN v_offers o ON o.id = c.offer_id GROUP BY c.invoice_id)
SELECT id, NOT has OR ok AS stock_alert_resolved, CASE WHEN has AND ok THEN {ts(0)} END AS stock_alert_resolved_at,
  CAST(to_json(CASE WHEN NOT has THEN [] WHEN ok THEN al2 ELSE al END) AS VARCHAR) AS stock_alerts
FROM inv""")
def stock_alert_resolution(t):
    """Invoices of the batch re-checked against restocked offers (v_offers)."""
    h = stock.invoice_stock_headers(_checked(t), LINE_ORDER).withColumnRenamed("invoice_id", "id")
    h = h.select("id", "stock_alerts", "stock_alert_resolved")
    r = stock.stock_alert_resolution(h, t.v_offers, AS_OF)
    return r.select("id", "stock_alert_resolved", "stock_alert_resolved_at", F.to_json("stock_alerts").alias("stock_alerts"))


CREATE_VIEWS = ["v_invoice_requests", "v_known_invoices", "v_invoice_items", "v_offers"]
ADMITTED = """adm AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY number ORDER BY r.created_at, r.invoice_id) AS rn
    FROM v_invoice_requests r WHERE COALESCE(number, '') <> ''
      AND EXISTS (SELECT 1 FROM v_invoice_items i WHERE i.invoice_id = r.invoice_id)
      AND NOT EXISTS (SELECT 1 FROM v_invoice_items i LEFT JOIN v_offers o ON o.id = i.offer_id WHERE i.invoice_id = r.invoice_id AND o.id IS NULL)
      AND number NOT IN (SELECT invoice_number FROM v_known_invoices)) x WHERE rn = 1)"""
CREATED = ADMITTED + ", " + CHECKED.replace("FROM v_invoice_items ii\n  WHERE NOT EXISTS", "FROM v_invoice_items ii\n  WHERE ii.invoice_id IN (SELECT invoice_id FROM adm) AND NOT EXISTS")


def _created(t):
    return stock.invoice_create(t.v_invoice_requests, t.v_invoice_items, t.v_offers, t.v_known_invoices, LINE_ORDER)


@query("invoice_create", CREATE_VIEWS, f"""
WITH {CREATED},
h AS (SELECT invoice_id, bool_or(alert) AS has,
    string_agg(CASE WHEN alert THEN {NOTE} END, chr(10) ORDER BY line_no, offer_id, tie1, quantity, line_total) AS admin_note
  FROM c GROUP BY invoice_id)
SELECT (SELECT COALESCE(MAX(id), 0) FROM v_known_invoices) + row_number() OVER (ORDER BY a.created_at, a.invoice_id) AS id, a.invoice_id,
  a.number AS invoice_number, NULLIF(customer_name, '') AS customer_name, NULLIF(customer_phone, '') AS customer_phone,
  NULLIF(customer_address, '') AS customer_address, COALESCE(subtotal, 0) AS subtotal, COALESCE(discount, 0) AS discount,
  COALESCE(total, 0) AS total, COALESCE(amount_received, 0) AS amount_received, COALESCE(change_amount, 0) AS change_amount,
  COALESCE(NULLIF(payment_method, ''), 'Espèces') AS payment_method, NULLIF(note, '') AS note, h.admin_note,
  CASE WHEN h.has THEN 'stock_insuffisant' ELSE 'verified' END AS stock_status, NOT h.has AS stock_alert_resolved,
  'confirmed' AS status, a.created_at
FROM adm a JOIN h ON h.invoice_id = a.invoice_id""")
def invoice_create(t):
    """Invoices of a batch: admission by number first, then the stock check among the admitted."""
    return _created(t)[0].drop("stock_alerts")


@query("invoice_create_lines", CREATE_VIEWS, f"WITH {CREATED} SELECT * FROM c")
def invoice_create_lines(t):
    return _created(t)[1]


@query("stock_after_events", ["v_invoice_items", "v_offers", "v_offer_creates"], f"""
WITH {CHECKED},
sets AS (SELECT offer_id, ts, event_id, COALESCE(NULLIF(quantity, 0), 0) AS quantity FROM v_offer_creates
  WHERE {jt('product_name')} <> '' AND {jt('category')} <> '' AND new_price IS NOT NULL AND new_price > 0),
last AS (SELECT offer_id, quantity, ts FROM (SELECT *, row_number() OVER (PARTITION BY offer_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM sets) x WHERE rn = 1),
dec AS (SELECT li.offer_id, SUM(li.requested) AS d FROM li LEFT JOIN last ON last.offer_id = li.offer_id
  WHERE last.ts IS NULL OR li.created_at >= last.ts GROUP BY li.offer_id)
SELECT o.id, o.product_name, o.category, o.category_id, o.description, o.new_price, o.price, o.discount,
  CAST(CASE WHEN dec.d IS NOT NULL
    THEN GREATEST(CASE WHEN last.ts IS NOT NULL THEN last.quantity ELSE o.quantity END - dec.d, 0)
    ELSE CASE WHEN last.ts IS NOT NULL THEN last.quantity ELSE o.quantity END END AS INTEGER) AS quantity,
  o.status, o.created_at
FROM v_offers o LEFT JOIN last ON last.offer_id = o.id LEFT JOIN dec ON dec.offer_id = o.id""")
def stock_after_events(t):
    """Stock after the invoice decrements and the offer updates' quantity sets, in time order."""
    from ..functions.exprs import blank_to_null
    lines = stock.valid_invoice_lines(t.v_invoice_items, t.v_offers)
    demand = lines.select("offer_id", F.col("created_at").alias("ts"),
                          stock.requested_qty("quantity").alias("requested"))
    u = t.v_offer_creates
    ok = (blank_to_null("product_name").isNotNull() & blank_to_null("category").isNotNull()
          & F.col("new_price").isNotNull() & (F.col("new_price") > 0))
    sets = u.where(ok).select("offer_id", "ts", "event_id",
                              F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(0)).alias("quantity"))
    return stock.stock_after_events(t.v_offers, demand, sets)
