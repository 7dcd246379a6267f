"""Entity views derived from the driver tables.

Fixed values: the SQL below is the test-fixture mapping of FIXTURES.md §2
(driver tables -> marketplace entities).  It is plain SQL accepted by both
Spark and DuckDB, so the Spark side and the oracle side read the very same
derived rows.  Placeholders: ``{table}`` is a source table or another view,
``{TS}`` is the zone-free timestamp type of the dialect (TIMESTAMP_NTZ in
Spark, TIMESTAMP in DuckDB); literal braces are doubled.
"""

from __future__ import annotations

import re
import string

VIEWS: dict[str, str] = {
    "v_orders": """
SELECT o_orderkey AS id,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS user_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'F' || CAST(o_custkey % 50 AS STRING) END AS first_name,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'L' || CAST(o_custkey % 70 AS STRING) END AS last_name,
  '77' || substr(CAST(10000000 + o_custkey AS STRING), 2) AS phone,
  CASE WHEN o_orderkey % 3 = 0 THEN 'pickup' ELSE 'home' END AS delivery_method,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Rue ' || CAST(o_orderkey % 100 AS STRING) END AS address,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'City' || CAST(o_custkey % 5 AS STRING) END AS city,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'D' || CAST(o_custkey % 8 AS STRING) END AS district,
  CAST(o_totalprice AS DECIMAL(14,2)) AS total,
  CASE o_orderstatus || substr(o_orderpriority, 1, 1)
    WHEN 'F1' THEN 'Delivered' WHEN 'F2' THEN 'completed' WHEN 'F3' THEN 'livré'
    WHEN 'F4' THEN 'cancelled' WHEN 'F5' THEN 'delivery_failed'
    WHEN 'P1' THEN 'shipping' WHEN 'P2' THEN 'in_delivery' WHEN 'P3' THEN 'en livraison'
    WHEN 'P4' THEN 'CANCELLED' WHEN 'P5' THEN NULL
    WHEN 'O1' THEN 'pending' WHEN 'O2' THEN 'processing' WHEN 'O3' THEN 'confirmed'
    WHEN 'O4' THEN 'en attente' ELSE 'refunded' END AS status,
  o_orderdate AS created_at
FROM {orders}""",
    "v_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS offer_id, l_linenumber AS line_no, l_suppkey AS tie1,
  CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(14,2)) AS line_total
FROM {lineitem}""",
    "v_offers": """
SELECT p_partkey AS id, p_name AS product_name,
  CASE WHEN p_partkey % 40 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN '  ' ELSE p_type END AS category,
  CAST(p_size % 30 AS BIGINT) AS category_id, p_brand AS description,
  CAST(p_retailprice AS DECIMAL(14,2)) AS new_price, CAST(p_retailprice AS DECIMAL(14,2)) AS price,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS discount,
  greatest(p_size * 10 - 20, 0) AS quantity,
  CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 'inactive' WHEN 1 THEN 'Deleted' ELSE 'active' END AS status,
  CAST(DATE '2001-01-01' + CAST(p_partkey % 200 AS INT) AS {TS}) AS created_at
FROM {part}""",
    "v_categories": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}""",
    "v_offer_images": """
SELECT page_id AS id, page_id % (SELECT CAST(floor(COUNT(*) / 40) AS BIGINT) + 1 FROM {part}) AS offer_id, url AS image_url,
  CASE WHEN page_id % 7 = 0 THEN TRUE WHEN page_id % 11 = 0 THEN NULL ELSE FALSE END AS is_main,
  CAST(page_id % 4 AS INT) AS sort_order
FROM {pages}""",
    "v_users": """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN '' ELSE replace(c_name, '#', ' ') END AS full_name,
  'u' || CAST(c_custkey AS STRING) || '@example.com' AS email,
  '77' || substr(CAST(10000000 + c_custkey AS STRING), 2) AS phone,
  CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INT) AS {TS}) AS created_at
FROM {customer}""",
    "v_cart_adds": """
SELECT event_id, user_id, event_id % (SELECT CAST(floor(COUNT(*) / 40) AS BIGINT) + 1 FROM {part}) AS offer_id,
  CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS quantity, ts
FROM {events} WHERE event_type = 'click'""",
    "v_favorite_adds": """
SELECT event_id, user_id, event_id % (SELECT CAST(floor(COUNT(*) / 40) AS BIGINT) + 1 FROM {part}) AS offer_id, ts FROM {events} WHERE event_type = 'view'""",
    "v_contact_messages": """
SELECT conv_id * 10 + turn AS id,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'C' || CAST(conv_id AS STRING) END AS first_name,
  'T' || CAST(turn AS STRING) AS last_name, 'c' || CAST(conv_id AS STRING) || '@example.com' AS email,
  text AS message, 'unread' AS status,
  CAST(DATE '2001-01-01' + CAST(conv_id % 150 AS INT) AS {TS}) AS created_at
FROM {conversations} WHERE role = 'assistant'""",
    "v_negotiations": """
SELECT conv_id * 10 + turn AS id, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id END AS user_id,
  conv_id * 4 AS offer_id, CAST(45 + turn * 3 AS INT) AS quantity,
  CASE WHEN turn % 2 = 0 THEN '' ELSE 'N' || CAST(conv_id AS STRING) END AS first_name,
  CASE WHEN turn % 4 = 0 THEN NULL ELSE 'P' END AS last_name,
  text AS message, 'unread' AS status,
  CAST(DATE '2001-02-01' + CAST(conv_id % 150 AS INT) AS {TS}) AS created_at
FROM {conversations} WHERE role = 'user'""",
    "v_invoices": """
SELECT id, 'INV-' || CAST(id AS STRING) AS invoice_number, total, created_at
FROM {v_orders} WHERE status IN ('Delivered', 'completed', 'livré')""",
    "v_invoice_items": """
SELECT i.id AS invoice_id, i.created_at, t.offer_id, t.line_no, t.tie1, t.quantity, t.line_total
FROM {v_order_items} t JOIN {v_invoices} i ON i.id = t.order_id""",
    "v_site_ads": """
SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://ads.example.com/' || s_name END AS link_url,
  CAST(100 + s_suppkey % 90 AS INT) AS width, CAST(60 + s_suppkey % 50 AS INT) AS height, CAST(s_suppkey % 6 AS INT) AS display_order,
  s_suppkey % 7 <> 0 AS is_active,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(DATE '2001-05-01' + CAST(s_suppkey % 90 AS INT) AS {TS}) END AS starts_at,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(DATE '2001-05-20' + CAST(s_suppkey % 90 AS INT) AS {TS}) END AS ends_at,
  CAST(DATE '2001-01-01' + CAST(s_suppkey % 100 AS INT) AS {TS}) AS created_at
FROM {supplier}""",
    "v_search_terms": """
SELECT DISTINCT p_brand || '/' || p_name AS query_id, p_name AS term FROM {part}
UNION
SELECT DISTINCT p_brand || '/' || p_name AS query_id, p_type AS term FROM {part}""",
    "v_registrations": """
SELECT event_id, ts,
  CASE CAST(event_id % 6 AS INT)
    WHEN 0 THEN '+221 77-' || substr(CAST(10000000 + user_id AS STRING), 2)
    WHEN 1 THEN '0022177' || substr(CAST(10000000 + user_id AS STRING), 2)
    WHEN 2 THEN ' U' || CAST(user_id AS STRING) || '@Example.com '
    WHEN 3 THEN 'bad' || CAST(user_id AS STRING)
    WHEN 4 THEN '(76) ' || substr(CAST(10000000 + user_id AS STRING), 2)
    ELSE 'u' || CAST(user_id AS STRING) || '@nodot' END AS identifier
FROM {events} WHERE event_type = 'signup'""",
    "v_llm_outputs": """
SELECT doc_id, 'Result: ```json {{"productName":' || CASE WHEN doc_id % 29 = 3 THEN '5' WHEN doc_id % 29 = 4 THEN '""' WHEN doc_id % 29 = 5 THEN 'null'
    ELSE '"P' || CAST(doc_id AS STRING) || '"' END || ',"category":' || CASE WHEN doc_id % 31 = 2 THEN '["' || lang || '"]' ELSE '"' || lang || '"' END
  || ',"description":' || CASE WHEN doc_id % 37 = 1 THEN '12' ELSE
    '"' || replace(replace(replace(replace(replace(text, chr(92), ' '), chr(34), ' '), chr(10), ' '), chr(13), ' '), chr(9), ' ') || '"' END
  || ',"confidence":' || CASE CAST(doc_id % 11 AS INT) WHEN 1 THEN '"0.25"' WHEN 2 THEN 'true' WHEN 3 THEN '" 7e-1 "' WHEN 4 THEN '"high"'
    WHEN 5 THEN 'null' WHEN 6 THEN '[1]' ELSE CAST(doc_id % 4 AS STRING) || '.5' END
  || ',"identifiedFeatures":' || CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '"blue, round"' WHEN 1 THEN '["a","b"]' WHEN 2 THEN '[]' ELSE 'null' END
  || CASE WHEN doc_id % 17 = 0 THEN '}} and {{b}}' WHEN doc_id % 17 = 1 THEN '}}, {{"b":1}}' WHEN doc_id % 17 = 2 THEN ',}}'
    WHEN doc_id % 17 = 3 THEN '' ELSE '}}' END || '``` done' AS raw
FROM {documents}""",
    "v_cart_sets": """
SELECT event_id, user_id, event_id % (SELECT CAST(floor(COUNT(*) / 40) AS BIGINT) + 1 FROM {part}) AS offer_id,
  CAST(regexp_extract(props, '[0-9]+', 0) AS INT) + 20 AS quantity, ts
FROM {events} WHERE event_type = 'error'""",
    "v_cart_deletes": """
SELECT event_id, user_id, event_id % (SELECT CAST(floor(COUNT(*) / 40) AS BIGINT) + 1 FROM {part}) AS offer_id, ts FROM {events} WHERE event_type = 'purchase'""",
    "v_status_changes": """
SELECT event_id, event_id % (SELECT MAX(o_orderkey) FROM {orders}) AS order_id, ts,
  CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'processing'
    WHEN 3 THEN 'shipped' WHEN 4 THEN 'delivered' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'Delivered'
    ELSE 'lost' END AS status
FROM {events} WHERE event_type = 'purchase'""",
    "v_offer_updates": """
SELECT event_id, event_id % (SELECT CAST(floor(COUNT(*) / 10) AS BIGINT) + 20 FROM {part}) AS offer_id, ts,
  CASE WHEN event_id % 10 = 0 THEN ' ' ELSE ' Item ' || CAST(event_id % 30 AS STRING) || ' ' END AS product_name,
  CAST(value AS DECIMAL(14,2)) - 20 AS new_price,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 40 AS INT) END AS quantity,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'active' END AS status
FROM {events} WHERE event_type = 'error'""",
    "v_message_actions": """
SELECT event_id, ts,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'other-' WHEN 1 THEN 'contact-' WHEN 2 THEN 'contact-' ELSE 'negotiation-' END
    || CAST((event_id % 20) * 10 + event_id % 8 AS STRING) AS message_id,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'read' WHEN 1 THEN 'reply' ELSE 'delete' END AS action,
  CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'R' || CAST(event_id AS STRING) END AS reply
FROM {events} WHERE event_type = 'signup'""",
    "v_profile_updates": """
SELECT event_id, user_id, ts,
  CASE WHEN event_id % 9 = 0 THEN '  ' ELSE ' Name ' || CAST(event_id % 40 AS STRING) END AS full_name,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '+221 78 ' || substr(CAST(10000000 + event_id AS STRING), 2)
    WHEN 2 THEN '12345' ELSE '77' || substr(CAST(10000000 + (user_id + 1) % 150 AS STRING), 2) END AS phone,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' f ' ELSE 'm' END AS gender,
  CASE WHEN event_id % 7 = 0 THEN '   ' WHEN event_id % 7 = 1 THEN NULL ELSE ' Street ' || CAST(event_id % 90 AS STRING) END AS address
FROM {events} WHERE event_type = 'view'""",
    "v_order_requests": """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS request_id, event_id % (SELECT COUNT(*) FROM {part}) AS offer_id, event_id AS line_no,
  CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 110 AS quantity
FROM {events} WHERE event_type = 'click'""",
    # --- additions of this repository (not in FIXTURES.md): inputs derived
    # from the same tables for the keyed lookups ---
    "v_orders_ref": """
SELECT o.*, 'REF-' || CAST(year(o.created_at) AS STRING) || '-' ||
  CASE WHEN length(CAST(o.id AS STRING)) >= 6 THEN CAST(o.id AS STRING)
       ELSE lpad(CAST(o.id AS STRING), 6, '0') END AS reference
FROM {v_orders} o""",
    "v_order_headers": """
SELECT request_id, first_name, last_name, phone, email, delivery_method, address, city, district, payment_method FROM (
  SELECT request_id, CASE WHEN request_id % 17 = 0 THEN NULL ELSE 'F' || CAST(request_id % 50 AS STRING) END AS first_name,
    CASE WHEN request_id % 23 = 0 THEN '' ELSE 'L' || CAST(request_id % 70 AS STRING) END AS last_name,
    '77' || substr(CAST(10000000 + request_id AS STRING), 2) AS phone,
    CASE WHEN request_id % 3 = 0 THEN '' ELSE 'g' || CAST(request_id AS STRING) || '@example.com' END AS email,
    CASE WHEN request_id % 5 = 0 THEN 'pickup' ELSE 'home' END AS delivery_method,
    CASE WHEN request_id % 11 = 0 THEN '' ELSE 'Rue ' || CAST(request_id % 90 AS STRING) END AS address,
    CASE WHEN request_id % 13 = 0 THEN NULL ELSE 'City' || CAST(request_id % 6 AS STRING) END AS city,
    CASE WHEN request_id % 4 = 0 THEN '' ELSE 'D' || CAST(request_id % 8 AS STRING) END AS district,
    CASE WHEN request_id % 19 = 0 THEN NULL ELSE 'cash' END AS payment_method
  FROM (SELECT DISTINCT request_id FROM {v_order_requests}) r) h""",
    "v_user_headers": """
SELECT user_id, CASE WHEN user_id % 9 = 0 THEN '' ELSE 'U' || CAST(user_id AS STRING) END AS first_name,
  'N' || CAST(user_id % 30 AS STRING) AS last_name, '77' || substr(CAST(10000000 + user_id AS STRING), 2) AS phone,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING) || '@example.com' END AS email,
  CASE WHEN user_id % 4 = 0 THEN 'pickup' ELSE 'home' END AS delivery_method,
  'Rue ' || CAST(user_id % 40 AS STRING) AS address,
  CASE WHEN user_id % 7 = 0 THEN '' ELSE 'City' || CAST(user_id % 6 AS STRING) END AS city,
  CASE WHEN user_id % 6 = 0 THEN '' ELSE 'D' || CAST(user_id % 8 AS STRING) END AS district,
  CASE WHEN user_id % 11 = 0 THEN '' ELSE 'card' END AS payment_method
FROM (SELECT DISTINCT user_id FROM {v_cart_adds}) u""",
    "v_user_profiles": """
SELECT u.*, CASE WHEN id % 3 = 0 THEN NULL ELSE 'f' END AS gender, 'Old ' || CAST(id AS STRING) AS address FROM {v_users} u""",
    "v_guest_requests": """
SELECT s.event_id AS request_id, ' ' || o.reference || ' ' AS reference,
  CASE WHEN s.event_id % 3 = 0 THEN o.phone || '9' ELSE o.phone END AS phone
FROM {v_status_changes} s JOIN {v_orders_ref} o ON o.id = s.order_id""",
    "v_contact_requests": """
SELECT id, first_name, last_name, email, 'Sujet ' || last_name AS subject, message, created_at
FROM {v_contact_messages}""",
    "v_negotiation_requests": """
SELECT id, user_id, offer_id, quantity, message, first_name, last_name,
  'n' || CAST(id AS STRING) || '@example.com' AS email, created_at
FROM {v_negotiations}""",
    "v_offer_creates": """
SELECT event_id AS id, event_id, offer_id, ts, product_name, 'C' || CAST(offer_id % 7 AS STRING) AS category,
  product_name AS description, new_price, quantity, status, CAST(event_id % 6 - 1 AS INT) AS new_images
FROM {v_offer_updates}""",
    "v_generated_requests": """
SELECT CAST(p_partkey AS BIGINT) AS request_id, CASE WHEN p_partkey % 12 = 5 THEN '' ELSE p_name END AS product_name, p_type AS category,
  CASE WHEN p_partkey % 15 = 4 THEN NULL ELSE p_brand END AS description, CAST(p_retailprice AS DECIMAL(14,2)) - 905 AS new_price,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS DECIMAL(14,2)) AS old_price, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS discount,
  CAST(NULL AS DECIMAL(14,2)) AS wholesale_price, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS quantity,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'active' END AS status, CAST(p_partkey % 8 AS INT) AS n_files
FROM {part}""",
    "v_invoice_requests": """
SELECT id AS invoice_id, created_at, CASE WHEN id % 13 = 0 THEN '' WHEN id % 5 = 0 THEN 'INV-' || CAST(id - id % 100 AS STRING)
    ELSE 'INV-' || CAST(id AS STRING) END AS number,
  CASE WHEN id % 3 = 0 THEN '' ELSE 'Cust' || CAST(id % 40 AS STRING) END AS customer_name, CASE WHEN id % 4 = 0 THEN NULL ELSE '77' END AS customer_phone,
  '' AS customer_address, total AS subtotal, CAST(CASE WHEN id % 6 = 0 THEN NULL ELSE 0 END AS DECIMAL(14,2)) AS discount, total,
  CAST(NULL AS DECIMAL(14,2)) AS amount_received, CAST(0 AS DECIMAL(14,2)) AS change_amount,
  CASE WHEN id % 7 = 0 THEN '' ELSE 'card' END AS payment_method, CASE WHEN id % 8 = 0 THEN 'n' ELSE '' END AS note
FROM {v_invoices}""",
    "v_known_invoices": """
SELECT id, invoice_number FROM {v_invoices} WHERE id % 9 = 0""",
    "v_ad_updates": """
SELECT id, id AS event_id, created_at AS ts,
  CASE WHEN id % 3 = 0 THEN ' ' ELSE 'New ' || title END AS title,
  CASE WHEN id % 4 = 0 THEN '' ELSE 'https://ads.example.com/' || CAST(id AS STRING) END AS link_url,
  CAST(0 AS INT) AS width, CAST(id % 3 AS INT) AS height,
  CASE WHEN id % 4 = 0 THEN CAST(0 AS INT) ELSE display_order + 1 END AS display_order,
  CASE WHEN id % 2 = 0 THEN 'false' ELSE 'yes' END AS is_active, starts_at, CAST(NULL AS {TS}) AS ends_at
FROM {v_site_ads}""",
    "v_ad_requests": """
SELECT id, CASE WHEN id % 7 = 0 THEN '  ' ELSE ' ' || title END AS title, CASE WHEN id % 4 = 0 THEN '' ELSE link_url END AS link_url,
  CASE WHEN id % 5 = 0 THEN CAST(0 AS INT) WHEN id % 5 = 1 THEN NULL ELSE width END AS width, CASE WHEN id % 6 = 0 THEN CAST(0 AS INT) ELSE height END AS height,
  display_order, CASE WHEN id % 3 = 0 THEN 'false' WHEN id % 3 = 1 THEN NULL ELSE 'true' END AS is_active, starts_at, ends_at
FROM {v_site_ads}""",
    "v_registration_requests": """
SELECT event_id, ts, CASE WHEN event_id % 13 = 0 THEN '   ' ELSE ' Name ' || CAST(event_id AS STRING) END AS full_name,
  identifier
FROM {v_registrations}""",
    "v_alert_requests": """
SELECT page_id,
  CASE CAST(page_id % 8 AS INT)
    WHEN 0 THEN 'https://res.cloudinary.com/demo/shop/image-search/' || CAST(page_id AS STRING) || '.jpg'
    WHEN 1 THEN 'http://res.cloudinary.com/shop/image-search/' || CAST(page_id AS STRING) || '.jpg'
    WHEN 2 THEN 'https://RES.cloudinary.com/shop/image-search/x' || CAST(page_id AS STRING)
    WHEN 3 THEN 'https://res.cloudinary.com/shop/image-search/../../private/' || CAST(page_id AS STRING)
    WHEN 4 THEN 'https://res.cloudinary.com/private/%2E%2e/shop/image-search/' || CAST(page_id AS STRING)
    WHEN 5 THEN ' https:' || chr(92) || chr(92) || 'res.cloudinary.com' || chr(92) || 'shop' || chr(92) || 'image-search' || chr(92) || 'a b.png'
    WHEN 6 THEN 'https://u:p@res.cloudinary.com:443/shop/image-search/..name' || CAST(page_id AS STRING)
    ELSE url END AS image_url,
  html AS product_description,
  CASE CAST(page_id % 3 AS INT) WHEN 0 THEN '  u' || CAST(page_id AS STRING) || '@example.com '
    WHEN 1 THEN '77' || CAST(page_id AS STRING) ELSE ' 12 ' END AS contact
FROM {pages}""",
    "v_product_analyses": """
SELECT CAST(p_partkey AS BIGINT) AS query_id, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ' ' || p_name || ' ' END AS product_name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS category,
  split('x;;' || p_brand || '; ' || substr(p_name, 1, 5) || ' ;b_l;q1;q2;q3;q4;q5;q6;q7;q8;' || p_type, ';') AS search_terms
FROM {part}""",
    "v_reset_tokens": """
SELECT event_id AS id, user_id, 'h' || CAST(event_id % 97 AS STRING) AS token_hash,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS expires_at
FROM {events} WHERE event_type = 'view'""",
    "v_token_probes": """
SELECT event_id, user_id, 'h' || CAST(event_id % 97 AS STRING) AS token_hash FROM {events} WHERE event_type IN ('click', 'view')""",
    "v_page_links": """
SELECT page_id, CASE CAST(page_id % 13 AS INT)
    WHEN 1 THEN 'https://' || host || '/x/../en/' || CAST(page_id AS STRING)
    WHEN 2 THEN 'https://' || host || '/en/%2E%2e/secret'
    WHEN 3 THEN 'https:' || chr(92) || chr(92) || upper(host) || chr(92) || 'en' || chr(92) || 'p'
    WHEN 4 THEN 'https://user:pw@' || host || ':443/en/./a b.png?x=/../'
    WHEN 5 THEN 'https://' || host || ':99999/en/'
    WHEN 6 THEN ' HTTPS:/' || host || '/fr/en/..'
    WHEN 7 THEN 'https:///' || host || '/fr/.%2e/en/é{{x}}'
    WHEN 8 THEN 'mailto:x@y'
    WHEN 9 THEN 'not a url'
    WHEN 10 THEN 'ht' || chr(9) || 'tps://' || replace(host, 'e', '%65') || '/en/#/..'
    WHEN 11 THEN 'https://' || host || '/en/../../../en/.'
    ELSE url END AS url
FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'thther.example.org' ELSE regexp_extract(url, '^https?://([^/]+)', 1) END AS host FROM {pages}) p""",
    "v_generated_images": """
SELECT CAST(floor(page_id / 3) AS BIGINT) AS request_id, page_id AS pos,
  CASE CAST(page_id % 7 AS INT) WHEN 0 THEN 'http://res.cloudinary.com/a.png' WHEN 1 THEN 'https://evil.example.com/res.cloudinary.com'
    ELSE 'https://res.cloudinary.com/demo/' || CAST(page_id AS STRING) || '.png' END AS url,
  CASE WHEN page_id % 11 = 0 THEN 'shop/ai-generated/../x' WHEN page_id % 11 = 1 THEN 'other/' || CAST(page_id AS STRING) WHEN page_id % 11 = 2 THEN NULL
    ELSE 'shop/ai-generated/' || CAST(page_id AS STRING) END AS public_id
FROM {pages}""",
    "v_grounding_sources": """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS response_id, page_id AS pos,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE regexp_replace(url, '[?#].*$', '') END AS uri,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'T' || CAST(page_id AS STRING) END AS title
FROM {pages}""",
}

SOURCE_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def dependencies(name: str) -> list[str]:
    """Names (tables or views) a view's SQL refers to, in order of first use."""
    out: list[str] = []
    for _, field, _, _ in string.Formatter().parse(VIEWS[name]):
        if field and field != "TS" and field not in out:
            out.append(field)
    return out


def view_order(names) -> list[str]:
    """The given views plus the views they depend on, dependencies first."""
    seen: list[str] = []

    def visit(n):
        if n in seen or n not in VIEWS:
            return
        for d in dependencies(n):
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def duckdb_with(names, body: str) -> str:
    """Wrap ``body`` in a WITH clause defining the named views for DuckDB."""
    names = view_order(names)
    if not names:
        return body
    extra, word = "", "WITH "
    own = re.match(r"(?is)^\s*with\s+(recursive\s)?", body)
    if own:  # merge the body's own CTEs
        body, extra = body[own.end():], ",\n"
        word = "WITH RECURSIVE " if own.group(1) else word
    ctes = []
    for n in names:
        sql = VIEWS[n].replace("{TS}", "TIMESTAMP")
        sql = sql.format(**{d: d for d in dependencies(n)})
        ctes.append(f"{n} AS ({sql.strip()})")
    return word + ",\n".join(ctes) + (extra or "\n") + body
