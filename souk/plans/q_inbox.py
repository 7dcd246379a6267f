"""Inbox keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import JS_WS
from ..operators import inbox as ib
from .registry import query

JS_TRIM_SQL = "regexp_replace({x}, '^" + JS_WS + "+|" + JS_WS + "+$', '', 'g')"


def jt(x: str) -> str:
    return JS_TRIM_SQL.replace("{x}", x)


@query("inbox", ["v_contact_messages", "v_negotiations", "v_users", "v_offers"], """
SELECT 'contact' AS type, 'contact-' || CAST(c.id AS VARCHAR) AS id, c.id AS source_id,
  concat(c.first_name, ' ', c.last_name) AS name, c.first_name, c.last_name, c.email,
  CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS subject, c.message, c.status, c.created_at,
  CAST(NULL AS TIMESTAMP) AS replied_at, CAST(NULL AS VARCHAR) AS admin_reply,
  CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS VARCHAR) AS product_name,
  CAST(NULL AS VARCHAR) AS product_reference
FROM v_contact_messages c
UNION ALL
SELECT 'negotiation', 'negotiation-' || CAST(n.id AS VARCHAR), n.id,
  COALESCE(NULLIF(concat_ws(' ', NULLIF(n.first_name, ''), NULLIF(n.last_name, '')), ''),
           NULLIF(u.full_name, ''), 'Visiteur'),
  COALESCE(NULLIF(n.first_name, ''), split_part(COALESCE(u.full_name, ''), ' ', 1), 'Visiteur'),
  COALESCE(NULLIF(n.last_name, ''), CASE WHEN position(' ' IN COALESCE(u.full_name, '')) > 0
    THEN substring(u.full_name, position(' ' IN u.full_name) + 1) ELSE '' END),
  u.email, u.phone, 'Négociation en quantité', n.message, n.status, n.created_at,
  CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), o.id, o.product_name, CAST(NULL AS VARCHAR)
FROM v_negotiations n LEFT JOIN v_users u ON u.id = n.user_id JOIN v_offers o ON o.id = n.offer_id""")
def inbox(t):
    return ib.inbox(t.v_contact_messages, t.v_negotiations, t.v_users, t.v_offers)


@query("contact_intake", ["v_contact_requests"], f"""
SELECT id, {jt('first_name')} AS first_name, {jt('last_name')} AS last_name, {jt('email')} AS email,
  CAST(NULL AS VARCHAR) AS phone, {jt('subject')} AS subject, {jt('message')} AS message,
  'unread' AS status, created_at
FROM v_contact_requests
WHERE first_name <> '' AND last_name <> '' AND email <> '' AND subject <> '' AND message <> ''""")
def contact_intake(t):
    return ib.contact_intake(t.v_contact_requests)


@query("negotiation_intake", ["v_negotiation_requests", "v_users", "v_offers"], f"""
SELECT n.id, u.id AS user_id, n.offer_id, n.quantity, {jt('n.message')} AS message,
  {jt('n.first_name')} AS first_name, {jt('n.last_name')} AS last_name, CAST(NULL AS VARCHAR) AS phone,
  {jt('n.email')} AS email, 'unread' AS status, n.created_at
FROM v_negotiation_requests n LEFT JOIN v_users u ON u.id = n.user_id
WHERE n.offer_id IS NOT NULL AND n.offer_id <> 0 AND n.quantity >= 51 AND n.message IS NOT NULL
  AND {jt('n.message')} <> '' AND n.first_name IS NOT NULL AND n.last_name IS NOT NULL
  AND n.email IS NOT NULL AND n.offer_id IN (SELECT id FROM v_offers WHERE status = 'active')""")
def negotiation_intake(t):
    return ib.negotiation_intake(t.v_negotiation_requests, t.v_users, t.v_offers)


@query("message_status_apply", ["v_message_actions", "v_contact_messages", "v_negotiations"], f"""
WITH a AS (SELECT event_id, ts, action, reply,
    CASE WHEN message_id LIKE 'contact-%' THEN 'contact'
         WHEN message_id LIKE 'negotiation-%' THEN 'negotiation' END AS kind,
    TRY_CAST(regexp_extract(message_id, '^(?:contact|negotiation)-(.*)$', 1) AS BIGINT) AS sid
  FROM v_message_actions),
v AS (SELECT * FROM a WHERE kind IS NOT NULL AND sid IS NOT NULL),
ok AS (SELECT * FROM v WHERE action = 'read'
   OR (action = 'reply' AND reply IS NOT NULL AND {jt('reply')} <> '')),
ls AS (SELECT kind, sid, CASE WHEN action = 'read' THEN 'read' ELSE 'replied' END AS st,
    row_number() OVER (PARTITION BY kind, sid ORDER BY ts DESC, event_id DESC) AS rn FROM ok),
lr AS (SELECT kind, sid, {jt('reply')} AS rp, ts AS rts,
    row_number() OVER (PARTITION BY kind, sid ORDER BY ts DESC, event_id DESC) AS rn
  FROM ok WHERE action = 'reply'),
del AS (SELECT DISTINCT kind, sid FROM v WHERE action = 'delete'),
msgs AS (SELECT 'contact' AS kind, id, status FROM v_contact_messages
  UNION ALL SELECT 'negotiation', id, status FROM v_negotiations)
SELECT m.kind AS type, m.id, COALESCE(ls.st, m.status) AS status, lr.rp AS admin_reply, lr.rts AS replied_at
FROM msgs m LEFT JOIN ls ON ls.kind = m.kind AND ls.sid = m.id AND ls.rn = 1
  LEFT JOIN lr ON lr.kind = m.kind AND lr.sid = m.id AND lr.rn = 1
WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.kind = m.kind AND del.sid = m.id)""")
def message_status_apply(t):
    """Messages after a batch of read/reply/delete actions (both kinds)."""
    acts = t.v_message_actions
    c, n = ib.message_status_apply(t.v_contact_messages, t.v_negotiations, acts)
    pick = ["id", "status", "admin_reply", "replied_at"]
    return (c.select(F.lit("contact").alias("type"), *pick)
            .unionByName(n.select(F.lit("negotiation").alias("type"), *pick)))
