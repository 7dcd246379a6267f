"""Inbox: contact messages and negotiation requests as one feed, plus the
batch operators that feed and maintain them (intake, read/reply/delete)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import concat_pg, js_trim
from .common import with_columns_or_null

CONTACT_COLUMNS = {"id": "bigint", "first_name": "string", "last_name": "string", "email": "string",
                   "phone": "string", "subject": "string", "message": "string", "status": "string",
                   "created_at": "timestamp_ntz", "replied_at": "timestamp_ntz",
                   "admin_reply": "string"}
NEGOTIATION_COLUMNS = {"id": "bigint", "user_id": "bigint", "offer_id": "bigint", "quantity": "int",
                       "message": "string", "first_name": "string", "last_name": "string",
                       "phone": "string", "email": "string", "status": "string",
                       "created_at": "timestamp_ntz", "replied_at": "timestamp_ntz",
                       "admin_reply": "string"}
NEGOTIATION_SUBJECT = "Négociation en quantité"
VISITOR = "Visiteur"


def inbox(contacts: DataFrame, negotiations: DataFrame, users: DataFrame,
          offers: DataFrame) -> DataFrame:
    """Both message kinds in one frame, newest first.

    Negotiations take missing names and contacts from the user (left join)
    and are kept only while their offer exists (inner join).
    """
    c = with_columns_or_null(contacts, CONTACT_COLUMNS)
    n = with_columns_or_null(negotiations, NEGOTIATION_COLUMNS)
    u = with_columns_or_null(users, {"id": "bigint", "full_name": "string", "email": "string",
                                     "phone": "string"})
    o = with_columns_or_null(offers, {"id": "bigint", "product_name": "string",
                                      "reference": "string"})
    contact_rows = c.select(
        F.lit("contact").alias("type"),
        F.concat(F.lit("contact-"), F.col("id").cast("string")).alias("id"),
        F.col("id").alias("source_id"),
        concat_pg("first_name", F.lit(" "), "last_name").alias("name"),
        "first_name", "last_name", "email", "phone", "subject", "message", "status",
        "created_at", "replied_at", "admin_reply",
        F.lit(None).cast("bigint").alias("product_id"),
        F.lit(None).cast("string").alias("product_name"),
        F.lit(None).cast("string").alias("product_reference"))
    fn = F.coalesce(F.col("u_full_name"), F.lit(""))
    space = F.instr(fn, " ")
    nego_rows = (n.join(u.select(F.col("id").alias("u_id"), F.col("full_name").alias("u_full_name"),
                                 F.col("email").alias("u_email"), F.col("phone").alias("u_phone")),
                        F.col("user_id") == F.col("u_id"), "left")
                 .join(o.select(F.col("id").alias("o_id"), F.col("product_name").alias("o_name"),
                                F.col("reference").alias("o_ref")),
                       F.col("offer_id") == F.col("o_id"), "inner")
                 .select(
                     F.lit("negotiation").alias("type"),
                     F.concat(F.lit("negotiation-"), F.col("id").cast("string")).alias("id"),
                     F.col("id").alias("source_id"),
                     F.coalesce(
                         F.nullif(F.concat_ws(" ", F.nullif("first_name", F.lit("")),
                                              F.nullif("last_name", F.lit(""))), F.lit("")),
                         F.nullif("u_full_name", F.lit("")), F.lit(VISITOR)).alias("name"),
                     F.coalesce(F.nullif("first_name", F.lit("")), F.split_part(fn, F.lit(" "), F.lit(1)),
                                F.lit(VISITOR)).alias("first_name"),
                     F.coalesce(F.nullif("last_name", F.lit("")),
                                F.when(space > 0, F.expr("substring(coalesce(u_full_name, ''), instr(coalesce(u_full_name, ''), ' ') + 1)"))
                                .otherwise(F.lit(""))).alias("last_name"),
                     F.coalesce("email", "u_email").alias("email"),
                     F.coalesce("phone", "u_phone").alias("phone"),
                     F.lit(NEGOTIATION_SUBJECT).alias("subject"),
                     "message", "status", "created_at", "replied_at", "admin_reply",
                     F.col("o_id").alias("product_id"), F.col("o_name").alias("product_name"),
                     F.col("o_ref").alias("product_reference")))
    return (contact_rows.unionByName(nego_rows)
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id")))


# ---------------------------------------------------------------------------
# Intake (validated appends)
# ---------------------------------------------------------------------------
def _truthy(c) -> F.Column:
    return F.col(c).isNotNull() & (F.col(c) != F.lit(""))


def contact_intake(requests: DataFrame) -> DataFrame:
    """Accept requests whose five required fields are non-empty (tested
    before trimming: blank-only passes and is stored as ''), store trimmed."""
    r = with_columns_or_null(requests, {k: v for k, v in CONTACT_COLUMNS.items()
                                        if k not in ("status", "replied_at", "admin_reply")})
    ok = _truthy("first_name") & _truthy("last_name") & _truthy("email") & _truthy("subject") \
        & _truthy("message")
    return r.where(ok).select(
        "id", js_trim("first_name").alias("first_name"), js_trim("last_name").alias("last_name"),
        js_trim("email").alias("email"),
        F.when(_truthy("phone"), js_trim("phone")).alias("phone"),
        js_trim("subject").alias("subject"), js_trim("message").alias("message"),
        F.lit("unread").alias("status"), "created_at")


def negotiation_intake(requests: DataFrame, users: DataFrame, offers: DataFrame) -> DataFrame:
    """Quantity integer >= 51, non-blank message, names and e-mail given,
    offer exists with status 'active'; an unknown user becomes NULL."""
    r = with_columns_or_null(requests, {k: v for k, v in NEGOTIATION_COLUMNS.items()
                                        if k not in ("status", "replied_at", "admin_reply")})
    ok = (F.col("offer_id").isNotNull() & (F.col("offer_id") != 0)
          & F.col("quantity").isNotNull() & (F.col("quantity") >= 51)
          & F.col("message").isNotNull() & (js_trim("message") != F.lit(""))
          & F.col("first_name").isNotNull() & F.col("last_name").isNotNull()
          & F.col("email").isNotNull())
    active = offers.where(F.col("status") == F.lit("active")).select(F.col("id").alias("offer_id"))
    known = users.select(F.col("id").alias("_uid"))
    return (r.where(ok).join(active, "offer_id", "left_semi")
            .join(known, F.col("user_id") == F.col("_uid"), "left")
            .select("id", F.col("_uid").alias("user_id"), "offer_id", "quantity",
                    js_trim("message").alias("message"), js_trim("first_name").alias("first_name"),
                    js_trim("last_name").alias("last_name"),
                    F.when(_truthy("phone"), js_trim("phone")).alias("phone"),
                    js_trim("email").alias("email"), F.lit("unread").alias("status"), "created_at"))


# ---------------------------------------------------------------------------
# Read / reply / delete by prefixed id
# ---------------------------------------------------------------------------
def _route(actions: DataFrame) -> DataFrame:
    """Split ``contact-<id>`` / ``negotiation-<id>`` into kind and numeric id."""
    kind = (F.when(F.col("message_id").startswith("contact-"), F.lit("contact"))
            .when(F.col("message_id").startswith("negotiation-"), F.lit("negotiation")))
    src = F.regexp_extract("message_id", r"^(?:contact|negotiation)-(.*)$", 1)
    return actions.withColumn("_kind", kind).withColumn("_sid", src.try_cast("bigint"))


def message_status_apply(contacts: DataFrame, negotiations: DataFrame, actions: DataFrame,
                         order: tuple = ("ts", "event_id")) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of ``(message_id, action, reply)`` in ``order``.

    ``read`` sets status 'read'; ``reply`` with a non-blank text sets
    'replied', the trimmed reply and ``replied_at`` (the action time);
    ``delete`` removes the row.  Ids without a known prefix change nothing.
    The result equals running the actions one by one: a delete wins over
    everything, the last valid action decides the status, the last valid
    reply decides reply text and time.
    """
    a = _route(actions).where(F.col("_kind").isNotNull() & F.col("_sid").isNotNull())
    valid = (F.col("action") == "read") | ((F.col("action") == "reply")
                                           & F.col("reply").isNotNull() & (js_trim("reply") != F.lit("")))
    a = a.withColumn("_valid", valid)
    key = ["_kind", "_sid"]
    ords = [F.col(c) for c in order]
    last_status = (a.where(F.col("_valid"))
                   .withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in ords])))
                   .where(F.col("_r") == 1)
                   .select(*key, F.when(F.col("action") == "read", F.lit("read"))
                           .otherwise(F.lit("replied")).alias("_status")))
    last_reply = (a.where(F.col("_valid") & (F.col("action") == "reply"))
                  .withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in ords])))
                  .where(F.col("_r") == 1)
                  .select(*key, js_trim("reply").alias("_reply"), F.col(order[0]).alias("_replied_at")))
    deleted = a.where(F.col("action") == "delete").select(*key).dropDuplicates()
    effects = last_status.join(last_reply, key, "full")

    def apply(table: DataFrame, kind: str) -> DataFrame:
        e = effects.where(F.col("_kind") == kind).drop("_kind").withColumnRenamed("_sid", "_id")
        d = deleted.where(F.col("_kind") == kind).select(F.col("_sid").alias("id"))
        t = table.join(d, "id", "left_anti").join(e, F.col("id") == F.col("_id"), "left")
        cols = []
        for c in table.columns:
            if c == "status":
                cols.append(F.coalesce("_status", "status").alias("status"))
            elif c == "admin_reply":
                cols.append(F.when(F.col("_reply").isNotNull(), F.col("_reply"))
                            .otherwise(F.col("admin_reply")).alias("admin_reply"))
            elif c == "replied_at":
                cols.append(F.when(F.col("_reply").isNotNull(), F.col("_replied_at"))
                            .otherwise(F.col("replied_at")).alias("replied_at"))
            else:
                cols.append(F.col(c))
        return t.select(*cols)

    return (apply(with_columns_or_null(contacts, CONTACT_COLUMNS), "contact"),
            apply(with_columns_or_null(negotiations, NEGOTIATION_COLUMNS), "negotiation"))
