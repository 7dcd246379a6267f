"""Shared column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Status vocabularies, compared after lower(coalesce(status, '')).
# ---------------------------------------------------------------------------
DELIVERED = ["delivered", "livree", "livré", "completed", "complete"]
SHIPPING = ["shipping", "shipped", "in_delivery", "in delivery", "transit",
            "en_livraison", "en livraison"]
PENDING = ["pending", "processing", "confirmed", "en_attente", "en attente"]
FAILED = ["failed", "delivery_failed", "non_livree", "non livrée", "undelivered"]
CANCELLED = "cancelled"
OFFER_WITHDRAWN = ["cancelled", "cancelled_offer", "deleted", "inactive"]
WRITABLE_ORDER_STATUSES = ["pending", "confirmed", "processing", "shipped",
                           "delivered", "cancelled"]

# The white-space set of JavaScript's String.prototype.trim and
# of its regular-expression class \s, written as a regex class that Java
# (Spark) and RE2 (DuckDB) read alike.
JS_WS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_key(c) -> Column:
    """lower(coalesce(status, '')): NULL is an empty status, never cancelled."""
    return F.lower(F.coalesce(col(c), F.lit("")))


def not_cancelled(c="status") -> Column:
    return status_key(c) != F.lit(CANCELLED)


def is_cancelled(c="status") -> Column:
    return status_key(c) == F.lit(CANCELLED)


def order_bucket(c="status") -> Column:
    """Delivery bucket of an order status; NULL when in no bucket."""
    k = status_key(c)
    return (F.when(k.isin(DELIVERED), "delivered")
            .when(k.isin(SHIPPING), "shipping")
            .when(k.isin(PENDING), "pending")
            .when(k.isin(FAILED), "failed")
            .when(k == F.lit(CANCELLED), "cancelled"))


def js_trim(c) -> Column:
    """JavaScript ``trim()``: strips Unicode white space, not only spaces."""
    return F.regexp_replace(col(c), f"^{JS_WS}+|{JS_WS}+$", "")


def blank_to_null(c) -> Column:
    """NULL for NULL, '' or white space only; the trimmed text otherwise."""
    t = js_trim(c)
    return F.when(t != F.lit(""), t)


def js_or_str(c, default) -> Column:
    """JavaScript ``x || default`` on a text column ('' counts as missing)."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col(c), F.lit("")), d)


def js_or_num(c, default) -> Column:
    """JavaScript ``Number(x) || default`` on a numeric column (0 is missing)."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(col(c), F.lit(0)), d)


def concat_pg(*cols) -> Column:
    """PostgreSQL CONCAT: NULL arguments count as ''."""
    return F.concat(*[F.coalesce(col(c), F.lit("")) for c in cols])


def person_label(first, last, fallback="Client") -> Column:
    """[first, last].filter(Boolean).join(' ') || fallback."""
    joined = F.concat_ws(" ", F.nullif(col(first), F.lit("")), F.nullif(col(last), F.lit("")))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(fallback))


def address_label(*parts) -> Column:
    """[parts].filter(Boolean).join(', '): NULL and '' dropped, nothing trimmed."""
    return F.concat_ws(", ", *[F.nullif(col(p), F.lit("")) for p in parts])


def reference_number(prefix, year, n) -> Column:
    """PREFIX-YYYY-000123: zero padded to six digits, never truncated."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.format_string("%s-%d-%06d", p, col(year), col(n))


def money(c) -> Column:
    return col(c).cast("decimal(14,2)")


def as_of_date(as_of) -> Column:
    """The clock of a query, as a DATE literal (never current_date())."""
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    return F.lit(as_of)


def as_of_ts(as_of) -> Column:
    """The clock as a zone-free timestamp (midnight for a date)."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = (_dt.datetime.fromisoformat(as_of) if len(as_of) > 10
                 else _dt.datetime.combine(_dt.date.fromisoformat(as_of), _dt.time()))
    elif isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime.combine(as_of, _dt.time())
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def not_expired(c, now) -> Column:
    """``expires_at > now`` (an open end does not pass, as NULL > now is not true)."""
    return F.coalesce(col(c).cast("timestamp_ntz") > as_of_ts(now), F.lit(False))


def day_after(as_of) -> Column:
    """Start of the day after ``as_of`` as a timestamp: the open upper bound."""
    return F.date_add(as_of_date(as_of), 1).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# Search patterns (ILIKE with PostgreSQL's default escape character)
# ---------------------------------------------------------------------------
_BAD_ESCAPE = re.compile(r"\\(.)", re.S)


def like_escape_fix(s: str) -> str:
    """Drop a backslash that escapes anything other than %, _ or backslash.

    PostgreSQL matches such a character literally; Spark rejects the pattern.
    """
    return _BAD_ESCAPE.sub(lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1), s)


def like_escape_fix_col(c) -> Column:
    """Column form of :func:`like_escape_fix`."""
    return F.regexp_replace(col(c), r"(?s)(?<!\\)((?:\\\\)*)\\([^%_\\])", "$1$2")


def contains_pattern(s) -> Column:
    """'%' || s || '%' for ILIKE, as a Column."""
    if isinstance(s, Column):
        return F.concat(F.lit("%"), like_escape_fix_col(s), F.lit("%"))
    return F.lit("%" + like_escape_fix(s) + "%")


def clamp_days(value, lo: int, hi: int, default: int = 30) -> int:
    """clamp(Number(value) || default, lo, hi); fractions are refused."""
    try:
        n = float(value) if value is not None and str(value).strip() != "" else 0.0
    except (TypeError, ValueError):
        n = 0.0
    if n != n or n == 0:  # NaN or 0 -> default
        n = float(default)
    n = min(max(n, lo), hi)
    if n != int(n):
        raise ValueError(f"period must be a whole number of days, got {value!r}")
    return int(n)
