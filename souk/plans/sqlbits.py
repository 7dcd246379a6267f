"""SQL fragments shared by the oracle strings (DuckDB dialect)."""

from __future__ import annotations

from ..functions.exprs import JS_WS

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"  # base vs change batch in the event views
WS_CLASS = JS_WS[1:-1]


def jt(x: str) -> str:
    """JavaScript trim in DuckDB."""
    return "regexp_replace(" + x + ", '^" + JS_WS + "+|" + JS_WS + "+$', '', 'g')"


def phone(x: str) -> str:
    """C1 phone normalisation in DuckDB."""
    p = "regexp_replace(" + jt(x) + ", '[" + WS_CLASS + "().\\-]', '', 'g')"
    p = (f"CASE WHEN starts_with({p}, '+221') THEN substr({p}, 5) "
         f"WHEN starts_with({p}, '00221') THEN substr({p}, 6) ELSE {p} END")
    return f"CASE WHEN regexp_full_match({p}, '7[0-9]{{8}}') THEN {p} END"


def email_ok(x: str) -> str:
    return ("regexp_full_match(" + x + ", '[^" + WS_CLASS + "@]+@[^" + WS_CLASS + "@]+\\.[^" + WS_CLASS + "@]+')")


def ref(prefix: str, year: int, id_expr: str) -> str:
    return f"printf('%s-%d-%06d', '{prefix}', {year}, {id_expr})"
