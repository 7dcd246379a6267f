"""Driver-facing query plans: one registered query (and oracle) per key."""

from .registry import AS_OF, DAYS, ORACLES, QUERIES


def load_all():
    """Import every query module so that all keys are registered."""
    from . import q_sales  # noqa: F401
    for mod in ("q_catalog", "q_documents", "q_inbox", "q_stock", "q_changes", "q_quality"):
        __import__(f"{__name__}.{mod}")  # a missing module is an error, not fewer keys
    return QUERIES, ORACLES


__all__ = ["AS_OF", "DAYS", "ORACLES", "QUERIES", "load_all"]
