from . import calendar, exprs

__all__ = ["calendar", "exprs"]
