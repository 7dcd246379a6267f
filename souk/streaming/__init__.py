"""Incremental (Structured Streaming) variants of batch operators."""

from .incremental import cart_upsert_stream, compact_cart, daily_orders_stream, read_cart

__all__ = ["cart_upsert_stream", "compact_cart", "daily_orders_stream", "read_cart"]
