from .sinks import append_batch, documents, report_document
from .tables import Tables
from .views import VIEWS, duckdb_with

__all__ = ["Tables", "VIEWS", "append_batch", "documents", "duckdb_with", "report_document"]
