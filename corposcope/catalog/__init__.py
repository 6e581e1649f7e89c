"""Named queries over the given tables, each with its DuckDB check where SQL can say it."""

from .base import REGISTRY, Query, query
from . import change_queries, diff_queries, edit_queries, index_queries, read_queries, search_queries, stream_queries, symbol_queries  # noqa: F401
from . import lookup_queries  # noqa: F401

__all__ = ["REGISTRY", "Query", "query"]
