"""All core queries and their SQL."""

from __future__ import annotations

from . import core_queries, io_queries, stream_queries, text_queries
from .core_queries import Q, SQL

__all__ = ["core_queries", "io_queries", "stream_queries", "text_queries", "queries", "oracle_sql"]


def queries():
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
