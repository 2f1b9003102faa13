"""All queries of the core package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, general, panel_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (text_queries, panel_queries, catalog_queries, general)
FLAGSHIP: Query = text_queries.keyword_panel


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out
