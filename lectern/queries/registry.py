"""The table of registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.session import spread
from lectern.sources.model import read as table

__all__ = ["ORACLE", "QUERIES", "query", "table", "texts"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores."""
    return spread(table(spark, sf_dir, name), TEXT_KEYS[name])
