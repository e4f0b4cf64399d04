"""Registration of comparable queries: a Spark callable and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; without ``sql`` it is checked by tests only."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def round_doubles(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, because two engines differ in the last bits."""
    return frame.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in frame.dtypes
        ]
    )
