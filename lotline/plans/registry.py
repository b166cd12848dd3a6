"""Registry of driver queries: inventory id -> (Spark builder, DuckDB oracle SQL).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver tables; the SQL text runs in DuckDB over the same parquet files
(views inlined as CTEs).  A ``None`` oracle means the operator is checked by
pytest against a brute-force fixture instead.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from lotline.plans import q_load, q_dispatch, q_allocate, q_stats, q_stream  # noqa: F401
    return QUERIES
