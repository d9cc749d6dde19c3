"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.session import spread_if_few

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Tables whose rows are texts: work per byte is high, so they should use every core.
TEXTS = ("documents", "pages", "conversations")


class Tables:
    """The given tables by name: ``t.documents`` reads ``documents.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread_if_few(df) if name in TEXTS else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; no SQL means the query is tested by brute force instead."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add
