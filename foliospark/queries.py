"""Registry of the engine's queries, each over whole tables, and the SQL that gives the same rows in DuckDB.

papers are orders, lecturers suppliers, programmes nations, keywords the words of parts' names, and messages events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables; without SQL where that can't express it."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


from foliospark import query_etl, query_graph, query_linkage, query_relational, query_retrieval, query_scalar, query_stream  # noqa: E402, F401
