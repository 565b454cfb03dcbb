"""Registration of catalogue queries beside the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codegrove.sources.catalog_graph import Graph, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(graph) -> DataFrame under a name; in the SQL, @relation stands for a relation of the graph."""

    def add(fn: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Graph(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return fn

    return add
