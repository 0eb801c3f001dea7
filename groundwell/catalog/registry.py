"""Registry of runnable queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; integers are widened so that both engines agree on the column types."""

    def add(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return widen(build(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def widen(df: DataFrame) -> DataFrame:
    narrow = {"integer", "short", "byte"}
    return df.select(*[
        F.col(f"`{f.name}`").cast("long").alias(f.name) if f.dataType.typeName() in narrow else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
