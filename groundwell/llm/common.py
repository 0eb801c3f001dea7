"""Registry, table access and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

BATCH_BYTES = 8 << 20

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_texts(texts: DataFrame) -> DataFrame:
    """Tell the session to hand texts to Python in batches of a few megabytes, however many rows that are, unless it has a
    bound of its own."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return texts


def key_of(column: Column | str) -> Column:
    """A never-null text key, so that null groups with null and joins stay plain equalities."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value.cast("string")))
