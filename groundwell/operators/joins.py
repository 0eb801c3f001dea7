"""Join helpers: broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when ``rows`` (a counted or proven bound) fit the limit; otherwise leave the join to the
    planner, which shuffles and splits skewed partitions."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
