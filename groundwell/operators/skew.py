"""Building blocks that keep one hot key from becoming one hot task.

Every helper here splits a key's rows over several tasks and returns exactly the rows or values the plain window
would return.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 64
BUCKET_ROWS = 100_000
MOST_BUCKETS = 1024


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, rank: str = "rank",
          bound: int | None = None, salts: int = DEFAULT_SALTS) -> DataFrame:
    """First ``n`` rows per key in ``order``, with their 1-based rank.

    A literal ``n``, or a literal ``bound`` on a per-row ``n``, lets the planner cut every map task to that many rows per
    key before the shuffle. Without a bound a per-row ``n`` cannot be used that way, so the rows of a key are ranked in
    salted parts first and only survivors meet.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    if isinstance(n, int) or bound is not None:
        limit = F.lit(n) if isinstance(n, int) else n
        most = n if isinstance(n, int) else max(bound, 0)
        ranked = df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= most)
        return ranked if isinstance(n, int) else ranked.filter(F.col(rank) <= limit)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in _plain_columns(df)]), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= n).drop("_salt", "_part")
    return kept.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def largest(df: DataFrame, *columns: str | Column) -> list[int]:
    """The largest value of each column of a request table, as literal bounds for :func:`top_n`."""
    row = df.agg(*[F.max(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [int(v) if v is not None else 0 for v in row]


def _plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in {
        "string", "long", "integer", "double", "float", "timestamp", "boolean", "date", "short", "byte"}]


def order_buckets(df: DataFrame, first: str, second: str | None = None, rows: int = BUCKET_ROWS) -> Column:
    """Order-preserving bucket of (``first``, ``second``) with about ``rows`` rows, whatever the values look like.

    The bounds are quantiles of ``df`` itself, so sparse ids and dense ones fill buckets alike. A value of ``first`` that
    fills buckets of its own is cut further by quantiles of ``second``.
    """
    columns = [first] if second is None else [first, second]
    # One pass gives the count and the finest bounds; of these, as many are taken as the count asks for.
    fine = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    found = df.agg(F.count(F.lit(1)).alias("_count"), *[
        F.percentile_approx(c, fine, F.lit(4 * MOST_BUCKETS)).alias(c) for c in columns]).first()
    parts = min(MOST_BUCKETS, 1 << max(0, -(-found["_count"] // rows) - 1).bit_length())
    if parts < 2:
        return F.lit(0).cast("long")
    held = {c: (found[c] or [])[MOST_BUCKETS // parts - 1::MOST_BUCKETS // parts] for c in columns}
    bounds = held[first]
    bucket = _below(F.col(first), sorted(set(bounds))) * (MOST_BUCKETS + 1)
    heavy = sorted({a for a, b in zip(bounds, bounds[1:]) if a == b})
    if second is not None and heavy:
        # A bound is the last value of its bucket, so its rows follow all others there.
        inside = _below(F.col(second), sorted(set(held[second]))) + 1
        bucket = bucket + F.when(F.array_contains(F.array(*map(F.lit, heavy)), F.col(first)), inside).otherwise(0)
    return bucket.cast("long")


def _below(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, in two steps of at most 64 comparisons each."""
    def count(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b < value))

    groups = [bounds[i:i + 64] for i in range(0, len(bounds), 64)]
    if len(groups) < 2:
        return count(F.array(*map(F.lit, bounds)))
    coarse = count(F.array(*[F.lit(g[-1]) for g in groups[:-1]]))
    return coarse * 64 + count(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse + 1))


def with_carry(df: DataFrame, keys: Sequence[str], bucket: str, tails: dict[str, Column],
               carries: dict[str, Column]) -> DataFrame:
    """Attach to every row a value derived from the earlier buckets of its key.

    ``tails`` are aggregates per (key, bucket); ``carries`` are window expressions over those aggregates, evaluated on
    the window given by :func:`earlier_buckets`. The summary holds one row per (key, bucket), so its window stays small
    whatever the size of the key.
    """
    summary = df.groupBy(*keys, bucket).agg(*[expr.alias(name) for name, expr in tails.items()])
    carried = summary.select(*keys, bucket, *[expr.alias(name) for name, expr in carries.items()])
    return df.join(carried, [*keys, bucket], "left")


def earlier_buckets(keys: Sequence[str], bucket: str):
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def previous_bucket(keys: Sequence[str], bucket: str):
    return Window.partitionBy(*keys).orderBy(bucket)


def lag_within_key(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column,
                   name: str) -> DataFrame:
    """``lag(value)`` over the key in ``order``, computed per bucket plus one carried value."""
    position = F.struct(*order)
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    staged = with_carry(
        df.withColumn("_value", value), keys, bucket,
        {"_tail": F.max_by("_value", position)},
        {"_carry": F.lag("_tail").over(previous_bucket(keys, bucket))},
    )
    first = F.row_number().over(local) == 1
    return staged.withColumn(
        name, F.when(first, F.col("_carry")).otherwise(F.lag("_value").over(local))
    ).drop("_value", "_carry")


def dense_ids(df: DataFrame, keys: Sequence[str], start: Column, name: str = "id") -> DataFrame:
    """Number the distinct ``keys`` from ``start + 1`` in the order of their hash.

    Hash prefixes give 4096 evenly filled groups; only the group sizes are summed in one place.
    """
    marked = df.withColumn("_hash", F.sha2(F.concat_ws("\x00", *[F.col(k).cast("string") for k in keys]), 256))
    marked = marked.withColumn("_group", F.substring("_hash", 1, 3))
    sizes = marked.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_group").orderBy("_hash"))
    return (
        marked.withColumn("_local", local)
        .join(offsets, "_group")
        .withColumn(name, (start + F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_hash", "_group", "_local", "_offset")
    )
