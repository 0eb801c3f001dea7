"""Keyed tables of points and chunks: upsert, delete, fetch, verification and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.operators.skew import top_n
from groundwell.operators.stages import materialize


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The last write per key wins.

    ``order`` is the write sequence inside ``incoming``; without it a key that comes twice stops the job. Only incoming
    rows are ranked; of the stored rows those of other keys are kept as they are.
    """
    if order is not None:
        latest = top_n(incoming.withColumn("_sequence", order), [key], [F.desc("_sequence")], 1, rank="_write").drop(
            "_sequence", "_write")
    else:
        twice = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
        refused = F.raise_error(F.concat(F.lit("a key is written twice without an order: "), F.col(key).cast("string")))
        # The check is part of the key, so it cannot be pruned away.
        kind = incoming.schema[key].dataType
        latest = incoming.withColumn(key, F.when(twice, refused.cast(kind)).otherwise(F.col(key)))
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(latest.select(*stored.columns))


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """S11."""
    return stored.join(ids.select(key), key, "left_anti")


def fetch(stored: DataFrame, ids: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """The payload of the listed ids; the vector column is pruned from the scan."""
    return stored.drop(vector).join(ids.select(key).distinct(), key, "left_semi")


def verify_collection(points: DataFrame, declared: DataFrame, vector: str = "vector") -> DataFrame:
    """Declared (collection, vector_size, distance) against the stored vectors; an empty collection conforms."""
    sizes = points.groupBy("collection").agg(
        F.min(F.size(vector)).alias("_low"), F.max(F.size(vector)).alias("_high"))
    agrees = F.col("_low").isNull() | (
        (F.col("_low") == F.col("vector_size")) & (F.col("_high") == F.col("vector_size")))
    return declared.join(sizes, "collection", "left").select(
        "collection", "vector_size", "distance",
        (agrees & (F.lower("distance") == "cosine")).alias("conforms"))


def counts_per_scope(points: DataFrame, scope: str = "knowledge_scope") -> DataFrame:
    """A05."""
    return points.groupBy(scope).agg(F.count(F.lit(1)).alias("point_count"))


def reconcile(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """One row per difference between a manifest and an index, both with point_id, knowledge_scope, chunk_id and
    content_hash."""
    fields = ["knowledge_scope", "chunk_id", "content_hash"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("point_id").agg(
            F.count(F.lit(1)).alias(f"{name}_n"),
            *[F.min(f).alias(f"{name}_{f}") for f in fields])

    both = side(manifest, "m").join(side(index, "i"), "point_id", "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"m_{f}").eqNullSafe(F.col(f"i_{f}"))
    issue = (
        F.when(F.col("m_n").isNull(), "unexpected")
        .when(F.col("i_n").isNull(), "missing")
        .when(F.col("m_n") > 1, "duplicate_in_manifest")
        .when(F.col("i_n") > 1, "duplicate_in_index")
        .when(differs, "mismatch")
    )
    return both.select("point_id", issue.alias("issue")).filter(F.col("issue").isNotNull())


RANGES = 4096
IDENTITY_FIELDS = ("point_id", "knowledge_scope", "chunk_id", "content_hash")


def _range() -> Column:
    return F.pmod(F.xxhash64("point_id"), F.lit(RANGES))


def range_fingerprints(rows: DataFrame) -> DataFrame:
    """``range, rows, first, second``: counts and order-free digests of ``RANGES`` ranges of the point ids, from one pass of
    partial sums. Kept with a snapshot, they stand for it in later comparisons."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in IDENTITY_FIELDS]
    sums = [F.sum(F.xxhash64(F.lit(seed), *texts).cast("decimal(38,0)")).alias(name) for seed, name in ((1, "first"), (2, "second"))]
    return rows.groupBy(_range().alias("range")).agg(F.count(F.lit(1)).alias("rows"), *sums)


def reconcile_ranges(manifest: DataFrame, index: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """J14 by fingerprints: the same rows as :func:`reconcile`, of which only the ranges that differ are joined.

    ``kept`` are fingerprints of the manifest from before, so that an unchanged manifest is not read. A manifest written to a
    keyed table has each point once; a point that both sides hold equally often is not looked at.
    """
    left = (kept if kept is not None else range_fingerprints(manifest)).withColumnsRenamed({c: f"m_{c}" for c in ("rows", "first", "second")})
    right = range_fingerprints(index)
    same = (F.col("m_rows").eqNullSafe(F.col("rows")) & F.col("m_first").eqNullSafe(F.col("first"))
            & F.col("m_second").eqNullSafe(F.col("second")))
    differing = materialize(left.join(right, "range", "full").filter(~same).select("range"))

    def of(side: DataFrame) -> DataFrame:
        # One row a range at most, so the side that is sent to all tasks is bounded.
        return side.withColumn("range", _range()).join(F.broadcast(differing), "range", "left_semi").drop("range")

    return reconcile(of(manifest), of(index))


def sync_plan(items: DataFrame, index: DataFrame) -> DataFrame:
    """What brings the memory index in line with the stored items.

    ``items`` has id, status and version; ``index`` has id and version.
    """
    have = index.select("id", F.col("version").alias("indexed_version"))
    both = items.select("id", "status", "version").join(have, "id", "full")
    action = (
        F.when(F.coalesce(F.col("status") != "active", F.lit(True)),
               F.when(F.col("indexed_version").isNotNull(), "delete").otherwise("none"))
        .when(F.col("indexed_version").eqNullSafe(F.col("version")), "none")
        .otherwise("upsert")
    )
    return both.select("id", action.alias("action"))


def leaks(hits: DataFrame, forgotten: DataFrame, key: str = "item_id") -> DataFrame:
    """Results that must not be there, because the item is forgotten or belongs to another tenant."""
    gone = hits.join(forgotten.select(key), key, "left_semi").withColumn("leak", F.lit("forgotten"))
    foreign = hits.filter(~F.col("user_id").eqNullSafe(F.col("requested_user_id"))).withColumn(
        "leak", F.lit("foreign_tenant"))
    return gone.unionByName(foreign)
