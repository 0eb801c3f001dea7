"""Blocks of near vectors inside each tenant: exact searches that skip blocks, and an approximate search over codes.

``block_index`` stores every point with the nearest of its tenant's centres, taken from the points themselves, one for about
``BLOCK_POINTS`` of them. Blocks are also what splits a hot tenant over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.text import compute_once
from groundwell.functions.vectors import dot, unit, vector_reason
from groundwell.operators.joins import broadcast_if_small
from groundwell.operators.skew import top_n
from groundwell.operators.stages import materialize

BLOCK_POINTS = 4096
MOST_BLOCKS = 256
#: Allowance for scores rounded to six decimals and for rounding in angles.
MARGIN = 2e-6
#: Approximate search: points of a list and of one task's share of a list, the share of a tenant's points whose lists are
#: probed, and candidates of each question that are scored exactly.
LIST_POINTS = 256
SLICE_POINTS = 16_384
PROBED = 0.75
CANDIDATES = 64
#: Exact search without an index: points of a tenant that one task holds, pairs that it scores at once, and pairs whose products
#: it holds at once.
SCAN_POINTS = 32_768
SCAN_PAIRS = 4_194_304
SCAN_PRODUCTS = 32_768
#: Vector stores keep scores in single precision; ranking on that many decimals keeps equal scores equal whatever the order of
#: summation, so that ties go to the smaller id.
SCORE_DECIMALS = 6
DIM = "_dim"


@dataclass(frozen=True)
class BlockIndex:
    """Stored points with unit vectors, block and cosine to its centre, and the centres of tenants of several blocks."""

    points: DataFrame
    centres: DataFrame
    tenant: str


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction, scaled to length one, with the dimension as part of their key."""
    once = compute_once(df, **{vector: F.col(vector)})
    return once.filter(vector_reason(F.col(vector)).isNull()).withColumns({vector: unit(F.col(vector)), DIM: F.size(vector)})


def _centres(points: DataFrame, tenant: str, size: int) -> DataFrame:
    """Centres of every tenant with more points than a block holds: its points of the smallest hashes."""
    counts = points.groupBy(tenant, DIM).agg(F.count(F.lit(1)).alias("_count")).filter(F.col("_count") > size)
    wanted = counts.withColumn("_blocks", F.least(F.ceil(F.col("_count") / size), F.lit(MOST_BLOCKS)).cast("int")).drop("_count")
    held = points.select(tenant, DIM, "point_id", "vector").join(wanted, [tenant, DIM])
    picked = top_n(held, [tenant, DIM], [F.xxhash64("point_id"), F.col("point_id")], F.col("_blocks"), rank="_block", bound=MOST_BLOCKS)
    return materialize(picked.select(tenant, DIM, "_block", F.col("vector").alias("_centre")))


def block_index(points: DataFrame, tenant: str, size: int = BLOCK_POINTS) -> BlockIndex:
    """Points without a usable vector are left out. A tenant of one block has block 0 and no cosine."""
    good = materialize(usable(points, "vector"))
    centres = _centres(good, tenant, size)
    grouped = centres.groupBy(tenant, DIM).agg(F.collect_list(F.struct("_block", "_centre")).alias("_centres"))
    rows, widest = centres.agg(F.count(F.lit(1)), F.coalesce(F.max(DIM), F.lit(0))).first()
    nearest = F.array_max(F.transform("_centres", lambda c: F.struct(
        dot(F.col("vector"), c["_centre"]).alias("near"), c["_block"].alias("block"))))
    met = compute_once(good.join(broadcast_if_small(grouped, rows, 16 + 8 * widest), [tenant, DIM], "left"), _place=nearest)
    placed = met.withColumns({"_block": F.coalesce(F.col("_place.block"), F.lit(0)), "_near": F.col("_place.near")})
    return BlockIndex(materialize(placed.drop("_place", "_centres")), centres, tenant)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def _blocks_of(index: BlockIndex) -> DataFrame:
    keys = [index.tenant, DIM, "_block"]
    blocks = index.points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_points"), F.min("_near").alias("_far"), F.max("_near").alias("_close"))
    return blocks.join(index.centres, keys, "left")


def block_bounds(asked: DataFrame, index: BlockIndex) -> DataFrame:
    """Every block of a question's tenant, with its points, the question's angle to its centre, and a bound that no cosine
    in the block exceeds: angles obey the triangle inequality."""
    met = asked.join(_blocks_of(index), [index.tenant, DIM]).withColumn("_turn", _angle(dot(F.col("query_vector"), F.col("_centre"))))
    gap = F.greatest(F.col("_turn") - _angle(F.col("_far")), _angle(F.col("_close")) - F.col("_turn"), F.lit(0.0))
    return met.withColumn("_bound", F.coalesce(F.cos(gap), F.lit(1.0)) + MARGIN).drop("_centre", "_far", "_close")


def block_pairs(reached: DataFrame, index: BlockIndex, matches: Column | None = None) -> DataFrame:
    """Pairs of questions and points of the blocks they reach. ``_floor`` is a cosine that a pair must be able to reach:
    both angles to the centre bound the angle between the two from below."""
    near = F.abs(F.col("_turn") - _angle(F.col("_near"))) <= _angle(F.col("_floor") - MARGIN) + MARGIN
    pairs = index.points.join(reached, [index.tenant, DIM, "_block"]).filter(F.coalesce(near, F.lit(True)))
    return pairs if matches is None else pairs.filter(matches)


def pruned_search(asked: DataFrame, index: BlockIndex, limit: int | Column, score: Column, matches: Column | None = None,
                  bound: int | None = None) -> DataFrame:
    """The best ``limit`` points of every question, exactly.

    The blocks that could hold the best come first, as many as hold ``limit`` points; they give a score that the last place
    certainly reaches, and only blocks and points that can reach it as well are scored then.
    """
    def best(scored: DataFrame) -> DataFrame:
        return top_n(scored, ["query_id"], [F.desc("score"), F.asc("point_id")], limit, bound=bound)

    def scored(reached: DataFrame) -> DataFrame:
        pairs = block_pairs(reached.drop("_points", "_bound", "_k", "_first"), index, matches)
        return pairs.withColumn("score", score).drop("vector", "query_vector", DIM, "_block", "_near", "_turn", "_floor")

    first, rest = search_rounds(asked, index, limit)
    found = materialize(best(scored(first)))
    most = (F.lit(limit) if isinstance(limit, int) else limit).alias("_last")
    floors = found.join(asked.select("query_id", most), "query_id").filter(F.col("rank") == F.col("_last")).select(
        "query_id", F.col("score").alias("_floor"))
    return best(found.drop("rank").unionByName(scored(with_floors(rest, floors))))


def search_rounds(asked: DataFrame, index: BlockIndex, limit: int | Column) -> tuple[DataFrame, DataFrame]:
    """The blocks of the first round, and all others."""
    reached = block_bounds(asked.withColumn("_k", F.lit(limit) if isinstance(limit, int) else limit), index)
    before = Window.partitionBy("query_id").orderBy(F.desc("_bound"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    reached = materialize(reached.withColumn("_first", F.coalesce(F.sum("_points").over(before), F.lit(0)) < F.col("_k")))
    return reached.filter("_first").withColumn("_floor", F.lit(-1.0)), reached.filter("NOT _first")


def with_floors(rest: DataFrame, floors: DataFrame) -> DataFrame:
    """The blocks that can still reach the floor of their question."""
    held = rest.join(floors, "query_id", "left").withColumn("_floor", F.coalesce("_floor", F.lit(-1.0)))
    return held.filter(F.col("_bound") >= F.col("_floor"))


def _codes(index: BlockIndex) -> DataFrame:
    """``point_id``, its list, and its residual to the list's centre in one byte for each dimension."""
    keys = [index.tenant, DIM, "_block"]
    blocks = _blocks_of(index).withColumn("_slices", F.ceil(F.col("_points") / SLICE_POINTS)).select(*keys, "_centre", "_slices")
    rest = F.when(F.col("_centre").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "_centre", lambda v, c: v - c))
    held = compute_once(index.points.select(*keys, "point_id", "vector").join(blocks, keys), _rest=rest)
    held = compute_once(held, _scale=F.greatest(F.array_max("_rest"), -F.array_min("_rest"), F.lit(1e-12)))
    return held.select(*keys, F.pmod(F.xxhash64("point_id"), F.col("_slices")).alias("_slice"), "point_id", "_scale",
                       F.transform("_rest", lambda x: F.round(x / F.col("_scale") * 127).cast("tinyint")).alias("_code"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the last decimal, halves away from zero as Spark rounds them."""
    scaled = scores * 10 ** SCORE_DECIMALS
    whole = np.floor(scaled + 0.5)
    # Near a half the decimal form of the number decides.
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        whole[i] = float(Decimal(repr(float(scores[i]))).scaleb(SCORE_DECIMALS).quantize(Decimal(1), ROUND_HALF_UP))
    return whole


def _best_of(vectors: np.ndarray, place: np.ndarray, asked: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, point, score) of the best points of each question, equal scores by ``place``. A product of matrices finds the
    pairs that can be among them; these are scored again, dimension by dimension, as the scores of Spark are."""
    points, most = len(vectors), min(int(limits.max()), len(vectors))
    near = asked @ vectors.T
    top = np.sort(np.partition(near, points - most, axis=1)[:, points - most:], axis=1)
    floors = top[np.arange(len(asked)), most - np.clip(limits, 1, most)] - MARGIN
    rows, at = np.nonzero(near >= np.where(limits > 0, floors, np.inf)[:, None])
    scores = np.concatenate([np.cumsum(vectors[at[i:i + SCAN_PRODUCTS]] * asked[rows[i:i + SCAN_PRODUCTS]], axis=1)[:, -1] + 0.0
                             for i in range(0, max(len(at), 1), SCAN_PRODUCTS)])
    order = np.lexsort((place[at], -_rounded(scores), rows))
    rank = np.arange(len(order)) - np.searchsorted(rows, rows[order])
    kept = order[rank < limits[rows[order]]]
    return rows[kept], at[kept], scores[kept]


def scanned_best(asked: DataFrame, points: DataFrame, tenant: str, limit: int | Column) -> DataFrame:
    """The best ``limit`` points of each question in every slice of its tenant's points, with their score: columns of ``asked``
    but the vector, ``point_id``, ``_row`` and ``score``. ``points`` is stored. Questions meet the points of a slice inside one task,
    so rows are made for the best and none for the other pairs."""
    keys = [tenant, DIM]
    counts = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SCAN_POINTS).alias("_slices"))
    dealt = points.select(*keys, "point_id", "_row", "vector").join(counts, keys)
    dealt = dealt.withColumn("_slice", F.pmod(F.xxhash64("point_id"), F.col("_slices"))).drop("_slices")
    kept = [c for c in asked.columns if c not in ("query_vector", DIM)]
    spread = asked.withColumn("_most", (F.lit(limit) if isinstance(limit, int) else limit).cast("long")).join(counts, keys)
    asks = spread.select(*kept, "query_vector", "_most", *[F.col(k).alias(f"_ask{k}") for k in keys], F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)).alias("_slice"))
    types = {f.name: f.dataType.simpleString() for f in [*points.schema.fields, *asked.schema.fields]}

    def scan(held: pa.Table, questions: pa.Table) -> pa.Table:
        ids, rows = held["point_id"].combine_chunks(), held["_row"].combine_chunks()
        told = questions.select(kept)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        limits = questions["_most"].to_numpy()
        if len(ids) and len(told) and limits.max() > 0:
            vectors, asked_vectors = _matrix(held["vector"]), _matrix(questions["query_vector"])
            place = np.empty(len(ids), np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            step = max(1, SCAN_PAIRS // len(ids))
            for at in range(0, len(told), step):
                if limits[at:at + step].max() > 0:
                    question, point, score = _best_of(vectors, place, asked_vectors[at:at + step], limits[at:at + step])
                    found.append((question + at, point, score))
        question, point, score = (np.concatenate(part) for part in zip(*found))
        best = told.take(pa.array(question))
        for name, values in (("point_id", ids.take(pa.array(point))), ("_row", rows.take(pa.array(point))), ("_raw", pa.array(score))):
            best = best.append_column(name, values)
        return best

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*kept, "point_id", "_row"]) + ", _raw double"
    found = dealt.groupBy(*keys, "_slice").cogroup(asks.groupBy(*[f"_ask{k}" for k in keys], "_slice")).applyInArrow(scan, schema)
    return found.withColumn("score", F.round("_raw", SCORE_DECIMALS)).drop("_raw")


def approximate_candidates(asked: DataFrame, index: BlockIndex, probed: float = PROBED, candidates: int = CANDIDATES) -> DataFrame:
    """``query_id, point_id``: the points of the probed lists with the best scores on codes, ``candidates`` of each
    question at most. Codes meet questions inside the share of a list, so a row is made per candidate and none per pair."""
    keys = [index.tenant, DIM, "_block"]
    met = asked.select("query_id", index.tenant, DIM, "query_vector").join(_blocks_of(index), [index.tenant, DIM])
    met = met.withColumn("_base", F.coalesce(dot(F.col("query_vector"), F.col("_centre")), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("_base"), "_block")
    before = F.coalesce(F.sum("_points").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_points").over(Window.partitionBy("query_id"))
    chosen = met.withColumns({"_before": before, "_total": total}).filter(
        F.col("_before") < F.greatest(F.col("_total") * probed, F.lit(candidates)))
    asks = chosen.select(*[F.col(k).alias(f"_ask{k}") for k in keys], "query_id", "query_vector", "_base", F.explode(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_points") / SLICE_POINTS) - 1)).alias("_slice"))
    kinds = {f.name: f.dataType.simpleString() for f in [*asks.schema.fields, *index.points.schema.fields]}

    def scan(points: pa.Table, asks_: pa.Table) -> pa.Table:
        ids, questions = points["point_id"].combine_chunks(), asks_["query_id"].combine_chunks()
        if not len(ids) or not len(questions):
            return pa.table({"query_id": questions[:0], "point_id": ids[:0], "near": pa.array([], pa.float64())})
        codes = _matrix(points["_code"]).astype(np.float32)
        scales = points["_scale"].to_numpy() / 127
        vectors, base = _matrix(asks_["query_vector"]).astype(np.float32), asks_["_base"].to_numpy()
        rows, places, scores = [], [], []
        for at in range(0, len(vectors), 256):
            near = (vectors[at:at + 256] @ codes.T) * scales + base[at:at + 256, None]
            most = min(candidates, near.shape[1])
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            rows.append(np.repeat(np.arange(at, at + len(near)), most))
            places.append(best.ravel())
            scores.append(np.take_along_axis(near, best, 1).ravel())
        return pa.table({"query_id": questions.take(pa.array(np.concatenate(rows))), "point_id": ids.take(pa.array(np.concatenate(places))),
                         "near": pa.array(np.concatenate(scores))})

    parts = [*keys, "_slice"]
    asked_parts = [*[f"_ask{k}" for k in keys], "_slice"]
    found = _codes(index).groupBy(*parts).cogroup(asks.groupBy(*asked_parts)).applyInArrow(
        scan, f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, near double")
    return top_n(found, ["query_id"], [F.desc("near"), F.asc("point_id")], candidates).select("query_id", "point_id")


def approximate_search(asked: DataFrame, index: BlockIndex, limit: int, score: Column, probed: float = PROBED,
                       candidates: int = CANDIDATES) -> DataFrame:
    """Candidates travel as two ids; vectors come back for them alone and are scored exactly."""
    proposed = approximate_candidates(asked, index, probed, max(candidates, limit)).join(asked, "query_id")
    pairs = index.points.join(proposed, [index.tenant, DIM, "point_id"])
    return top_n(pairs.withColumn("score", score).drop("vector", "query_vector", DIM, "_block", "_near"),
                 ["query_id"], [F.desc("score"), F.asc("point_id")], limit)
