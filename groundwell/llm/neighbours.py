"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are rotated by a random orthogonal matrix and assigned to inverted lists. A list is stored in blocks of bounded
size, each with its rotated vectors cut into column blocks. For a query and a list that it probes, distances grow column
block by column block; after each, a hypothesis test on the partial distance (which estimates the whole one, as the rotation
spreads differences evenly) abandons candidates that are unlikely to beat the bound. The bound is the k-th best of full
distances to the candidates that looked nearest after the first block. What survives is measured exactly on the original
vectors, and the k best of all lists are merged.

The lists are fitted on a sample of ``SAMPLE`` vectors; every vector is indexed. Distances are Euclidean, in double
precision, ties go to the smaller id. Queries are dealt out in groups, lists in blocks, so that neither a popular list nor a
vector with very many copies meets in one task.

A query whose lists hold fewer than k other vectors is asked again in all lists. The lists are made of the most frequent
dimension; vectors of another one are compared with those of their own, exactly and in blocks as well.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
an id; vectors of different dimensions have no distance; of rows that share an id each is a candidate, but none is one for
its own id; with fewer candidates than k all are returned; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.common import query, table
from groundwell.operators.stages import materialize

K = 10
SAMPLE = 20_000
#: Vectors of one block of a list, and queries of one group.
BLOCK = 4_096
QUERIES_AT_ONCE = 512
COLUMNS = 16
#: Strictness of the test: the chance to lose a true neighbour falls with its square.
STRICT = 2.1
#: Share of the lists that a query probes. Vectors without clusters, like random ones, need most of them.
PROBED = 0.75


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def rotation(dimension: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 12) -> np.ndarray:
    """k-means on the sample. Equal vectors count once, so that copies do not claim centres."""
    sample = np.unique(sample, axis=0)
    found = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = _nearest(sample, found, 1)[:, 0]
        sums, counts = np.zeros_like(found), np.bincount(nearest, minlength=len(found))
        np.add.at(sums, nearest, sample)
        there = counts > 0
        found[there] = sums[there] / counts[there, None]
    return found


def _nearest(rows: np.ndarray, found: np.ndarray, count: int) -> np.ndarray:
    norms = (found * found).sum(1)
    out = []
    for i in range(0, len(rows), 4096):
        far = norms - 2 * rows[i:i + 4096] @ found.T
        near = np.argpartition(far, count - 1, 1)[:, :count] if count < far.shape[1] else np.argsort(far, 1)
        out.append(near)
    return np.concatenate(out) if out else np.zeros((0, count), np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def scan(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int,
         strict: float = STRICT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, exact distances) of up to k candidates of one block for each query."""
    rotated = vectors @ turn
    width = rotated.shape[1]
    edges = [*range(0, width, COLUMNS), width]
    blocks = [np.ascontiguousarray(rotated[:, a:b].T) for a, b in zip(edges, edges[1:])]
    for q, own in zip(queries, query_ids):
        asked = q @ turn
        alive = np.flatnonzero(ids != own)
        if not len(alive):
            continue
        if len(alive) > k:
            partial = ((blocks[0] - asked[:edges[1], None]) ** 2).sum(0)[alive]
            near = alive[np.argpartition(partial, k - 1)[:k]]
            bound = np.max(((rotated[near] - asked) ** 2).sum(1)) * (1 + 1e-9)
            for block, a, b in zip(blocks, edges, edges[1:]):
                if a:
                    partial = partial + ((block[:, alive] - asked[a:b, None]) ** 2).sum(0)
                # At b of all dimensions, partial * width / b estimates the whole; a wide miss is no accident.
                slack = (1 + strict / np.sqrt(b)) ** 2 if b < width else 1 + 1e-9
                stay = partial * width <= bound * slack * b
                alive, partial = alive[stay], partial[stay]
        exact = np.sqrt(((vectors[alive] - q) ** 2).sum(1))
        best = np.lexsort((ids[alive], exact))[:k]
        yield int(own), alive[best], exact[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding",
           probed: float = PROBED, strict: float = STRICT) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to k nearest vectors of each row of ``queries``, other than rows of its id."""
    spark = vectors.sparkSession
    rows = valid(vectors, vec_id, embedding)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dimension, total = common.width, common["count"]
    sample = rows.filter(F.size("v") == dimension).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    found = centres(np.array(sample.select("v").toPandas()["v"].tolist()), int(min(4096, max(1, total ** 0.5))))
    turn = rotation(dimension)

    def assigned(vectors_: DataFrame, count: int, name: str) -> DataFrame:
        """Vectors with their nearest lists; those of another dimension have one list, below 0."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _nearest(_matrix(batch.column(1)), found, count)
                    order = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(order), batch.column(1).take(order), pa.array(near.reshape(-1).astype(np.int32))],
                        names=[name, "v", "list"])

        others = vectors_.filter(F.size("v") != dimension).select(F.col("vec_id").alias(name), "v", (-F.size("v")).alias("list"))
        return vectors_.filter(F.size("v") == dimension).mapInArrow(run, f"{name} bigint, v array<double>, list int").unionByName(others)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            data = _matrix(left.column("v").combine_chunks())
            usual = data.shape[1] == dimension
            for own, at, far in scan(_matrix(right.column("v").combine_chunks()), right.column("query_id").to_numpy(), ids, data,
                                     turn if usual else np.eye(data.shape[1]), k, strict if usual else 1e9):
                out.append((np.full(len(at), own), ids[at], far))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    # A block holds about BLOCK vectors of a list, a group about QUERIES_AT_ONCE queries: as many as counts ask for.
    kept = materialize(assigned(rows, 1, "vec_id"))
    sizes = kept.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))

    def found_in(posed_: DataFrame, probes: int) -> DataFrame:
        asked = materialize(assigned(posed_, probes, "query_id"))
        groups = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("groups"))
        shape = materialize(sizes.join(groups, "list"))
        stored = kept.join(shape, "list").select(
            "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "vec_id", "v")
        posed = asked.join(shape, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("group"), "query_id", "v")
        keys = ["list", "block", "group"]
        near = stored.groupBy(keys).cogroup(posed.groupBy(keys)).applyInArrow(
            compare, "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return materialize(near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score"))

    asks = valid(queries, vec_id, embedding)
    probes = max(1, min(len(found), int(np.ceil(probed * len(found)))))
    near = found_in(asks, probes)
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(asks.join(full, "vec_id", "left_anti"))
    if probes == len(found) or short.isEmpty():
        return near
    again = found_in(short, len(found))
    return near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


@query("op6_nearest_neighbours")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
