"""Tenant-filtered vector search over two sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions import identity as ids
from groundwell.functions.memory import memory_point_reason
from groundwell.functions.render import memory_text
from groundwell.functions.text import first_reason, is_blank, trim
from groundwell.functions.vectors import dot, vector_reason
from groundwell.operators.blocks import (
    CANDIDATES, DIM, LIST_POINTS, PROBED, SCORE_DECIMALS, BlockIndex, approximate_search, block_index, pruned_search, scanned_best,
    usable)
from groundwell.operators.context import validated_hits
from groundwell.operators.joins import broadcast_if_small
from groundwell.operators.skew import largest, top_n
from groundwell.operators.stages import materialize


def split_vectors(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Adds the reason a vector is refused."""
    return df.withColumn("reject_reason", vector_reason(F.col(vector)))


def dimension_report(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Whether all vectors of a batch have one dimension."""
    return df.groupBy(*keys).agg(
        F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")
    ).withColumn("one_dimension", F.col("low") == F.col("high"))


def missing_vectors(inputs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Inputs for which no vector came back; must be empty."""
    return inputs.join(vectors.filter(F.col("vector").isNotNull()).select(key), key, "left_anti")


#: Tasks over which the points of one tenant are spread; every question is sent to each of them.
TENANT_PARTS = 16
#: Bytes of a ranked pair without vectors and payload.
BEST_ROW_BYTES = 256
#: Types of columns that a condition on pairs may read.
MATCHED = ("string", "long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp")


def _score() -> Column:
    return F.round(dot(F.col("vector"), F.col("query_vector")), SCORE_DECIMALS)


def nearest(queries: DataFrame, points: DataFrame | BlockIndex, tenant: str, limit: int | Column,
            matches: Column | None = None) -> DataFrame:
    """Best points per query by cosine inside the tenant of the query.

    ``queries`` has query_id, the tenant column and query_vector; ``points`` has point_id, the tenant column, vector and
    payload, or is an index of such points, which lets blocks be skipped. Vectors are scaled once per row, and each task keeps
    only its best rows per query; without ``matches``, a condition on pairs, questions and points meet as matrices. Tenant and dimension are parts of the join key: a pair
    across tenants is never formed, and a point of another dimension has no cosine with a question and is not met
    (:func:`foreign_dimensions` names the requests whose tenant has such points).
    """
    asked = usable(queries, "query_vector")
    bound = None if isinstance(limit, int) else largest(queries, limit)[0]
    if isinstance(points, BlockIndex):
        return pruned_search(asked, points, limit, _score(), matches, bound)
    # Points of tenants that nobody asks are dropped on the stored column, before their vectors are touched. The rest is
    # written once: pairs are ranked by ids and scores alone, and the payload comes back for the best of them.
    stored = materialize(usable(points.join(queries.select(tenant).distinct(), tenant, "left_semi"), "vector").withColumns({
        "_part": F.pmod(F.xxhash64("point_id"), F.lit(TENANT_PARTS)), "_row": F.monotonically_increasing_id()}))
    if matches is None:
        narrow = scanned_best(asked, stored, tenant, limit)
    else:
        spread = asked.withColumn("_part", F.explode(F.array(*[F.lit(i).cast("long") for i in range(TENANT_PARTS)])))
        needed = [c for c in stored.columns if c in {tenant, DIM, "_part", "_row", "point_id", "vector"} or (
            c not in spread.columns and stored.schema[c].dataType.typeName() in MATCHED)]
        pairs = stored.select(*needed).join(spread, [tenant, DIM, "_part"]).filter(matches)
        narrow = pairs.select(*[c for c in asked.columns if c not in ("query_vector", DIM)], "point_id", "_row", _score().alias("score"))
    best = top_n(narrow, ["query_id"], [F.desc("score"), F.asc("point_id")], limit, bound=bound)
    payload = stored.drop(tenant, DIM, "_part", "point_id", "vector")
    most = asked.count() * (limit if bound is None else bound)
    return payload.join(broadcast_if_small(best, most, BEST_ROW_BYTES), "_row").drop("_row")


def foreign_dimensions(queries: DataFrame, points: DataFrame, tenant: str) -> DataFrame:
    """``query_id, foreign_points`` of the requests whose tenant holds usable vectors of another dimension."""
    asked = queries.filter(vector_reason(F.col("query_vector")).isNull()).select(
        "query_id", tenant, F.size("query_vector").alias("_asked"))
    sizes = points.join(queries.select(tenant).distinct(), tenant, "left_semi").filter(
        vector_reason(F.col("vector")).isNull()).groupBy(tenant, F.size("vector").alias("_stored")).agg(F.count(F.lit(1)).alias("_n"))
    return asked.join(sizes, tenant).filter(F.col("_asked") != F.col("_stored")).groupBy("query_id").agg(
        F.sum("_n").alias("foreign_points"))


def search_documents(queries: DataFrame, points: DataFrame | BlockIndex, limit: int | Column) -> DataFrame:
    """Scoped document search."""
    return nearest(queries, points, "knowledge_scope", limit)


def search_memory(queries: DataFrame, points: DataFrame | BlockIndex, limit: int | Column) -> DataFrame:
    """Memory search of one user, of one kind when ``requested_kind`` is given."""
    asked = F.col("requested_kind")
    return nearest(queries, points, "user_id", limit, asked.isNull() | (F.col("kind") == asked))


def prefiltered(queries: DataFrame, points: DataFrame | BlockIndex, tenant: str, limit: int, probed: float = PROBED,
                candidates: int = CANDIDATES) -> DataFrame:
    """Approximate form of :func:`nearest`. Lists near a question propose points by their codes, and an exact pass ranks
    them; points of lists that are not probed are not seen. Off unless called."""
    index = points if isinstance(points, BlockIndex) else block_index(points, tenant, LIST_POINTS)
    return approximate_search(usable(queries, "query_vector"), index, limit, _score(), probed, candidates)


# --- hits ----------------------------------------------------------------------------------------------------------

HIT_COLUMNS = ["query_id", "source", "id", "content", "score", "user_id", "knowledge_scope", "kind", "title",
               "source_ref", "metadata"]


def memory_hits(results: DataFrame, *more: str) -> DataFrame:
    """Search results as hits of the memory source, with ``more`` columns as they are."""
    key, value, kind = trim(F.col("memory_key")), trim(F.col("value")), trim(F.col("kind"))
    return results.select(
        "query_id",
        F.lit("memory").alias("source"),
        F.concat(F.lit("memory:"), F.col("point_id").cast("string")).alias("id"),
        memory_text(kind, key, value).alias("content"),
        "score",
        "user_id",
        F.lit("").alias("knowledge_scope"),
        kind.alias("kind"),
        F.lit("").alias("title"),
        F.lit("").alias("source_ref"),
        F.create_map(F.lit("key"), key, F.lit("version"), F.col("version").cast("string")).alias("metadata"),
        *more,
    )


def document_hits(results: DataFrame, *more: str) -> DataFrame:
    return results.select(
        "query_id",
        F.lit("document").alias("source"),
        F.concat(F.lit("document:"), "point_id").alias("id"),
        trim(F.col("text")).alias("content"),
        "score",
        F.lit("").alias("user_id"),
        "knowledge_scope",
        F.lit("").alias("kind"),
        trim(F.col("title")).alias("title"),
        trim(F.col("source_ref")).alias("source_ref"),
        F.create_map(
            F.lit("document_id"), F.col("document_id"), F.lit("chunk_id"), F.col("chunk_id"),
            F.lit("content_hash"), F.col("content_hash"), F.lit("embedding_model"), F.col("embedding_model"),
        ).alias("metadata"),
        *more,
    )


def payload_reason() -> Column:
    """A document point must agree with its own payload."""
    return first_reason(
        (trim(F.col("point_id")) != ids.point_id(F.col("knowledge_scope"), F.col("chunk_id")), "point_id_mismatch"),
        (trim(F.col("content_hash")) != ids.trimmed_hash(F.col("text")), "content_hash_mismatch"),
        (is_blank(F.col("embedding_model")), "embedding_model_required"),
    )


def retrieved_chunks(chunks: DataFrame) -> DataFrame:
    """Six trimmed fields and the reason a chunk is refused."""
    fields = ["knowledge_scope", "document_id", "chunk_id", "title", "source_ref", "text"]
    required = ["knowledge_scope", "document_id", "chunk_id", "text"]
    reason = first_reason(*[(is_blank(F.col(c)), f"{c}_required") for c in required])
    return chunks.withColumn("reject_reason", reason).withColumns({c: trim(F.col(c)) for c in fields})


def document_point_reason() -> Column:
    """P13, P27 for a found document point."""
    required = [(is_blank(F.col(c)), f"{c}_required") for c in ("knowledge_scope", "document_id", "chunk_id", "text")]
    return F.coalesce(payload_reason(), first_reason(*required))


def judged_memories(results: DataFrame) -> DataFrame:
    """``point_reason`` of found memory points. A point without an ``item_id`` of its own is its item."""
    if "item_id" not in results.columns:
        results = results.withColumn("item_id", F.col("point_id"))
    return results.withColumn("requested_user_id", trim(F.col("user_id"))).withColumn("point_reason", memory_point_reason())


# --- both sources --------------------------------------------------------------------------------------------------


def dual_request_reason() -> Column:
    """P23."""
    return first_reason(
        (is_blank(F.col("query")), "query_required"),
        (~F.col("use_memory") & ~F.col("use_documents"), "no_source_enabled"),
        (F.col("use_memory") & (is_blank(F.col("user_id")) | (F.col("memory_limit") <= 0)),
         "memory_needs_user_and_limit"),
        (F.col("use_documents") & (is_blank(F.col("knowledge_scope")) | (F.col("document_limit") <= 0)),
         "documents_need_scope_and_limit"),
    )


def tenant_violations(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hits whose owner is not the one the request named."""
    owners = requests.select("query_id", F.col("user_id").alias("_user"), F.col("knowledge_scope").alias("_scope"))
    joined = hits.join(owners, "query_id", "left")
    own = F.when(F.col("source") == "memory", F.col("user_id").eqNullSafe(F.col("_user"))).otherwise(
        F.col("knowledge_scope").eqNullSafe(F.col("_scope")))
    return joined.filter(~own).drop("_user", "_scope")


def checked_hits(requests: DataFrame, memory_points: DataFrame | BlockIndex, document_points: DataFrame | BlockIndex) -> DataFrame:
    """Trimmed hits of both sources for every valid request, with the reason why a hit must not be used: its point breaks a
    payload rule (P13, P14, P27), it belongs to another tenant (P12), or it breaks a rule for hits (P10, P11)."""
    valid = requests.filter(dual_request_reason().isNull())
    personal = valid.filter("use_memory").select(
        "query_id", trim(F.col("user_id")).alias("user_id"), "query_vector", F.col("memory_limit").alias("_limit"),
        F.lit(None).cast("string").alias("requested_kind"))
    scoped = valid.filter("use_documents").select(
        "query_id", trim(F.col("knowledge_scope")).alias("knowledge_scope"), "query_vector",
        F.col("document_limit").alias("_limit"))
    memories = judged_memories(search_memory(personal, memory_points, F.col("_limit")))
    documents = search_documents(scoped, document_points, F.col("_limit")).withColumn("point_reason", document_point_reason())
    found = memory_hits(memories, "point_reason").unionByName(document_hits(documents, "point_reason"))
    owners = requests.select("query_id", trim(F.col("user_id")).alias("_user"), trim(F.col("knowledge_scope")).alias("_scope"))
    foreign = F.when(F.col("source") == "memory", ~F.col("user_id").eqNullSafe(F.col("_user"))).otherwise(
        ~F.col("knowledge_scope").eqNullSafe(F.col("_scope")))
    judged = validated_hits(found).join(owners, "query_id")
    return judged.withColumn("reject_reason", F.coalesce(
        F.concat(F.lit("stored point is not intact: "), "point_reason"), F.when(foreign, "hit of another tenant"),
        "reject_reason")).drop("_user", "_scope", "point_reason")


@dataclass(frozen=True)
class Retrieved:
    """Hits of the requests that can be answered, and ``query_id, reject_reason`` of those that met a broken hit."""

    hits: DataFrame
    refused: DataFrame


def dual_results(requests: DataFrame, memory_points: DataFrame | BlockIndex, document_points: DataFrame | BlockIndex) -> Retrieved:
    """A request that meets one hit that must not be used is given up with a reason, as its tenant's data cannot be
    trusted; all other requests of the batch are answered."""
    checked = materialize(checked_hits(requests, memory_points, document_points))
    refused = checked.filter(F.col("reject_reason").isNotNull()).groupBy("query_id").agg(F.min(
        F.concat("id", F.lit(": "), "reject_reason")).alias("reject_reason"))
    return Retrieved(checked.join(refused, "query_id", "left_anti").drop("reject_reason"), refused)


def dual_retrieve(requests: DataFrame, memory_points: DataFrame | BlockIndex, document_points: DataFrame | BlockIndex) -> DataFrame:
    """Hits of both sources for every valid request that can be answered; a disabled source is skipped.

    ``requests`` carries query_vector, computed once and used for both sources.
    """
    return dual_results(requests, memory_points, document_points).hits


def retrieval_warnings(requests: DataFrame) -> DataFrame:
    """A request without a usable query vector goes on without context, with a warning instead of hits."""
    reason = vector_reason(F.col("query_vector"))
    return requests.select("query_id", F.when(
        reason.isNotNull(), F.array(F.concat(F.lit("query embedding unavailable: "), reason))
    ).otherwise(F.array().cast("array<string>")).alias("warnings"))
