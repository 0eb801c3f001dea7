"""Golden-set evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import first_reason, is_blank, trim

RANKS = 3
MIN_CASES = 10


def _trimmed(values: Column) -> Column:
    return F.transform(values, trim)


def case_reasons(cases: DataFrame) -> DataFrame:
    """P25: reason per case; an empty or repeated id, missing or overlapping expectations."""
    copies = cases.groupBy(trim(F.col("case_id")).alias("_id")).agg(F.count(F.lit(1)).alias("_copies"))
    expected, forbidden = _trimmed(F.col("expected_chunk_ids")), _trimmed(F.col("forbidden_chunk_ids"))
    count = F.coalesce(F.size("expected_chunk_ids"), F.lit(0))
    joined = cases.withColumn("_id", trim(F.col("case_id"))).join(copies, "_id", "left")

    def unusable(values: Column) -> Column:
        return F.exists(values, lambda v: v == "") | (F.size(F.array_distinct(values)) < F.size(values))

    return joined.withColumn("reject_reason", first_reason(
        (is_blank(F.col("case_id")), "case_id_required"),
        (is_blank(F.col("query")), "query_required"),
        (is_blank(F.col("knowledge_scope")), "knowledge_scope_required"),
        (F.col("_copies") > 1, "case_id_repeated"),
        (~count.between(1, 3), "expected_count"),
        (F.coalesce(F.size("forbidden_chunk_ids"), F.lit(0)) < 1, "forbidden_required"),
        (unusable(expected), "expected_ids_unusable"),
        (unusable(forbidden), "forbidden_ids_unusable"),
        (F.size(F.array_intersect(expected, forbidden)) > 0, "expected_and_forbidden"),
    )).drop("_id", "_copies")


def ordered_cases(cases: DataFrame) -> DataFrame:
    """K03."""
    return cases.orderBy("case_id")


def hit_failures(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Retrieved rows that make the whole evaluation void. ``hits`` has case_id, rank, chunk_id and
    knowledge_scope; a case has at most three, so the repeat count is small."""
    scopes = cases.select("case_id", F.col("knowledge_scope").alias("_scope"))
    clean = hits.withColumn("_chunk", trim(F.col("chunk_id")))
    repeats = clean.groupBy("case_id", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    joined = clean.join(repeats, ["case_id", "_chunk"]).join(scopes, "case_id")
    return joined.select("case_id", "rank", "chunk_id", first_reason(
        (F.col("rank") > RANKS, "too_many_hits"),
        (trim(F.col("knowledge_scope")) != F.col("_scope"), "cross_scope_hit"),
        (F.col("_chunk") == "", "empty_chunk_id"),
        (F.col("_n") > 1, "duplicate_chunk_id"),
    ).alias("failure")).filter(F.col("failure").isNotNull())


def case_results(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall, reciprocal rank of the first expected hit and the forbidden hits of each case."""
    found = hits.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", trim(F.col("chunk_id")).alias("chunk_id")))).alias("_hits"))
    joined = cases.join(found, "case_id", "left").withColumns({
        "_hits": F.coalesce("_hits", F.array().cast("array<struct<rank:int,chunk_id:string>>")),
        "_expected": F.array_distinct(_trimmed(F.col("expected_chunk_ids"))),
        "_forbidden": F.array_distinct(_trimmed(F.col("forbidden_chunk_ids"))),
    })
    expected_hits = F.filter("_hits", lambda h: F.array_contains("_expected", h["chunk_id"]))
    ranks = F.transform(expected_hits, lambda h: h["rank"])
    ids = F.transform("_hits", lambda h: h["chunk_id"])
    return joined.select(
        "case_id",
        (F.size(expected_hits) / F.size("_expected")).alias("recall_at_3"),
        F.when(F.size(ranks) > 0, F.lit(1.0) / F.array_min(ranks)).otherwise(0.0).alias("mrr_at_3"),
        F.array_sort(F.filter(ids, lambda c: F.array_contains("_forbidden", c))).alias("forbidden_hits"),
        ids.alias("retrieved_chunk_ids"),
    )


def report(results: DataFrame, failures: DataFrame) -> DataFrame:
    """The means, the share of isolated cases and whether the set passed. A hit failure stops the job."""
    foreign = failures.filter("failure = 'cross_scope_hit'").select("case_id").distinct()
    isolated = foreign.agg(F.count(F.lit(1)).alias("n")).scalar()
    broken = failures.agg(F.count(F.lit(1)).alias("n")).scalar()
    guard = F.when(broken > 0, F.raise_error(F.lit("retrieval returned hits that void the evaluation")).cast("long"))
    perfect = (F.col("recall_at_3") == 1) & (F.size("forbidden_hits") == 0)
    totals = results.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.avg("recall_at_3").alias("mean_recall_at_3"),
        F.avg("mrr_at_3").alias("mean_mrr_at_3"),
        F.bool_and(perfect).alias("_perfect"),
    )
    few = F.raise_error(F.lit(f"the evaluation needs at least {MIN_CASES} cases")).cast("long")
    counted = F.when(F.col("case_count") < MIN_CASES, few).otherwise(F.col("case_count"))
    return totals.select(
        F.coalesce(guard, counted).alias("case_count"), "mean_recall_at_3", "mean_mrr_at_3",
        ((F.col("case_count") - isolated) / F.col("case_count")).alias("scope_isolation"), F.col("_perfect").alias("passed"))
