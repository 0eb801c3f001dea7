"""Merging and packing retrieved hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.render import context_block, context_head, context_line, context_tail
from groundwell.functions.text import first_reason, is_blank, is_finite, trim, value_key
from groundwell.functions.tokens import CODE_POINTS, TokenCounter
from groundwell.operators.skew import largest, top_n

SOURCES = ("memory", "document")


def metadata_reason(metadata: Column) -> Column:
    """Keys must stay distinct and non-empty after trimming."""
    keys = F.transform(F.map_keys(metadata), trim)
    return first_reason(
        (F.exists(keys, lambda k: k == ""), "metadata_key_required"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "metadata_key_repeated"),
    )


def trimmed_metadata(metadata: Column) -> Column:
    """Null for a refused or empty map."""
    entries = F.transform(F.map_entries(metadata), lambda e: F.struct(trim(e["key"]), trim(e["value"])))
    usable = metadata_reason(metadata).isNull() & (F.size(metadata) > 0)
    return F.when(usable, F.map_from_entries(entries))


def hit_reason() -> Column:
    """P10: ownership fields follow the source."""
    memory, document = trim(F.col("source")) == "memory", trim(F.col("source")) == "document"
    no_user, no_scope = is_blank(F.col("user_id")), is_blank(F.col("knowledge_scope"))
    return F.coalesce(
        first_reason(
            (is_blank(F.col("id")), "id_required"),
            (is_blank(F.col("content")), "content_required"),
            (~F.coalesce(is_finite(F.col("score")), F.lit(False)), "score_not_finite"),
            (memory & no_user, "memory_needs_user"),
            (memory & ~no_scope, "memory_with_scope"),
            (document & no_scope, "document_needs_scope"),
            (document & ~no_user, "document_with_user"),
            (~F.coalesce(memory | document, F.lit(False)), "source_unknown"),
        ),
        metadata_reason(F.col("metadata")),
    )


def validated_hits(hits: DataFrame) -> DataFrame:
    """P10: trimmed hits with their reject_reason."""
    texts = ["source", "id", "content", "user_id", "knowledge_scope", "kind", "title", "source_ref"]
    return hits.withColumn("reject_reason", hit_reason()).withColumns(
        {**{c: trim(F.col(c)) for c in texts}, "metadata": trimmed_metadata(F.col("metadata"))})


def ranked_by_source(hits: DataFrame, n: int | Column) -> DataFrame:
    """Best ``n`` per query and source; scores of different sources are never compared."""
    return top_n(hits, ["query_id", "source"], [F.desc("score"), F.asc("id")], n, rank="source_rank")


def _distinct_best(hits: DataFrame, quota: Column, bound: int) -> DataFrame:
    """Best hits with distinct content, up to the quota; a duplicate does not use up quota."""
    first = top_n(hits, ["query_id", "_key"], [F.desc("score"), F.asc("id")], 1, rank="_copy").drop("_copy")
    return top_n(first, ["query_id"], [F.desc("score"), F.asc("id")], quota, rank="source_rank", bound=bound)


def merge(hits: DataFrame, limits: DataFrame) -> DataFrame:
    """Memory first, then documents, each within its quota; a document whose content equals a *taken* memory
    is left out. ``limits`` has query_id, memory_limit and document_limit."""
    quotas = limits.select("query_id", "memory_limit", "document_limit")
    most_memory, most_documents = largest(quotas, "memory_limit", "document_limit")
    keyed = hits.withColumn("_key", value_key(F.col("content"))).join(quotas, "query_id")
    memory = _distinct_best(keyed.filter(F.col("source") == "memory"), F.col("memory_limit"), most_memory)
    taken = memory.select("query_id", "_key")
    others = keyed.filter(F.col("source") == "document").join(taken, ["query_id", "_key"], "left_anti")
    documents = _distinct_best(others, F.col("document_limit"), most_documents)
    return (
        memory.withColumn("source_order", F.lit(0))
        .unionByName(documents.withColumn("source_order", F.lit(1)))
        .drop("_key", "memory_limit", "document_limit")
    )


def select_within_budget(merged: DataFrame, budgets: DataFrame, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """Walk the merged hits of a query, skip each one that would push the rendered block over the budget and
    go on. A query has at most the sum of its quotas, so its hits fit one row.

    ``budgets`` has query_id and context_token_budget. With an additive counter the block costs its frame plus its
    lines; any other column counter is applied to the whole tentative block.
    """
    fields = ["source_order", "source_rank", "source", "id", "content", "kind", "title", "source_ref"]
    grouped = merged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_hits"))
    rendered = grouped.join(budgets.select("query_id", "context_token_budget"), "query_id").withColumn(
        "_rows", F.transform("_hits", lambda h: F.struct(h["id"].alias("id"), h["source"].alias("source"),
                                                         context_line(h).alias("line"))))
    frame = counter(F.lit(context_head() + context_tail()))
    start = F.struct(
        F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"),
        F.array().cast("array<string>").alias("dropped"), F.array().cast("array<string>").alias("lines"),
        F.array().cast("array<string>").alias("sources"))
    budget = F.col("context_token_budget")

    def step(state: Column, row: Column) -> Column:
        lines = F.concat(state["lines"], F.array(row["line"]))
        if counter.additive:
            total = F.when(state["used"] == 0, frame).otherwise(state["used"]) + counter(row["line"])
        else:
            total = counter(context_block(lines))
        keep = F.struct(
            total.cast("long").alias("used"), F.concat(state["kept"], F.array(row["id"])).alias("kept"),
            state["dropped"].alias("dropped"), lines.alias("lines"),
            F.concat(state["sources"], F.array(row["source"])).alias("sources"))
        drop = F.struct(
            state["used"].alias("used"), state["kept"].alias("kept"),
            F.concat(state["dropped"], F.array(row["id"])).alias("dropped"), state["lines"].alias("lines"),
            state["sources"].alias("sources"))
        return F.when(total <= budget, keep).otherwise(drop)

    packed = rendered.withColumn("_s", F.aggregate("_rows", start, step))
    return packed.select(
        "query_id",
        F.col("_s.kept").alias("kept_ids"),
        F.col("_s.dropped").alias("dropped_ids"),
        F.col("_s.used").alias("used_tokens"),
        context_block(F.col("_s.lines")).alias("rendered"),
        # Hits in use per source.
        F.size(F.filter(F.col("_s.sources"), lambda s: s == "memory")).cast("long").alias("used_memory_items"),
        F.size(F.filter(F.col("_s.sources"), lambda s: s == "document")).cast("long").alias("used_document_chunks"),
    )


def budget_reason() -> Column:
    return F.when(F.col("context_token_budget") <= 0, F.lit("context_token_budget_required"))
