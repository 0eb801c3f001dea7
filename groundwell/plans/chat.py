"""Context assembly for chat requests: retrieval, packing, budgets, history, summary, final prompt.

All requests of a batch run together. A summary can be advanced only once per batch, so requests that use the summary of one
session are refused when there are several; other requests may share a session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.render import assistant_prefix, chat_message, combined_system, summary_block
from groundwell.functions.tokens import CODE_POINTS, TokenCounter
from groundwell.functions.vectors import hash_embedding
from groundwell.operators import context, history, summary, vector
from groundwell.operators.history import SESSION
from groundwell.operators.skew import largest
from groundwell.operators.stages import materialize


@dataclass(frozen=True)
class ChatSettings:
    summary_input_reserve: int = 1024
    summary_output_limit: int = 512
    policy: summary.TriggerPolicy = summary.TriggerPolicy()
    max_fetch: int = history.TOKEN_MODE_FETCH


def _retrieved(requests: DataFrame, memory_points: DataFrame, document_points: DataFrame,
               embed: Callable[[Column], Column], counter: TokenCounter) -> DataFrame:
    asked = requests.filter(F.col("use_memory") | F.col("use_knowledge")).select(
        F.col("request_id").alias("query_id"), F.col("message").alias("query"), "user_id", "knowledge_scope", "use_memory",
        F.col("use_knowledge").alias("use_documents"), "memory_limit", "document_limit", "context_token_budget",
    )
    embedded = materialize(asked.withColumn("query_vector", embed(F.col("query"))))
    found = vector.dual_results(embedded, memory_points, document_points)
    selection = context.select_within_budget(context.merge(found.hits, embedded), embedded, counter)
    warned = vector.retrieval_warnings(embedded).join(
        found.refused.withColumnRenamed("reject_reason", "retrieval_reason"), "query_id", "left")
    return warned.join(selection, "query_id", "left").withColumnRenamed("query_id", "request_id")


def _windows(requests: DataFrame, messages: DataFrame, counter: TokenCounter, fetch: int) -> DataFrame:
    """B09 and B10 per request: the newest messages of its session, as many as it asks for. Only a token mode without a
    limit of its own is bounded by ``fetch``."""
    limit = F.when(F.col("recent_limit") > 0, F.col("recent_limit")).otherwise(
        F.when(F.col("history_mode") == "count", 0).otherwise(fetch))
    asked = requests.select("request_id", *SESSION, "history_mode", "history_budget", limit.alias("_limit"))
    most = largest(asked, "_limit")[0]
    recent = history.recent(messages.join(asked.select(*SESSION).distinct(), SESSION, "left_semi"), most)
    joined = recent.withColumn("tokens", history.message_tokens(counter)).join(asked, SESSION)
    newest = Window.partitionBy("request_id").orderBy("age").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = joined.filter(F.col("age") <= F.col("_limit")).drop("_limit")
    return inside.withColumn("running_tokens", F.sum("tokens").over(newest)).filter(
        (F.col("history_mode") == "count") | (F.col("running_tokens") <= F.col("history_budget")))


def assemble(requests: DataFrame, messages: DataFrame, memory_points: DataFrame, document_points: DataFrame,
             summaries: DataFrame, model_limits: DataFrame, settings: ChatSettings = ChatSettings(),
             embed: Callable[[Column], Column] = hash_embedding,
             generate: Callable[[Column], Column] = summary.first_and_last,
             counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """One row per request: the prompt with its budget, or the reason there is none."""
    shared = F.count_if("use_session_summary").over(Window.partitionBy(*SESSION)) > 1
    judged = materialize(requests.withColumn("reject_reason", F.coalesce(
        history.chat_request_reason(), F.when(F.col("use_session_summary") & shared, "session_repeated"))))
    valid = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    retrieved = _retrieved(valid, memory_points, document_points, embed, counter)
    block = F.coalesce("rendered", F.lit(""))
    prepared = valid.join(retrieved, "request_id", "left").withColumn(
        "system_prompt", F.when(block == "", F.col("system_prompt")).otherwise(
            combined_system(F.col("system_prompt"), block)))

    planned = history.automatic_plan(prepared, model_limits, counter).withColumnRenamed("reject_reason", "plan_reason")
    reserve = F.when(F.col("use_session_summary"), settings.summary_input_reserve).otherwise(0)
    planned = planned.withColumns({
        "summary_input_reserve": F.lit(settings.summary_input_reserve),
        "summary_output_limit": F.lit(settings.summary_output_limit),
        "history_mode": F.when(F.col("auto_token_budget"), "automatic").when(F.col("recent_token_budget") > 0, "manual")
        .otherwise("count"),
    })
    planned = materialize(planned.withColumns({
        "plan_reason": F.coalesce("retrieval_reason", F.when(F.col("auto_token_budget"), F.coalesce("plan_reason", F.when(
            F.col("use_session_summary"), history.summary_reserve_reason())))),
        "history_budget": F.when(F.col("auto_token_budget"), F.col("available_history_tokens") - reserve)
        .otherwise(F.col("recent_token_budget")),
    }))
    going = planned.filter(F.col("plan_reason").isNull())
    window = materialize(_windows(going, messages, counter, settings.max_fetch))

    # The summary is advanced over what has left the conservative window.
    starts = window.groupBy("request_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("recent_start_id"))
    asking = going.filter("use_session_summary").join(starts, "request_id", "left").select(
        *SESSION, "model", F.coalesce("recent_start_id", F.lit(0)).alias("recent_start_id"),
        F.lit(settings.summary_output_limit).alias("max_output_tokens"))
    updated = summary.update_all(messages, asking, summaries, settings.policy, generate, counter).select(
        *SESSION, F.col("content").alias("summary"), F.col("version").alias("summary_version"),
        F.col("watermark").alias("summary_watermark"), F.col("trigger_reason").alias("summary_trigger_reason"),
        F.col("updated").alias("summary_updated"), F.col("reject_reason").alias("summary_reason"))
    with_summary = going.withColumn("_key", F.when(F.col("use_session_summary"), F.col("request_id"))).join(
        updated.join(going.filter("use_session_summary").select(F.col("request_id").alias("_key"), *SESSION), SESSION)
        .drop(*SESSION), "_key", "left").drop("_key")
    has_summary = F.coalesce("summary_version", F.lit(0)) > 0
    note = summary_block(F.col("summary"))
    final_system = F.when(has_summary, combined_system(F.col("system_prompt"), note)).otherwise(F.col("system_prompt"))
    final_fixed = counter(history.fixed_prompt(final_system, F.col("message")))
    staged = with_summary.withColumns({
        "system_prompt": final_system,
        "final_fixed_tokens": final_fixed,
        "summary_tokens": F.when(has_summary, counter(chat_message(F.lit("system"), note))),
        "final_available_tokens": F.when(has_summary, F.col("context_limit") - final_fixed - F.col("output_reserve")),
    }).withColumn("final_reason", F.coalesce("summary_reason", history.summary_final_reason()))

    parts = window.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "id", chat_message(F.col("role"), F.col("content"))
                                             .alias("text")))).alias("_parts"),
        F.sum("tokens").alias("used_recent_tokens"))
    body = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    head = F.when(F.coalesce("system_prompt", F.lit("")) == "", F.lit("")).otherwise(
        chat_message(F.lit("system"), F.col("system_prompt")))
    done = staged.join(parts, "request_id", "left").select(
        "request_id",
        "final_reason",
        F.concat(head, F.coalesce(body, F.lit("")), chat_message(F.lit("user"), F.col("message")),
                 F.lit(assistant_prefix())).alias("prompt"),
        F.col("history_mode").alias("budget_mode"),
        "context_limit",
        F.when(has_summary, F.col("final_fixed_tokens")).otherwise(F.col("fixed_input_tokens")).alias("fixed_input_tokens"),
        F.coalesce("final_available_tokens", "available_history_tokens").alias("available_recent_tokens"),
        F.coalesce("used_recent_tokens", F.lit(0)).alias("used_recent_tokens"),
        F.coalesce(F.size("_parts"), F.lit(0)).cast("long").alias("used_messages"),
        "summary_version", "summary_watermark", "summary_trigger_reason",
        F.coalesce("summary_updated", F.lit(False)).alias("summary_updated"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_context_tokens"),
        "used_memory_items", "used_document_chunks", "warnings",
    )
    reasons = judged.select("request_id", *SESSION, "reject_reason").join(
        planned.select("request_id", "plan_reason"), "request_id", "left")
    joined = reasons.join(done, "request_id", "left")
    reason = F.coalesce("reject_reason", "plan_reason", "final_reason")
    return joined.withColumns({
        "reject_reason": reason,
        "prompt": F.when(reason.isNull(), F.col("prompt")),
    }).drop("plan_reason", "final_reason")
