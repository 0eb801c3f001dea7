"""Message history: incremental and newest-first reads, count and token windows, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.render import assistant_prefix, chat_message
from groundwell.functions.text import first_reason, is_blank, trim
from groundwell.functions.tokens import CODE_POINTS, TokenCounter
from groundwell.operators.skew import BUCKET_ROWS, lag_within_key, order_buckets, top_n
from groundwell.operators.stages import materialize

SESSION = ["session_id", "user_id"]
NEWEST_FIRST = ("created_at", "id")
TOKEN_MODE_FETCH = 50

# Message roles of a source message.
SOURCE_ROLES = ("user", "assistant")


def list_after(messages: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Messages past the watermark of their session, in id order. A session without a row starts at 0 only when
    it is listed, so ``watermarks`` names the sessions to read."""
    marks = watermarks.select(*SESSION, F.coalesce("last_message_id", F.lit(0)).alias("last_message_id"))
    return messages.join(marks, SESSION).filter(F.col("id") > F.col("last_message_id")).drop("last_message_id")


def recent(messages: DataFrame, n: int, position: str = "age") -> DataFrame:
    """The newest ``n`` messages per session and user; ``age`` is 1 for the newest."""
    return top_n(messages, SESSION, [F.desc(c) for c in NEWEST_FIRST], n, rank=position)


def oldest_first(window: DataFrame) -> DataFrame:
    """The order in which a window is handed to a prompt."""
    return window.orderBy(*SESSION, *[F.asc(c) for c in NEWEST_FIRST])


def turns_to_store(requests: DataFrame) -> DataFrame:
    """The rows a finished request appends: its question, its answer, both or none."""
    def turn(flag: str, role: str, content: str) -> DataFrame:
        return requests.filter(F.col(flag)).select(
            *SESSION, F.lit(role).alias("role"), F.col(content).alias("content"), "created_at")

    return turn("store_user_turn", "user", "message").unionByName(turn("store_assistant_turn", "assistant", "answer"))


def message_reasons(messages: DataFrame, rows: int = BUCKET_ROWS, roles: tuple[str, ...] = SOURCE_ROLES) -> DataFrame:
    """P20: reason per message. ``position`` is the order of arrival; ids must rise strictly within a session."""
    staged = messages.withColumn("_bucket", order_buckets(messages, "position", rows=rows))
    staged = lag_within_key(staged, SESSION, "_bucket", ["position"], F.col("id"), "_previous")
    role = F.lower(trim(F.col("role")))
    return staged.withColumn("reject_reason", first_reason(
        (F.col("id") <= 0, "id_not_positive"),
        (F.col("id") <= F.col("_previous"), "id_not_increasing"),
        (~role.isin(*roles), "role_unsupported"),
        (is_blank(F.col("content")), "content_required"),
    )).drop("_bucket", "_previous")


# --- windows -------------------------------------------------------------------------------------------------------


def count_window(messages: DataFrame, recent_limit: int) -> DataFrame:
    """Count mode fetches exactly ``recent_limit`` messages, so a limit of zero gives an empty history."""
    return recent(messages, recent_limit) if recent_limit > 0 else recent(messages, 1).filter(F.lit(False))


def message_tokens(counter: TokenCounter = CODE_POINTS, formatted: bool = True) -> Column:
    """Tokens of one message, with its chat markup or content only."""
    text = chat_message(F.col("role"), F.col("content")) if formatted else F.col("content")
    return counter.guarded(text)


def token_window(messages: DataFrame, budget: int | Column, strict: bool = True,
                 counter: TokenCounter = CODE_POINTS, fetch: int = TOKEN_MODE_FETCH) -> DataFrame:
    """Newest first until the first message that would exceed the budget; that one and all older ones are left out.

    The fetch limit comes first, as in a request, so a session holds at most ``fetch`` rows here. The strict form
    counts chat markup and may be empty; the lenient form counts content, always keeps the newest message and keeps
    everything when the budget is zero or less.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    fetched = recent(messages, fetch).withColumn("tokens", message_tokens(counter, formatted=strict))
    newest = Window.partitionBy(*SESSION).orderBy("age").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = fetched.withColumn("running_tokens", F.sum("tokens").over(newest))
    # Counts are not negative, so the running sum never falls back under the budget after the first overflow.
    fits = F.col("running_tokens") <= budget
    keep = (budget > 0) & fits if strict else (budget <= 0) | fits | (F.col("age") == 1)
    return summed.filter(keep)


def recent_start(window: DataFrame, sessions: DataFrame) -> DataFrame:
    """Q01: id of the oldest message inside each window, 0 for a session whose window is empty."""
    oldest = window.groupBy(*SESSION).agg(F.min_by("id", F.struct(*NEWEST_FIRST)).alias("recent_start_id"))
    return sessions.select(*SESSION).distinct().join(oldest, SESSION, "left").withColumn(
        "recent_start_id", F.coalesce("recent_start_id", F.lit(0)))


# --- requests and budgets ------------------------------------------------------------------------------------------


def chat_request_reason() -> Column:
    """P22 over the request columns."""
    auto, retrieval = F.col("auto_token_budget"), F.col("use_memory") | F.col("use_knowledge")
    return first_reason(
        (is_blank(F.col("session_id")), "session_id_required"),
        (is_blank(F.col("user_id")), "user_id_required"),
        (is_blank(F.col("message")), "message_required"),
        (auto & (F.col("recent_token_budget") > 0), "two_token_budgets"),
        (auto & (F.col("output_token_reserve") <= 0), "output_token_reserve_required"),
        (F.col("use_session_summary") & ~auto, "summary_needs_auto_budget"),
        (retrieval & ~auto, "retrieval_needs_auto_budget"),
        (F.col("use_memory") & (F.col("memory_limit") <= 0), "memory_limit_required"),
        (F.col("use_knowledge") & is_blank(F.col("knowledge_scope")), "knowledge_scope_required"),
        (F.col("use_knowledge") & (F.col("document_limit") <= 0), "document_limit_required"),
        (retrieval & (F.col("context_token_budget") <= 0), "context_token_budget_required"),
    )


def budget_plan(df: DataFrame) -> DataFrame:
    """Adds available_history_tokens and the reason a plan is impossible."""
    limit, fixed, reserve = F.col("context_limit"), F.col("fixed_input_tokens"), F.col("output_reserve")
    reason = first_reason(
        (limit.isNull(), "model_unknown"),
        (limit <= 0, "context_limit_not_positive"),
        (fixed < 0, "fixed_tokens_negative"),
        (reserve < 0, "reserve_negative"),
        (fixed + reserve > limit, "over_context_limit"),
    )
    return df.withColumn("reject_reason", reason).withColumn(
        "available_history_tokens", F.when(F.col("reject_reason").isNull(), limit - fixed - reserve))


def fixed_prompt(system: Column, question: Column) -> Column:
    """The part of a prompt every request carries: system message when there is one, question, assistant prefix."""
    head = F.when(F.coalesce(system, F.lit("")) == "", F.lit("")).otherwise(chat_message(F.lit("system"), system))
    return F.concat(head, chat_message(F.lit("user"), question), F.lit(assistant_prefix()))


def automatic_plan(requests: DataFrame, model_limits: DataFrame, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """The context limit comes from the model and the fixed tokens from the whole rendered prompt."""
    rendered = requests.join(model_limits, "model", "left").withColumn(
        "rendered_fixed_prompt", fixed_prompt(F.col("system_prompt"), F.col("message")))
    counted = rendered.withColumns({
        "fixed_input_tokens": counter.guarded(F.col("rendered_fixed_prompt")),
        "output_reserve": F.col("output_token_reserve"),
    })
    return budget_plan(counted)


def template_overhead(df: DataFrame, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """What the markup costs beyond system and prompt content; ``rendered`` is the whole prompt."""
    count = {c: counter.guarded(F.coalesce(c, F.lit(""))) for c in ("system", "prompt", "rendered")}
    content = count["system"] + count["prompt"]
    return df.withColumns({
        "system_tokens": count["system"], "prompt_tokens": count["prompt"], "content_tokens": content,
        "rendered_tokens": count["rendered"], "template_overhead": count["rendered"] - content,
    })


def summary_reserve_reason() -> Column:
    """B14 before the update: the reserves must make sense and fit."""
    reserve, output = F.col("summary_input_reserve"), F.col("summary_output_limit")
    return first_reason(
        (reserve <= 0, "summary_reserve_not_positive"),
        (output <= 0, "summary_output_not_positive"),
        (output >= reserve, "summary_output_over_reserve"),
        (F.col("available_history_tokens") < reserve, "history_smaller_than_reserve"),
    )


def summary_final_reason() -> Column:
    """B14 after the update: the block fits its reserve and the final plan does not shrink the history."""
    return first_reason(
        (F.col("summary_tokens") > F.col("summary_input_reserve"), "summary_over_reserve"),
        (F.col("final_available_tokens") < F.col("history_budget"), "history_would_shrink"),
    )


# --- whole conversations -------------------------------------------------------------------------------------------


def render_conversations(window: DataFrame, assistant: bool = True, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """One rendered prompt per session from a bounded window; the count is taken once, over the rendered text."""
    parts = window.groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct(*NEWEST_FIRST, chat_message(F.col("role"), F.col("content")).alias("text"))))
        .alias("_parts"))
    body = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    rendered = parts.select(*SESSION, F.concat(body, F.lit(assistant_prefix() if assistant else "")).alias("rendered"))
    return rendered.withColumn("total_tokens", counter.guarded(F.col("rendered")))


#: Messages of one slice of a transcript, about.
SLICE_MESSAGES = 1000


def transcript_totals(messages: DataFrame, counter: TokenCounter = CODE_POINTS, rows: int = SLICE_MESSAGES) -> DataFrame:
    """Content tokens against the tokens of the transcript ``role: content`` per line, in the order of ids.

    An additive counter gives the transcript count as a sum. With another one that names safe cuts, slices of a session are
    counted apart from their first cut to their last, and what lies between the cuts of two slices is counted again as a seam.
    No session is brought together in one place.
    """
    line = F.concat("role", F.lit(": "), "content", F.lit("\n"))
    if counter.additive:
        return messages.groupBy(*SESSION).agg(
            F.sum(counter.guarded(F.col("content"))).alias("content_tokens"),
            F.sum(counter.guarded(line)).alias("transcript_tokens"),
        )
    if counter.cut is None:
        raise ValueError("the transcript count of a session needs an additive counter, or one that names safe cuts")
    contents = messages.select(*SESSION, counter.guarded(F.col("content")).alias("n")).groupBy(*SESSION).agg(
        F.sum("n").alias("content_tokens"))
    lines = messages.select(*SESSION, "id", line.alias("line"), order_buckets(messages, "id", rows=rows).alias("slice"))
    slices = lines.groupBy(*SESSION, "slice").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l")).select(
        *SESSION, "slice", F.split(F.array_join(F.transform("l", lambda x: x["line"]), ""), counter.cut).alias("parts"))
    slices = materialize(slices.withColumn("whole", F.size("parts") == 1))
    inner = slices.filter("NOT whole").select(*SESSION, F.array_join(F.slice("parts", 2, F.size("parts") - 2), "").alias("text"))
    ends = F.array_sort(F.collect_list(F.struct(
        "slice", F.get("parts", F.lit(0)).alias("head"), "whole", F.element_at("parts", -1).alias("tail"))))

    def step(state: Column, part: Column) -> Column:
        grown = F.concat(state["open"], part["head"])
        return F.when(part["whole"], F.struct(state["seams"].alias("seams"), grown.alias("open"))).otherwise(
            F.struct(F.concat(state["seams"], F.array(grown)).alias("seams"), part["tail"].alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("seams"), F.lit("").alias("open"))
    folded = slices.groupBy(*SESSION).agg(F.aggregate(ends, start, step).alias("s"))
    seams = folded.select(*SESSION, F.explode(F.concat(F.col("s.seams"), F.array("s.open"))).alias("text"))
    counted = inner.unionByName(seams).filter("text <> ''").select(*SESSION, counter.guarded(F.col("text")).alias("n"))
    return contents.join(counted.groupBy(*SESSION).agg(F.sum("n").alias("transcript_tokens")), SESSION)
