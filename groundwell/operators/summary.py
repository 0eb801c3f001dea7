"""Rolling session summaries (Q01-Q07, P29): every step over all sessions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.render import clean_summary, message_line, update_prompt
from groundwell.functions.text import first_reason, is_blank
from groundwell.functions.tokens import CODE_POINTS, TokenCounter
from groundwell.operators.history import SESSION, list_after, message_tokens
from groundwell.operators.skew import BUCKET_ROWS, earlier_buckets, order_buckets, with_carry
from groundwell.operators.stages import materialize

# Trigger reasons.
NO_EVICTED, BOTH, BY_MESSAGES, BY_TOKENS, BELOW = (
    "no_evicted_messages", "both_thresholds", "message_threshold", "token_threshold", "below_threshold")


@dataclass(frozen=True)
class TriggerPolicy:
    min_messages: int = 8
    min_tokens: int = 2048

    def __post_init__(self) -> None:
        if self.min_messages <= 0 or self.min_tokens <= 0:
            raise ValueError("both thresholds must be positive")


def update_request_reason() -> Column:
    """P29."""
    return first_reason(
        (is_blank(F.col("session_id")), "session_id_required"),
        (is_blank(F.col("user_id")), "user_id_required"),
        (is_blank(F.col("model")), "model_required"),
        (F.col("recent_start_id") < 0, "recent_start_negative"),
        (F.col("max_output_tokens") <= 0, "max_output_tokens_required"),
    )


def lookup(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """Q07: the stored summary of each request; a missing one is version 0 with an empty text."""
    stored = summaries.select(*SESSION, "content", "last_message_id", "version", F.lit(True).alias("found"))
    return requests.join(stored, SESSION, "left").withColumns({
        "content": F.coalesce("content", F.lit("")),
        "last_message_id": F.coalesce("last_message_id", F.lit(0)),
        "version": F.coalesce("version", F.lit(0)),
        "found": F.coalesce("found", F.lit(False)),
    })


def is_evicted() -> Column:
    """A message past the watermark is evicted when the recent window starts after it."""
    start = F.col("recent_start_id")
    return (start == 0) | ((start > F.col("last_message_id")) & (F.col("id") < start))


def select_prefix(messages: DataFrame, requests: DataFrame, counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """Q02: per session the messages not yet summarised, those already evicted from the window, and the next watermark.

    ``requests`` has the session keys, last_message_id and recent_start_id. Everything is a conditional aggregate, so a
    long session is reduced before the shuffle.
    """
    marks = requests.select(*SESSION, "last_message_id", "recent_start_id")
    after = messages.join(marks, SESSION).filter(F.col("id") > F.col("last_message_id")).withColumn(
        "tokens", message_tokens(counter))
    evicted = is_evicted()
    sums = after.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("unsummarized_messages"),
        F.sum("tokens").alias("unsummarized_tokens"),
        F.count_if(evicted).alias("evicted_messages"),
        F.sum(F.when(evicted, F.col("tokens"))).alias("evicted_tokens"),
        F.max(F.when(evicted, F.col("id"))).alias("_last_evicted"),
        F.bool_or(F.col("id") == F.col("recent_start_id")).alias("_start_seen"),
    )
    start, mark = F.col("recent_start_id"), F.col("last_message_id")
    reason = first_reason(
        (mark < 0, "watermark_negative"),
        (start < 0, "recent_start_negative"),
        ((start > mark) & ~F.coalesce("_start_seen", F.lit(False)), "recent_start_not_found"),
    )
    joined = requests.join(sums, SESSION, "left").withColumn("reject_reason", reason)
    zero = {c: F.coalesce(c, F.lit(0)) for c in
            ("unsummarized_messages", "unsummarized_tokens", "evicted_messages", "evicted_tokens")}
    return joined.withColumns({**zero, "next_watermark": F.coalesce("_last_evicted", mark)}).drop(
        "_last_evicted", "_start_seen")


def trigger_reason(policy: TriggerPolicy) -> Column:
    """Q03: nothing is summarised before something has left the window."""
    messages = F.col("unsummarized_messages") >= policy.min_messages
    tokens = F.col("unsummarized_tokens") >= policy.min_tokens
    return (
        F.when(F.col("evicted_messages") == 0, NO_EVICTED)
        .when(messages & tokens, BOTH)
        .when(messages, BY_MESSAGES)
        .when(tokens, BY_TOKENS)
        .otherwise(BELOW)
    )


def trigger_input_reason() -> Column:
    return first_reason(
        (F.col("unsummarized_messages") < 0, "unsummarized_messages_negative"),
        (F.col("unsummarized_tokens") < 0, "unsummarized_tokens_negative"),
        (F.col("evicted_messages") < 0, "evicted_messages_negative"),
        (F.col("evicted_messages") > F.col("unsummarized_messages"), "evicted_over_unsummarized"),
    )


def decide(selection: DataFrame, policy: TriggerPolicy = TriggerPolicy()) -> DataFrame:
    bad = trigger_input_reason()
    return selection.withColumn("trigger_reason", F.when(bad.isNull(), trigger_reason(policy))).withColumn(
        "should_summarize", F.coalesce(F.col("trigger_reason").isin(BOTH, BY_MESSAGES, BY_TOKENS), F.lit(False)))


def update_prompts(messages: DataFrame, decided: DataFrame) -> DataFrame:
    """R07 per triggered session. A prompt is one text by contract; it holds the messages the trigger let through."""
    due = decided.filter(F.col("should_summarize") & F.col("reject_reason").isNull())
    marks = due.select(*SESSION, "last_message_id", "recent_start_id")
    evicted = messages.join(marks, SESSION).filter((F.col("id") > F.col("last_message_id")) & is_evicted())
    line = message_line(F.col("id"), F.col("role"), F.col("content"))
    parts = evicted.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("_l"))
    lines = F.array_join(F.transform("_l", lambda p: p["line"]), "")
    return due.join(parts, SESSION).withColumn("prompt", update_prompt(F.col("content"), lines)).drop("_l")


#: Levels of partial summaries; a generator that does not shorten its input ends there.
MOST_LEVELS = 12


def bounded_prompts(messages: DataFrame, decided: DataFrame, generate: Callable[[Column], Column], budget: int,
                    counter: TokenCounter = CODE_POINTS) -> DataFrame:
    """R07 under an input budget: as :func:`update_prompts`, but no prompt, partial ones included, holds more than ``budget``
    tokens of lines.

    A session whose lines fit is prompted as it is. Of others the lines are cut into runs of half the budget by their running
    count, so that a run ends with the line that crosses it. Each run is summarised on its own, all runs of all sessions side
    by side, and its summary takes the place of its lines, until these fit.
    A partial summary without text adds nothing. A line above half the budget, or summaries that do not get shorter, refuse the session with a ``prompt_reason``.
    """
    half = budget // 2
    due = decided.filter(F.col("should_summarize") & F.col("reject_reason").isNull())
    marks = due.select(*SESSION, "last_message_id", "recent_start_id")
    evicted = messages.join(marks, SESSION).filter((F.col("id") > F.col("last_message_id")) & is_evicted())
    lines = materialize(evicted.select(*SESSION, "id", message_line(F.col("id"), F.col("role"), F.col("content")).alias("line"))
                        .withColumn("tokens", counter(F.col("line"))))
    for _ in range(MOST_LEVELS):
        # The running count is taken over order buckets, so a long session is spread over tasks.
        bucketed = lines.withColumn("_bucket", order_buckets(lines, "id", rows=BUCKET_ROWS))
        local = Window.partitionBy(*SESSION, "_bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        placed = with_carry(bucketed, SESSION, "_bucket", {"_sum": F.sum("tokens")},
                            {"_base": F.coalesce(F.sum("_sum").over(earlier_buckets(SESSION, "_bucket")), F.lit(0))})
        before = F.col("_base") + F.coalesce(F.sum("tokens").over(local), F.lit(0))
        sums = lines.groupBy(*SESSION).agg(F.sum("tokens").alias("_total"), F.max("tokens").alias("_longest"))
        placed = materialize(placed.withColumn("run", F.floor(before / half)).join(sums, SESSION).select(
            *SESSION, "id", "line", "tokens", "run", "_total", "_longest"))
        several = materialize(placed.filter((F.col("_total") > budget) & (F.col("_longest") <= half)).select(*SESSION).distinct())
        if several.isEmpty():
            break
        part = placed.join(several.select(*SESSION), SESSION)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "")
        partial = part.groupBy(*SESSION, "run").agg(F.max("id").alias("id"), text.alias("text")).select(
            *SESSION, "id", clean_summary(generate(update_prompt(F.lit(""), F.col("text")))).alias("partial"))
        told = partial.filter(F.col("partial").isNotNull()).select(
            *SESSION, "id", message_line(F.col("id"), F.lit("summary"), F.col("partial")).alias("line")).withColumn(
            "tokens", counter(F.col("line")))
        lines = materialize(lines.join(several.select(*SESSION), SESSION, "left_anti").unionByName(told))
    reason = F.when(F.col("_total") <= budget, None).when(F.col("_longest") > half, "message_over_input_budget").otherwise(
        "summary_does_not_shrink")
    judged = placed.select(*SESSION, reason.alias("prompt_reason")).distinct()
    kept = placed.join(judged.filter(F.col("prompt_reason").isNull()).select(*SESSION), SESSION, "left_semi")
    parts = kept.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda p: p["line"]), "")
    return due.join(judged.select(*SESSION, "prompt_reason"), SESSION).join(parts, SESSION, "left").withColumn(
        "prompt", update_prompt(F.col("content"), joined)).drop("_l")


def save(stored: DataFrame, proposals: DataFrame) -> DataFrame:
    """Q05: compare-and-set. ``proposals`` has the keys, content, last_message_id and expected_version; the result says
    what happens to each and the version it would get."""
    current = stored.select(*SESSION, F.col("version").alias("_version"), F.col("last_message_id").alias("_mark"))
    expected = F.col("expected_version")
    outcome = (
        F.when(is_blank(F.col("content")), "content_required")
        .when(F.col("last_message_id") <= 0, "watermark_required")
        .when(expected < 0, "expected_version_negative")
        .when((expected == 0) & F.col("_version").isNotNull(), "version_conflict")
        .when((expected > 0) & ~F.col("_version").eqNullSafe(expected), "version_conflict")
        .when(F.col("last_message_id") < F.col("_mark"), "watermark_regression")
        .otherwise("accepted")
    )
    return proposals.join(current, SESSION, "left").withColumn("outcome", outcome).withColumn(
        "version", F.when(F.col("outcome") == "accepted", expected + 1)).drop("_version", "_mark")


def merged(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """The summary table after the accepted proposals."""
    accepted = saved.filter(F.col("outcome") == "accepted").select(*SESSION, "content", "last_message_id", "version")
    kept = stored.select(*SESSION, "content", "last_message_id", "version").join(accepted, SESSION, "left_anti")
    return kept.unionByName(accepted)


def first_and_last(prompt: Column) -> Column:
    """U03 default: an extractive stand-in for a model, the first and the last message line of the prompt."""
    lines = F.filter(F.split(prompt, "\n"), lambda l: F.startswith(l, F.lit("[id=")))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(
        F.concat(F.get(lines, F.lit(0)), F.lit(" … "), F.get(lines, F.size(lines) - 1)))


def update_all(messages: DataFrame, requests: DataFrame, summaries: DataFrame, policy: TriggerPolicy = TriggerPolicy(),
               generate: Callable[[Column], Column] = first_and_last,
               counter: TokenCounter = CODE_POINTS, input_budget: int | None = None) -> DataFrame:
    """Q06: read, select, decide, generate and compare-and-set for every requested session. With an ``input_budget`` no prompt
    holds more tokens of messages (:func:`bounded_prompts`).

    Each row tells whether the summary was updated; a failed step leaves the stored summary as it is. Requests that
    are not valid, or name a session more than once, come back with their reason.
    """
    repeated = F.count(F.lit(1)).over(Window.partitionBy(*SESSION)) > 1
    valid = requests.withColumn("request_reason", F.coalesce(
        update_request_reason(), F.when(repeated, "session_repeated")))
    refused = lookup(valid.filter(F.col("request_reason").isNotNull()), summaries).select(
        "*", F.col("request_reason").alias("reject_reason"), F.lit(False).alias("updated"),
        F.col("last_message_id").alias("watermark")).drop("request_reason")
    current = lookup(valid.filter(F.col("request_reason").isNull()), summaries)
    decided = decide(select_prefix(messages, current, counter), policy)
    if input_budget is None:
        prompts = update_prompts(messages, decided)
    else:
        decided = materialize(decided)
        prompts = materialize(bounded_prompts(messages, decided, generate, input_budget, counter))
        refusals = prompts.filter(F.col("prompt_reason").isNotNull()).select(*SESSION, "prompt_reason")
        prompts = prompts.filter(F.col("prompt_reason").isNull())
        decided = decided.join(refusals, SESSION, "left").withColumn(
            "reject_reason", F.coalesce("reject_reason", "prompt_reason")).drop("prompt_reason")
    made = prompts.select(
        *SESSION, clean_summary(generate(F.col("prompt"))).alias("generated"),
        F.col("next_watermark").alias("_mark"), F.col("version").alias("expected_version"))
    proposals = made.filter(F.col("generated").isNotNull()).select(
        *SESSION, F.col("generated").alias("content"), F.col("_mark").alias("last_message_id"), "expected_version")
    saved = save(summaries, proposals).select(
        *SESSION, F.col("outcome"), F.col("version").alias("new_version"), F.col("content").alias("new_content"))
    done = decided.join(saved, SESSION, "left").withColumns({
        "updated": F.coalesce(F.col("outcome") == "accepted", F.lit(False)),
        "version": F.coalesce("new_version", "version"),
        "content": F.coalesce("new_content", "content"),
        "watermark": F.when(F.col("outcome") == "accepted", F.col("next_watermark"))
        .otherwise(F.col("last_message_id")),
    }).drop("new_version", "new_content", "request_reason")
    return done.unionByName(refused, allowMissingColumns=True)


def unread(messages: DataFrame, summaries: DataFrame, sessions: DataFrame) -> DataFrame:
    """S03 with the stored watermarks; sessions without a summary are read from the start."""
    return list_after(messages, lookup(sessions.select(*SESSION).distinct(), summaries))
