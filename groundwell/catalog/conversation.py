"""History windows, budgets, chat rendering and rolling summaries over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.registry import query
from groundwell.functions import render
from groundwell.operators import history, summary
from groundwell.sources import tables

_M = f"WITH {sql.MESSAGES}"
_CHAT = "'<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)"
_NEWEST = "PARTITION BY session_id, user_id ORDER BY created_at DESC, id DESC"
WINDOW_BUDGET = 700
POLICY = summary.TriggerPolicy(min_messages=3, min_tokens=900)
MODELS = [("small", 4096), ("large", 32768)]


def messages(spark, folder):
    return tables.messages(spark, folder)


def watermarks(spark, folder):
    """A watermark per session: the largest id among its system and user turns before turn 3."""
    return messages(spark, folder).groupBy("session_id", "user_id").agg(
        F.coalesce(F.max(F.when((F.col("role") == "user") & (F.col("id") % 1000 < 4), F.col("id"))), F.lit(0))
        .alias("last_message_id"))


_MARKS = f"""{_M},
marks AS (SELECT session_id, user_id,
  coalesce(max(CASE WHEN role = 'user' AND id % 1000 < 4 THEN id END), 0) AS last_message_id
  FROM messages GROUP BY session_id, user_id)"""


@query("s03_messages_after", f"""{_MARKS}
  SELECT id, session_id, user_id, role, content FROM messages JOIN marks USING (session_id, user_id)
  WHERE id > last_message_id""")
def _(spark, folder):
    return history.list_after(messages(spark, folder), watermarks(spark, folder)).select(
        "id", "session_id", "user_id", "role", "content")


@query("s04_newest_messages", f"""{_M}
  SELECT id, session_id, user_id, role, content, created_at, age FROM (
    SELECT *, row_number() OVER ({_NEWEST}) AS age FROM messages) WHERE age <= 4""")
def _(spark, folder):
    return history.recent(messages(spark, folder), 4).select(
        "id", "session_id", "user_id", "role", "content", "created_at", "age")


@query("k04_oldest_first", f"""{_M}
  SELECT session_id, user_id, id, row_number() OVER (PARTITION BY session_id, user_id ORDER BY created_at, id) AS place
  FROM (SELECT *, row_number() OVER ({_NEWEST}) AS age FROM messages) WHERE age <= 4""")
def _(spark, folder):
    window = history.oldest_first(history.recent(messages(spark, folder), 4))
    size = window.groupBy("session_id", "user_id").agg(F.max("age").alias("n"))
    return window.join(size, ["session_id", "user_id"]).select(
        "session_id", "user_id", "id", (F.col("n") - F.col("age") + 1).alias("place"))


_REQUESTS = f"""{_M},
requests AS (SELECT session_id, user_id, id, content AS message, role,
  role <> 'system' AS store_user_turn, role = 'assistant' AS store_assistant_turn, 'echo ' || role AS answer, created_at,
  id % 3 = 0 AS auto_token_budget, CASE WHEN id % 5 = 0 THEN 100 ELSE 0 END AS recent_token_budget,
  CASE WHEN id % 7 = 0 THEN 0 ELSE 256 END AS output_token_reserve, id % 2 = 0 AS use_session_summary,
  id % 11 = 0 AS use_memory, id % 13 = 0 AS use_knowledge, CASE WHEN id % 22 = 0 THEN 0 ELSE 3 END AS memory_limit,
  CASE WHEN id % 26 = 0 THEN 0 ELSE 3 END AS document_limit,
  CASE WHEN id % 39 = 0 THEN '' ELSE 'scope' END AS knowledge_scope,
  CASE WHEN id % 33 = 0 THEN 0 ELSE 500 END AS context_token_budget,
  CASE WHEN id % 4 = 0 THEN 'small' WHEN id % 4 = 1 THEN 'large' ELSE 'unknown' END AS model,
  CASE WHEN role = 'user' THEN 'Be brief.' ELSE '' END AS system_prompt
  FROM messages)"""


def requests(spark, folder):
    """One request per message, with settings derived from its id so that every rule is met and broken somewhere."""
    i = F.col("id")

    def pick(test, yes, no):
        return F.when(test, F.lit(yes)).otherwise(F.lit(no))

    return messages(spark, folder).select(
        "session_id", "user_id", "id", F.col("content").alias("message"), "role",
        (F.col("role") != "system").alias("store_user_turn"),
        (F.col("role") == "assistant").alias("store_assistant_turn"),
        F.concat(F.lit("echo "), "role").alias("answer"), "created_at",
        (i % 3 == 0).alias("auto_token_budget"),
        pick(i % 5 == 0, 100, 0).alias("recent_token_budget"),
        pick(i % 7 == 0, 0, 256).alias("output_token_reserve"),
        (i % 2 == 0).alias("use_session_summary"),
        (i % 11 == 0).alias("use_memory"), (i % 13 == 0).alias("use_knowledge"),
        pick(i % 22 == 0, 0, 3).alias("memory_limit"), pick(i % 26 == 0, 0, 3).alias("document_limit"),
        pick(i % 39 == 0, "", "scope").alias("knowledge_scope"),
        pick(i % 33 == 0, 0, 500).alias("context_token_budget"),
        F.when(i % 4 == 0, "small").when(i % 4 == 1, "large").otherwise("unknown").alias("model"),
        pick(F.col("role") == "user", "Be brief.", "").alias("system_prompt"),
    )


@query("s05_stored_turns", f"""{_REQUESTS}
  SELECT session_id, user_id, 'user' AS role, message AS content, created_at FROM requests WHERE store_user_turn
  UNION ALL SELECT session_id, user_id, 'assistant', answer, created_at FROM requests WHERE store_assistant_turn""")
def _(spark, folder):
    return history.turns_to_store(requests(spark, folder))


@query("p20_message_sequence", f"""{_M},
  arrived AS (SELECT *, id + CASE WHEN role = 'system' THEN 2 ELSE 0 END AS position FROM messages),
  seen AS (SELECT *, lag(id) OVER (PARTITION BY session_id, user_id ORDER BY position, id) AS before FROM arrived)
  SELECT session_id, id, CASE WHEN id <= 0 THEN 'id_not_positive' WHEN id <= before THEN 'id_not_increasing'
    WHEN lower({sql.trim('role')}) NOT IN ('user', 'assistant') THEN 'role_unsupported'
    WHEN {sql.blank('content')} THEN 'content_required' END AS reject_reason FROM seen""")
def _(spark, folder):
    arrived = messages(spark, folder).withColumn(
        "position", F.col("id") * 10 + F.when(F.col("role") == "system", 21).otherwise(0))
    # The last digit keeps positions distinct, as two messages may otherwise arrive at the same place.
    return history.message_reasons(arrived, rows=100).select("session_id", "id", "reject_reason")


@query("p22_chat_requests", f"""{_REQUESTS}
  SELECT id, CASE WHEN {sql.blank('session_id')} THEN 'session_id_required'
    WHEN {sql.blank('user_id')} THEN 'user_id_required' WHEN {sql.blank('message')} THEN 'message_required'
    WHEN auto_token_budget AND recent_token_budget > 0 THEN 'two_token_budgets'
    WHEN auto_token_budget AND output_token_reserve <= 0 THEN 'output_token_reserve_required'
    WHEN use_session_summary AND NOT auto_token_budget THEN 'summary_needs_auto_budget'
    WHEN (use_memory OR use_knowledge) AND NOT auto_token_budget THEN 'retrieval_needs_auto_budget'
    WHEN use_memory AND memory_limit <= 0 THEN 'memory_limit_required'
    WHEN use_knowledge AND {sql.blank('knowledge_scope')} THEN 'knowledge_scope_required'
    WHEN use_knowledge AND document_limit <= 0 THEN 'document_limit_required'
    WHEN (use_memory OR use_knowledge) AND context_token_budget <= 0 THEN 'context_token_budget_required'
    END AS reject_reason FROM requests""")
def _(spark, folder):
    return requests(spark, folder).select("id", history.chat_request_reason().alias("reject_reason"))


@query("b09_count_window", f"""{_M}
  SELECT session_id, user_id, id FROM (SELECT *, row_number() OVER ({_NEWEST}) AS age FROM messages) WHERE age <= 3""")
def _(spark, folder):
    return history.count_window(messages(spark, folder), 3).select("session_id", "user_id", "id")


_WINDOW = f"""{_M},
counted AS (SELECT *, length({_CHAT}) AS tokens, row_number() OVER ({_NEWEST}) AS age FROM messages),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id, user_id ORDER BY age
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM counted WHERE age <= 50),
recent AS (SELECT * FROM summed WHERE running <= {WINDOW_BUDGET})"""


def strict_window(spark, folder):
    return history.token_window(messages(spark, folder), WINDOW_BUDGET)


@query("b10_token_window", f"""{_WINDOW}
  SELECT 'strict' AS mode, session_id, user_id, id, tokens, CAST(running AS BIGINT) AS running_tokens FROM recent
  UNION ALL
  SELECT 'lenient', session_id, user_id, id, tokens, CAST(running AS BIGINT) FROM (
    SELECT *, sum(tokens) OVER (PARTITION BY session_id, user_id ORDER BY age
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
    FROM (SELECT * REPLACE (length(content) AS tokens) FROM counted WHERE age <= 50))
  WHERE running <= {WINDOW_BUDGET} OR age = 1""")
def _(spark, folder):
    cols = ["session_id", "user_id", "id", "tokens", "running_tokens"]
    lenient = history.token_window(messages(spark, folder), WINDOW_BUDGET, strict=False)
    return strict_window(spark, folder).select(F.lit("strict").alias("mode"), *cols).unionByName(
        lenient.select(F.lit("lenient").alias("mode"), *cols))


@query("b11_budget_plan", f"""{_REQUESTS}
  SELECT id, CASE WHEN length(message) + output_token_reserve > 600 THEN 'over_context_limit' END AS reject_reason,
    CASE WHEN length(message) + output_token_reserve <= 600 THEN 600 - length(message) - output_token_reserve END
      AS available_history_tokens FROM requests""")
def _(spark, folder):
    plans = requests(spark, folder).select(
        "id", F.lit(600).alias("context_limit"), F.char_length("message").alias("fixed_input_tokens"),
        F.col("output_token_reserve").alias("output_reserve"))
    return history.budget_plan(plans).select("id", "reject_reason", "available_history_tokens")


_PLANNED = f"""{_REQUESTS},
limits(model, context_limit) AS (VALUES ('small', 4096), ('large', 32768)),
planned AS (SELECT r.*, context_limit,
    length(CASE WHEN system_prompt = '' THEN '' ELSE '<|im_start|>system' || chr(10) || system_prompt || '<|im_end|>'
      || chr(10) END || '<|im_start|>user' || chr(10) || message || '<|im_end|>' || chr(10) || '<|im_start|>assistant'
      || chr(10)) AS fixed FROM requests r LEFT JOIN limits USING (model))"""


def planned(spark, folder):
    limits = spark.createDataFrame(MODELS, "model string, context_limit long")
    return history.automatic_plan(requests(spark, folder), limits)


@query("b12_automatic_plan", f"""{_PLANNED}
  SELECT id, model, CAST(context_limit AS BIGINT) AS context_limit, fixed AS fixed_input_tokens,
    CASE WHEN context_limit IS NULL THEN 'model_unknown' WHEN fixed + output_token_reserve > context_limit
      THEN 'over_context_limit' END AS reject_reason,
    CASE WHEN fixed + output_token_reserve <= context_limit THEN context_limit - fixed - output_token_reserve END
      AS available_history_tokens FROM planned""")
def _(spark, folder):
    return planned(spark, folder).select(
        "id", "model", "context_limit", "fixed_input_tokens", "reject_reason", "available_history_tokens")


@query("b13_template_overhead", f"""{_PLANNED}
  SELECT id, length(system_prompt) AS system_tokens, length(message) AS prompt_tokens,
    length(system_prompt) + length(message) AS content_tokens, fixed AS rendered_tokens,
    fixed - length(system_prompt) - length(message) AS template_overhead FROM planned""")
def _(spark, folder):
    parts = requests(spark, folder).select(
        "id", F.col("system_prompt").alias("system"), F.col("message").alias("prompt"),
        history.fixed_prompt(F.col("system_prompt"), F.col("message")).alias("rendered"))
    return history.template_overhead(parts).drop("system", "prompt", "rendered")


@query("b14_summary_reserve", f"""{_PLANNED},
  reserved AS (SELECT *, context_limit - fixed - output_token_reserve AS available, id % 6 * 100 AS reserve,
    id % 4 * 100 AS output FROM planned WHERE fixed + output_token_reserve <= context_limit)
  SELECT id, CASE WHEN reserve <= 0 THEN 'summary_reserve_not_positive' WHEN output <= 0 THEN 'summary_output_not_positive'
      WHEN output >= reserve THEN 'summary_output_over_reserve'
      WHEN available < reserve THEN 'history_smaller_than_reserve' END AS reserve_reason,
    CASE WHEN length(message) > reserve THEN 'summary_over_reserve'
      WHEN available - length(message) < available - reserve THEN 'history_would_shrink' END AS final_reason
  FROM reserved""")
def _(spark, folder):
    ready = planned(spark, folder).filter(F.col("reject_reason").isNull()).withColumns({
        "summary_input_reserve": F.col("id") % 6 * 100,
        "summary_output_limit": F.col("id") % 4 * 100,
        "summary_tokens": F.char_length("message"),
    })
    final = ready.withColumns({
        "history_budget": F.col("available_history_tokens") - F.col("summary_input_reserve"),
        "final_available_tokens": F.col("available_history_tokens") - F.col("summary_tokens"),
    })
    return final.select("id", history.summary_reserve_reason().alias("reserve_reason"),
                        history.summary_final_reason().alias("final_reason"))


@query("r01_chat_messages", f"""{_M}
  SELECT id, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN {_CHAT} END AS text,
    CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool') THEN 'role_unsupported' END AS reject_reason
  FROM messages""")
def _(spark, folder):
    return messages(spark, folder).select(
        "id", render.chat_message(F.col("role"), F.col("content")).alias("text"),
        render.role_reason(F.col("role")).alias("reject_reason"))


@query("r02_rendered_windows", f"""{_WINDOW},
  texts AS (SELECT session_id, user_id, string_agg({_CHAT}, '' ORDER BY created_at, id) || '<|im_start|>assistant'
    || chr(10) AS rendered FROM recent GROUP BY session_id, user_id)
  SELECT *, length(rendered) AS total_tokens FROM texts""")
def _(spark, folder):
    return history.render_conversations(strict_window(spark, folder))


@query("r03_message_tokens", f"{_M} SELECT id, length({_CHAT}) AS tokens FROM messages")
def _(spark, folder):
    return messages(spark, folder).select("id", history.message_tokens().alias("tokens"))


@query("r04_transcript_totals", f"""{_M}
  SELECT session_id, user_id, CAST(sum(length(content)) AS BIGINT) AS content_tokens,
    length(string_agg(role || ': ' || content || chr(10), '')) AS transcript_tokens FROM messages GROUP BY ALL""")
def _(spark, folder):
    return history.transcript_totals(messages(spark, folder))


@query("q01_recent_start", f"""{_WINDOW},
  sessions AS (SELECT DISTINCT session_id, user_id FROM messages),
  firsts AS (SELECT session_id, user_id, min(id) AS first_id FROM recent GROUP BY ALL)
  SELECT session_id, user_id, coalesce(first_id, 0) AS recent_start_id FROM sessions LEFT JOIN firsts
  USING (session_id, user_id)""")
def _(spark, folder):
    return history.recent_start(strict_window(spark, folder), messages(spark, folder))


def update_requests(spark, folder):
    """Every session asks for an update against its own token window and watermark."""
    starts = history.recent_start(strict_window(spark, folder), messages(spark, folder))
    return starts.withColumns({"model": F.lit("small"), "max_output_tokens": F.lit(512)})


def stored_summaries(spark, folder):
    """Summaries stored so far: the sessions whose watermark is positive."""
    return watermarks(spark, folder).filter(F.col("last_message_id") > 0).select(
        "session_id", "user_id", F.concat(F.lit("Known <"), "session_id", F.lit("> & more")).alias("content"),
        "last_message_id", (F.col("last_message_id") % 3 + 1).alias("version"))


_UPDATES = f"""{_WINDOW},
marks AS (SELECT session_id, user_id,
  coalesce(max(CASE WHEN role = 'user' AND id % 1000 < 4 THEN id END), 0) AS last_message_id
  FROM messages GROUP BY session_id, user_id),
stored AS (SELECT session_id, user_id, 'Known <' || session_id || '> & more' AS content, last_message_id,
  last_message_id % 3 + 1 AS version FROM marks WHERE last_message_id > 0),
sessions AS (SELECT DISTINCT session_id, user_id FROM messages),
starts AS (SELECT session_id, user_id, coalesce(min(r.id), 0) AS recent_start_id FROM sessions
  LEFT JOIN recent r USING (session_id, user_id) GROUP BY ALL),
requests AS (SELECT session_id, user_id, recent_start_id, coalesce(content, '') AS content,
  coalesce(last_message_id, 0) AS last_message_id, coalesce(version, 0) AS version
  FROM starts LEFT JOIN stored USING (session_id, user_id)),
pending AS (SELECT m.*, r.recent_start_id, r.last_message_id, length({_CHAT.replace('content', 'm.content')}) AS tokens,
  r.recent_start_id = 0 OR (r.recent_start_id > r.last_message_id AND m.id < r.recent_start_id) AS evicted
  FROM messages m JOIN requests r USING (session_id, user_id) WHERE m.id > r.last_message_id),
totals AS (SELECT session_id, user_id, count(*) AS n, sum(tokens) AS t, count(*) FILTER (evicted) AS e,
  sum(tokens) FILTER (evicted) AS et, max(id) FILTER (evicted) AS last_evicted,
  bool_or(id = recent_start_id) AS start_seen FROM pending GROUP BY ALL),
prefix AS (SELECT session_id, user_id, recent_start_id, last_message_id, content, version,
  CASE WHEN recent_start_id > last_message_id AND NOT coalesce(start_seen, false) THEN 'recent_start_not_found' END
    AS reject_reason,
  coalesce(n, 0) AS unsummarized_messages, CAST(coalesce(t, 0) AS BIGINT) AS unsummarized_tokens,
  coalesce(e, 0) AS evicted_messages, CAST(coalesce(et, 0) AS BIGINT) AS evicted_tokens,
  coalesce(last_evicted, last_message_id) AS next_watermark
  FROM requests LEFT JOIN totals USING (session_id, user_id)),
decided AS (SELECT *, CASE WHEN evicted_messages = 0 THEN 'no_evicted_messages'
  WHEN unsummarized_messages >= {POLICY.min_messages} AND unsummarized_tokens >= {POLICY.min_tokens}
    THEN '{summary.BOTH}'
  WHEN unsummarized_messages >= {POLICY.min_messages} THEN 'message_threshold'
  WHEN unsummarized_tokens >= {POLICY.min_tokens} THEN 'token_threshold' ELSE 'below_threshold' END AS trigger_reason
  FROM prefix),
lines AS (SELECT session_id, user_id, id, '[id=' || id || ' role=' || {sql.escape('role')} || '] ' ||
  {sql.escape('content')} || chr(10) AS line FROM pending WHERE evicted),
prompts AS (SELECT session_id, user_id, '<previous_summary>' || chr(10)
  || CASE WHEN {sql.blank('any_value(content)')} THEN '(empty)' ELSE {sql.escape('any_value(content)')} END || chr(10)
  || '</previous_summary>' || chr(10) || '<new_messages>' || chr(10) || string_agg(line, '' ORDER BY id)
  || '</new_messages>' AS prompt
  FROM decided JOIN lines USING (session_id, user_id)
  WHERE trigger_reason IN ('{summary.BOTH}', 'message_threshold', 'token_threshold') AND reject_reason IS NULL
  GROUP BY session_id, user_id)"""


def selection(spark, folder):
    current = summary.lookup(update_requests(spark, folder), stored_summaries(spark, folder))
    return summary.select_prefix(messages(spark, folder), current)


@query("q02_prefix_selection", f"""{_UPDATES}
  SELECT session_id, user_id, recent_start_id, last_message_id, reject_reason, unsummarized_messages,
    unsummarized_tokens, evicted_messages, evicted_tokens, next_watermark FROM prefix""")
def _(spark, folder):
    return selection(spark, folder).select(
        "session_id", "user_id", "recent_start_id", "last_message_id", "reject_reason", "unsummarized_messages",
        "unsummarized_tokens", "evicted_messages", "evicted_tokens", "next_watermark")


@query("q03_trigger", f"""{_UPDATES} SELECT session_id, user_id, trigger_reason,
  trigger_reason IN ('{summary.BOTH}', 'message_threshold', 'token_threshold') AS should_summarize FROM decided""")
def _(spark, folder):
    return summary.decide(selection(spark, folder), POLICY).select(
        "session_id", "user_id", "trigger_reason", "should_summarize")


@query("r07_update_prompts", f"{_UPDATES} SELECT session_id, user_id, prompt FROM prompts")
def _(spark, folder):
    decided = summary.decide(selection(spark, folder), POLICY)
    return summary.update_prompts(messages(spark, folder), decided).select("session_id", "user_id", "prompt")


def _generated(prompt: str) -> str:
    lines = f"list_filter(string_split({prompt}, chr(10)), lambda l: starts_with(l, '[id='))"
    return f"({lines})[1] || ' … ' || ({lines})[-1]"


@query("q04_generated_summaries", f"""{_UPDATES}
  SELECT session_id, user_id, {sql.trim(_generated('prompt'))} AS content FROM prompts""")
def _(spark, folder):
    decided = summary.decide(selection(spark, folder), POLICY)
    prompts = summary.update_prompts(messages(spark, folder), decided)
    return prompts.select("session_id", "user_id", render.clean_summary(
        summary.first_and_last(F.col("prompt"))).alias("content"))


@query("q05_compare_and_set", f"""{_UPDATES},
  proposals AS (SELECT session_id, user_id, 'Next ' || session_id AS content, next_watermark - CAST(session_id AS BIGINT) % 4
    AS last_message_id, (version + CASE WHEN CAST(session_id AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END) AS expected_version
    FROM prefix)
  SELECT p.session_id, p.user_id, CASE WHEN p.last_message_id <= 0 THEN 'watermark_required'
      WHEN expected_version = 0 AND s.version IS NOT NULL THEN 'version_conflict'
      WHEN expected_version > 0 AND s.version IS DISTINCT FROM expected_version THEN 'version_conflict'
      WHEN p.last_message_id < s.last_message_id THEN 'watermark_regression' ELSE 'accepted' END AS outcome
  FROM proposals p LEFT JOIN stored s USING (session_id, user_id)""")
def _(spark, folder):
    number = F.col("session_id").cast("long")
    proposals = selection(spark, folder).select(
        "session_id", "user_id", F.concat(F.lit("Next "), "session_id").alias("content"),
        (F.col("next_watermark") - number % 4).alias("last_message_id"),
        (F.col("version") + F.when(number % 5 == 0, 1).otherwise(0)).alias("expected_version"))
    return summary.save(stored_summaries(spark, folder), proposals).select("session_id", "user_id", "outcome")


@query("q06_summary_update", f"""{_UPDATES}
  SELECT session_id, user_id, trigger_reason, prompt IS NOT NULL AS updated,
    version + CASE WHEN prompt IS NULL THEN 0 ELSE 1 END AS version,
    CASE WHEN prompt IS NULL THEN last_message_id ELSE next_watermark END AS watermark,
    CASE WHEN prompt IS NULL THEN content ELSE {sql.trim(_generated('prompt'))} END AS content
  FROM decided LEFT JOIN prompts USING (session_id, user_id)""")
def _(spark, folder):
    return summary.update_all(
        messages(spark, folder), update_requests(spark, folder), stored_summaries(spark, folder), POLICY
    ).select("session_id", "user_id", "trigger_reason", "updated", "version", "watermark", "content")


@query("q07_summary_lookup", f"""{_UPDATES}
  SELECT session_id, user_id, content, last_message_id, version, version > 0 AS found FROM requests""")
def _(spark, folder):
    sessions = messages(spark, folder).select("session_id", "user_id").distinct()
    return summary.lookup(sessions, stored_summaries(spark, folder))


@query("p29_update_requests", f"""{_M}
  SELECT id, CASE WHEN {sql.blank('role')} THEN 'model_required' WHEN id % 5 = 0 THEN 'recent_start_negative'
    WHEN id % 7 = 0 THEN 'max_output_tokens_required' END AS reject_reason FROM messages""")
def _(spark, folder):
    asked = messages(spark, folder).select(
        "id", "session_id", "user_id", F.col("role").alias("model"),
        F.when(F.col("id") % 5 == 0, -1).otherwise(0).alias("recent_start_id"),
        F.when(F.col("id") % 7 == 0, 0).otherwise(64).alias("max_output_tokens"))
    return asked.select("id", summary.update_request_reason().alias("reject_reason"))


@query("r08_extraction_prompts", f"""{_M},
  lines AS (SELECT session_id, user_id, id, '[id=' || id || ' role=' || {sql.escape(f"lower({sql.trim('role')})")} || '] '
    || {sql.escape('content')} || chr(10) AS line, row_number() OVER ({_NEWEST}) AS age FROM messages)
  SELECT session_id, user_id, '<session_summary>' || chr(10) || '(empty)' || chr(10) || '</session_summary>' || chr(10)
    || '<messages>' || chr(10) || string_agg(line, '' ORDER BY id) || '</messages>' AS prompt
  FROM lines WHERE age <= 6 GROUP BY session_id, user_id""")
def _(spark, folder):
    from groundwell.operators.memory import extraction_prompts

    window = history.recent(messages(spark, folder), 6).withColumn("summary", F.lit(" "))
    return extraction_prompts(window)


@query("r09_system_prompts", f"""{_M}
  SELECT id, CASE WHEN role = 'user' THEN 'Base ' || user_id || chr(10) || chr(10) ELSE '' END
    || '{render.SUMMARY_NOTE.strip()}' || chr(10) || '<session_summary>' || chr(10) || content || chr(10)
    || '</session_summary>' AS system FROM messages""")
def _(spark, folder):
    base = F.when(F.col("role") == "user", F.concat(F.lit("Base "), "user_id")).otherwise(F.lit(""))
    return messages(spark, folder).select(
        "id", render.combined_system(base, render.summary_block(F.col("content"))).alias("system"))


@query("r10_clean_summaries", f"""{_M}
  SELECT id, CASE WHEN role = 'system' THEN NULL ELSE nullif({sql.trim('content')}, '') END AS content FROM messages""")
def _(spark, folder):
    wrapped = F.when(F.col("role") == "system", F.lit(" <updated_summary> </updated_summary>\n")).otherwise(
        F.concat(F.lit(" <updated_summary>"), "content", F.lit("\n</updated_summary> ")))
    return messages(spark, folder).select("id", render.clean_summary(wrapped).alias("content"))
