"""Streaming forms drained over the given tables; each is checked against the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.conversation import _WINDOW, POLICY, WINDOW_BUDGET
from groundwell.catalog.long_term import _APPLIED, event_messages, stored_items
from groundwell.catalog.registry import query
from groundwell.operators import summary
from groundwell.operators.stages import fresh_path
from groundwell.sources import tables
from groundwell.streaming import streams


@query("t01_log_stream", f"""WITH {sql.MESSAGES}
  SELECT session_id, content AS answer, '2024-01-01' AS log_day FROM messages WHERE role = 'assistant'""")
def _(spark, folder):
    path = fresh_path(spark, "stream-log")
    answers = tables.as_messages(streams.stream_table(spark, folder, "conversations")).filter(F.col("role") == "assistant")
    records = answers.select("session_id", F.col("content").alias("answer"), F.to_date("created_at").alias("log_date"))
    streams.log_stream(records, path, f"{path}-checkpoint").awaitTermination()
    stored = spark.read.schema("session_id string, answer string, log_date date").json(path)
    return stored.select("session_id", "answer", F.col("log_date").cast("string").alias("log_day"))


@query("t02_window_stream", f"""{_WINDOW},
  kept AS (SELECT session_id, user_id, string_agg(id, ',' ORDER BY created_at, id) AS ids, CAST(sum(tokens) AS BIGINT) AS used
    FROM recent GROUP BY ALL)
  SELECT session_id, user_id, coalesce(ids, '') AS recent_ids, coalesce(used, 0) AS used_tokens
  FROM (SELECT DISTINCT session_id, user_id FROM messages) LEFT JOIN kept USING (session_id, user_id)""")
def _(spark, folder):
    streams.use_rocksdb(spark)
    arriving = streams.stream_parts(tables.messages(spark, folder), fresh_path(spark, "message-parts"))
    last = streams.run_updates(streams.recent_windows(arriving, WINDOW_BUDGET), fresh_path(spark, "windows"))
    return last.withColumn("recent_ids", F.array_join("recent_ids", ","))


@query("t03_memory_stream", f"{_APPLIED} SELECT user_id, kind, memory_key, value, status, version FROM after")
def _(spark, folder):
    path = fresh_path(spark, "memory")
    stored = streams.MemoryTables.of(spark, path, 16)
    stored.start(stored_items(spark, folder))
    arriving = streams.stream_in_order(tables.read(spark, folder, "events"), f"{path}/arriving", "event_id", 3)
    streams.memory_stream(tables.as_candidates(arriving), event_messages(spark, folder), stored, f"{path}/checkpoint").awaitTermination()
    return stored.items.read().drop("id")


@query("t04_trigger_stream", f"""WITH {sql.MESSAGES},
  totals AS (SELECT session_id, user_id, count(*) AS n, CAST(sum(length('<|im_start|>' || role || chr(10) || content
    || '<|im_end|>' || chr(10))) AS BIGINT) AS t FROM messages GROUP BY ALL)
  SELECT session_id, user_id, n AS unsummarized_messages, t AS unsummarized_tokens, greatest(n - 2, 0) AS evicted_messages,
    CASE WHEN n <= 2 THEN 'no_evicted_messages' WHEN n >= {POLICY.min_messages} AND t >= {POLICY.min_tokens}
      THEN '{summary.BOTH}' WHEN n >= {POLICY.min_messages} THEN 'message_threshold'
      WHEN t >= {POLICY.min_tokens} THEN 'token_threshold' ELSE 'below_threshold' END AS trigger_reason FROM totals""")
def _(spark, folder):
    streams.use_rocksdb(spark)
    arriving = streams.stream_parts(tables.messages(spark, folder), fresh_path(spark, "message-parts"))
    return streams.run_updates(streams.summary_triggers(arriving, 2, POLICY), fresh_path(spark, "triggers")).drop(
        "late_messages")
