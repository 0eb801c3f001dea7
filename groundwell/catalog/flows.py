"""Whole flows: answered questions, assembled chat prompts, a published collection, extracted memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.conversation import MODELS, POLICY, stored_summaries
from groundwell.catalog.documents import POLICY as CHUNK_POLICY
from groundwell.catalog.publishing import NEW, NOW, OLD
from groundwell.catalog.registry import query
from groundwell.catalog.retrieval import stored_chunks
from groundwell.catalog.vectors import document_points, memory_points
from groundwell.functions.vectors import EMBEDDING_SIZE, generator
from groundwell.operators import history, memory
from groundwell.operators.stages import materialize
from groundwell.plans import answers, chat, publish
from groundwell.sources import tables


@query("flow_answers", f"""WITH {sql.COMPRESSED.replace("substr(text, 1, 80)", "substr(text, 1, 200)")},
  joined AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS body FROM compressed WHERE query_id % 3 <> 0
    GROUP BY query_id)
  SELECT query_id, CASE WHEN query_id % 10 = 9 THEN 'user_id_required' END AS reject_reason, CASE WHEN query_id % 10 = 9
    THEN NULL WHEN body IS NULL THEN '当前未命中知识库，我只能基于通用能力回答：' || question ELSE '根据知识库，' || body END AS answer
  FROM questions LEFT JOIN joined USING (query_id)""")
def _(spark, folder):
    i = F.col("query_id")
    asked = tables.questions(spark, folder).withColumns({
        "session_id": F.lit("s"), "user_id": F.when(i % 10 == 9, " ").otherwise("u"), "model": F.lit(""),
        "use_knowledge": i % 3 != 0, "created_at": F.lit(NOW).cast("timestamp")})
    settings = answers.AnswerSettings(sql.SEARCH_TOP, sql.SEARCH_THRESHOLD, 3, 200)
    return answers.answer_requests(asked, stored_chunks(spark, folder), settings).select(
        "query_id", "reject_reason", "answer")


@query("flow_chat_prompts")
def _(spark, folder):
    sessions = tables.messages(spark, folder)
    last = sessions.groupBy("session_id", "user_id").agg(F.max_by("content", "id").alias("message"))
    i = F.col("session_id").cast("long")
    asked = last.withColumns({
        "request_id": i, "model": F.when(i % 2 == 0, "small").otherwise("large"),
        "recent_limit": F.when(i % 4 == 3, 2).otherwise(0), "recent_token_budget": F.when(i % 4 == 2, 500).otherwise(0),
        "auto_token_budget": i % 4 < 2, "output_token_reserve": F.lit(256), "system_prompt": F.lit("Be brief."),
        "use_session_summary": i % 4 == 0, "use_memory": i % 4 == 1, "use_knowledge": i % 4 < 2,
        "knowledge_scope": F.concat(F.lit("src"), (i % 20).cast("string")), "memory_limit": F.lit(2),
        "document_limit": F.lit(2), "context_token_budget": F.lit(1500)})
    limits = spark.createDataFrame(MODELS, "model string, context_limit long")
    settings = chat.ChatSettings(policy=POLICY)
    return chat.assemble(asked, sessions, materialize(memory_points(spark, folder)),
                         materialize(document_points(spark, folder)), stored_summaries(spark, folder), limits,
                         settings).drop("warnings")


@query("flow_published_scopes", f"""WITH RECURSIVE {sql.SOURCE_DOCUMENTS},{sql.structured_chunks(CHUNK_POLICY.max_tokens)}
  SELECT knowledge_scope, '{NEW}' AS collection, count(*) AS points, 'activated' AS outcome FROM schunks
  GROUP BY knowledge_scope""")
def _(spark, folder):
    def nothing(name):
        return spark.createDataFrame([], tables.SCHEMAS[name])

    aliases = spark.createDataFrame([("live", OLD)], "alias string, collection string")
    done = publish.build_and_publish(
        tables.structured_documents(spark, folder), CHUNK_POLICY, NEW, "live", OLD, nothing("document_sources"),
        nothing("document_versions"), nothing("document_chunk_manifests"), aliases, EMBEDDING_SIZE,
        F.lit(NOW).cast("timestamp"))
    counts = done.points.groupBy("knowledge_scope", "collection").agg(F.count(F.lit(1)).alias("points"))
    return counts.join(done.outcomes.select("knowledge_scope", "outcome"), "knowledge_scope")


def _echo():
    """A stand-in model: proposes what the first user message of the prompt says as a goal."""
    def propose(prompts):
        import json
        import re

        out = []
        for prompt in prompts:
            found = re.search(r"^\[id=(\d+) role=user\] (.{0,40})", prompt, re.M)
            items = [] if found is None else [dict(
                operation="upsert", kind="goal", key="First Words", value=found.group(2), confidence=0.5,
                source_message_ids=[int(found.group(1))])]
            out.append(json.dumps({"candidates": items}))
        return out

    return propose


@query("m03_extracted_candidates", f"""WITH {sql.MESSAGES},
  aged AS (SELECT *, row_number() OVER (PARTITION BY session_id, user_id ORDER BY created_at DESC, id DESC) AS age FROM messages),
  firsts AS (SELECT session_id, user_id, min(id) AS id FROM aged WHERE age <= 6 AND role = 'user' GROUP BY ALL)
  SELECT session_id, user_id, 'goal' AS kind, 'first_words' AS key, id AS cited FROM firsts""")
def _(spark, folder):
    window = history.recent(tables.messages(spark, folder), 6).withColumn("summary", F.lit(""))
    found = memory.extract(materialize(window), generator(_echo)).candidates
    return found.select("session_id", "user_id", "kind", "key", F.get("source_message_ids", F.lit(0)).alias("cited"))
