"""Golden-set evaluation, sinks and upload reports over benchmark, conversations, documents, orders and lineitem."""

from __future__ import annotations


from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.conversation import requests as chat_requests
from groundwell.catalog.registry import query
from groundwell.catalog.retrieval import compressed, document_chunks
from groundwell.operators import evaluate, history, lexical
from groundwell.operators.stages import fresh_path
from groundwell.sources import reports, sinks, tables


def ranked(spark, folder):
    return lexical.best_pairs(tables.questions(spark, folder), document_chunks(spark, folder), 5, sql.SEARCH_THRESHOLD)


_CASES = f"""WITH {sql.SEARCH},
cases AS (SELECT 'q' || query_id AS case_id, query_id, max(CASE WHEN rank = 2 THEN chunk_id END) AS second,
  max(CASE WHEN rank = 4 THEN chunk_id END) AS fourth, max(CASE WHEN rank = 3 THEN chunk_id END) AS third
  FROM ranked WHERE rank <= 5 GROUP BY query_id),
golden AS (SELECT case_id, query_id, CASE WHEN query_id % 2 = 0 THEN [second, fourth] ELSE [second] END AS expected,
  CASE WHEN query_id % 3 = 0 THEN third ELSE 'none#0' END AS forbidden FROM cases),
results AS (SELECT case_id, count(*) FILTER (list_contains(expected, chunk_id)) / len(any_value(expected)) AS recall,
  coalesce(1.0::DOUBLE / min(rank) FILTER (list_contains(expected, chunk_id)), 0) AS mrr,
  coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (chunk_id = forbidden), '') AS forbidden_hits,
  string_agg(chunk_id, ',' ORDER BY rank) AS retrieved
  FROM golden JOIN ranked USING (query_id) WHERE rank <= 3 GROUP BY case_id)"""


def golden_cases(spark, folder):
    """A case per question: its second and sometimes fourth best chunk is expected, sometimes the third is forbidden."""
    def at(rank):
        return F.max(F.when(F.col("rank") == rank, F.col("chunk_id")))

    places = ranked(spark, folder).groupBy("query_id").agg(
        at(2).alias("second"), at(3).alias("third"), at(4).alias("fourth"))
    even = F.col("query_id") % 2 == 0
    return places.select(
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("case_id"), F.lit("question").alias("query"),
        F.lit("all").alias("knowledge_scope"),
        F.when(even, F.array("second", "fourth")).otherwise(F.array("second")).alias("expected_chunk_ids"),
        F.array(F.when(F.col("query_id") % 3 == 0, F.col("third")).otherwise("none#0")).alias("forbidden_chunk_ids"))


def evaluated_hits(spark, folder):
    return ranked(spark, folder).filter(F.col("rank") <= 3).select(
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("case_id"), "rank", "chunk_id",
        F.lit("all").alias("knowledge_scope"))


@query("a01_case_results", f"""{_CASES}
  SELECT case_id, recall AS recall_at_3, mrr AS mrr_at_3, forbidden_hits, retrieved AS retrieved_chunk_ids FROM results""")
def _(spark, folder):
    found = evaluate.case_results(golden_cases(spark, folder), evaluated_hits(spark, folder))
    return found.withColumns({"forbidden_hits": F.array_join("forbidden_hits", ","),
                              "retrieved_chunk_ids": F.array_join("retrieved_chunk_ids", ",")})


@query("a02_report", f"""{_CASES}
  SELECT count(*) AS case_count, round(avg(recall), 9) AS mean_recall_at_3, round(avg(mrr), 9) AS mean_mrr_at_3,
    1.0::DOUBLE AS scope_isolation, bool_and(recall = 1 AND forbidden_hits = '') AS passed FROM results""")
def _(spark, folder):
    cases, hits = golden_cases(spark, folder), evaluated_hits(spark, folder)
    made = evaluate.report(evaluate.case_results(cases, hits), evaluate.hit_failures(cases, hits))
    return made.withColumns({c: F.round(c, 9) for c in ("mean_recall_at_3", "mean_mrr_at_3")})


@query("a03_hit_failures", f"""{_CASES}
  SELECT case_id, rank, failure FROM (SELECT case_id, rank, CASE WHEN query_id % 4 = 0 AND rank = 1 THEN 'cross_scope_hit'
    WHEN query_id % 4 = 1 AND rank = 2 THEN 'empty_chunk_id' WHEN query_id % 4 = 2 AND rank <> 2 THEN 'duplicate_chunk_id' END
    AS failure FROM golden JOIN ranked USING (query_id) WHERE rank <= 3) WHERE failure IS NOT NULL""")
def _(spark, folder):
    case = F.substring("case_id", 2, 20).cast("long") % 4
    rank = F.col("rank")
    bad = evaluated_hits(spark, folder).withColumns({
        "knowledge_scope": F.when((case == 0) & (rank == 1), "other").otherwise(F.col("knowledge_scope")),
        "chunk_id": F.when((case == 1) & (rank == 2), " ").when((case == 2) & (rank != 2), "same").otherwise(
            F.col("chunk_id"))})
    return evaluate.hit_failures(golden_cases(spark, folder), bad).select("case_id", "rank", "failure")


_ODD_CASES = """
odd AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 9 = 1 THEN 'same' ELSE 'c' || doc_id END AS case_id
  FROM documents)"""


@query("p25_golden_cases", f"""WITH {_ODD_CASES}
  SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'case_id_required' WHEN 1 THEN 'case_id_repeated' WHEN 2 THEN 'query_required'
    WHEN 3 THEN 'expected_count' WHEN 4 THEN 'forbidden_required' WHEN 5 THEN 'expected_ids_unusable'
    WHEN 6 THEN 'forbidden_ids_unusable' WHEN 7 THEN 'expected_and_forbidden' END AS reject_reason FROM odd""")
def _(spark, folder):
    i = F.col("doc_id")
    case = i % 9
    name = i.cast("string")
    many = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.concat(name, F.lit("#"), n.cast("string")))
    cases = tables.read(spark, folder, "documents").select(
        "doc_id", F.when(case == 0, " ").when(case == 1, "same").otherwise(F.concat(F.lit("c"), name)).alias("case_id"),
        F.when(case == 2, "").otherwise(F.col("text")).alias("query"), F.col("source").alias("knowledge_scope"),
        F.when(case == 3, many).when(case == 5, F.array(name, F.concat(F.lit(" "), name))).otherwise(F.array(name))
        .alias("expected_chunk_ids"),
        F.when(case == 4, F.array().cast("array<string>")).when(case == 6, F.array(F.lit(" ")))
        .when(case == 7, F.array(F.concat(name, F.lit(" ")))).otherwise(F.array(F.lit("x"))).alias("forbidden_chunk_ids"))
    return evaluate.case_reasons(cases).select("doc_id", "reject_reason")


@query("k03_ordered_cases", f"{_CASES} SELECT case_id FROM golden ORDER BY case_id")
def _(spark, folder):
    return evaluate.ordered_cases(golden_cases(spark, folder)).select("case_id")


# --- sinks ---------------------------------------------------------------------------------------------------------


@query("s01_source_documents", """SELECT source AS knowledge_scope, CAST(doc_id AS VARCHAR) AS document_id,
  source || '/' || doc_id || '.md' AS source_ref, 'markdown' AS format, text AS content FROM documents""")
def _(spark, folder):
    return tables.structured_documents(spark, folder).drop("title")


@query("s05_appended_turns", f"""WITH {sql.MESSAGES}
  SELECT role, count(*) AS turns, CAST(sum(length(content)) AS BIGINT) AS characters FROM (
    SELECT 'user' AS role, content FROM messages WHERE role <> 'system' UNION ALL
    SELECT 'assistant', 'echo ' || role FROM messages WHERE role = 'assistant') GROUP BY role""")
def _(spark, folder):
    path = fresh_path(spark, "turns")
    sinks.append_turns(history.turns_to_store(chat_requests(spark, folder)), path)
    return spark.read.parquet(path).groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length("content")).alias("characters"))


@query("s06_conversation_log", f"""WITH {sql.COMPRESSED},
  joined AS (SELECT query_id, string_agg(substr(text, 1, 80), ' ' ORDER BY rank) AS body,
    string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM compressed GROUP BY query_id)
  SELECT CAST(query_id AS VARCHAR) AS session_id, body IS NOT NULL AS used_knowledge, coalesce(ids, '') AS ids,
    'mock-chat' AS chat_model, CASE WHEN query_id % 2 = 0 THEN '2024-03-01' ELSE '2024-03-02' END AS log_day
  FROM questions LEFT JOIN joined USING (query_id)""")
def _(spark, folder):
    path = fresh_path(spark, "log")
    made = lexical.answers(tables.questions(spark, folder), compressed(spark, folder), 80)
    day = F.when(F.col("query_id") % 2 == 0, "2024-03-01 10:00:00").otherwise("2024-03-02 10:00:00")
    records = sinks.log_records(made.withColumns({
        "session_id": F.col("query_id").cast("string"), "user_id": F.lit("u"), "model": F.lit(" "),
        "created_at": day.cast("timestamp")}), "mock-chat", "mock-embedding")
    sinks.append_log(records, path)
    stored = spark.read.schema(records.schema).json(path)
    return stored.select("session_id", "used_knowledge", F.array_join("retrieved_chunk_ids", ",").alias("ids"),
                         "chat_model", F.col("log_date").cast("string").alias("log_day"))


@query("s07_text_archive", "SELECT CAST(doc_id AS VARCHAR) AS document_id, text FROM documents")
def _(spark, folder):
    path = fresh_path(spark, "archive")
    sinks.archive_texts(tables.line_documents(spark, folder), path, 8)
    return spark.read.parquet(path).select("document_id", "text")


# --- upload reports ------------------------------------------------------------------------------------------------


def upload_requests(spark, folder):
    """A report request per order line: first the pending file, then its result."""
    lines = tables.read(spark, folder, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    size = F.col("l_quantity").cast("long") * 1000
    status = F.when(F.col("l_returnflag") == "R", 2).otherwise(3)

    def file(code, done, at):
        return F.struct(key.alias("filename"), key.alias("path"), key.alias("key"), size.alias("filesize"),
                        done.alias("uploaded_size"), code.alias("status"), at.alias("upload_time"))

    pending = file(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    ended = file(status, F.when(status == 3, size).otherwise(F.lit(0).cast("long")), F.lit(1000).cast("long"))
    info = F.when(F.col("l_linestatus") == "O", F.array(pending)).otherwise(F.array(pending, ended))
    return lines.select(F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("pid"), F.lit(2).alias("progress"), info.alias("extra_upload_info")))
        .alias("body"))


_FILES = """
files AS (SELECT CAST(l_orderkey AS VARCHAR) AS pid, l_orderkey || '-' || l_linenumber AS key,
  CAST(trunc(l_quantity) AS BIGINT) * 1000 AS filesize, l_linestatus = 'O' AS open, l_returnflag = 'R' AS failed FROM lineitem),
rows_ AS (SELECT pid, key, filesize, 0 AS status, 0 AS uploaded FROM files UNION ALL
  SELECT pid, key, filesize, CASE WHEN failed THEN 2 ELSE 3 END, CASE WHEN failed THEN 0 ELSE filesize END FROM files WHERE NOT open)"""


@query("s08_upload_reports", f"""WITH {_FILES}
  SELECT pid, key, filesize, CAST(status AS BIGINT) AS status, CAST(uploaded AS BIGINT) AS uploaded_size FROM rows_""")
def _(spark, folder):
    return reports.parse_reports(upload_requests(spark, folder)).select(
        "pid", "key", "filesize", "status", "uploaded_size")


@query("a10_upload_progress", f"""WITH {_FILES},
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, key
    ORDER BY status > 0 DESC, status DESC, uploaded DESC, filesize DESC) AS age FROM rows_) WHERE age = 1)
  SELECT pid, count(*) AS files, count(*) FILTER (status < 2) AS pending, count(*) FILTER (status = 2) AS failed,
    count(*) FILTER (status = 3) AS success, CAST(sum(filesize) AS BIGINT) AS bytes,
    CAST(sum(uploaded) AS BIGINT) AS uploaded_bytes, round(count(*) FILTER (status = 3) / count(*), 6) AS completion
  FROM latest GROUP BY pid""")
def _(spark, folder):
    return reports.batch_progress(reports.parse_reports(upload_requests(spark, folder)), reports.WHOLE_FILE_CODES)
