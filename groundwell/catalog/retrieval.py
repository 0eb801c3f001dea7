"""Line chunking, lexical search and answer assembly over documents, conversations and benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.registry import query
from groundwell.functions import text as tx
from groundwell.functions.tokens import similarity, token_set
from groundwell.operators import lexical, lines
from groundwell.operators.points import upsert
from groundwell.operators.stages import fresh_path, materialize
from groundwell.plans import ingest
from groundwell.sources import tables

_DOCS = f"WITH {sql.LINE_DOCUMENTS},{sql.LINE_CHUNKS}"
_DIALOGUE = f"WITH {sql.DIALOGUE_DOCUMENTS},{sql.LINE_CHUNKS}"


def document_chunks(spark, folder):
    return lines.line_chunks(tables.line_documents(spark, folder))


def stored_chunks(spark, folder):
    """The chunk table a search runs on."""
    return materialize(document_chunks(spark, folder))


def hits(spark, folder):
    return lexical.search(tables.questions(spark, folder), stored_chunks(spark, folder),
                          sql.SEARCH_TOP, sql.SEARCH_THRESHOLD)


def compressed(spark, folder):
    return lexical.compress(hits(spark, folder), 3, 80)


@query("c01_line_chunks", f"{_DOCS} SELECT document_id, chunk_id, chunk_index, text FROM chunks")
def _(spark, folder):
    return document_chunks(spark, folder).select("document_id", "chunk_id", "chunk_index", "text")


@query("c02_heading_lines", f"""WITH {sql.DIALOGUE_DOCUMENTS},{sql.LINE_ROWS}
  SELECT document_id, line_no - 1 AS line_no, line, heading FROM marked""")
def _(spark, folder):
    return lines.line_headings(tables.dialogue_documents(spark, folder))


@query("c03_carried_headings", f"{_DIALOGUE} SELECT chunk_id, section FROM chunks")
def _(spark, folder):
    untitled = tables.dialogue_documents(spark, folder).withColumn("title", F.lit(""))
    return lines.line_chunks(untitled).select("chunk_id", F.col("title").alias("section"))


@query("c04_chunk_titles", f"{_DIALOGUE} SELECT chunk_id, title FROM chunks")
def _(spark, folder):
    return lines.line_chunks(tables.dialogue_documents(spark, folder)).select("chunk_id", "title")


@query("c05_character_windows", f"""
  WITH t AS (SELECT conv_id, turn, {sql.trim('text')} AS line FROM conversations),
  p AS (SELECT *, unnest(range(0, CASE WHEN length(line) <= 120 THEN 1
      ELSE CAST(ceil((length(line) - 120) / 100.0) AS BIGINT) + 1 END)) AS piece_no FROM t)
  SELECT conv_id, turn, piece_no, CASE WHEN length(line) <= 120 THEN line
    ELSE {sql.trim('substr(line, piece_no * 100 + 1, 120)')} END AS piece FROM p""")
def _(spark, folder):
    rows = tables.read(spark, folder, "conversations").select("conv_id", "turn", tx.trim(F.col("text")).alias("line"))
    return rows.select("conv_id", "turn", F.posexplode(lines.windows_of(F.col("line"))).alias("piece_no", "piece"))


@query("c18_split_preview", f"{_DIALOGUE} SELECT document_id, chunk_id, chunk_index, text FROM chunks")
def _(spark, folder):
    return lines.split_preview(tables.dialogue_documents(spark, folder))


@query("s13_chunk_store", f"""{_DOCS}
  SELECT document_id, chunk_id, chunk_index, text || '!' AS text FROM chunks WHERE chunk_index % 2 = 0
  UNION ALL SELECT document_id, chunk_id, chunk_index, text FROM chunks WHERE chunk_index % 2 = 1
  ORDER BY document_id, chunk_index""")
def _(spark, folder):
    stored = document_chunks(spark, folder).select("document_id", "chunk_id", "chunk_index", "text")
    changed = stored.filter(F.col("chunk_index") % 2 == 0).withColumn("text", F.concat("text", F.lit("!")))
    return upsert(stored, changed, "chunk_id").orderBy("document_id", "chunk_index")


@query("s15_simple_ingest", f"""{_DOCS}
  SELECT document_id, count(*) AS chunk_count, 'ok' AS status FROM chunks GROUP BY document_id""")
def _(spark, folder):
    return document_chunks(spark, folder).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.lit("ok").alias("status"))


@query("s15_ingest_status", f"""{_DOCS},
  stored AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id)
  SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n END AS chunk_count,
    CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n END AS stored_chunks, CASE WHEN doc_id % 7 = 0 THEN 'refused' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 7 = 0 THEN 'text_required' END AS reason, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS archived
  FROM documents LEFT JOIN stored ON document_id = CAST(doc_id AS VARCHAR)""")
def _(spark, folder):
    """Every seventh document comes without the text that it needs; another may be blank. Chunks and texts are read back from
    what was written."""
    seventh = F.coalesce(F.col("document_id").cast("long") % 7 == 0, F.lit(False))
    docs = tables.line_documents(spark, folder).withColumns({
        "text": F.when(seventh, F.lit(" ")).otherwise(F.col("text")), "text_required": seventh})
    path = fresh_path(spark, "ingest")
    store = ingest.chunk_table(spark, f"{path}/chunks", buckets=32)
    told = ingest.ingest_texts(docs, store, f"{path}/archive", "load", 0)
    held = store.read().groupBy("document_id").agg(F.count(F.lit(1)).alias("stored_chunks"))
    kept = spark.read.parquet(f"{path}/archive/load-0").select("document_id", F.sha2("text", 256).alias("archived"))
    return told.join(held, "document_id", "left").join(kept, "document_id", "left").select(
        "document_id", "chunk_count", F.coalesce("stored_chunks", F.when(F.col("status") == "refused", F.lit(0))).alias("stored_chunks"),
        "status", "reason", "archived")


@query("p26_default_substitution", f"""
  SELECT doc_id, CASE WHEN {sql.blank("regexp_extract(text, '^[^A-Z]*', 0)")} THEN source
    ELSE regexp_extract(text, '^[^A-Z]*', 0) END AS value FROM documents""")
def _(spark, folder):
    head = F.regexp_extract("text", "^[^A-Z]*", 0)
    return tables.read(spark, folder, "documents").select("doc_id", tx.or_default(head, F.col("source")).alias("value"))


@query("j01_search_text", f"SELECT doc_id, {sql.search_text('text')} AS normal FROM documents")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", tx.search_text(F.col("text")).alias("normal"))


@query("j02_token_sets", f"""SELECT doc_id, token, mixed FROM (
  SELECT doc_id, unnest({sql.tokens('text')}) AS token, false AS mixed FROM documents UNION ALL
  SELECT doc_id, unnest({sql.tokens("source || '退款 步骤' || lang || '说明'")}) AS token, true AS mixed FROM documents)""")
def _(spark, folder):
    docs = tables.read(spark, folder, "documents")
    cjk = F.concat("source", F.lit("退款 步骤"), "lang", F.lit("说明"))
    plain = docs.select("doc_id", F.explode(token_set(F.col("text"))).alias("token"), F.lit(False).alias("mixed"))
    mixed = docs.select("doc_id", F.explode(token_set(cjk)).alias("token"), F.lit(True).alias("mixed"))
    return plain.unionByName(mixed)


@query("j03_similarity", f"""
  WITH t AS (SELECT conv_id, turn, {sql.tokens('text')} AS toks FROM conversations),
  p AS (SELECT conv_id, turn, toks, lag(toks) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
  SELECT conv_id, turn, CASE WHEN before IS NULL OR len(before) = 0 OR len(toks) = 0 THEN 0.0 ELSE
    len(list_intersect(toks, before)) / sqrt(CAST(len(toks) * len(before) AS DOUBLE)) END AS score FROM p""")
def _(spark, folder):
    turns = tables.read(spark, folder, "conversations").select("conv_id", "turn", token_set(F.col("text")).alias("now"))
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("now").alias("before"))
    return turns.join(earlier, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce(similarity(F.col("now"), F.col("before")), F.lit(0.0)).alias("score"))


@query("j04_lexical_search", f"WITH {sql.SEARCH} SELECT query_id, chunk_id, score, rank, document_id, title, text FROM hits")
def _(spark, folder):
    return hits(spark, folder).select("query_id", "chunk_id", "score", "rank", "document_id", "title", "text")


@query("j05_retrieval", f"""WITH {sql.SEARCH}
  SELECT query_id, question, {sql.search_text('question')} AS normalized_question, chunk_id, rank
  FROM hits JOIN questions USING (query_id)""")
def _(spark, folder):
    found = lexical.retrieve(tables.questions(spark, folder), stored_chunks(spark, folder),
                             sql.SEARCH_TOP, sql.SEARCH_THRESHOLD)
    return found.select("query_id", "question", "normalized_question", "chunk_id", "rank")


@query("j06_debug_view", f"""WITH {sql.SEARCH}
  SELECT query_id, rank, document_id, chunk_id, title, source_ref, {sql.round4('score')} AS score,
    substr(text, 1, 120) AS preview FROM hits""")
def _(spark, folder):
    return lexical.debug_view(hits(spark, folder))


@query("k01_top_k", f"WITH {sql.SEARCH} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= {sql.SEARCH_TOP}")
def _(spark, folder):
    return lexical.best_pairs(tables.questions(spark, folder), document_chunks(spark, folder),
                              sql.SEARCH_TOP, sql.SEARCH_THRESHOLD)


@query("b01_dedupe_hits", f"WITH {sql.DEDUPED} SELECT query_id, chunk_id, rank FROM deduped")
def _(spark, folder):
    return lexical.dedupe_hits(hits(spark, folder)).select("query_id", "chunk_id", "rank")


@query("b02_limit_hits", f"""WITH {sql.SEARCH} SELECT query_id, chunk_id, rank FROM hits WHERE rank <= 2""")
def _(spark, folder):
    return lexical.limit_hits(hits(spark, folder), 2).select("query_id", "chunk_id", "rank")


@query("b03_compress", f"WITH {sql.COMPRESSED} SELECT query_id, chunk_id, rank, text FROM compressed")
def _(spark, folder):
    return compressed(spark, folder).select("query_id", "chunk_id", "rank", "text")


@query("b04_truncate", """
  SELECT doc_id, substr(text, 1, 100) AS cut, text AS uncut,
    CASE WHEN octet_length(encode(text)) <= 40 THEN text ELSE NULL END AS whole FROM documents""")
def _(spark, folder):
    t = F.col("text")
    return tables.read(spark, folder, "documents").select(
        "doc_id", tx.truncate(t, 100).alias("cut"), tx.truncate(t, 0).alias("uncut"),
        F.when(F.octet_length(t) <= 40, tx.truncate_bytes(t, 40)).alias("whole"))


@query("b05_answer_ids", f"""WITH {sql.COMPRESSED}
  SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM compressed GROUP BY query_id""")
def _(spark, folder):
    return lexical.ids_per_query(compressed(spark, folder)).select(
        "query_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("r06_knowledge_prompt", f"""WITH {sql.COMPRESSED},
  numbered AS (SELECT query_id, string_agg(kept || '. [' || title || '] ' || substr(text, 1, 80) || chr(10), ''
    ORDER BY kept) || chr(10) AS body FROM compressed GROUP BY query_id)
  SELECT query_id, '[System Instruction]' || chr(10) || '{lexical.PROMPT_SYSTEM}' || chr(10) || chr(10)
    || '[Relevant Knowledge]' || chr(10) || coalesce(body, '无命中知识。' || chr(10) || chr(10))
    || '[User Question]' || chr(10) || question AS prompt
  FROM questions LEFT JOIN numbered USING (query_id)""")
def _(spark, folder):
    return lexical.knowledge_prompt(tables.questions(spark, folder), compressed(spark, folder), 80)


@query("r11_answers", f"""WITH {sql.COMPRESSED},
  joined AS (SELECT query_id, string_agg(substr(text, 1, 80), ' ' ORDER BY rank) AS body,
    string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM compressed GROUP BY query_id)
  SELECT query_id, CASE WHEN body IS NULL THEN '{lexical.ANSWER_FALLBACK}' || question
    ELSE '{lexical.ANSWER_PREFIX}' || body END AS answer, body IS NOT NULL AS used_knowledge, coalesce(ids, '') AS ids
  FROM questions LEFT JOIN joined USING (query_id)""")
def _(spark, folder):
    made = lexical.answers(tables.questions(spark, folder), compressed(spark, folder), 80)
    return made.select("query_id", "answer", "used_knowledge", F.array_join("retrieved_chunk_ids", ",").alias("ids"))


@query("r13_preview", """
  SELECT doc_id, CASE WHEN length(flat) <= 60 THEN flat ELSE substr(flat, 1, 60) || '...' END AS preview
  FROM (SELECT doc_id, replace(text, chr(10), '\\n') AS flat FROM documents)""")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", tx.preview(F.col("text"), 60).alias("preview"))


@query("u04_slots", f"""WITH {sql.COMPRESSED} SELECT query_id, chunk_id, rank, text FROM compressed""")
def _(spark, folder):
    # Retriever and compressor are plain functions from DataFrame to DataFrame, so any other one fits the slot.
    chunks = stored_chunks(spark, folder)
    found = tables.questions(spark, folder).transform(lexical.search, chunks, sql.SEARCH_TOP, sql.SEARCH_THRESHOLD)
    return found.transform(lexical.compress, 3, 80).select("query_id", "chunk_id", "rank", "text")
