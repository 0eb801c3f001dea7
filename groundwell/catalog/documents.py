"""Document identity and structured chunking over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.catalog import sql
from groundwell.catalog.registry import query
from groundwell.functions import identity as ids
from groundwell.functions import text as tx
from groundwell.functions.tokens import CODE_POINTS
from groundwell.operators import structure
from groundwell.operators.structure import ChunkPolicy
from groundwell.sources import tables

LIMIT = 400
POLICY = ChunkPolicy(LIMIT, 2)
WIDE = 1_000_000

_DOCS = f"WITH RECURSIVE {sql.SOURCE_DOCUMENTS},{sql.structured_chunks(LIMIT)}"
_DIALOGUE = f"WITH RECURSIVE {sql.DIALOGUE_DOCUMENTS},{sql.structured_chunks(WIDE)}"


def documents(spark, folder):
    return tables.structured_documents(spark, folder)


def chunks(spark, folder):
    return structure.structured_chunks(documents(spark, folder), POLICY)


_IDENTIFIER = "trim({x}, ' ')"


def odd_names(spark, folder):
    """Identifiers and paths with the defects the rules look for, made from document ids and sources."""
    i, source = F.col("doc_id"), F.col("source")
    name = F.concat(source, F.lit("-"), i.cast("string"))
    case = i % 8
    return tables.read(spark, folder, "documents").select(
        "doc_id",
        F.when(case == 0, F.lit("  ")).when(case == 1, F.concat(F.lit("."), name)).when(case == 2, F.repeat(name, 30))
        .when(case == 3, F.concat(name, F.lit(" x"))).when(case == 4, F.concat(F.lit(" "), name, F.lit("\t")))
        .otherwise(name).alias("name"),
        F.when(case == 0, F.concat(F.lit("/"), name)).when(case == 1, F.concat(F.lit("../"), name))
        .when(case == 2, F.concat(name, F.lit("//x"))).when(case == 3, F.concat(name, F.lit("/./x")))
        .when(case == 4, F.concat(name, F.lit("\\x"))).when(case == 5, F.concat(name, F.lit("/")))
        .when(case == 6, F.concat(F.lit(" a/"), name, F.lit(".md "))).otherwise(F.concat(F.lit("a/../"), name))
        .alias("path"),
        F.when(case == 0, " Markdown ").when(case == 1, "GO").when(case == 2, "").when(case == 3, "html")
        .otherwise("markdown").alias("format"),
        F.when(case == 0, F.concat(source, F.lit("//x"))).when(case == 1, F.concat(source, F.lit("/  b / c")))
        .when(case == 2, F.repeat(name, 300)).when(case == 3, F.concat(source, F.lit("\tx"))).otherwise(source)
        .alias("heading"),
    )


_ODD = """
odd AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN '.' || name WHEN 2 THEN repeat(name, 30)
    WHEN 3 THEN name || ' x' WHEN 4 THEN ' ' || name || chr(9) ELSE name END AS name,
  CASE doc_id % 8 WHEN 0 THEN '/' || name WHEN 1 THEN '../' || name WHEN 2 THEN name || '//x' WHEN 3 THEN name || '/./x'
    WHEN 4 THEN name || '\\x' WHEN 5 THEN name || '/' WHEN 6 THEN ' a/' || name || '.md ' ELSE 'a/../' || name END AS path,
  CASE doc_id % 8 WHEN 0 THEN ' Markdown ' WHEN 1 THEN 'GO' WHEN 2 THEN '' WHEN 3 THEN 'html' ELSE 'markdown' END AS format,
  CASE doc_id % 8 WHEN 0 THEN source || '//x' WHEN 1 THEN source || '/  b / c' WHEN 2 THEN repeat(name, 300)
    WHEN 3 THEN source || chr(9) || 'x' ELSE source END AS heading
  FROM (SELECT *, source || '-' || doc_id AS name FROM documents))"""


@query("p01_normalized_documents", f"""WITH {_ODD}
  SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'knowledge_scope_required' WHEN 1 THEN 'knowledge_scope_unsafe'
    WHEN 2 THEN CASE WHEN octet_length(encode(name)) > 128 THEN 'knowledge_scope_too_long' ELSE 'source_ref_not_clean' END
    WHEN 3 THEN 'knowledge_scope_unsafe' WHEN 4 THEN 'source_ref_backslash' WHEN 5 THEN 'source_ref_not_clean'
    WHEN 7 THEN 'source_ref_not_clean' END AS reject_reason, {sql.portable('text')} AS content
  FROM odd JOIN documents USING (doc_id)""")
def _(spark, folder):
    named = odd_names(spark, folder).join(documents(spark, folder).select(
        F.col("document_id").cast("long").alias("doc_id"), "document_id", "content"), "doc_id")
    normal = structure.normalize_documents(named.select(
        "doc_id", F.col("name").alias("knowledge_scope"), "document_id", F.col("path").alias("source_ref"), "format",
        "content"))
    return normal.select("doc_id", "reject_reason", "content")


@query("p02_identifiers", f"""WITH {_ODD}
  SELECT doc_id, CASE WHEN {sql.blank('name')} THEN 'id_required'
    WHEN octet_length(encode({sql.trim('name')})) > 128 THEN 'id_too_long'
    WHEN NOT regexp_full_match({sql.trim('name')}, '[A-Za-z0-9_][A-Za-z0-9_.:-]*') THEN 'id_unsafe' END AS reject_reason
  FROM odd""")
def _(spark, folder):
    return odd_names(spark, folder).select(
        "doc_id", ids.identifier_reason(F.col("name"), "id").alias("reject_reason"))


@query("p03_source_paths", f"""WITH {_ODD}
  SELECT doc_id, CASE WHEN contains(path, '\\') THEN 'source_ref_backslash'
    WHEN starts_with({sql.trim('path')}, '/') THEN 'source_ref_absolute'
    WHEN starts_with({sql.trim('path')}, '../') THEN 'source_ref_escapes'
    WHEN contains(path, '//') OR contains(path, '/./') OR contains(path, '/../') OR ends_with({sql.trim('path')}, '/')
      THEN 'source_ref_not_clean' END AS reject_reason FROM odd""")
def _(spark, folder):
    return odd_names(spark, folder).select("doc_id", ids.source_ref_reason(F.col("path")).alias("reject_reason"))


@query("p04_formats", f"""WITH {_ODD}
  SELECT doc_id, lower({sql.trim('format')}) AS format, CASE WHEN {sql.blank('format')} THEN 'format_required'
    WHEN lower({sql.trim('format')}) NOT IN ('markdown', 'go') THEN 'format_unsupported' END AS reject_reason FROM odd""")
def _(spark, folder):
    return odd_names(spark, folder).select(
        "doc_id", ids.normal_format(F.col("format")).alias("format"),
        ids.format_reason(F.col("format")).alias("reject_reason"))


@query("p05_heading_paths", f"""WITH {_ODD}
  SELECT doc_id, array_to_string(list_transform(string_split(heading, '/'), lambda s: {sql.trim('s')}), ' / ') AS heading,
    CASE WHEN octet_length(encode(heading)) > 1024 THEN 'heading_path_too_long'
      WHEN contains(heading, chr(9)) THEN 'heading_path_control'
      WHEN len(list_filter(string_split(heading, '/'), lambda s: {sql.trim('s')} = '')) > 0
        THEN 'heading_path_empty_segment' END AS reject_reason FROM odd""")
def _(spark, folder):
    return odd_names(spark, folder).select(
        "doc_id", ids.normal_heading_path(F.col("heading")).alias("heading"),
        ids.heading_path_reason(F.col("heading")).alias("reject_reason"))


_MESSY = "chr(13) || chr(10) || '  ' || chr(13) || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10)) || '  ' || chr(10) || ' ' || chr(10)"


@query("c06_portable_text", f"SELECT doc_id, {sql.portable(_MESSY)} AS content FROM documents")
def _(spark, folder):
    messy = F.concat(F.lit("\r\n  \r"), F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit("  \n \n"))
    return tables.read(spark, folder, "documents").select("doc_id", tx.portable(messy).alias("content"))


@query("i01_content_hash", f"SELECT doc_id, sha256({sql.portable('text')}) AS content_hash FROM documents")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query("c07_fence_blocks", f"""{_DIALOGUE.replace('WITH RECURSIVE', 'WITH RECURSIVE')}
  SELECT document_id, min(n) - 1 AS first_line, max(n) - 1 AS last_line FROM numbered WHERE code
  GROUP BY document_id, unit_no""")
def _(spark, folder):
    normal = structure.normalize_documents(tables.dialogue_documents(spark, folder))
    lines = tx.compute_once(normal, _lines=F.split("content", "\n"))
    blocks = lines.select("document_id", F.explode(structure.fence_blocks(F.col("_lines"))["blocks"]).alias("b"))
    return blocks.select("document_id", F.col("b.first").alias("first_line"), F.col("b.last").alias("last_line"))


@query("c08_atx_headings", f"""{_DIALOGUE}
  SELECT document_id, n - 1 AS line_no, length(marks) AS level, heading AS title FROM titled WHERE heading IS NOT NULL""")
def _(spark, folder):
    normal = structure.normalize_documents(tables.dialogue_documents(spark, folder))
    staged = tx.compute_once(normal, _lines=F.split("content", "\n"))
    staged = tx.compute_once(staged, _blocks=structure.fence_blocks(F.col("_lines"))["blocks"])
    rows = staged.select("document_id", "_blocks", F.posexplode("_lines").alias("line_no", "line"))
    outside = ~F.exists("_blocks", lambda b: F.col("line_no").between(b["first"], b["last"]))
    heads = rows.filter(outside).select("document_id", "line_no", structure.heading_of(F.col("line")).alias("h"))
    return heads.filter(F.col("h").isNotNull()).select(
        "document_id", "line_no", F.col("h.level").alias("level"), F.col("h.title").alias("title"))


@query("c09_heading_paths", f"{_DIALOGUE} SELECT document_id, unit_no, heading_path FROM units")
def _(spark, folder):
    return structure.markdown_units(tables.dialogue_documents(spark, folder)).select(
        "document_id", "unit_no", "heading_path")


@query("c10_structural_units", f"{_DIALOGUE} SELECT document_id, unit_no, structure_kind, heading_path, text FROM units")
def _(spark, folder):
    return structure.markdown_units(tables.dialogue_documents(spark, folder)).drop("knowledge_scope")


@query("c11_sentences", """
  SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_no FROM (
    SELECT doc_id, regexp_extract_all(text, '[^.!?。！？\\n]*[.!?。！？\\n]|[^.!?。！？\\n]+$') AS s FROM documents)""")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select(
        "doc_id", F.posexplode(structure.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query("c12_packed_sentences", f"""{_DOCS} SELECT document_id, unit_no, CAST(part AS BIGINT) AS part, text FROM packed_parts""")
def _(spark, folder):
    units = structure.markdown_units(documents(spark, folder)).filter(F.length("text") > LIMIT)
    return units.select("document_id", "unit_no", F.posexplode(
        structure.packed_sentences(F.col("text"), LIMIT)).alias("part", "text"))


@query("c13_exact_pieces", """
  SELECT doc_id, i AS piece_no, substr(text, i * 250 + 1, 250) AS piece FROM (
    SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(text) / 250.0) AS BIGINT)))) AS i FROM documents)""")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select(
        "doc_id", F.posexplode(structure.exact_pieces(F.col("text"), 250)).alias("piece_no", "piece"))


@query("c14_code_pieces")
def _(spark, folder):
    rows = structure.structured_chunks(tables.dialogue_documents(spark, folder).drop("title", "text", "tags"),
                                       ChunkPolicy(240, 1))
    return rows.filter(F.col("structure_kind") == "code").select("document_id", "ordinal", "text", "token_count")


@query("c15_packed_paragraphs", f"{_DOCS} SELECT document_id, CAST(ordinal AS BIGINT) AS ordinal, heading_path, raw AS text FROM packed")
def _(spark, folder):
    parsed = structure.parse_markdown(structure.normalize_documents(documents(spark, folder)))
    packed = structure.split_and_pack(parsed, POLICY)
    return packed.filter(F.col("reject_reason").isNull()).select(
        "document_id", F.posexplode("packed").alias("ordinal", "u")).select(
        "document_id", "ordinal", F.col("u.path").alias("heading_path"), F.col("u.text").alias("text"))


@query("c16_structured_chunks", f"""{_DOCS} SELECT knowledge_scope, document_id, chunk_id, structure_kind, heading_path,
  text, content_hash, ordinal, duplicate_ordinal, token_count FROM schunks""")
def _(spark, folder):
    return chunks(spark, folder).drop("source_ref", "title")


@query("c17_token_counts", "SELECT doc_id, length(text) AS tokens FROM documents")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", CODE_POINTS.guarded(F.col("text")).alias("tokens"))


@query("c19_routed_units", f"""{_DOCS}
  SELECT document_id, unit_no, count(*) AS pieces, CAST(max(length(text)) AS BIGINT) AS longest FROM parts GROUP BY ALL""")
def _(spark, folder):
    parsed = structure.parse_markdown(structure.normalize_documents(documents(spark, folder)))
    # The number of a unit takes the place of its path, so that pieces can be told apart.
    numbered = F.transform("units", lambda u, i: F.struct(u["kind"].alias("kind"), i.cast("string").alias("path"), u["text"].alias("text")))
    split = structure.split_units(parsed.withColumn("units", numbered), POLICY)
    parts = split.filter(F.col("reject_reason").isNull()).select("document_id", F.explode("split").alias("p"))
    return parts.groupBy("document_id", F.col("p.path").cast("bigint").alias("unit_no")).agg(
        F.count(F.lit(1)).alias("pieces"), F.max(F.length("p.text")).alias("longest"))


@query("i02_chunk_ids", f"{_DIALOGUE} SELECT document_id, ordinal, chunk_id FROM schunks")
def _(spark, folder):
    policy = ChunkPolicy(WIDE, 2)
    docs = tables.dialogue_documents(spark, folder).drop("title", "text", "tags")
    return structure.structured_chunks(docs, policy).select("document_id", "ordinal", "chunk_id")


@query("i03_policy_hash", """
  SELECT doc_id, sha256(concat_ws(chr(0), 'markdown', 'parser-v1', CAST(n_chars + 1 AS VARCHAR), CAST(doc_id % 5 AS VARCHAR),
    'hash-64')) AS chunk_policy_hash FROM documents""")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", ids.policy_hash(
        F.lit(" Markdown"), F.lit("parser-v1 "), F.col("n_chars") + 1, F.col("doc_id") % 5, F.lit("hash-64"))
        .alias("chunk_policy_hash"))


_EDITED = "CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || 'Appendix ' || doc_id ELSE text END"


def _versioned(text: str, suffix: str) -> str:
    """The chunk ids of one version of the documents, as a subquery of its own."""
    docs = sql.SOURCE_DOCUMENTS.replace(" text FROM documents", f" {text} AS text FROM documents")
    return f"{suffix} AS (WITH RECURSIVE {docs},{sql.structured_chunks(LIMIT)} SELECT chunk_id FROM schunks)"


@query("i04_change_set", f"""WITH {_versioned('text', 'before')}, {_versioned(_EDITED, 'after')}
  SELECT coalesce(b.chunk_id, a.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'added'
    WHEN a.chunk_id IS NULL THEN 'removed' ELSE 'kept' END AS change
  FROM before b FULL JOIN after a ON a.chunk_id = b.chunk_id""")
def _(spark, folder):
    docs = documents(spark, folder)
    number = F.col("document_id").cast("long")
    edited = docs.withColumn("content", F.when(number % 3 == 0, F.concat(
        "content", F.lit("\n\nAppendix "), "document_id")).otherwise(F.col("content")))
    return structure.change_set(structure.structured_chunks(docs, POLICY), structure.structured_chunks(edited, POLICY))


@query("i05_point_ids", f"SELECT doc_id, {sql.point_id('source', 'CAST(doc_id AS VARCHAR)')} AS point_id FROM documents")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select(
        "doc_id", ids.point_id(F.col("source"), F.col("doc_id").cast("string")).alias("point_id"))


@query("i06_trimmed_hash", f"SELECT doc_id, sha256({sql.trim('text')}) AS content_hash FROM documents")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", ids.trimmed_hash(F.col("text")).alias("content_hash"))


@query("i07_bounded_errors", f"""WITH t AS (SELECT doc_id, {sql.trim('text')} AS text FROM documents),
  cut AS (SELECT doc_id, text, list_aggregate(list_transform(string_split(text, ''), lambda c: octet_length(encode(c))),
    'sum') AS bytes FROM t),
  sized AS (SELECT doc_id, c, n, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM (
    SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS n FROM cut
    WHERE bytes > 2048))
  SELECT doc_id, text AS message FROM cut WHERE bytes <= 2048
  UNION ALL SELECT doc_id, string_agg(c, '' ORDER BY n) || '...[truncated]' FROM sized WHERE upto <= 2048 - 14
  GROUP BY doc_id""")
def _(spark, folder):
    return tables.read(spark, folder, "documents").select("doc_id", ids.bounded_error(F.col("text")).alias("message"))


@query("u05_document_to_chunks", f"{_DOCS} SELECT document_id, count(*) AS chunk_count FROM schunks GROUP BY document_id")
def _(spark, folder):
    return chunks(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))


@query("u01_token_counter", "SELECT doc_id, length(text) AS code_points, octet_length(encode(text)) AS octets FROM documents")
def _(spark, folder):
    from groundwell.functions.tokens import TokenCounter

    octets = TokenCounter(column=lambda text: F.octet_length(text).cast("long"))
    return tables.read(spark, folder, "documents").select(
        "doc_id", CODE_POINTS(F.col("text")).alias("code_points"), octets(F.col("text")).alias("octets"))
