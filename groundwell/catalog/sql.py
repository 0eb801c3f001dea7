"""SQL fragments the oracles share. They state each rule independently of the Spark code, mostly as plain windows."""

from __future__ import annotations

from groundwell.functions.text import UNICODE_SPACES

_SPACE_CLASS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(x: str) -> str:
    return f"trim({x}, '{UNICODE_SPACES}')"


def blank(x: str) -> str:
    return f"(coalesce({trim(x)}, '') = '')"


def fold(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE_CLASS}+', ' ', 'g'), '{UNICODE_SPACES}')"


def search_text(x: str) -> str:
    return fold(f"lower({x})")


def portable(x: str) -> str:
    lines = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')"
    head = f"regexp_replace({lines}, '^{_SPACE_CLASS}*\\n', '')"
    return f"(CASE WHEN {blank(x)} THEN '' ELSE regexp_replace({head}, '\\n{_SPACE_CLASS}*$', '') END)"


def round4(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 10000 + 0.5) / 10000)"


def tokens(x: str) -> str:
    t = search_text(x)
    cjk = f"regexp_replace({t}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')"
    return (
        f"list_distinct(list_concat(list_concat(regexp_extract_all({t}, '[a-z0-9]+'), "
        f"list_filter(string_split({cjk}, ''), lambda c: c <> '')), "
        f"list_transform(range(1, length({cjk})), lambda i: substr({cjk}, i, 2))))"
    )


def escape(x: str) -> str:
    for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        x = f"replace({x}, '{raw}', '{out}')"
    return x


NL = "chr(10)"

LINE_DOCUMENTS = """
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, lang AS title, source || '/' || doc_id || '.md' AS source_ref, text
  FROM documents)"""

# One Markdown document per conversation turn: it has headings, a colon line and a fenced block.
DIALOGUE_DOCUMENTS = """
docs AS (
  SELECT 'conv' || (conv_id % 7) AS knowledge_scope, conv_id || '-' || turn AS document_id, role AS title,
    'dialogue/' || conv_id || '-' || turn || '.md' AS source_ref,
    '# ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Turn ' || turn || chr(10) || chr(10)
      || '```text' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Notes:' || chr(10) || text AS text
  FROM conversations)"""


def heading_of(line: str) -> str:
    marked = trim(f"ltrim({line}, '#')")
    prefixes = " OR ".join(f"starts_with({line}, '{p}')" for p in
                           ("一、", "二、", "三、", "四、", "五、", "1.", "2.", "3."))
    return (
        f"CASE WHEN starts_with({line}, '#') THEN nullif({marked}, '') "
        f"WHEN right({line}, 1) IN (':', '：') OR (length({line}) <= 18 AND ({prefixes})) "
        f"THEN rtrim({line}, ':：') END"
    )


LINE_ROWS = f"""
raw_lines AS (
  SELECT document_id, title, source_ref, text, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM docs WHERE NOT {blank('text')}),
trimmed AS (SELECT *, {trim('raw')} AS line FROM raw_lines),
marked AS (SELECT *, {heading_of('line')} AS heading FROM trimmed)"""

LINE_CHUNKS = f"""{LINE_ROWS},
effective AS (
  SELECT *, CASE WHEN heading <> '' AND NOT coalesce(lead(heading IS NOT NULL) OVER w, false) THEN heading END AS effective
  FROM marked WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
carried AS (
  SELECT *, coalesce(last_value(effective IGNORE NULLS) OVER (
    PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section
  FROM effective),
pieces AS (
  SELECT document_id, title, source_ref, section, line_no, unnest(range(0,
    CASE WHEN length(line) <= 120 THEN 1 ELSE CAST(ceil((length(line) - 120) / 100.0) AS BIGINT) + 1 END)) AS piece, line
  FROM carried WHERE heading IS NULL AND line <> ''),
bodies AS (
  SELECT document_id, source_ref, title, section,
    row_number() OVER (PARTITION BY document_id ORDER BY line_no, piece) - 1 AS chunk_index,
    CASE WHEN length(line) <= 120 THEN line ELSE {trim('substr(line, piece * 100 + 1, 120)')} END AS text
  FROM pieces),
all_chunks AS (
  SELECT document_id, source_ref, section, chunk_index, text,
    concat_ws(' / ', nullif({trim('title')}, ''), nullif({trim('section')}, '')) AS title FROM bodies
  UNION ALL
  SELECT document_id, source_ref, '' AS section, 0 AS chunk_index, {trim('text')} AS text, title FROM docs
  WHERE NOT {blank('text')} AND document_id NOT IN (SELECT document_id FROM bodies)),
chunks AS (
  SELECT document_id, document_id || '#' || chunk_index AS chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index,
    title, section, source_ref, text FROM all_chunks)"""

SEARCH_TOP = 5
SEARCH_THRESHOLD = 0.1

SEARCH = f"""{LINE_DOCUMENTS},{LINE_CHUNKS},
questions AS (SELECT item_id AS query_id, text AS question FROM benchmark),
question_sets AS (SELECT query_id, question, {tokens('question')} AS toks FROM questions),
chunk_sets AS (SELECT chunk_id, {tokens("title || ' ' || text")} AS toks FROM chunks),
qt AS (SELECT query_id, len(toks) AS nq, unnest(toks) AS token FROM question_sets),
ct AS (SELECT chunk_id, len(toks) AS nc, unnest(toks) AS token FROM chunk_sets),
scored AS (
  SELECT query_id, chunk_id, count(*) / sqrt(CAST(nq * nc AS DOUBLE)) AS score
  FROM qt JOIN ct USING (token) GROUP BY query_id, chunk_id, nq, nc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored WHERE score >= {SEARCH_THRESHOLD}),
hits AS (SELECT * FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= {SEARCH_TOP})"""

DEDUPED = f"""{SEARCH},
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, {search_text("title || ' ' || text")} ORDER BY rank) AS copy FROM hits),
deduped AS (SELECT * EXCLUDE (copy) FROM keyed WHERE copy = 1)"""

COMPRESSED = f"""{DEDUPED},
compressed AS (
  SELECT * REPLACE (substr(text, 1, 80) AS text) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept FROM deduped) WHERE kept <= 3)"""

MESSAGES = """
messages AS (
  SELECT conv_id * 1000 + turn + 1 AS id, CAST(conv_id AS VARCHAR) AS session_id,
    CAST(conv_id % 37 AS VARCHAR) AS user_id, role, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn) AS created_at
  FROM conversations)"""


# --- structured chunks ---------------------------------------------------------------------------------------------

SOURCE_DOCUMENTS = """
docs AS (
  SELECT source AS knowledge_scope, CAST(doc_id AS VARCHAR) AS document_id, lang AS title,
    source || '/' || doc_id || '.md' AS source_ref, text FROM documents)"""

# Fenced code is found by counting fence lines: the given texts have no fence inside a fence.
STRUCTURE = f"""
clean AS (SELECT * REPLACE ({portable('text')} AS text) FROM docs WHERE NOT {blank('text')}),
doc_lines AS (SELECT knowledge_scope, document_id, source_ref, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM clean),
fences AS (SELECT *, starts_with({trim('line')}, '```') OR starts_with({trim('line')}, '~~~') AS fence FROM doc_lines),
inside AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fence_no FROM fences),
typed AS (SELECT *, fence OR fence_no % 2 = 1 AS code,
  CASE WHEN NOT (fence OR fence_no % 2 = 1) THEN regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]', 1) ELSE '' END AS marks
  FROM inside),
titled AS (SELECT *, CASE WHEN marks <> '' THEN nullif({trim(f"rtrim({trim('substr(ltrim(line), length(marks) + 1)')}, '#')")}, '')
  END AS heading FROM typed),
""" + "".join(
    f"""level{i} AS (SELECT *, max(CASE WHEN heading IS NOT NULL AND length(marks) = {i} THEN n END) OVER p AS at{i},
  arg_max(heading, n) FILTER (heading IS NOT NULL AND length(marks) = {i}) OVER p AS text{i}
  FROM {'titled' if i == 1 else f'level{i - 1}'} WINDOW p AS (PARTITION BY document_id ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
""" for i in range(1, 7)) + f"""
pathed AS (SELECT *, coalesce(nullif(concat_ws(' / ', """ + ", ".join(
    f"CASE WHEN at{i} > greatest(0, " + ", ".join(f"coalesce(at{j}, 0)" for j in range(1, i)) + f") THEN text{i} END"
    if i > 1 else "text1" for i in range(1, 7)) + f"""), ''), 'Document') AS heading_path,
  code OR (heading IS NULL AND NOT {blank('line')}) AS content FROM level6),
grouped AS (SELECT *, CASE WHEN content AND (lag(content) OVER w IS NOT TRUE OR lag(code) OVER w <> code
    OR (code AND fence AND fence_no % 2 = 1)) THEN 1 ELSE 0 END AS starts FROM pathed
  WINDOW w AS (PARTITION BY document_id ORDER BY n)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit_no FROM grouped WHERE content),
units AS (SELECT knowledge_scope, document_id, source_ref, CAST(unit_no - 1 AS BIGINT) AS unit_no,
  CASE WHEN bool_or(code) THEN 'code' ELSE 'paragraph' END AS structure_kind, any_value(heading_path) AS heading_path,
  string_agg(CASE WHEN code AND fence AND fence_no % 2 = 1 THEN {trim('line')} ELSE line END, chr(10) ORDER BY n) AS text
  FROM numbered GROUP BY ALL)"""


def structured_chunks(limit: int) -> str:
    """Greedy packing of sentences and paragraphs as recursive queries; needs WITH RECURSIVE."""
    return f"""{STRUCTURE},
sentence_rows AS (SELECT document_id, unit_no, unnest(s) AS sentence, generate_subscripts(s, 1) AS sn FROM (
  SELECT document_id, unit_no, regexp_extract_all(text, '[^.!?。！？\\n]*[.!?。！？\\n]|[^.!?。！？\\n]+$') AS s
  FROM units WHERE structure_kind = 'paragraph' AND length(text) > {limit})),
piece_rows AS (SELECT document_id, unit_no, sn, i, substr(sentence, i * {limit} + 1, {limit}) AS piece FROM (
  SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(sentence) / {limit}.0) AS BIGINT)))) AS i FROM sentence_rows)),
pieces AS (SELECT document_id, unit_no, piece, row_number() OVER (PARTITION BY document_id, unit_no ORDER BY sn, i) AS pn
  FROM piece_rows),
sentence_fold AS (
  SELECT document_id, unit_no, pn, length(piece) AS open, 0 AS part FROM pieces WHERE pn = 1 UNION ALL
  SELECT p.document_id, p.unit_no, p.pn, CASE WHEN f.open + length(piece) > {limit} THEN length(piece)
      ELSE f.open + length(piece) END, CASE WHEN f.open + length(piece) > {limit} THEN part + 1 ELSE part END
  FROM sentence_fold f JOIN pieces p ON p.document_id = f.document_id AND p.unit_no = f.unit_no AND p.pn = f.pn + 1),
packed_parts AS (SELECT document_id, unit_no, part, string_agg(piece, '' ORDER BY pn) AS text
  FROM sentence_fold JOIN pieces USING (document_id, unit_no, pn) GROUP BY ALL),
parts AS (
  SELECT u.document_id, u.unit_no, coalesce(p.part, 0) AS part, structure_kind, heading_path, coalesce(p.text, u.text) AS text
  FROM units u LEFT JOIN packed_parts p USING (document_id, unit_no)),
ordered_parts AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_no, part) AS pn FROM parts),
pack_fold AS (
  SELECT document_id, pn, structure_kind, heading_path, length(text) AS open, 0 AS ordinal FROM ordered_parts WHERE pn = 1
  UNION ALL
  SELECT p.document_id, p.pn, p.structure_kind, p.heading_path,
    CASE WHEN joins THEN open + 2 + length(text) ELSE length(text) END, CASE WHEN joins THEN ordinal ELSE ordinal + 1 END
  FROM (SELECT p.*, f.open, f.ordinal, p.structure_kind = 'paragraph' AND f.structure_kind = 'paragraph'
      AND p.heading_path = f.heading_path AND f.open + 2 + length(p.text) <= {limit} AS joins
    FROM pack_fold f JOIN ordered_parts p ON p.document_id = f.document_id AND p.pn = f.pn + 1) p),
packed AS (SELECT document_id, f.structure_kind, f.heading_path, ordinal,
  string_agg(text, chr(10) || chr(10) ORDER BY pn) AS raw
  FROM pack_fold f JOIN ordered_parts p USING (document_id, pn) GROUP BY ALL),
texts AS (SELECT document_id, structure_kind, heading_path, ordinal, {portable('raw')} AS text FROM packed),
refused AS (SELECT DISTINCT document_id FROM texts WHERE text = ''),
hashed AS (SELECT t.*, sha256(text) AS content_hash FROM texts t ANTI JOIN refused USING (document_id)),
repeated AS (SELECT *, row_number() OVER (PARTITION BY document_id, structure_kind, heading_path, content_hash
  ORDER BY ordinal) - 1 AS duplicate_ordinal FROM hashed),
schunks AS (SELECT knowledge_scope, document_id, source_ref, sha256(concat_ws(chr(0), knowledge_scope, document_id,
    structure_kind, heading_path, content_hash, CAST(duplicate_ordinal AS VARCHAR))) AS chunk_id,
  structure_kind, heading_path, repeated.text, content_hash, CAST(ordinal AS BIGINT) AS ordinal, duplicate_ordinal,
  length(repeated.text) AS token_count FROM repeated JOIN clean USING (document_id))"""


def point_id(scope: str, chunk: str) -> str:
    h = f"sha256({scope} || chr(0) || {chunk})"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
            f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || "
            f"substr({h}, 21, 12)")
