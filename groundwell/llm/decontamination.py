"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Item texts are cut into windows of 13 words (an item of fewer words is one window). Each text is normalised and scanned
once; the words inside any occurrence are hit, and hit words are mapped back to spans of the original text. A document is
contaminated when at least one word in 20 is hit.

The automaton travels to the tasks, so its size is checked: items beyond ``BLOCK_WORDS`` words are split over several
automata, and each scans every text.

Defined results: a null or empty text has no words and is clean; a null item text has no windows; an item without an id
marks words but is not listed; repeated items and windows count once; an empty benchmark leaves all clean; an empty table
gives no rows. Other columns pass through in ``row``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.automaton import Phrases, words_of
from groundwell.llm.common import query, table, whole_texts

WINDOW = 13
#: One hit word in so many contaminates.
SHARE = 20
#: Benchmark words in one automaton, about 13 nodes each.
BLOCK_WORDS = 100_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_TYPE = "struct<n_words:bigint,hit:array<bigint>,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def windows(item: bytes | None, size: int) -> list[tuple[bytes, ...]]:
    words = words_of(item)
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def spans(text: bytes, hit: list[int]) -> list[dict[str, int]]:
    """Runs of hit words as spans in code points of the original text."""
    wanted, found, last = set(hit), [], -2
    for i, match in enumerate(_WORD.finditer(text.decode("utf-8", "replace"))):
        if i in wanted:
            if last == i - 1:
                found[-1]["end"] = match.end()
            else:
                found.append({"start": match.start(), "end": match.end()})
            last = i
    return found


def _scanner(phrases: Phrases):
    @F.arrow_udf(_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            words = words_of(text)
            places = phrases.places(words)
            hit = sorted({i for start, n, _ in places for i in range(start, start + n)})
            items = sorted({item for _, _, value in places for item in value})
            out.append({"n_words": len(words), "hit": hit, "items": items, "spans": spans(text, hit) if hit else []})
        return pa.array(out, _ARROW)

    return scan


def automata(benchmark: DataFrame, item_id: str, text: str, window: int) -> list[Phrases]:
    """The benchmark as automata of a bounded size; at least one."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * BLOCK_WORDS)))
    found = []
    for block in range(blocks):
        phrases: dict[tuple[bytes, ...], set] = {}
        for item, words in items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect():
            for key in windows(words, window):
                phrases.setdefault(key, set()).update([] if item is None else [item])
        found.append(Phrases({k: tuple(sorted(v)) for k, v in phrases.items()}))
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``row`` (all columns), ``n_words, n_hit, items, spans, contaminated`` of every document."""
    scans = [_scanner(p) for p in automata(benchmark, item_id, item_text, window)]
    scanned = whole_texts(documents).select(F.struct("*").alias("row"), *[
        scan(F.col(text).cast("binary")).alias(f"scan{i}") for i, scan in enumerate(scans)])

    def merged(field: str) -> Column:
        return F.array_distinct(F.concat(*[F.col(f"scan{i}")[field] for i in range(len(scans))]))

    return scanned.select(
        "row", F.col("scan0")["n_words"].alias("n_words"), F.size(merged("hit")).cast("long").alias("n_hit"),
        F.array_sort(merged("items")).alias("items"), F.array_sort(merged("spans")).alias("spans"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, w, least(len(w), 13) AS size FROM (SELECT item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)
), places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
    SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM words, (SELECT DISTINCT size FROM windows))
), found AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op9_decontamination", SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
