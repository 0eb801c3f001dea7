"""Ranked lexical search as a search for largest inner products, in buckets of vector length.

A document becomes the vector of its term impacts, an item the vector of its term weights; the score is their product. Only
terms of items are coordinates, as others never add to a score.

1. **Profiles.** Texts are read once; the number of terms and the counts of item terms of each document are written to the
   shared folder. Sums over these rows give N, L and the document frequencies.
2. **Lengths.** Impacts and their Euclidean length follow from the profile. Lengths are cut into buckets, each a tenth lower
   than the one before.
3. **Long vectors first.** The longest vectors are searched first and give every item a score that its last place certainly
   reaches. By Cauchy-Schwarz, a bucket whose length times the item's length stays below that score is skipped; documents
   that no item can need are not even handed to Python.
4. **Inside a bucket.** The item's heaviest coordinates are taken until the others cannot reach the score alone: only
   documents that have one of these remain, and of them those whose exact part on these coordinates plus the product of the
   remaining lengths can still reach it.
5. **Survivors** are scored exactly, in 64-bit integers. Each task hands on the best of its documents for each item only.

Bounds are floating point with a margin above their rounding error; a pair is ruled out only strictly below the score, so ties
are whole. Items are searched in blocks of ``BLOCK_BYTES`` of text, the only thing that the driver holds; each block is a pass of its own.

Defined results: a null or empty text has no terms and is never found; an item without terms, or whose terms no document
holds, has no rows; repeated terms of an item count each; repeated rows of documents or items are ranked each, in an order
fixed by their ids; a null id comes first; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.automaton import words_of
from groundwell.llm.common import query, table, whole_texts
from groundwell.operators.stages import materialize

TOP = 20
#: Bytes of item texts that are searched at once; a larger item is a block of its own.
BLOCK_BYTES = 4 << 20
#: Lengths of a bucket lie within this factor.
STEP = 0.9
#: The first round takes the longest vectors, one in so many.
FIRST = 64
#: Documents that a task holds at once, and relative margin of the bounds.
ROWS, MARGIN = 16_384, 1e-9


class Items:
    """Item vectors over the terms of a block, each term a number; ``weights`` come from the corpus."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.names, self.terms = [], []
        for name, text in rows:
            counts = Counter(self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text))
            self.names.append(name)
            self.terms.append((np.fromiter(counts.keys(), np.int64), np.fromiter(counts.values(), np.int64)))

    def weigh(self, n: int, df: dict[int, int]) -> None:
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if df.get(t) else 0
                            for t in range(len(self.numbers))], np.int64)
        vectors = []
        for terms, counts in self.terms:
            values = weights[terms] * counts
            order = np.argsort(-values, kind="stable")
            order = order[values[order] > 0]
            vectors.append((terms[order], values[order]))
        self.terms = vectors
        #: tails[i][k]: length of the vector of item i without its first k coordinates.
        self.tails = [np.sqrt(np.append(np.cumsum((v[::-1].astype(np.float64)) ** 2)[::-1], 0.0)) for _, v in vectors]


def profiles(documents: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document that has terms: its length and the item terms that it holds."""
    numbers = items.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            kept, sizes, terms, counts, offsets = [], [], [], [], [0]
            for row, value in enumerate(batch.column(1)):
                words = words_of(value.as_py())
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                kept.append(row)
                sizes.append(len(words))
                terms.extend(found.keys())
                counts.extend(found.values())
                offsets.append(len(terms))
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(kept, pa.int32())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return whole_texts(documents).select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def vectors(profile: DataFrame, n: int, total: int) -> DataFrame:
    """``doc_id, terms, impacts, length`` of every document with a coordinate. Impacts are whole numbers."""
    m = F.lit(75) + F.expr(f"(25L * n * {n}L) div {total}L")
    impacts = F.transform("counts", lambda tf: F.call_function("div", tf * 1_000_000_000, tf * 1000 + F.col("m") * 12))
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return profile.filter(F.size("terms") > 0).withColumn("m", m).withColumn("impacts", impacts).select(
        "doc_id", "terms", "impacts", length.alias("length"))


class Best:
    """The best documents of each item so far, and the score below which a document is of no use."""

    def __init__(self, count: int, top: int, floors: dict[int, int]):
        self.top = top
        self.ids = [np.empty(0, np.int64) for _ in range(count)]
        self.scores = [np.empty(0, np.int64) for _ in range(count)]
        self.floors = np.array([floors.get(i, 1) for i in range(count)], np.int64)

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[item], ids]), np.concatenate([self.scores[item], scores])
        if len(ids) > self.top:
            order = np.lexsort((ids, -scores))[:self.top]
            ids, scores = ids[order], scores[order]
        self.ids[item], self.scores[item] = ids, scores
        if len(ids) == self.top:
            self.floors[item] = max(self.floors[item], scores.min())


class Block:
    """Vectors of similar lengths, with the documents of each coordinate."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths, self.longest = ids, lengths, float(lengths.max()) if len(lengths) else 0.0
        order = np.argsort(terms, kind="stable")
        self.owner, self.impacts = owner[order], impacts[order]
        self.starts = terms[order]

    def postings(self, term: int) -> slice:
        a, b = np.searchsorted(self.starts, [term, term + 1])
        return slice(a, b)

    def search(self, terms: np.ndarray, values: np.ndarray, tails: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of all that can reach ``floor``, and perhaps others."""
        bound = floor / (1 + MARGIN)
        if tails[0] * self.longest < bound:
            return self.ids[:0], self.ids[:0]
        # The first coordinates without which no document of the block reaches the bound.
        focus = int(np.searchsorted(-(tails * self.longest), -bound, "right"))
        places = [self.postings(t) for t in terms]
        score = np.zeros(len(self.ids), np.int64)
        squares = np.zeros(len(self.ids))
        for place, value in zip(places[:focus], values):
            score[self.owner[place]] += value * self.impacts[place]
            squares[self.owner[place]] += self.impacts[place].astype(np.float64) ** 2
        some = np.flatnonzero(score)
        rest = np.sqrt(np.maximum(self.lengths[some] ** 2 * (1 + MARGIN) - squares[some], 0.0))
        some = some[score[some] + tails[focus] * rest >= bound]
        if len(some) and focus < len(terms):
            survives = np.zeros(len(self.ids), bool)
            survives[some] = True
            for place, value in zip(places[focus:], values[focus:]):
                held = survives[self.owner[place]]
                score[self.owner[place][held]] += value * self.impacts[place][held]
        some = some[score[some] >= floor]
        return some, score[some]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The vectors of a task, some thousand at a time, by buckets of length."""
    def flush(held: list[pa.RecordBatch]) -> Iterator[Block]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows["length"].to_numpy()
        bucket = np.floor(np.log(lengths) / math.log(STEP)).astype(np.int64)
        lists, impacts = rows["terms"].chunk(0), rows["impacts"].chunk(0)
        ids, known = rows["doc_id"].fill_null(-2 ** 63).to_numpy(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(ids)), known)
        terms, values = lists.flatten().to_numpy(), impacts.flatten().to_numpy()
        for b in np.unique(bucket):
            inside = bucket == b
            place = np.cumsum(inside) - 1
            mine = inside[owner]
            yield Block(ids[inside], place[owner[mine]], terms[mine], values[mine], lengths[inside])

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= ROWS:
            yield from flush(held)
            held, count = [], 0
    if held:
        yield from flush(held)


def best_products(found: DataFrame, items: Items, floors: dict[int, int], top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of every task, no fewer than the best of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.names), top, floors)
        for block in _blocks(batches):
            for i, (terms, values) in enumerate(items.terms):
                if len(terms):
                    rows, scores = block.search(terms, values, items.tails[i], int(best.floors[i]))
                    if len(rows):
                        best.add(i, block.ids[rows], scores)
        sizes = [len(x) for x in best.ids]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), pa.array(np.concatenate(best.ids)),
                pa.array(np.concatenate(best.scores))], names=["item", "doc_id", "score"])

    return found.select("doc_id", "terms", "impacts", "length").mapInArrow(run, "item int, doc_id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items in blocks of a bounded size, cut by running totals of hash groups."""
    rows = items.select(F.col(item_id).cast("long").alias("name"), F.col(text).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    group = F.pmod(F.xxhash64("name", "text"), F.lit(max(blocks, 1)))
    for block in range(blocks):
        held = rows.filter((group == block) & (F.octet_length("text") > 0)).collect()
        yield Items(sorted((tuple(r) for r in held), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def ranked_search(documents: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every row of ``queries`` with a score above 0."""
    spark, results = documents.sparkSession, []
    for items in item_blocks(queries, item_id, item_text):
        profile = materialize(profiles(documents, items, doc_id, text))
        n, total = profile.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            continue
        held = profile.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        items.weigh(n, {r.term: r.df for r in held})
        found = materialize(vectors(profile, n, total))
        edge = found.agg(F.percentile_approx("length", 1 - 1 / FIRST, F.lit(1000))).first()[0]
        if edge is None:
            continue
        seeds = materialize(_ranked(best_products(found.filter(F.col("length") >= edge), items, {}, top), top))
        # Every item's score at its last place so far, for items that fill all places.
        floors = {r.item: r.score for r in seeds.filter(F.col("rank") == top).select("item", "score").collect()}
        need = min((floors.get(i, 1) / (tails[0] * (1 + MARGIN)) for i, tails in enumerate(items.tails) if tails[0]), default=math.inf)
        rest = best_products(found.filter((F.col("length") < edge) & (F.col("length") >= need * (1 - MARGIN))), items, floors, top)
        names = spark.createDataFrame(list(enumerate(items.names)), "item int, item_id bigint")
        best = _ranked(seeds.select("item", "doc_id", "score").unionByName(rest), top)
        results.append(best.join(F.broadcast(names), "item").select(
            "item_id", "rank", F.nullif("doc_id", F.lit(-2 ** 63)).alias("doc_id"), "score"))
    if not results:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), held AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)) AS impact
  FROM held JOIN lengths USING (doc_id), whole
), scores AS (
  SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query("op13_ranked_search", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
