"""Phrase collocation mining by marginalising the counts of the longest windows.

Every word opens one window: itself and its lead columns, the next words of its piece, padded behind the end of the piece. Only
these windows are counted, so a word is shuffled once (and once a task, if its window repeats there). The count of a shorter
phrase is the sum over the windows that it starts, which ``ROLLUP`` takes prefix by prefix; no text is cut into n-grams of
each order.

A first pass counts the words and gives the sizes of the languages. A word below the least count is in no candidate, so a
window ends before it. The other words are numbered, the most frequent first, and a window is one 64-bit number where that
holds all its words. Tasks add equal windows up before they leave. The numbers travel to the tasks, so their count is
checked: beyond ``NUMBERED`` words, or where a window does not fit, windows have a column for each word with its 64-bit hash, and
tasks know rare words by a bitmap of ``BITS`` bits (a rare word that passes it by chance is counted and dropped later). The first
pass proves that no two words share a hash, or another seed is taken.

Scores are exact: products are decimals of 38 digits, which holds a billion times a trillion squared.

Defined results: a null or empty text has no words, a null language is ``und``; repeated rows count each; a phrase does not
reach over a break or a document; ties are ordered by phrase in byte order; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.common import query, table, whole_texts
from groundwell.operators.stages import materialize

ORDER = 3
LEAST = 10
#: A phrase goes where a longer candidate around it has this percentage of its count.
COVERED = 50
TOP = 2000
SCORE = "(a * a * 1000000BD) div (l * r)"
#: Words that are numbered, bits of the bitmap, and what a task holds: distinct words, and words whose windows it adds up.
NUMBERED = (1 << 21) - 1
BITS = 1 << 25
HELD, WORDS = 300_000, 1_500_000
SEEDS = 8
#: Lower-cases A-Z and turns breaks into full stops, which no word holds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _words(text: bytes | None) -> list[bytes]:
    """Words and breaks of a text; blanks and tabs are all that is left to separate words."""
    return text.translate(_FOLD).replace(b".", b" . ").split() if text else []


def _id(lang: bytes, word: bytes, seed: int) -> int:
    """Spark's ``xxhash64(seed, lang, word)`` over texts."""
    value = xxhash.xxh64_intdigest(str(seed).encode(), 42)
    value = xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, value))
    return value - (1 << 64) if value >> 63 else value


def _texts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    named = F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary")
    return whole_texts(documents).select(named, F.col(text).cast("binary"))


def vocabulary(documents: DataFrame, text: str, lang: str, seed: int) -> DataFrame:
    """``lang, word, id, f`` of every word of every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = defaultdict(Counter)

        def told() -> pa.RecordBatch:
            rows = [(name, word, n) for name, words in counts.items() for word, n in words.items() if word != b"."]
            counts.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "f"])

        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                counts[name].update(_words(value))
                if sum(map(len, counts.values())) > HELD:
                    yield told()
        yield told()

    told = _texts(documents, text, lang).mapInArrow(run, "lang binary, word binary, f bigint")
    return told.groupBy("lang", "word").agg(F.sum("f").alias("f")).select(
        F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"),
        F.xxhash64(F.lit(str(seed)), F.col("lang").cast("string"), F.col("word").cast("string")).alias("id"), "f")


def named_words(documents: DataFrame, text: str, lang: str) -> tuple[int, DataFrame]:
    """A seed, and the vocabulary under ids that are proven to differ."""
    for seed in range(SEEDS):
        words = materialize(vocabulary(documents, text, lang, seed))
        if words.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id = 0").isEmpty():
            return seed, words
    raise ValueError("words share ids under every seed")


def frequent_bits(words: DataFrame, least: int, bits: int) -> bytes:
    """One bit for the ids of words that stand at least ``least`` times; its size does not depend on the words."""
    place = F.pmod("id", F.lit(bits)) + 1
    rows = words.filter(F.col("f") >= least).groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")).collect()
    whole = bytearray(-(-bits // 8))
    for r in rows:
        whole[4096 * (r.bucket - 1):4096 * (r.bucket - 1) + len(r.held)] = r.held
    return bytes(whole[:-(-bits // 8)])


class Numbers:
    """The number of every word that is not rare: its place by frequency, or its hash where there are too many. 0 is no word."""

    def __init__(self, words: DataFrame, least: int, seed: int, order: int):
        self.seed, self.bits, self.places, self.width = seed, None, None, 0
        often = words.filter(F.col("f") >= least)
        count = often.count()
        if count <= NUMBERED and order * count.bit_length() < 64:
            held = often.select("id", "f").toArrow()
            ids, f = held["id"].to_numpy(), held["f"].to_numpy()
            self.hashes, self.width = np.sort(ids), max(1, count.bit_length())
            self.places = np.empty(count, np.int64)
            self.places[np.lexsort((self.hashes, -f[np.argsort(ids)]))] = np.arange(1, count + 1)
        else:
            self.bits = np.frombuffer(frequent_bits(words, least, BITS), np.uint8)

    def number(self, lang: bytes, word: bytes) -> int:
        if word == b".":
            return 0
        value = _id(lang, word, self.seed)
        if self.bits is not None:
            place = value % (len(self.bits) * 8)
            return value if self.bits[place >> 3] >> (place & 7) & 1 else 0
        at = int(np.searchsorted(self.hashes, value))
        return int(self.places[at]) if at < len(self.hashes) and self.hashes[at] == value else 0

    def named(self, words: DataFrame) -> DataFrame:
        """``id, word, lang`` with the numbers of the words as ids."""
        if self.places is None:
            return words.select("id", "word", "lang")
        table_ = pa.table({"id": self.hashes, "place": self.places})
        return words.join(words.sparkSession.createDataFrame(table_), "id").select(F.col("place").alias("id"), "word", "lang")


def added_windows(ids: np.ndarray, order: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The windows of a sequence of ids, in order and each once, with their counts; 0 ends a window. With a ``width``, a window
    is one number with so many bits for each word."""
    padded = np.concatenate([ids, np.zeros(order, np.int64)])
    columns = [padded[:len(ids)]]
    for k in range(1, order):
        columns.append(np.where(columns[-1] == 0, 0, padded[k:len(ids) + k]))
    opened = columns[0] != 0
    columns = [c[opened] for c in columns]
    if width:
        keys = columns[0]
        for c in columns[1:]:
            keys = keys << width | c
        keys, counts = np.unique(keys, return_counts=True)
        return [keys], counts
    by = np.lexsort(columns[::-1])
    columns = [c[by] for c in columns]
    fresh = np.ones(len(by), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(fresh)
    return [c[starts] for c in columns], np.diff(starts, append=len(by))


def windows(documents: DataFrame, text: str, lang: str, order: int, numbers: Numbers) -> DataFrame:
    """``w1 .. wN, f``, or ``w, f``: the windows that open at frequent words, added up within tasks and then over all. 0 stands
    for a break, for a rare word, and for all that follows these."""
    names = ["w"] if numbers.width else [f"w{k}" for k in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = defaultdict(dict)

        def number(name: bytes, word: bytes) -> int:
            if sum(map(len, known.values())) > HELD:
                known.clear()
            return known[name].setdefault(word, numbers.number(name, word))

        def told(parts: list[np.ndarray]) -> pa.RecordBatch:
            columns, counts = added_windows(np.concatenate(parts), order, numbers.width)
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts)], names=[*names, "n"])

        held, size = [], 0
        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(value)
                ids = list(map(known[name].get, words))
                if None in ids:
                    ids = [number(name, w) if i is None else i for w, i in zip(words, ids)]
                held.append(np.array([*ids, 0], np.int64))
                size += len(ids) + 1
                if size > WORDS:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    told_ = _texts(documents, text, lang).mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "n"]))
    return told_.groupBy(*names).agg(F.sum("n").alias("f"))


def counted(documents: DataFrame, text: str, lang: str, order: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f`` of every phrase of up to ``order`` words that stands at least ``least`` times, and ``lang, n``."""
    seed, words = named_words(documents, text, lang)
    numbers = Numbers(words, least, seed, order)
    names, width = [f"w{k}" for k in range(1, order + 1)], numbers.width
    longest = windows(documents, text, lang, order, numbers)
    if width:
        mask = F.lit((1 << width) - 1)
        longest = longest.select(*[F.shiftright("w", width * (order - k)).bitwiseAND(mask).alias(f"w{k}") for k in range(1, order + 1)], "f")
    # The bound depends on the last word, so both uses share the exchange of the windows.
    whole = longest.filter(F.col("f") >= F.when(F.col(names[-1]) == 0, F.lit(None)).otherwise(least)).select(
        F.array(*names).alias("ids"), "f")
    shorter = longest.rollup(*names[:-1]).agg(F.sum("f").alias("f")).filter((F.col("f") >= least) & F.col("w1").isNotNull()).select(
        F.filter(F.array(*names[:-1]), lambda w: w.isNotNull()).alias("ids"), "f").filter(~F.array_contains("ids", 0))
    phrases = materialize(whole.unionByName(shorter))
    spelled = phrases.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(numbers.named(words), "id")
    named = spelled.groupBy("ids", "f", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    return (named.select("lang", F.col("spelled.word").alias("words"), "f"),
            words.groupBy("lang").agg(F.sum("f").alias("n")))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def _runs(words: Column) -> Column:
    """All contiguous parts of two words or more, but not the whole."""
    n = F.size(words)
    return F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda size: F.transform(
        F.sequence(F.lit(1), n - size + 1), lambda i: _phrase(F.slice(words, i, size)))))


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, least: int = LEAST,
                 covered: int = COVERED, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of 2 to ``order`` words of each language."""
    found, sizes = counted(documents, text, lang, order, least)
    frequent = materialize(found.withColumn("phrase", _phrase(F.col("words"))))
    candidates = frequent.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = frequent.filter(F.size("words") < order)

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _phrase(F.slice("words", 1, F.col("k"))).alias("first"),
        _phrase(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))

    def wide(column: str) -> Column:
        return F.col(column).cast("decimal(15,0)")

    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumns({c: wide(c) for c in ("a", "l", "r")}).withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("low")).select(
        "lang", "phrase", *[F.col(f"low.{c}").cast("long").alias(c) for c in ("a", "l", "r", "score")])

    around = candidates.filter(F.size("words") > 2).select("lang", F.explode(_runs(F.col("words"))).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS size))
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3)
  GROUP BY ALL
), ranked AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank
  FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("text", "lang"))
