"""Exact n-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their hashes. It is cut into fragments, and a set falls apart into its pieces
of each fragment.

1. **Candidates.** Sets of similar size share a scheme that cuts the order into half as many fragments again as two linked
   sets can differ in. If they differ in at most D fragments, the rarest piece in which they agree has at most D rarer ones
   in either set: so sets meet on their D + 1 rarest pieces only. A passage that many documents share makes frequent pieces,
   and sets with enough rare ones never meet on these. Only hashes of whole pieces are shuffled.
2. **Bounds.** Each set carries parity sketches of 1024 and 2048 bits. The bits in which two sketches differ are at most the
   n-grams in which the sets differ, so pairs beyond the limit are dropped without losing a link. The narrow one meets every
   pair of a shared piece, the wide one what is left of these, before any n-gram is moved.
3. **Partial overlaps.** For the pairs that remain, overlaps are counted fragment by fragment and summed per pair.

Equal sets are one class from the start. To join a large group of near copies without forming all of its pairs, every class
is first compared with one leader per shared piece. Only pieces whose classes still lie in different components are
compared pair by pair, so every pair is either counted, ruled out by a bound, or already connected.

Exact but for equal 64-bit hashes of different n-grams. Defined results: a null or empty text, or one without words, has no
n-grams and links with nothing; equal rows are one class; a null id takes part in links, but is named only where no
other id is in its component; an empty table gives no rows. Other columns are ignored, or kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.common import query, table, whole_texts
from groundwell.llm.components import components
from groundwell.llm.shingles import mix, sets
from groundwell.operators.stages import materialize

#: Ranges of the global order in which overlaps are counted.
FRAGMENTS = 8
_U = np.uint64
WIDE = 2048
#: The narrow sketch is the wide one, folded in two.
_WORDS = [f"s{i}" for i in range(WIDE // 128)]
#: Schemes are told apart within a room; prefix n-grams may always be met on.
SCHEMES, ANY = 1 << 12, 1 << 62


class Schemes:
    """Fragment counts by set size for links with num * union <= den * intersection, in integers.

    Bucket b holds the sizes [low[b], low[b + 1]); a linked partner of a set of bucket b, if not smaller, lies in b or
    b + 1. Scheme b serves pairs whose smaller set lies in bucket b, so each set is cut by schemes b and b - 1. Linked
    sets differ in at most ``differ`` n-grams; ``spare`` more fragments than that allow for pieces that are empty in both.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.fragments, self.spare = [1], [], []

    def grow(self, size: int) -> None:
        while self.low[-1] <= size or len(self.fragments) < len(self.low) - 1:
            self.low.append(self.low[-1] * self.den // self.num + 1)
            small = self.low[-1] - 1
            differ = (small + small * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            spare = 1 + (differ + 1) // 2
            self.fragments.append(differ + 1 + spare)
            self.spare.append(spare)

    def bucket(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """Linked sets share one of so many first n-grams of each, in the global order."""
        return sizes - -(-sizes * self.num // self.den) + 1


def _digests(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bytes that name a set."""
    sums = [np.add.reduceat(mix(grams ^ _U(salt)), starts) for salt in (0x51ED270B, 0xA3C59AC2F1D37)]
    return np.ascontiguousarray(np.stack(sums, 1)).view("S16")[:, 0]


def _bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return starts, np.diff(starts, append=len(rows))


def _wide(bit: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parity sketches of ``WIDE`` bits, a row for each set, made for a few hundred at a time."""
    out, ends = [], np.cumsum(counts)
    for i in range(0, len(counts), 512):
        own = counts[i:i + 512]
        places = np.repeat(np.arange(len(own)), own) * WIDE + (bit[ends[i] - counts[i]:ends[i + len(own) - 1]] & _U(WIDE - 1)).astype(np.int64)
        odd = np.bincount(places, minlength=len(own) * WIDE).astype(np.uint8) & 1
        out.append(np.packbits(odd.reshape(len(own), WIDE), axis=1).view(np.int64).reshape(-1))
    return np.concatenate(out).reshape(len(counts), WIDE // 64)


def _parts(names: np.ndarray) -> np.ndarray:
    """The first half of each name."""
    return np.ascontiguousarray(names).view(np.int64)[::2].copy()


def _column(values: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def profiles(documents: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``doc_id, n, cls, part, s0.., wide``: set size, name of the set, its first half and the parity sketches of every
    document that has n-grams."""
    schema = "doc_id bigint, n bigint, cls binary, part bigint, " + ", ".join(f"{s} bigint" for s in _WORDS) + ", wide array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, grams in sets(batch.column(1), size):
                starts, counts = _bounds(rows)
                if not len(starts):
                    continue
                wide = _wide(mix(grams ^ _U(0x7C0FFEE)), counts)
                folded = wide[:, :len(_WORDS)] ^ wide[:, len(_WORDS):]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(counts) + 1) * wide.shape[1], pa.int32()), pa.array(wide.reshape(-1)))
                names = _digests(grams, starts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(first + rows[starts])), pa.array(counts, pa.int64()), _column(names),
                    pa.array(_parts(names)), *[pa.array(np.ascontiguousarray(s)) for s in folded.T], lists,
                ], names=["doc_id", "n", "cls", "part", *_WORDS, "wide"])

    return whole_texts(documents).select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, schema)


def signatures(documents: DataFrame, text: str, size: int, num: int, den: int) -> DataFrame:
    """``sig, part, room``: hashes of whole pieces, with the first half of the name of the set, and how many more pieces of its
    scheme may be met on than are its own alone (see :func:`rarest`). Equal sets of one task are told once, so that large
    groups of copies are thinned out before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, told = Schemes(num, den), set()
        for batch in batches:
            for _, rows, grams in sets(batch.column(0), size):
                if not len(rows):
                    continue
                starts, counts = _bounds(rows)
                names = _digests(grams, starts)
                fresh = np.array([not (n in told or told.add(n)) for n in names.tolist()], bool)
                if not fresh.any():
                    continue
                keep = np.repeat(fresh, counts)
                sigs, parts, rooms = cut(grams[keep], counts[fresh], _parts(names[fresh]), schemes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs.view(np.int64)), pa.array(parts), pa.array(rooms)], names=["sig", "part", "room"])

    return whole_texts(documents).select(F.col(text).cast("binary")).mapInArrow(run, "sig bigint, part bigint, room bigint")


def cut(grams: np.ndarray, counts: np.ndarray, parts: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    schemes.grow(int(counts.max()))
    buckets = schemes.bucket(counts)
    fragments, spare = np.array(schemes.fragments), np.array(schemes.spare)
    ends = np.cumsum(counts)
    place = np.arange(len(grams)) - np.repeat(ends - counts, counts)
    found_sigs, found_parts, found_rooms, short = [], [], [], np.zeros(len(counts), bool)
    hashed = mix(grams ^ _U(0x2545F4914F6CDD1D))
    for back in (0, 1):
        scheme = buckets - back
        used = np.flatnonzero(scheme >= 0)
        if not len(used):
            continue
        mask = np.repeat(scheme >= 0, counts)
        owner = np.repeat(np.arange(len(counts)), counts)[mask]
        cuts = fragments[scheme[owner]].astype(np.uint64)
        fragment = ((grams[mask] >> _U(32)) * cuts) >> _U(32)
        edges = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(fragment.astype(np.int64), prepend=-1) != 0))
        sums = np.add.reduceat(hashed[mask], edges)
        who = owner[edges]
        found_sigs.append(mix(sums ^ mix(scheme[who].astype(np.uint64) * _U(1 << 32) + fragment[edges])))
        found_parts.append(parts[who])
        pieces_of = np.bincount(who, minlength=len(counts))
        # fragments - spare is D + 1; a room names its scheme, as a set has a room in each.
        room = fragments[scheme] - spare[scheme] - pieces_of
        found_rooms.append((room * SCHEMES + scheme)[who].astype(np.int64))
        empty = fragments[scheme[used]] - pieces_of[used]
        short[used] |= empty > spare[scheme[used]]
    if short.any():
        # Too many empty pieces: such sets could agree in these alone, so they also tell their first n-grams.
        first = np.repeat(short, counts) & (place < np.repeat(schemes.prefix(counts), counts))
        found_sigs.append(mix(grams[first] ^ _U(0x632BE59BD9B4E019)))
        found_parts.append(np.repeat(parts, counts)[first])
        found_rooms.append(np.full(int(first.sum()), ANY, np.int64))
    return np.concatenate(found_sigs), np.concatenate(found_parts), np.concatenate(found_rooms)


def rarest(told: DataFrame) -> DataFrame:
    """``sig, part`` on which sets of different names meet.

    A set that tells m pieces in a scheme, of which others share c, has m - c rarer ones of its own, so D + 1 - m + c of the
    shared ones are left to meet on, from the rarest. One exchange tells rows apart and counts them; pieces that no two sets
    share, nearly all, end there.
    """
    once = told.repartition("sig").dropDuplicates(["sig", "part", "room"])
    shared = once.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("sig"))).filter("held > 1")
    scheme = ["part", "room"]
    place = F.row_number().over(Window.partitionBy(*scheme).orderBy("held", "sig"))
    ranked = shared.withColumns({"place": place, "c": F.count(F.lit(1)).over(Window.partitionBy(*scheme))})
    inside = F.col("place") <= F.floor(F.col("room") / SCHEMES) + F.col("c")
    return ranked.filter((F.col("room") == ANY) | inside).select("sig", "part").distinct()


def _several(rows: DataFrame, value: str) -> DataFrame:
    """Rows of pieces that hold several values."""
    ends = rows.groupBy("sig").agg(F.min(value).alias("low"), F.max(value).alias("high")).filter("low < high")
    return rows.join(ends.select("sig"), "sig")


def pieces(documents: DataFrame, text: str, size: int) -> DataFrame:
    """``cls, fragment, grams``: every set, cut by ranges of the global order; empty pieces are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = set()
        for batch in batches:
            for _, rows, grams in sets(batch.column(0), size):
                starts, counts = _bounds(rows)
                if not len(starts):
                    continue
                names = _digests(grams, starts)
                fresh = np.repeat(np.array([not (n in told or told.add(n)) for n in names.tolist()], bool), counts)
                owner = np.repeat(np.arange(len(starts)), counts)[fresh]
                grams = grams[fresh]
                fragment = (grams >> _U(32)) * _U(FRAGMENTS) >> _U(32)
                if not len(grams):
                    continue
                edges = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(fragment.astype(np.int64), prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(grams)), pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [_column(names[owner[edges]]), pa.array(fragment[edges].astype(np.int32)), lists],
                    names=["cls", "fragment", "grams"])

    return whole_texts(documents).select(F.col(text).cast("binary")).mapInArrow(run, "cls binary, fragment int, grams array<bigint>")


def _differ(num: int, den: int) -> Column:
    """No pair with more differing n-grams is linked."""
    return F.floor((F.col("a.n") + F.col("b.n")) * (den - num) / (den + num))


def _possible(num: int, den: int) -> Column:
    apart = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in _WORDS), F.lit(0))
    return ((F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num) & (apart <= _differ(num, den)))


def _linked(pairs: DataFrame, documents: DataFrame, doc_id: str, text: str, classes: DataFrame, size: int, num: int,
            den: int) -> DataFrame:
    """The pairs ``a, b, na, nb`` that are linked: partial overlaps per fragment, summed per pair."""
    wide = classes.select("cls", "wide")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    limit = F.floor((F.col("na") + F.col("nb")) * (den - num) / (den + num))
    pairs = materialize(
        pairs.join(wide.select(F.col("cls").alias("a"), F.col("wide").alias("x")), "a")
        .join(wide.select(F.col("cls").alias("b"), F.col("wide").alias("y")), "b")
        .filter(apart <= limit).select("a", "b", "na", "nb"))
    involved = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
                           .join(classes.select("cls", "doc_id"), "cls").select("doc_id").distinct())
    # One document stands for each class; rows that share its id are cut as well and simply not asked for.
    chosen = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut_up = materialize(pieces(chosen.join(involved, chosen["doc_id"].eqNullSafe(involved["doc_id"]), "left_semi"), "text", size)
                         .dropDuplicates(["cls", "fragment"]))
    left = cut_up.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("x"))
    right = cut_up.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("y"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("partial"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("both"))
    return summed.filter(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b")


def _joined(documents: DataFrame, size: int, num: int, den: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n, cls`` of every row with n-grams, and ``cls, component_id, label`` of every class."""
    profile = materialize(profiles(documents, doc_id, text, size))
    classes = materialize(profile.groupBy("cls", "part", "n", *_WORDS).agg(
        F.min("doc_id").alias("doc_id"), F.any_value("wide").alias("wide")))
    bounds = classes.drop("doc_id", "wide")
    shared = materialize(_several(rarest(signatures(documents, text, size, num, den)), "part"))

    # The leader of a piece is the class that meets the most others: near copies are closest to what they were made of.
    met = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("met"))
    degrees = shared.join(met, "sig").groupBy("part").agg(F.sum("met").alias("degree"))
    leaders = shared.join(degrees, "part").groupBy("sig").agg(F.max_by("part", F.struct("degree", "part")).alias("leader"))
    stars = materialize(
        shared.join(leaders, "sig").filter("part <> leader").select("leader", "part").distinct()
        .join(bounds.alias("a"), F.col("leader") == F.col("a.part")).drop(F.col("a.part"))
        .join(bounds.alias("b"), "part").filter(_possible(num, den)).select(*_pair()).distinct())
    links = materialize(_linked(stars, documents, doc_id, text, classes, size, num, den))
    found = components(links)

    # What is left: pieces whose classes are not all connected yet, compared pair by pair under the bounds.
    labelled = classes.select("part", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select(
        "part", "cls", F.coalesce("label", "cls").alias("label"))
    apart = materialize(_several(shared.join(labelled, "part"), "label").select("sig", "cls", "label"))
    held = apart.join(bounds.drop("part"), "cls")
    rest = materialize(
        held.alias("a").join(held.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.cls") < F.col("b.cls"))
                             & (F.col("a.label") != F.col("b.label")) & _possible(num, den))
        .select(*_pair()).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    more = _linked(rest, documents, doc_id, text, classes, size, num, den)
    final = components(materialize(links.union(more)))

    grouped = classes.select("cls", "doc_id").join(final.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "doc_id", F.coalesce("label", "cls").alias("label"))
    named = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return profile.select("doc_id", "n", "cls"), materialize(grouped.join(named, "label").select("cls", "component_id", "label"))


def _pair() -> list[Column]:
    first = F.col("a.cls") < F.col("b.cls")
    return [F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b"),
            F.when(first, F.col("a.n")).otherwise(F.col("b.n")).alias("na"),
            F.when(first, F.col("b.n")).otherwise(F.col("a.n")).alias("nb")]


def _wordless(text: str) -> Column:
    return ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def join(documents: DataFrame, size: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: documents link when den * |x & y| >= num * |x | y|; a component
    is named by its smallest id."""
    rows, classes = _joined(documents, size, num, den, doc_id, text)
    there = rows.join(classes, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    name = F.col(doc_id).cast("long")
    return there.unionByName(documents.filter(_wordless(text)).select(
        name.alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), name.alias("component_id")))


def keep_one(documents: DataFrame, size: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each component: that with the smallest id. Of rows that share the id, or have none in
    a component without ids, the smallest by its columns stays. Rows without words all stay.

    Only ids are shuffled where each is on one row; rows that share an id are told apart on the side.
    """
    rows, classes = _joined(documents, size, num, den, doc_id, text)
    decided = rows.join(classes, "cls").select("doc_id", "component_id")
    per_id = decided.groupBy("doc_id").agg(
        (F.count(F.lit(1)) > 1).alias("repeated"),
        F.max(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), 0).otherwise(1)).alias("drops"))
    touched = materialize(per_id.withColumn("repeated", F.col("repeated") | F.col("doc_id").isNull())
                          .filter("repeated OR drops = 1"))
    packed = documents.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    single = packed.join(touched.select("doc_id"), same, "left_anti").select("row")
    wordless = packed.join(touched.select("doc_id"), same, "left_semi").filter(_wordless("text")).select("row")
    shared = packed.join(touched.filter("repeated").select("doc_id"), same, "left_semi").filter(~_wordless("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.to_json("row")), F.to_json("row"))
    first = (
        shared.withColumn("cls", _names(size)(F.col("text").cast("binary"))).join(classes, "cls")
        .filter(F.col("id").eqNullSafe(F.col("component_id"))).withColumn("rank", F.row_number().over(order))
        .filter("rank = 1").select("row"))
    return single.union(wordless).union(first).select("row.*")


def _names(size: int):
    @F.arrow_udf("binary")
    def named(texts: pa.Array) -> pa.Array:
        out: list[bytes | None] = [None] * len(texts)
        for first, rows, grams in sets(texts, size):
            starts, _ = _bounds(rows)
            for r, name in zip(rows[starts].tolist(), _column(_digests(grams, starts)).to_pylist() if len(starts) else ()):
                out[first + r] = name
        return pa.array(out, pa.binary())

    return named


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 90 * (s.n + t.n - shared)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reached JOIN both_ways ON a = other)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


@query("op3_ngram_jaccard_join", SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents").select("doc_id", "text"), 3, 90, 100)
