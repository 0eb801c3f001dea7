"""Token ids in a binary format: canonical length-limited Huffman codes, decoded by table in independent blocks.

Texts are encoded with a public tokenizer, an end id is appended, and documents are written in ascending id order. Id counts
of the whole corpus give code lengths of at most ``LIMIT`` bits (package-merge); codes are canonical, so the file holds
lengths only. A dataset is a folder with two parts that Spark writes, commits and reads:

- ``lengths``: one row (id, bits) per id that occurs,
- ``blocks``: rows (part, block, doc_ids, tokens, bits, jumps). A block holds whole documents of about ``BLOCK`` ids: their
  names and token counts, the bit stream, and the bit length of every ``STEP`` ids as checkpoints, so that many runs are
  decoded side by side. A document longer than a block has one of its own,
- ``index``: rows (part, block, start): how many ids stand before each block.

Documents are dealt out by ranges of their ids before they are tokenised, once, and raw blocks are staged. Counting, coding
and numbering work on blocks, whose order no longer matters.

The tokenizer sees each distinct word of a stretch of text once. That is exact for this tokenizer, since it drops white
space and no pre-token crosses it; the tests compare with encoding whole texts.

Defined results: a null or empty text has the end id only; a null id comes first; rows that share an id are written in the
order of their texts; an empty table gives an empty dataset. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from groundwell.llm.common import query, table, whole_texts
from groundwell.operators.stages import stage_folder

LIMIT = 16
BLOCK = 1 << 17
STEP = 64
#: Documents in one range of the order, about, where the session has no more partitions.
RANGE = 50_000
END = 2
#: Texts whose distinct words are looked up together.
ROWS = 2048
#: Pieces of words that the tokenizer is given in one text, and that are kept for the next texts.
AT_ONCE, CACHED_PIECES = 1 << 15, 400_000

_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xc0, 0xd7), *range(0xd8, 0xf7), *range(0xf8, 0x100)]))
_SYMBOLS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<>")
#: Words that the tokenizer takes as letters, then symbols: two pre-tokens at most, each ending a word.
_PLAIN = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*[!-&(-/:;=?@\\[-`{}~]*$"


class Encoder:
    """Encodes batches of texts through a cache of pieces of words, which the tasks of one Python worker share."""

    opened: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end: int):
        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocabulary = self.tokenizer.get_vocab()
        self.stops = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.stops[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Pieces of plain words in lower case need no normalizing, and no splitting but at white space.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    @classmethod
    def of(cls, path: str, end: int) -> Encoder:
        if (path, end) not in cls.opened:
            cls.opened[path, end] = cls(path, end)
        return cls.opened[path, end]

    def _forget(self) -> None:
        """Piece 0 is empty, and piece 1, which no word is, stands for the end id."""
        self.known = pa.array(["", "\n"])
        self.flat = np.array([self.end], np.uint32)
        self.starts, self.sizes = np.zeros(2, np.int64), np.arange(2)

    def _ids(self, tokenizer: Tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: pa.Array, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *ids])

    def _learn(self, plain: pa.Array, odd: pa.Array) -> None:
        """Encode new pieces: plain ones in one go, as the ids of each end with an end-of-word id; odd ones one by one."""
        for i in range(0, len(plain), AT_ONCE):
            some = plain.slice(i, AT_ONCE)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")
            ids = self._ids(self.plain, whole.to_pylist())
            ends = np.flatnonzero(self.stops[ids[0]]) + 1
            if len(ends) != len(some):
                ids = self._ids(self.tokenizer, some.to_pylist())
                ends = np.cumsum([len(x) for x in ids])
            self._keep(some, ids, np.diff(ends, prepend=0))
        if len(odd):
            ids = self._ids(self.tokenizer, [w[1:].decode("utf-8", "replace") for w in odd.view(pa.binary()).to_pylist()])
            self._keep(odd, ids, np.array([len(x) for x in ids], np.int64))

    def _pieces(self, words: pa.Array) -> np.ndarray:
        """The two pieces of each word."""
        is_plain = pc.match_substring_regex(words, _PLAIN)
        plain, odd = words.filter(is_plain), words.filter(pc.invert(is_plain))
        told = pa.concat_arrays([
            pc.utf8_lower(pc.ascii_rtrim(plain, _SYMBOLS)), pc.utf8_ltrim(plain, _LETTERS),
            pc.binary_join_element_wise(pa.scalar("\0"), odd, pa.scalar(""))]).dictionary_encode()
        place = pc.fill_null(pc.index_in(told.dictionary, value_set=self.known), -1).to_numpy().copy()
        is_odd = pc.starts_with(told.dictionary, "\0").to_numpy(zero_copy_only=False)
        fresh = [np.flatnonzero((place < 0) & kind) for kind in (~is_odd, is_odd)]
        place[np.concatenate(fresh)] = len(self.known) + np.arange(sum(map(len, fresh)))
        self._learn(*[told.dictionary.take(pa.array(f)) for f in fresh])
        number = place[told.indices.to_numpy()]
        at, out, n = is_plain.to_numpy(zero_copy_only=False), np.zeros((len(words), 2), np.int64), len(plain)
        out[at, 0], out[at, 1], out[~at, 0] = number[:n], number[n:2 * n], number[2 * n:]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all binary texts, each closed by the end id, and their number per text."""
        if len(self.known) > CACHED_PIECES:
            self._forget()
        texts = pc.fill_null(texts, b"").view(pa.string())
        # A-Z in lower case is the same word, but not where it could make the name of a special token.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        told = split.flatten().dictionary_encode()
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        last = np.cumsum(2 * counts + 1) - 1
        pieces, is_word = np.ones(2 * len(told) + len(counts), np.int64), np.ones(2 * len(told) + len(counts), bool)
        is_word[last] = False
        pieces[is_word] = self._pieces(told.dictionary)[told.indices.to_numpy()].reshape(-1)
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[pieces] - ends + sizes, sizes) + np.arange(total)]
        return ids, np.diff(ends[last], prepend=0)


def raw_blocks(documents: DataFrame, path: str, doc_id: str, text: str, end: int) -> DataFrame:
    """``part, block, doc_ids, tokens, ids`` in ascending order of the ids of documents."""
    spark = documents.sparkSession
    kind = _width(path, end)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // RANGE))
    rows = whole_texts(documents).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, total = TaskContext.get().partitionId(), 0, [], 0
        encoder = Encoder.of(path, end)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(names), ROWS):
                ids, counts = encoder.encode(texts.slice(i, ROWS))
                ends = np.cumsum(counts)
                for name, own in zip(names[i:i + ROWS], np.split(ids.astype(kind), ends[:-1])):
                    held.append((name, own))
                    total += len(own)
                    if total >= BLOCK:
                        yield _block(part, block, held)
                        block, held, total = block + 1, [], 0
        if held:
            yield _block(part, block, held)

    return (rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
            .mapInArrow(run, "part int, block int, doc_ids array<bigint>, tokens array<bigint>, ids binary"))


def _width(path: str, end: int) -> str:
    """The narrowest type for ids in stages."""
    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def _block(part: int, block: int, held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([[n for n, _ in held]], pa.list_(pa.int64())),
        pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())),
        pa.array([np.concatenate([x for _, x in held]).tobytes()], pa.binary())],
        names=["part", "block", "doc_ids", "tokens", "ids"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge: the symbols in the cheapest 2n - 2 packages."""
    n = len(counts)
    if n <= 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    merged, levels = leaf, []
    for _ in range(limit - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
    # From the last level down: of the cheapest entries, leaves add a bit to their symbol, packages open two entries below.
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.uint32), bits[order].astype(np.uint8)
        self.widest = int(self.bits[-1]) if len(ids) else 1
        spans = np.uint64(1) << (np.uint64(self.widest) - self.bits.astype(np.uint64))
        self.first = np.cumsum(spans) - spans
        self.spans = spans
        self._made = None

    def __getstate__(self):
        return self.ids, self.bits

    def __setstate__(self, state):
        self.__init__(*state)

    def _tables(self):
        if self._made is None:
            size = int(self.ids.max()) + 1 if len(self.ids) else 1
            words, bits = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
            words[self.ids] = self.first >> (np.uint64(self.widest) - self.bits.astype(np.uint64))
            bits[self.ids] = self.bits
            table = np.zeros(1 << self.widest, np.uint32)
            widths = np.zeros(1 << self.widest, np.uint8)
            used = int(self.spans.sum())
            table[:used] = np.repeat(self.ids, self.spans.astype(np.int64))
            widths[:used] = np.repeat(self.bits, self.spans.astype(np.int64))
            self._made = words, bits, table, widths
        return self._made

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream of ids, and the bits of every ``STEP`` ids."""
        words, bits, _, _ = self._tables()
        width = bits[ids].astype(np.int64)
        ends = np.cumsum(width)
        starts = ends - width
        cell, shift = starts >> 6, (64 - (starts & 63) - width)
        code = words[ids]
        head = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        stream = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        edges = np.flatnonzero(np.diff(cell, prepend=-1))
        stream[cell[edges]] = np.bitwise_or.reduceat(head, edges)
        over = np.flatnonzero(shift < 0)
        stream[cell[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        marks = ends[np.minimum(np.arange(STEP, len(ids) + STEP, STEP), len(ids)) - 1]
        return stream.astype(">u8").tobytes()[:-(-int(ends[-1]) // 8)], np.diff(marks, prepend=0)

    def unpack(self, stream: bytes, jumps: np.ndarray, count: int) -> np.ndarray:
        """All runs between checkpoints step by step at once, by one table lookup per id."""
        _, _, table, widths = self._tables()
        data = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.cumsum(jumps) - jumps
        out = np.zeros((len(jumps), STEP), np.uint32)
        last = count - (len(jumps) - 1) * STEP
        down = np.uint32(32 - self.widest)
        for step in range(STEP):
            if step == last:
                at = at[:-1]
            if not len(at):
                break
            look = (window[at >> 3] << (at & 7).astype(np.uint32)) >> down
            out[:len(at), step] = table[look]
            at = at + widths[look]
        return out.reshape(-1)[:count]


def write(documents: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Write the dataset of ``documents`` to ``folder``."""
    spark, kind = documents.sparkSession, _width(path, end)
    stage = f"{folder}-raw"
    raw_blocks(documents, path, doc_id, text, end).write.option("compression", "zstd").parquet(stage)
    raw = spark.read.parquet(stage)

    counts = raw.select("ids").mapInArrow(_counter(kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    seen = counts.toPandas().sort_values("id")  # one row per id of the vocabulary at most
    bits = code_lengths(seen["n"].to_numpy(np.float64))
    (spark.createDataFrame(pd.DataFrame({"id": seen["id"].to_numpy(np.int64), "bits": bits}), "id bigint, bits bigint")
     .coalesce(1).write.parquet(f"{folder}/lengths"))

    size = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = raw.select("part", "block", size.alias("size"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(outer), F.lit(0)).alias("before"))
    (sizes.join(parts, "part")
     .select("part", "block", (F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("start"))
     .write.parquet(f"{folder}/index"))

    code = Code(seen["id"].to_numpy(np.int64), bits)
    (raw.mapInArrow(_packer(code, kind), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks"))


BLOCKS = "part int, block int, doc_ids array<bigint>, tokens array<bigint>, jumps array<int>, bits binary"


def _counter(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                found = np.bincount(np.frombuffer(ids, kind), minlength=len(total))
                found[:len(total)] += total
                total = found
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    return run


def _packer(code: Code, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ids in enumerate(batch.column(4).to_pylist()):
                bits, jumps = code.pack(np.frombuffer(ids, kind).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, 1) for c in range(4)], pa.array([jumps.tolist()], pa.list_(pa.int32())),
                     pa.array([bits], pa.binary())], names=["part", "block", "doc_ids", "tokens", "jumps", "bits"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document of a dataset; ``ids`` are 32-bit little-endian integers."""
    return _decoded(spark, folder, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, with the number of ids and their crc32 instead of the ids."""
    return _decoded(spark, folder, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _decoded(spark: SparkSession, folder: str, column: str, value, kind: pa.DataType) -> DataFrame:
    lengths = spark.read.parquet(f"{folder}/lengths").toPandas()
    code = Code(lengths["id"].to_numpy(np.int64), lengths["bits"].to_numpy(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, names, tokens, jumps, bits = (batch.column(c)[i] for c in range(6))
                tokens = np.array(tokens.values)
                ends = np.cumsum(tokens)
                ids = code.unpack(bits.as_py(), np.array(jumps.values, np.int64), int(ends[-1]))
                n = len(tokens)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, block.as_py(), np.int32)), names.values,
                    pa.array(ends - tokens), pa.array(tokens),
                    pa.array([value(ids[e - t:e]) for e, t in zip(ends.tolist(), tokens.tolist())], kind),
                ], names=["part", "block", "doc_id", "inner", "n_tokens", column.split()[0]])

    rows = spark.read.parquet(f"{folder}/blocks").mapInArrow(
        run, f"part int, block int, doc_id bigint, inner bigint, n_tokens bigint, {column}")
    return rows.join(spark.read.parquet(f"{folder}/index"), ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", column.split()[0])


def written(documents: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write a dataset to a new folder of the session's shared folder, and name it."""
    folder = f"{stage_folder(documents.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(documents, folder, path or public_tokenizers.path("word_bpe_49k.json"), doc_id, text)
    return folder


@query("op4_token_binary")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return read_digests(spark, written(table(spark, folder, "documents").select("doc_id", "text")))
