import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from groundwell.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "Hello, WORLD!! don't we'll it's 'S x'sy", "<|endoftext|> a<|startoftext|>b <|end of|>", "a1b22 c_d-e/f %%%",
    "Ünïcode ÉTÉ İstanbul ΣΑΣ straße Å é ≠ x́.", "nbsp x y\x1cz\x85w", "日本語 テスト 😀😀 👨‍👩‍👧", "\x00 null \x7f",
    "word " * 5000, "a" * 3000, "!?" * 700, "ab'c 'tis rock'n'roll '’s", "﻿bom ​zero",
]


def expected(rows):
    """(doc_id, start, ids) in order, by encoding whole texts."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((name, start, ids))
        start += len(ids)
    return out


def test_round_trip(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in documents.limit(120).collect()] + [(10_000 - 7 * i, t) for i, t in enumerate(ODD)] + [(None, "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(6)
    folder = tokens.written(df)
    got = sorted(((r.doc_id, r.start, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in tokens.read(spark, folder).collect()),
                 key=lambda r: r[1])
    assert got == expected(rows)
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in tokens.read_digests(spark, folder).collect()}
    assert digests == {(n, s): (len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for n, s, i in got}


def test_repeated_rows_and_empty_table(spark, edges, nothing):
    assert tokens.read(spark, tokens.written(nothing)).count() == 0
    got = tokens.read_digests(spark, tokens.written(edges)).collect()
    assert len(got) == edges.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_small_blocks(spark, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(300)]
    monkeypatch.setattr(tokens, "BLOCK", 64)
    got = tokens.read(spark, tokens.written(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert sorted((r.doc_id, r.start, list(np.frombuffer(r.ids, "<u4"))) for r in got) == [
        (n, s, i) for n, s, i in expected(rows)]


@pytest.mark.parametrize("counts", [[5], [3, 4], [1, 1, 1], [1] * 300, [2 ** i for i in range(40)], [1, 10 ** 9, 5, 5, 7]])
def test_code_lengths_are_limited_and_complete(counts):
    bits = tokens.code_lengths(np.array(counts, float), 10)
    assert bits.max() <= 10 and bits.min() >= 1
    if len(counts) > 1:
        assert sum(2.0 ** -b for b in bits) == 1
    order = np.argsort(counts, kind="stable")
    assert all(bits[a] >= bits[b] for a, b in zip(order, order[1:]))


def test_code_lengths_match_plain_huffman_where_the_limit_is_far():
    import heapq
    draw = random.Random(3)
    for _ in range(20):
        counts = [draw.randint(1, 500) for _ in range(draw.randint(2, 60))]
        heap, total = counts[:], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            total += pair
            heapq.heappush(heap, pair)
        assert int((tokens.code_lengths(np.array(counts, float), 40) * np.array(counts)).sum()) == total


def test_code_packs_any_ids():
    draw = np.random.default_rng(6)
    for size in (1, 2, 3, 64, 65, 5000):
        ids = draw.zipf(1.3, size) % 49_000
        seen, counts = np.unique(ids, return_counts=True)
        code = tokens.Code(seen, tokens.code_lengths(counts.astype(float)))
        bits, jumps = code.pack(ids.astype(np.int64))
        assert (code.unpack(bits, jumps, size) == ids).all()
        assert len(bits) == -(-int(jumps.sum()) // 8)


def test_batches_of_words_are_encoded_as_whole_texts(monkeypatch):
    """Words of every kind, whatever is kept from texts before, and each new one is told to the tokenizer once, with others."""
    draw = random.Random(2)
    parts = ["ab", "ABC", "é", "ÀÖØ", "ß", "ÿ", "'s", "'", "<|", "endoftext", "|>", "<", "1", "٣", "!?", "--", "[]\\^_`", "{|}~", "\x1c", "\x85",
             "\xa0", "　", "日本", "́", "\x00", "Σ", "İ", "\U0001f600", "�"]
    words = ["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(1500)]
    texts = [None, "", " ", "\n a \t"] + [draw.choice(" \n\t\x0b").join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(1200)]
    tokenizer = Tokenizer.from_file(PATH)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    monkeypatch.setattr(tokens, "CACHED_PIECES", 500)
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    encoder = tokens.Encoder(PATH, 2)
    for i in range(0, len(texts), 100):
        ids, counts = encoder.encode(pa.array([t and t.encode() for t in texts[i:i + 100]], pa.binary()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[i:i + 100]
    ids, counts = encoder.encode(pa.array([], pa.binary()))
    assert len(ids) == len(counts) == 0
    broken = b"ok \xff\xfe b\xe9d. \xc3"
    assert encoder.encode(pa.array([broken]))[0].tolist() == tokenizer.encode(
        broken.decode("utf-8", "replace"), add_special_tokens=False).ids + [2]
