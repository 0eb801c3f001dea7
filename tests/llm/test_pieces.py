import hashlib
import random

import pytest
import sentencepiece

from groundwell.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ODD = [
    None, "", " ", "▁", " ▁ x▁y", "Hello  WORLD\n\tx", "\x00 null \x7f \x85", "日本語 テスト 😀😀 👨‍👩‍👧", "﻿bom ​zero é Å ﬁ",
    "<s> </s> <unk> <0x0A>", "a" * 20_000, " " * 5000, "ab" * 9000, "word, " * 20_000, "1234567890" * 300, "tab\ttab\r\nline",
]


def test_encoding_equals_the_library(spark, edges):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(100 + i, r.text, 2) for i, r in enumerate(edges.collect())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    found = pieces.encoded(df).select("row", "ids", pieces.piece_text(pieces.F.col("ids")).alias("decoded")).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = LIBRARY.encode(r.row.text or "")
        assert list(r.ids) == expected
        assert r.decoded == (LIBRARY.decode(expected) if expected else "")


def test_whole_documents_and_digests(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = pieces.op11(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def test_random_joins_of_pieces():
    coder, draw = pieces.load(pieces.MODEL), random.Random(5)
    known = list(coder.ids)
    for _ in range(4000):
        text = "".join(draw.choices(known, k=draw.randint(1, 12)))
        if draw.random() < 0.5:
            text = text.replace("▁", " ")
        assert list(coder.encode(text)) == LIBRARY.encode(text)


def test_words_need_not_be_cut():
    """The cuts are for speed only: whole texts, run through the backtracking at once, give the same pieces."""
    coder, draw = pieces.load(pieces.MODEL), random.Random(8)
    for _ in range(300):
        text = coder.processor.normalize("".join(draw.choices("ab é\nthe ing ▁", k=draw.randint(1, 200))))
        assert [i for p in coder.split(text) for i in coder.codes(p)] == list(coder.encode(text.replace("▁", " ")[1:]))


class Merges:
    """A model of few merges, in which the longest piece is often wrong."""

    def __init__(self, pieces_):
        self.pieces = pieces_

    def get_piece_size(self):
        return len(self.pieces)

    def id_to_piece(self, i):
        return self.pieces[i]

    def get_score(self, i):
        return -float(i)

    def is_control(self, i):
        return False

    is_unknown = is_byte = is_unused = is_control

    def unk_id(self):
        return 99


def test_backtracking_where_the_longest_piece_is_wrong():
    coder, draw = pieces.Pieces(Merges(["bc", "cd", "ab", "abc", "bcd", "abcd", "da", "dab", "cdab", "aa", "aaa"])), random.Random(1)
    undone = 0
    for _ in range(3000):
        text = "".join(draw.choices("abcde", k=draw.randint(0, 30)))
        expected = coder.merged(text)
        assert coder.split(text) == expected
        at = 0
        for piece in expected:
            undone += any(len(p) > len(piece) and text.startswith(p, at) for p in coder.ids)
            at += len(piece)
    assert undone > 100
    assert coder.codes("e") == [99]


def test_empty_table(spark, nothing):
    assert pieces.encoded(nothing).count() == 0


def test_unused_pieces_are_refused():
    model = Merges(["a"])
    model.is_unused = lambda i: True
    with pytest.raises(ValueError):
        pieces.Pieces(model)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "WORD_CHARS", 40)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    coder = pieces.Pieces(sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL))
    draw = random.Random(4)
    words = ["token", "Entität,", "x&&&", "internationalisation", "été", "\n", "a1", "日本"]
    for _ in range(40):
        text = " ".join(draw.choices(words, k=60))
        assert list(coder.encode(text)) == LIBRARY.encode(text)
