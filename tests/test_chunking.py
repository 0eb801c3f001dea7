"""Golden cases of line chunking and structured chunking, and brute-force checks of the folds."""

import random

import pytest
from pyspark.sql import functions as F

from groundwell.functions.tokens import CODE_POINTS, python_counter
from groundwell.operators import lines, structure
from groundwell.operators.splitting import DoesNotFit, Splitter
from groundwell.operators.structure import ChunkPolicy


def line_docs(spark, *rows):
    return spark.createDataFrame([(d, t, d + ".md", x, ["tag"]) for d, t, x in rows],
                                 "document_id string, title string, source_ref string, text string, tags array<string>")


def structured(spark, *texts, fmt="markdown"):
    return spark.createDataFrame([("scope", f"d{i}", "a/b.md", fmt, t) for i, t in enumerate(texts)],
                                 "knowledge_scope string, document_id string, source_ref string, format string, "
                                 "content string")


def chunks(spark, text, limit, overlap=0, counter=CODE_POINTS):
    rows = structure.structured_chunks(structured(spark, text), ChunkPolicy(limit, overlap), counter)
    return [(r.structure_kind, r.heading_path, r.text) for r in rows.orderBy("ordinal").collect()]


def test_blank_lines_are_skipped_and_numbering_starts_at_zero(spark):
    got = lines.line_chunks(line_docs(spark, ("guide", "使用说明", "第一段介绍。\n\n第二段讲步骤。\n第三段讲注意事项。")))
    assert [(r.chunk_id, r.text) for r in got.orderBy("chunk_index").collect()] == [
        ("guide#0", "第一段介绍。"), ("guide#1", "第二段讲步骤。"), ("guide#2", "第三段讲注意事项。")]


def test_heading_is_carried_into_the_title(spark):
    got = lines.line_chunks(line_docs(spark, ("r", "退款政策", "# 申请条件\n用户在购买后可以申请。\n:\n其余")))
    assert [r.title for r in got.orderBy("chunk_index").collect()] == ["退款政策 / 申请条件"] * 2


def test_heading_directly_followed_by_a_heading_has_no_effect(spark):
    got = lines.line_chunks(line_docs(spark, ("r", "T", "# A\n# B\nbody\n# C\n:\nrest")))
    assert [r.title for r in got.orderBy("chunk_index").collect()] == ["T / B", "T / B"]


def test_long_line_gives_overlapping_windows(spark):
    text = "".join(chr(ord("a") + i % 26) for i in range(260))
    got = [r.text for r in lines.line_chunks(line_docs(spark, ("x", "", text))).orderBy("chunk_index").collect()]
    assert got == [text[0:120], text[100:220], text[200:260]]


def test_document_of_headings_only_falls_back_to_its_text(spark):
    got = lines.line_chunks(line_docs(spark, ("x", "T", " # only \n"), ("empty", "T", " \n ")))
    assert [(r.document_id, r.title, r.text) for r in got.collect()] == [("x", "T", "# only")]
    assert lines.rejected_documents(line_docs(spark, ("empty", "T", " \n "))).first().reject_reason == "text_required"


def test_overlap_must_be_smaller_than_the_window():
    with pytest.raises(ValueError):
        lines.windows_of(F.col("x"), 20, 20)


def test_heading_stack_and_fence(spark):
    text = "# Course\n\nIntro.\n\n## Identity ##\n\nId.\n\n```go\n# no heading\n~~~\n```\nAfter.\n# Top\n\nEnd."
    assert chunks(spark, text, 200) == [
        ("paragraph", "Course", "Intro."), ("paragraph", "Course / Identity", "Id."),
        ("code", "Course / Identity", "```go\n# no heading\n~~~\n```"), ("paragraph", "Course / Identity", "After."),
        ("paragraph", "Top", "End.")]


def test_repeated_blocks_get_distinct_ids(spark):
    rows = structure.structured_chunks(structured(spark, "# Course\n\nSame.\n\nSame."), ChunkPolicy(8, 1)).collect()
    assert len(rows) == 2 and len({r.chunk_id for r in rows}) == 2
    assert sorted(r.duplicate_ordinal for r in rows) == [0, 1]


def test_oversized_fence_repeats_its_markers_and_one_line(spark):
    got = chunks(spark, "# Course\n\n```go\nline one\nline two\nline three\nline four\n```", 30, 1)
    assert [t for _, _, t in got] == ["```go\nline one\nline two\n```", "```go\nline two\nline three\n```",
                                      "```go\nline three\nline four\n```"]


def test_marker_characters_in_the_text_survive(spark):
    assert chunks(spark, "\x01 odd\n\x02x\n\n\x03 0", 50) == [("paragraph", "Document", "\x01 odd\n\x02x\n\n\x03 0")]


@pytest.mark.parametrize("text, reason", [
    ("# C\n\n```go\nfunc", "unclosed_fence"), ("# a//b\n\nx", "heading_path_empty_segment"), ("  \n", "content_required"),
    ("# only", "no_chunks"), ("~~~\nq\n~~~", "piece_over_limit")])
def test_refused_documents(spark, text, reason):
    got = structure.chunk_documents(structured(spark, text), ChunkPolicy(6)).first()
    assert got.reject_reason == reason and got.chunks is None


def test_source_code_needs_its_units(spark):
    policy = ChunkPolicy(12, 0)
    plain = structured(spark, "package a", fmt="go")
    assert structure.chunk_documents(plain, policy).first().reject_reason == "units_required"
    units = F.array(F.struct(F.lit("go_declaration").alias("kind"), F.lit("a").alias("path"),
                             F.lit("func a() {\n\tb()\n}").alias("text")))
    rows = structure.structured_chunks(plain.withColumn("units", units), policy).orderBy("ordinal").collect()
    assert [r.text for r in rows] == ["func a() {", "\tb()\n}"]


def test_opaque_counter_gives_the_same_chunks_as_the_closed_forms(spark):
    random.seed(3)
    words = ["ab", "c.", "退款。", "x!", "long" * 5, "\n", "\n\n", "# H\n", "```\ncode\n```\n"]
    texts = ["".join(random.choice(words) + random.choice([" ", "\n"]) for _ in range(60)) for _ in range(12)]
    docs = structured(spark, *texts)
    for limit in (14, 40):
        fast = structure.chunk_documents(docs, ChunkPolicy(limit, 1), CODE_POINTS)
        slow = structure.chunk_documents(docs, ChunkPolicy(limit, 1), python_counter(len))
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))


def test_counts_need_not_grow_with_the_text():
    table = {"a": 2, "ab": 1}
    assert Splitter(lambda t: table.get(t, len(t)), 1).pieces("ab") == ["ab"]
    rows = {"a": 1, "a\nb": 2, "a\nb\nc": 1}
    assert Splitter(lambda t: rows.get(t, len(t)), 1).code("a\nb\nc", False) == ["a\nb\nc"]


def test_overlap_alone_makes_no_piece():
    assert Splitter(len, 6, 1, True).code("a\nbbbb\ncccc", False) == ["a\nbbbb", "cccc"]
    with pytest.raises(DoesNotFit):
        Splitter(len, 8, 0, True).code("```\nx\n```", True)


def test_zero_count_of_a_text_is_an_error():
    with pytest.raises(ValueError):
        Splitter(lambda t: 0, 5).fits("x")


def blocks_by_loop(lines):
    """Fences one line after the other."""
    found, start = [], None
    for i, line in enumerate(lines):
        text = line.strip()
        char = text[:1]
        if not text.startswith(("```", "~~~")):
            continue
        run = len(text) - len(text.lstrip(char))
        if start is None:
            start = (i, char, run)
        elif run == len(text) and char == start[1] and run >= start[2]:
            found.append((start[0], i))
            start = None
    return found, start[0] if start else -1


def test_fences_match_a_loop_beyond_one_batch(spark):
    draw = random.Random(6)
    marks = ["```", "~~~", "````", "```go", "~~~~ ", "text", ""]
    for n in (0, 1, 3, 257, 3000):
        lines = draw.choices(marks, k=n)
        df = spark.createDataFrame([(lines,)], "lines array<string>")
        got = df.select(structure.fence_blocks(F.col("lines")).alias("f")).first().f
        assert ([tuple(b) for b in got.blocks], got.open) == blocks_by_loop(lines)


def test_repeats_are_numbered_in_order(spark):
    draw = random.Random(7)
    for n in (0, 1, 5, 2000):
        keys = [draw.choice("abcde") * draw.randint(1, 3) for _ in range(n)]
        df = spark.createDataFrame([(keys,)], "keys array<string>")
        got = df.select(structure.duplicate_ordinals(F.col("keys")).alias("n")).first().n
        assert list(got) == [keys[:i].count(k) for i, k in enumerate(keys)]


def test_twice_the_fences_or_repeats_take_twice_the_time(spark):
    def took(n):
        import time
        df = spark.createDataFrame([(["```"] * n, ["same", "other"] * (n // 2))], "lines array<string>, keys array<string>").cache()
        df.count()
        started = time.time()
        row = df.select(F.size(structure.fence_blocks(F.col("lines"))["blocks"]).alias("b"),
                        F.array_max(structure.duplicate_ordinals(F.col("keys"))).alias("m")).first()
        assert (row.b, row.m) == (n // 2, n // 2 - 1)
        return time.time() - started

    took(1000)
    assert took(200_000) < 6 * took(50_000) + 5


@pytest.mark.parametrize("kind", ["code", "declaration", "paragraph"])
def test_a_declared_longest_token_bounds_the_tries(kind):
    """A counter of tokens of 1 to 4 characters gives the same pieces with and without its bound, in few calls."""
    draw = random.Random(3)

    def count(text):
        calls.append(len(text))
        return len([t for part in text.split("\n") for t in range(0, len(part), 4)]) + text.count("\n")

    calls, per_char = [], []
    for size in (400, 1600):
        text = "\n".join("x" * draw.choice([0, 1, 3, 9, 25]) for _ in range(size // 8))
        text = "```\n" + text + "\n```" if kind == "code" else text
        plain = Splitter(count, 9, 1).unit(kind, text) if size == 400 else None
        calls.clear()
        bounded = Splitter(count, 9, 1, longest=4).unit(kind, text)
        assert plain is None or bounded == plain
        per_char.append(len(calls) / len(text))
        assert max(calls[1:]) <= 2 * 9 * 4 + 8
    assert per_char[1] < 1.5 * per_char[0] + 0.5
