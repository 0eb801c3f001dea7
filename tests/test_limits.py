"""Limits that belong to a request, repeated keys, foreign dimensions, order buckets and keyed stream state."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundwell.functions import identity as ids
from groundwell.functions.tokens import CODE_POINTS, python_counter
from groundwell.operators import history as past
from groundwell.operators import blocks, memory, points, summary, vector, versions
from groundwell.operators.skew import lag_within_key, order_buckets
from groundwell.operators.splitting import Splitter
from groundwell.operators.structure import ChunkPolicy, structured_chunks
from groundwell.plans import chat, publish
from groundwell.sources import tables
from groundwell.streaming.streams import SummaryTrigger


def history(spark, n):
    return spark.range(1, n + 1).select(
        "id", F.lit("s").alias("session_id"), F.lit("u").alias("user_id"), F.lit("user").alias("role"),
        F.lit("x").alias("content"), F.timestamp_seconds("id").alias("created_at"))


@pytest.mark.parametrize("limit,mode,expected", [
    (49, "count", 49), (50, "count", 50), (70, "count", 70), (0, "count", 0), (70, "manual", 70), (0, "manual", 50), (200, "count", 80)])
def test_a_history_is_as_long_as_its_request_says(spark, limit, mode, expected):
    asked = spark.createDataFrame([(1, "s", "u", mode, 10 ** 6, limit)],
                                  "request_id long, session_id string, user_id string, history_mode string, history_budget long, recent_limit int")
    window = chat._windows(asked, history(spark, 80), CODE_POINTS, 50)
    assert sorted(r.id for r in window.collect()) == list(range(81 - expected, 81))


def test_two_updates_of_one_session_are_refused(spark):
    asked = spark.createDataFrame([("s", "u", "m", 75, 100), ("s", "u", "m", 60, 100), ("t", "u", "m", 0, 100)],
                                  "session_id string, user_id string, model string, recent_start_id long, max_output_tokens long")
    stored = spark.createDataFrame([], "session_id string, user_id string, content string, last_message_id long, version long")
    rows = summary.update_all(history(spark, 80), asked, stored, summary.TriggerPolicy(1, 1)).collect()
    assert sorted((r.session_id, r.reject_reason, r.updated) for r in rows) == [
        ("s", "session_repeated", False), ("s", "session_repeated", False), ("t", None, False)]


def test_upsert_without_an_order_refuses_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, points.upsert(stored, fresh, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="written twice"):
        points.upsert(stored, fresh.union(fresh), "id").collect()


def test_a_point_of_another_dimension_is_reported_and_not_met(spark):
    asked = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "other", [1.0])], "query_id long, knowledge_scope string, query_vector array<double>")
    stored = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [1.0, 0.0, 0.0]), ("c", "other", [1.0])],
                                   "point_id string, knowledge_scope string, vector array<double>")
    assert sorted((r.query_id, r.point_id) for r in vector.search_documents(asked, stored, 5).collect()) == [(1, "a"), (2, "c")]
    assert [tuple(r) for r in vector.foreign_dimensions(asked, stored, "knowledge_scope").collect()] == [(1, 1)]


DOCUMENT = ("point_id string, knowledge_scope string, document_id string, chunk_id string, title string, source_ref string, text string, "
            "content_hash string, embedding_model string, vector array<double>")
MEMORY = "point_id long, user_id string, kind string, memory_key string, value string, version long, vector array<double>"


@pytest.mark.parametrize("change,message", [
    ({}, None), ({"point_id": "'x'"}, "point_id_mismatch"), ({"text": "'other'"}, "content_hash_mismatch"),
    ({"document_id": "' '"}, "document_id_required"), ({"kind": "'nonsense'"}, "kind"), ({"version": "0L"}, "version_not_positive")])
def test_a_tampered_point_fails_its_requests_alone(spark, change, message):
    text = F.lit("some text")
    documents = spark.createDataFrame([("", "t", "d", "c1", "", "", "", "", "m", [1.0, 0.0])], DOCUMENT).withColumns(
        {"text": text, "content_hash": ids.trimmed_hash(text), "point_id": ids.point_id(F.col("knowledge_scope"), F.col("chunk_id"))})
    good = documents.withColumns({"knowledge_scope": F.lit("fine"), "point_id": ids.point_id(F.lit("fine"), F.col("chunk_id"))})
    memories = spark.createDataFrame([(7, "u", "goal", "k", "v", 1, [0.0, 1.0])], MEMORY)
    documents = documents.withColumns({k: F.expr(v) for k, v in change.items() if k in documents.columns})
    changed = memories.withColumns({k: F.expr(v) for k, v in change.items() if k in memories.columns and k not in documents.columns})
    asked = spark.createDataFrame(
        [(1, "q", " u ", "t", True, True, 2, 2, [1.0, 1.0]), (2, "q", "w", "fine", True, True, 2, 2, [1.0, 1.0]),
         (3, "q", "w", "t", True, False, 2, 2, [1.0, 1.0]), (4, "", "u", "t", True, True, 2, 2, [1.0, 1.0])],
        "query_id long, query string, user_id string, knowledge_scope string, use_memory boolean, "
        "use_documents boolean, memory_limit int, document_limit int, query_vector array<double>")
    others = memories.withColumns({"user_id": F.lit("w"), "point_id": F.lit(9).cast("long")})
    found = vector.dual_results(asked, changed.unionByName(others), documents.unionByName(good))
    answered = [(2, "document"), (2, "memory"), (3, "memory")]
    refused = {r.query_id: r.reject_reason for r in found.refused.collect()}
    if message is None:
        answered = [(1, "document"), (1, "memory"), *answered]
        assert refused == {}
    else:
        assert refused.keys() == {1} and message in refused[1]
    assert sorted((r.query_id, r.source) for r in found.hits.collect()) == answered


def clustered(spark, tenants, seed=3, dim=16):
    """Points around a few directions; the first tenant holds most of them."""
    import numpy as np
    draw = np.random.default_rng(seed)
    rows, name = [], 0
    for tenant, count in enumerate(tenants):
        around = draw.normal(size=(8, dim))
        for i in range(count):
            rows.append((name, f"t{tenant}", (around[i % 8] + 0.15 * draw.normal(size=dim)).tolist()))
            name += 1
    rows += [(name, "t0", None), (name + 1, "t0", [0.0] * dim), (name + 2, "t0", [1.0] * 3), (name + 3, "t0", [float("nan")] * dim)]
    rows += [(name + 4 + i, "t0", rows[0][2]) for i in range(40)]
    return spark.createDataFrame(rows, "point_id long, tenant string, vector array<double>")


def test_pruned_search_equals_plain_search_and_forms_fewer_pairs(spark):
    stored = clustered(spark, (1500, 60, 3)).repartition(4).cache()
    asked = stored.filter("point_id % 25 = 0").select(F.col("point_id").alias("query_id"), "tenant", F.col("vector").alias("query_vector"),
                                                      (F.col("point_id") % 3 + 1).alias("wanted"))
    index = blocks.block_index(stored, "tenant", 50)
    for limit in (4, F.col("wanted")):
        plain = {(r.query_id, r.point_id, r.score, r["rank"]) for r in vector.nearest(asked, stored, "tenant", limit).collect()}
        assert plain == {(r.query_id, r.point_id, r.score, r["rank"]) for r in vector.nearest(asked, index, "tenant", limit).collect()}
    odd = F.col("point_id") % 2 == F.col("query_id") % 2
    plain = {(r.query_id, r.point_id, r["rank"]) for r in vector.nearest(asked, stored, "tenant", 5, odd).collect()}
    assert plain == {(r.query_id, r.point_id, r["rank"]) for r in vector.nearest(asked, index, "tenant", 5, odd).collect()}
    questions = blocks.usable(asked, "query_vector")
    first, rest = blocks.search_rounds(questions, index, 4)
    found = vector.nearest(asked, stored, "tenant", 4).filter("rank = 4").select("query_id", F.col("score").alias("_floor"))
    formed = blocks.block_pairs(first, index).count() + blocks.block_pairs(blocks.with_floors(rest, found), index).count()
    every = questions.join(index.points.drop("query_vector"), ["tenant", "_dim"]).count()
    assert every > 80_000 and formed < every / 3
    # The hot tenant is spread over many blocks.
    sizes = index.points.filter("tenant = 't0'").groupBy("_block").count().agg(F.count("count"), F.max("count"), F.sum("count")).first()
    assert sizes[0] > 20 and sizes[1] < sizes[2] / 5


def test_approximate_search_makes_few_candidates(spark):
    stored = clustered(spark, (1500, 60, 3)).repartition(4).cache()
    asked = stored.filter("point_id % 25 = 0").select(F.col("point_id").alias("query_id"), "tenant", F.col("vector").alias("query_vector"))
    exact = {(r.query_id, r.point_id): r.score for r in vector.nearest(asked, stored, "tenant", 5).collect()}
    index = blocks.block_index(stored, "tenant", 100)
    near = {(r.query_id, r.point_id): r.score for r in vector.prefiltered(asked, index, "tenant", 5).collect()}
    assert len(exact.keys() & near.keys()) >= 0.95 * len(exact)
    assert all(exact[pair] == near[pair] for pair in exact.keys() & near.keys())
    rows = blocks.approximate_candidates(blocks.usable(asked, "query_vector"), index, candidates=20)
    assert rows.count() == rows.distinct().count() <= 20 * asked.count()


def test_scopes_without_a_live_version_need_reconciliation(spark):
    sources = spark.createDataFrame([(1, "a", None), (2, "b", 12), (3, "c", None)], "id long, knowledge_scope string, active_version_id long")
    state = spark.createDataFrame([(11, 1, "new", "ready"), (12, 2, "old", "active"), (13, 3, "new", "failed")],
                                  "id long, document_source_id long, target_collection string, status string")
    aliases = spark.createDataFrame([("live", "new")], "alias string, collection string")
    found = versions.needs_reconciliation(aliases, sources, state, F.lit("live")).collect()
    assert sorted(map(tuple, found)) == [("a", None, "new"), ("b", "old", "new")]


def test_an_alias_asked_for_two_targets_moves_nowhere(spark):
    outcomes = spark.createDataFrame([("x", "p", "activated"), ("x", "q", "activated"), ("y", "p", "activated"), ("z", "q", "stale")],
                                     "alias string, collection string, outcome string")
    aliases = spark.createDataFrame([("x", "o"), ("y", "o")], "alias string, collection string")
    assert sorted(map(tuple, versions.switched_aliases(aliases, outcomes).collect())) == [("x", "o"), ("y", "p")]
    assert [tuple(r) for r in versions.switch_conflicts(outcomes).collect()] == [("x", ["p", "q"])]


def test_a_digest_depends_on_rows_and_not_on_their_order(spark):
    rows = [("s", "c", i, f"{i:064d}", "h" * 64, f"{i * 7919 % 997:05x}", 5) for i in range(300)]
    schema = "knowledge_scope string, collection string, ordinal long, chunk_id string, content_hash string, point_id string, token_count long"
    one = versions.manifest_digests(spark.createDataFrame(rows, schema)).collect()
    assert one == versions.manifest_digests(spark.createDataFrame(rows[::-1], schema).repartition(5)).collect()
    assert one[0].chunk_count == 300
    assert one != versions.manifest_digests(spark.createDataFrame(rows[:-1], schema)).collect()


@pytest.mark.parametrize("kind", ["sparse", "ties"])
def test_order_buckets_are_bounded_and_keep_the_order(spark, kind):
    draw = random.Random(2)
    first = [draw.getrandbits(62) if kind == "sparse" else draw.choice([5, 5, 5, draw.randrange(100)]) for _ in range(4000)]
    df = spark.createDataFrame(list(zip(["k"] * 4000, first, draw.sample(range(10 ** 6), 4000))), "k string, a long, p long")
    df = df.withColumn("b", order_buckets(df, "a", "p", rows=100))
    rows = sorted((r.a, r.p, r.b) for r in df.collect())
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    sizes = pd.Series([r[2] for r in rows]).value_counts()
    assert sizes.max() <= 300 and len(sizes) >= 15
    lagged = {(r.a, r.p): r.previous for r in lag_within_key(df, ["k"], "b", ["a", "p"], F.col("p"), "previous").collect()}
    assert all(lagged[y[:2]] == x[1] for x, y in zip(rows, rows[1:]))


class _State:
    """The two kinds of state that the trigger keeps."""

    def __init__(self):
        self.values, self.one = {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return _Value()

    def iterator(self):
        return iter(list(self.values.items()))

    def removeKey(self, key):
        del self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def batch(*rows):
    return pd.DataFrame(rows, columns=["id", "tokens", "saved"])


def test_trigger_counts_do_not_depend_on_batches_and_restart_behind_a_summary():
    trigger = SummaryTrigger(2)
    trigger.init(_State())

    def fed(*batches):
        return next(trigger.handleInputRows(("s", "u"), iter(batches), None)).iloc[0].tolist()[2:]

    # Arrow batches in any order, with a repeat.
    assert fed(batch((5, 10, False), (6, 10, False)), batch((1, 10, False), (2, 10, False)), batch((3, 10, False), (4, 10, False), (3, 10, False))) == [6, 60, 4, 0]
    assert fed(batch((2, 10, False), (7, 1, False))) == [7, 61, 5, 0]
    assert fed(batch((4, 0, True))) == [3, 21, 1, 0]
    assert fed(batch((3, 10, False), (8, 1, False))) == [4, 22, 2, 1]


def naive(text, limit, overlap, fenced):
    """Code pieces by trying every length."""
    splitter = Splitter(len, limit, overlap, additive=False)
    return splitter.code(text, fenced)


def test_line_pieces_by_search_match_every_length_tried():
    draw = random.Random(9)
    for _ in range(300):
        rows = ["x" * draw.choice([0, 1, 3, 5, 9, 20]) for _ in range(draw.randint(3, 14))]
        fenced = draw.random() < 0.4
        limit, overlap = draw.randint(44 if fenced else 3, 50 if fenced else 14), draw.randint(0, 3)
        assert Splitter(len, limit, overlap, additive=True).code("\n".join(rows), fenced) == naive("\n".join(rows), limit, overlap, fenced)


@pytest.mark.parametrize("wrong", [False, True])
def test_a_golden_set_guards_publication(spark, wrong):
    texts = [f"alpha{i} beta{i * 3} gamma{i * 7} delta{i}" for i in range(10)]
    documents = spark.createDataFrame([("scope", "doc", "doc.md", "markdown", "\n\n".join(texts), "t")],
                                      "knowledge_scope string, document_id string, source_ref string, format string, content string, title string")
    policy = ChunkPolicy(40)
    chunks = {r.text: r.chunk_id for r in structured_chunks(documents, policy).collect()}
    assert len(chunks) == 10
    cases = [(f"c{i}", t, "scope", [chunks[texts[(i + wrong) % 10 if i == 4 else i]]], ["none"], "") for i, t in enumerate(texts)]
    if wrong:
        cases[4] = (*cases[4][:3], ["missing"], *cases[4][4:])
    nothing = {n: spark.createDataFrame([], tables.SCHEMAS[n]) for n in ("document_sources", "document_versions", "document_chunk_manifests")}
    done = publish.build_and_publish(
        documents, policy, "ctx_documents_b", "live", "ctx_documents_a", nothing["document_sources"], nothing["document_versions"],
        nothing["document_chunk_manifests"], spark.createDataFrame([("live", "ctx_documents_a")], "alias string, collection string"),
        64, F.lit("2024-01-01 00:00:00").cast("timestamp"), spark.createDataFrame(cases, tables.GOLDEN_CASES))
    assert [r.outcome for r in done.outcomes.collect()] == ["golden_set_failed" if wrong else "activated"]
    assert [r.collection for r in done.aliases.collect()] == ["ctx_documents_a" if wrong else "ctx_documents_b"]


def test_refused_extractions_come_back_with_their_reason(spark):
    def reply(kind, cited):
        return ('{"candidates": [{"operation": "upsert", "kind": "%s", "key": "k", "value": "v", "confidence": 0.5, '
                '"source_message_ids": [%d]}]}' % (kind, cited))

    replies = {"good": reply("goal", 1), "cites": reply("goal", 99), "kind": reply("nonsense", 3), "text": "no json"}
    rows = [(i + 1, s, "u", "user", f"I am {s}", "") for i, s in enumerate(replies)]
    messages = spark.createDataFrame(rows, "id long, session_id string, user_id string, role string, content string, summary string")

    def generate(prompt):
        out = F.lit(None).cast("string")
        for name, text in replies.items():
            out = F.when(F.contains(prompt, F.lit(f"I am {name}")), text).otherwise(out)
        return out

    found = memory.extract(messages, generate)
    assert [r.session_id for r in found.candidates.collect()] == ["good"]
    refused = {r.session_id: r.reject_reason for r in found.refused.collect()}
    assert refused.keys() == {"cites", "kind", "text"} and refused["cites"] == "source_unknown" and refused["text"] == "not_one_json_object"


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_prefilter_finds_most_of_the_exact_top(spark, size):
    from groundwell.catalog import QUERIES
    folder = f"/root/testdata/{size}"
    questions = {r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    exact = {(r.query_id, r.point_id): r.score for r in QUERIES["j07_document_questions"](spark, folder).collect()}
    near = {(r.query_id, r.point_id): r.score for r in QUERIES["j12_prefiltered_vectors"](spark, folder).collect()}
    assert {q for q, _ in exact} == {q for q, _ in near} == questions
    assert len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(exact[pair] == near[pair] for pair in exact.keys() & near.keys())
    asked = {r.query_id for r in QUERIES["j08_memory_questions"](spark, folder).select("query_id").distinct().collect()}
    assert {f"{q}/all" for q in questions} <= asked


def four_characters(text):
    """Tokens of leading white space and up to four characters, so a joined text may count fewer than its parts."""
    import re
    return len(re.findall(r"\s*\S{1,4}|\s+$", text))


def test_transcripts_with_a_counter_that_merges(spark):
    """Slices and seams give the count of the whole text."""
    draw = random.Random(12)
    rows = []
    for i in range(400):
        session = "long" if i % 2 else draw.choice(["a", "b", "c"])
        text = draw.choice(["", "word " * draw.randint(1, 9), "x" * draw.randint(1, 30), "tail\n\n", " ", "é ü "])
        rows.append((i + 1, session, "u", draw.choice(["user", "assistant"]), text))
    rows += [(1000 + i, "joined", "u", "", "") for i in range(30)]
    messages = spark.createDataFrame(rows, "id long, session_id string, user_id string, role string, content string")
    messages = messages.filter("content <> ''").unionByName(messages.filter("content = ''").withColumn("content", F.lit("y")))
    counter = python_counter(four_characters, cut=r"(?<=\S)(?=\s)")
    texts, contents = {}, {}
    for r in messages.orderBy("id").collect():
        texts[r.session_id] = texts.get(r.session_id, "") + f"{r.role}: {r.content}\n"
        contents[r.session_id] = contents.get(r.session_id, 0) + four_characters(r.content)
    for size in (7, 10 ** 6):
        got = {r.session_id: (r.content_tokens, r.transcript_tokens) for r in past.transcript_totals(messages, counter, size).collect()}
        assert got == {s: (contents[s], four_characters(t)) for s, t in texts.items()}
    with pytest.raises(ValueError):
        past.transcript_totals(messages, python_counter(four_characters))


def chatter(spark, sizes):
    rows = [(n * 100_000 + i + 1, f"s{n}", "u", "user" if i % 2 == 0 else "assistant", f"message {i} of {n}", i) for n, size in enumerate(sizes) for i in range(size)]
    return spark.createDataFrame(rows, "id long, session_id string, user_id string, role string, content string, at long").withColumn(
        "created_at", F.timestamp_seconds("at")).drop("at")


def test_long_sessions_are_summarised_within_the_input_budget(spark):
    messages = chatter(spark, [5000, 40, 6])
    stored = spark.createDataFrame([], "session_id string, user_id string, content string, last_message_id long, version long")
    asked = messages.groupBy("session_id", "user_id").agg((F.max("id") - 1).alias("recent_start_id")).withColumns(
        {"model": F.lit("m"), "max_output_tokens": F.lit(100).cast("long")})
    budget, frame = 2000, len("<previous_summary>\n\n</previous_summary>\n<new_messages>\n</new_messages>") + 60

    def generate(prompt):
        checked = F.when(F.length(prompt) > budget + frame, F.raise_error(F.lit("prompt above its budget")).cast("string"))
        return F.coalesce(checked, F.substring(summary.first_and_last(prompt), 1, 300))

    policy = summary.TriggerPolicy(1, 1)
    done = {r.session_id: r for r in summary.update_all(messages, asked, stored, policy, generate, input_budget=budget).collect()}
    plain = {r.session_id: r for r in summary.update_all(messages, asked, stored, policy).collect()}
    assert all(done[s].updated and done[s].watermark == plain[s].watermark for s in plain)
    assert (done["s2"].content, done["s1"].content) == (plain["s2"].content, plain["s1"].content)
    assert "message 0 of 0" in done["s0"].content and len(done["s0"].content) <= 300
    with pytest.raises(Exception, match="above its budget"):
        summary.update_all(messages, asked, stored, policy, generate).collect()
    # A single line that cannot fit, and a generator that does not shorten, refuse their sessions alone.
    wide = messages.withColumn("content", F.when(F.col("id") == 3, F.repeat(F.lit("x"), F.lit(1500))).otherwise(F.col("content")))
    refused = {r.session_id: (r.reject_reason, r.updated) for r in summary.update_all(wide, asked, stored, policy, generate, input_budget=budget).collect()}
    assert refused["s0"] == ("message_over_input_budget", False) and refused["s1"] == (None, True)
    echo = summary.update_all(messages.filter("session_id <> 's0'"), asked.filter("session_id <> 's0'"), stored, policy,
                              lambda p: F.repeat(F.lit("z"), F.lit(1000)), input_budget=1000)
    assert {r.session_id: r.reject_reason for r in echo.collect()} == {"s1": "message_over_input_budget", "s2": None}
