"""Merging, packing, windows, triggers and search against hand-made cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from groundwell.operators import context, evaluate, history, lexical, summary, vector
from groundwell.operators.skew import lag_within_key, order_buckets, top_n
from groundwell.streaming.streams import RecentWindow

HITS = ("query_id long, source string, id string, content string, score double, user_id string, knowledge_scope string, "
        "kind string, title string, source_ref string, metadata map<string,string>")


def hit(source, n, content, score, q=1):
    memory = source == "memory"
    return (q, source, f"{source}:{n}", content, score, "u" if memory else "", "" if memory else "s", "", "", "", None)


def test_duplicates_do_not_use_quota_and_memory_wins(spark):
    hits = spark.createDataFrame([
        hit("memory", 1, "Alpha", 0.9), hit("memory", 2, "beta", 0.8), hit("memory", 4, " ALPHA ", 0.85),
        hit("memory", 9, "late", 0.1), hit("document", 1, "one", 0.5), hit("document", 2, "alpha", 0.9),
        hit("document", 3, "two", 0.4), hit("document", 4, "three", 0.3)], HITS)
    limits = spark.createDataFrame([(1, 2, 2)], "query_id long, memory_limit int, document_limit int")
    got = context.merge(hits, limits).orderBy("source_order", "source_rank").collect()
    assert [r.id for r in got] == ["memory:1", "memory:2", "document:1", "document:3"]


def test_budget_skips_the_large_hit_and_goes_on(spark):
    hits = spark.createDataFrame([hit("memory", 1, "a", 0.9), hit("memory", 2, "x" * 500, 0.8),
                                  hit("memory", 3, "<b> & 'c'", 0.7)], HITS)
    limits = spark.createDataFrame([(1, 5, 5, 330)],
                                   "query_id long, memory_limit int, document_limit int, context_token_budget int")
    got = context.select_within_budget(context.merge(hits, limits), limits).first()
    assert got.kept_ids == ["memory:1", "memory:3"] and got.dropped_ids == ["memory:2"]
    assert "&lt;b&gt; &amp; &#39;c&#39;" in got.rendered and got.used_tokens == len(got.rendered) <= 330
    assert got.used_memory_items == 2


def messages(spark, rows):
    return spark.createDataFrame(rows, "id long, session_id string, user_id string, role string, content string, "
                                       "created_at timestamp")


def test_token_window_stops_at_the_first_overflow(spark):
    rows = [(i, "s", "u", "user", "x" * n, None) for i, n in ((1, 1), (2, 90), (3, 5), (4, 3))]
    df = messages(spark, rows).withColumn("created_at", F.timestamp_seconds("id"))
    lenient = history.token_window(df, 8, strict=False)
    assert sorted(r.id for r in lenient.collect()) == [3, 4]
    assert [r.id for r in history.token_window(df, 2, strict=False).collect()] == [4]
    assert history.token_window(df, 2).count() == 0 and history.token_window(df, 0).count() == 0
    assert history.token_window(df, 0, strict=False).count() == 4
    assert history.count_window(df, 0).count() == 0 and history.count_window(df, 2).count() == 2


@pytest.mark.parametrize("ids, mark, start, evicted, watermark, reason", [
    (range(19, 27), 20, 25, 4, 24, None), ((19, 20, 21, 23, 30), 20, 30, 2, 23, None), ((21, 22), 20, 0, 2, 22, None),
    ((21, 22), 20, 20, 0, 20, None), ((21, 22), 20, 40, 2, 22, "recent_start_not_found")])
def test_prefix_selection(spark, ids, mark, start, evicted, watermark, reason):
    df = messages(spark, [(i, "s", "u", "user", "x", None) for i in ids])
    asked = spark.createDataFrame([("s", "u", mark, start)],
                                  "session_id string, user_id string, last_message_id long, recent_start_id long")
    got = summary.select_prefix(df, asked).first()
    assert got.reject_reason == reason
    if reason is None:
        assert (got.evicted_messages, got.next_watermark) == (evicted, watermark)


@pytest.mark.parametrize("n, tokens, evicted, reason", [
    (10, 5000, 0, "no_evicted_messages"), (8, 1000, 2, "message_threshold"), (3, 3000, 1, "token_threshold"),
    (3, 1000, 1, "below_threshold"), (8, 3000, 1, "both_thresholds")])
def test_trigger(spark, n, tokens, evicted, reason):
    row = spark.createDataFrame([(n, tokens, evicted)],
                                "unsummarized_messages long, unsummarized_tokens long, evicted_messages long")
    assert summary.decide(row).first().trigger_reason == reason


def test_budget_equation(spark):
    row = spark.createDataFrame([(32768, 56, 2048), (100, 80, 30), (0, 0, 0)],
                                "context_limit int, fixed_input_tokens int, output_reserve int")
    got = history.budget_plan(row).collect()
    assert [(r.available_history_tokens, r.reject_reason) for r in got] == [
        (30664, None), (None, "over_context_limit"), (None, "context_limit_not_positive")]


def test_question_finds_its_policy(spark):
    chunks = spark.createDataFrame([
        ("a#0", "a", "其他", "a.md", "天气很好"), ("r#0", "refund", "退款政策", "r.md", "用户可以申请退款。处理流程包括步骤。")],
        "chunk_id string, document_id string, title string, source_ref string, text string")
    queries = spark.createDataFrame([(1, "退款需要什么步骤"), (2, "zzz")], "query_id long, question string")
    got = lexical.search(queries, chunks, 3, 0.1).collect()
    assert [(r.query_id, r.document_id, r.rank) for r in got] == [(1, "refund", 1)]
    said = {r.query_id: r for r in lexical.answers(queries, lexical.search(queries, chunks, 3, 0.1), 300).collect()}
    assert said[1].used_knowledge and said[2].answer.endswith("zzz") and said[2].retrieved_chunk_ids == []


def test_search_equals_scoring_every_pair(spark, monkeypatch):
    random.seed(5)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    texts = [(f"c{i:03}", f"d{i}", "", "", " ".join(random.choices(words, k=random.randint(1, 14)))) for i in range(300)]
    asked = [(i, " ".join(random.choices(words, k=random.randint(1, 20)))) for i in range(25)]
    chunks = spark.createDataFrame(texts, "chunk_id string, document_id string, title string, source_ref string, text string")
    queries = spark.createDataFrame(asked, "query_id long, question string")
    want = set()
    for q, question in asked:
        a = set(question.split())
        scored = []
        for c, _, _, _, text in texts:
            b = set(text.split())
            score = len(a & b) / (len(a) * len(b)) ** 0.5
            if score >= 0.1:
                scored.append((-score, c))
        want |= {(q, c, r) for r, (_, c) in enumerate(sorted(scored)[:4], 1)}
    for parts in ((7, 2), (1024, 32), ()):
        monkeypatch.setattr(lexical, "FLOOR_PARTS", parts)
        got = {(r.query_id, r.chunk_id, r["rank"]) for r in lexical.best_pairs(queries, chunks, 4, 0.1).collect()}
        assert got == want


def test_index_leaves_frequent_words_out(spark):
    """Of the chunks that share a word with a question, few are proposed, although every chunk and question holds the most
    frequent words."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [(f"c{i}", f"d{i}", "", "", " ".join(draw.choices(words, weights, k=30))) for i in range(3000)]
    asked = [(i, " ".join(texts[i * 50][4].split()[:20] + draw.choices(words, weights, k=6))) for i in range(40)]
    chunks = spark.createDataFrame(texts, "chunk_id string, document_id string, title string, source_ref string, text string")
    queries = spark.createDataFrame(asked, "query_id long, question string")
    sets, questions = lexical.chunk_token_sets(chunks).cache(), lexical.question_sets(queries).cache()
    ordered = lexical.rarest_first(questions, sets).cache()
    floors = lexical.score_floors(questions, ordered, sets, 3, 0.1)
    # Floors from a part are below the third best of all; here the part holds one chunk in 32.
    assert floors.filter("floor > 0.1").count() == 40
    proposed = lexical.proposed_pairs(ordered, sets, floors).count()
    shared = sum(bool(set(q.split()) & set(t[4].split())) for _, q in asked for t in texts)
    assert shared > 100_000 and proposed < shared / 4
    ranked = {(r.query_id, r["rank"]): r.chunk_id for r in lexical.best_pairs(queries, chunks, 3, 0.1).collect()}
    assert all(ranked[i, 1] == f"c{i * 50}" for i in range(40))


def test_foreign_hits_are_named(spark):
    hits = spark.createDataFrame([hit("memory", 1, "a", 0.9)], HITS)
    asked = spark.createDataFrame([(1, "other", "s")], "query_id long, user_id string, knowledge_scope string")
    assert vector.tenant_violations(hits, asked).count() == 1


def test_salted_top_n_and_bucketed_lag_equal_the_plain_windows(spark):
    random.seed(2)
    rows = [(0 if random.random() < 0.5 else random.randint(1, 5), i, random.randint(0, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    keyed = df.withColumn("n", F.col("k") + 1)
    got = {(r.k, r.i, r["rank"]) for r in top_n(keyed, ["k"], [F.desc("v"), F.asc("i")], F.col("n"), salts=4).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        best = sorted((-v, i) for kk, i, v in rows if kk == k)[: k + 1]
        want |= {(k, i, n) for n, (_, i) in enumerate(best, 1)}
    assert got == want
    lagged = lag_within_key(df.withColumn("b", order_buckets(df, "i", rows=13)), ["k"], "b", ["i"], F.col("v"), "p")
    previous, want = {}, set()
    for k, i, v in rows:
        want.add((i, previous.get(k)))
        previous[k] = v
    assert {(r.i, r.p) for r in lagged.collect()} == want


def test_evaluation_metrics(spark):
    schema = ("case_id string, query string, knowledge_scope string, expected_chunk_ids array<string>, "
              "forbidden_chunk_ids array<string>")
    cases = spark.createDataFrame([(f"c{i:02}", "q", "s", ["a"] if i else ["a", "b"], ["f"]) for i in range(10)], schema)
    hits = spark.createDataFrame([(f"c{i:02}", 1, "x" if i else "f", "s") for i in range(10)] +
                                 [(f"c{i:02}", 2, "a", "s") for i in range(10)],
                                 "case_id string, rank int, chunk_id string, knowledge_scope string")
    results = {r.case_id: r for r in evaluate.case_results(cases, hits).collect()}
    assert (results["c00"].recall_at_3, results["c00"].mrr_at_3, results["c00"].forbidden_hits) == (0.5, 0.5, ["f"])
    assert (results["c01"].recall_at_3, results["c01"].mrr_at_3) == (1.0, 0.5)
    failures = evaluate.hit_failures(cases, hits)
    report = evaluate.report(evaluate.case_results(cases, hits), failures).first()
    assert report.case_count == 10 and not report.passed and abs(report.mean_recall_at_3 - 0.95) < 1e-12
    bad = hits.withColumn("knowledge_scope", F.lit("other"))
    with pytest.raises(Exception, match="void"):
        evaluate.report(evaluate.case_results(cases, bad), evaluate.hit_failures(cases, bad)).collect()


def test_streamed_window_keeps_only_what_can_matter():
    window = RecentWindow(10, 50)._window([(5, 5, 4), (4, 4, 5), (3, 3, 9), (2, 2, 1)])
    assert window == ([(5, 5, 4), (4, 4, 5)], 9)


def test_floors_come_from_the_rarest_words(spark):
    """The third best score of a question is known before all chunks are searched, wherever these chunks lie."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [draw.choices(words, weights, k=30) for _ in range(2000)]
    asked = [(i, " ".join(texts[i * 50])) for i in range(40)]
    near = [texts[i * 50][:28 - j] + ["other"] for i in range(40) for j in range(2)]
    rows = [(f"c{i}", f"d{i}", "", "", " ".join(t)) for i, t in enumerate(texts + near)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, title string, source_ref string, text string")
    queries = spark.createDataFrame(asked, "query_id long, question string")
    best = {}
    for i, question in asked:
        q, found = set(question.split()), []
        for c, *_, text in rows:
            t = set(text.split())
            found.append((-len(q & t) / (len(q) * len(t)) ** 0.5, c))
        best[i] = sorted(found)[:3]
    sets, questions = lexical.chunk_token_sets(chunks).cache(), lexical.question_sets(queries).cache()
    ordered = lexical.rarest_first(questions, sets).cache()
    floors = {r.query_id: r.floor for r in lexical.score_floors(questions, ordered, sets, 3, 0.1).collect()}
    assert floors == {i: -b[2][0] for i, b in best.items()}
    got = {}
    for r in lexical.best_pairs(queries, chunks, 3, 0.1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    assert got == best


def test_chunks_that_share_an_id_are_scored_apart(spark):
    chunks = spark.createDataFrame([("c", "d", "", "", "a b c d"), ("c", "d", "", "", "a b"), ("e", "d", "", "", "a x y z")],
                                   "chunk_id string, document_id string, title string, source_ref string, text string")
    queries = spark.createDataFrame([(1, "a b c d")], "query_id long, question string")
    got = lexical.best_pairs(queries, chunks, 5, 0.1).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c", 1.0), ("c", 2 / 8 ** 0.5), ("e", 0.25)]
