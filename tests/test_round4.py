"""Findings of the third round that were settled after it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundwell.catalog import publishing
from groundwell.operators import memory
from groundwell.operators.stages import stage_folder
from groundwell.plans import ingest
from groundwell.sources.buckets import BucketTable
from groundwell.streaming import streams
from tests.test_memory import CANDIDATES, ITEMS, candidate


def test_the_memory_stream_calls_no_state_per_identity_and_resumes_a_batch(spark, monkeypatch):
    path = f"{stage_folder(spark)}/resumed-{uuid.uuid4().hex}"
    kept = streams.MemoryTables.of(spark, path, 4)
    kept.start(spark.createDataFrame([(7, "u", "goal", "k", "A", "active", 3)], ITEMS))
    said = [candidate(0, "upsert", "k", "B", 10), candidate(1, "forget", "none", "", 11), candidate(2, "upsert", "new", "C", 12)]
    spark.createDataFrame(said, CANDIDATES).coalesce(1).write.parquet(f"{path}/arriving")
    messages = spark.createDataFrame([(i, "user", "m") for i in (10, 11, 12)], "id long, role string, content string")

    def start():
        arriving = spark.readStream.schema(CANDIDATES).parquet(f"{path}/arriving")
        return streams.memory_stream(arriving, messages, kept, f"{path}/checkpoint")

    # The job dies between the items and the evidence of its batch.
    with monkeypatch.context() as broken:
        broken.setattr(streams, "new_evidence", lambda *a: 1 / 0)
        query = start()
        try:
            query.awaitTermination()
        except Exception as error:
            assert "ZeroDivisionError" in str(error)
    assert kept.items.last().writers["stream"] == 0 and kept.evidence.read().isEmpty()
    query = start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == []
    assert sorted((r.memory_key, r.value, r.version) for r in kept.items.read().collect()) == [("k", "B", 4), ("new", "C", 1)]
    assert sorted(r.source_message_id for r in kept.evidence.read().collect()) == [10, 12]


def test_only_hot_identities_are_cut_into_buckets(spark):
    said = [candidate(i, "forget" if i % 5 == 4 else "upsert", "hot" if i % 2 else f"k{i % 8}", f"v{i // 6}", 100 + i) for i in range(120)]
    events = spark.createDataFrame(said, CANDIDATES)
    items = spark.createDataFrame([(1, "u", "goal", "hot", "v0", "active", 3), (2, "u", "goal", "k2", "v9", "forgotten", 2)], ITEMS)
    plain = memory.resolve_batch(events, items)
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    split = memory.resolve_batch(events, items, rows=20)
    assert "Join" in split._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect())) and plain.count() == 120


def test_a_snapshot_is_chunked_once_and_only_where_it_is_read(spark, monkeypatch):
    calls, chunks = [], publishing.chunks
    monkeypatch.setattr(publishing, "chunks", lambda *a: calls.append(a) or chunks(*a))
    assert publishing.outcomes(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
    assert publishing.activated(spark, "/root/testdata/sf0.001")[0].count() > 0 and len(calls) == 1


def test_an_upsert_without_an_order_ranks_no_rows(spark, monkeypatch):
    plans, change = [], BucketTable._change

    def seen(self, rows, writer, batch, made, notes=None):
        return change(self, rows, writer, batch, lambda held: plans.append(made(held)) or plans[-1], notes)

    monkeypatch.setattr(BucketTable, "_change", seen)
    texts = [("1", "one", "a"), ("2", "two", "b"), ("2", "two again", "c"), ("3", " ", "d"), (None, "none", "e")]
    documents = spark.createDataFrame(texts, "document_id string, text string, source_ref string").withColumns(
        {"title": F.lit(""), "tags": F.array(F.lit("t"))})
    path = f"{stage_folder(spark)}/plain-{uuid.uuid4().hex}"
    store = ingest.chunk_table(spark, f"{path}/chunks", buckets=4)
    told = ingest.ingest_texts(documents, store, f"{path}/archive", "load", 0)
    assert "Window" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, ((r.document_id, r.chunk_count, r.reason) for r in told.collect()))) == sorted(map(str, [
        ("1", 1, None), ("2", 0, "document_repeated"), ("2", 0, "document_repeated"), ("3", 0, "text_required"), (None, 0, "document_id_required")]))
    assert [r.text for r in store.read().collect()] == ["one"]
