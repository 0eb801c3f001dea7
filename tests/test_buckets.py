"""Bucketed tables against a plain dict, and what a batch reads and writes."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from groundwell.operators.stages import stage_folder
from groundwell.sources.buckets import BucketTable
from groundwell.sources.files import list_names

SCHEMA = "user string, name long, value string"


def fresh(spark, buckets=8):
    return BucketTable(spark, f"{stage_folder(spark)}/bucketed-{uuid.uuid4().hex}", SCHEMA, ["user", "name"], buckets)


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def content(table):
    return {(r.user, r.name): r.value for r in table.read().collect()}


def test_random_batches_match_a_dict(spark):
    table, expected, draw = fresh(spark), {}, random.Random(2)
    for batch in range(5):
        wanted = {(draw.choice(["a", "b", None]), draw.choice([*range(12), None])): f"{batch}-{i}" for i in range(9)}
        table.upsert(rows(spark, [(*k, v) for k, v in wanted.items()]), "w", batch)
        expected |= wanted
        gone = draw.sample(sorted(expected, key=str), 3)
        table.delete(rows(spark, [(*k, None) for k in gone]), "d", batch)
        for k in gone:
            del expected[k]
        assert content(table) == expected
        assert table.read().count() == len(expected)
    kept = content(table)
    table.insert(rows(spark, [(*k, "other") for k in kept if None not in k] + [("new", 1, "x"), ("new", 1, "x")]), "i", 0)
    assert content(table) == {**kept, ("new", 1): "x"}


def test_one_row_touches_one_bucket(spark):
    table = fresh(spark, 16)
    table.upsert(rows(spark, [("u", i, "old") for i in range(200)]), "w", 1)
    before = table.last()
    written = table.upsert(rows(spark, [("u", 7, "new")]), "w", 2)
    after = table.last()
    assert len(written) == 1
    assert [b for b in before.buckets if before.buckets[b] != after.buckets[b]] == written
    folder = after.buckets[written[0]]
    assert [n for n in list_names(spark, f"{table.path}/data/{folder}") if n.startswith("_bucket")] == [f"_bucket={written[0]}"]
    held, _ = table.touched(rows(spark, [("u", 7, "")]))
    assert 0 < held.count() < 40 and all(f"_bucket={written[0]}" in f for f in held.inputFiles())


def test_a_repeated_batch_changes_nothing(spark):
    table = fresh(spark)
    table.upsert(rows(spark, [("u", 1, "a")]), "w", 4, notes={"last": 9})
    seen = table.last()
    assert table.upsert(rows(spark, [("u", 1, "b")]), "w", 4) == [] and table.upsert(rows(spark, [("u", 1, "c")]), "w", 3) == []
    assert table.last() == seen and content(table) == {("u", 1): "a"} and seen.notes == {"last": 9}
    again = BucketTable(spark, table.path, SCHEMA, ["user", "name"], 99)
    assert again.buckets == table.buckets and content(again) == {("u", 1): "a"}
    with pytest.raises(ValueError):
        BucketTable(spark, table.path, SCHEMA, ["name"])


def test_order_and_repeated_keys(spark):
    table = fresh(spark)
    twice = rows(spark, [("u", 1, "b"), ("u", 1, "a")])
    with pytest.raises(Exception, match="written twice"):
        table.upsert(twice, "w", 0)
    assert table.last().number == 0 and content(table) == {}
    table.upsert(twice, "w", 0, F.col("value"))
    assert content(table) == {("u", 1): "b"}


def test_a_job_that_dies_and_a_second_writer(spark, monkeypatch):
    table = fresh(spark)
    table.upsert(rows(spark, [("u", 1, "a")]), "w", 0)
    broken = rows(spark, [("u", 2, "b")]).withColumn("value", F.when(F.col("name") > 0, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, "w", 1)
    assert content(table) == {("u", 1): "a"}
    behind = table.last()
    table.upsert(rows(spark, [("u", 3, "c")]), "w", 1)
    monkeypatch.setattr(table, "last", lambda: behind)
    with pytest.raises(RuntimeError, match="another writer"):
        table.upsert(rows(spark, [("u", 4, "d")]), "x", 0)
    monkeypatch.undo()
    assert content(table) == {("u", 1): "a", ("u", 3): "c"}


def test_vacuum_keeps_what_is_read(spark):
    table = fresh(spark, 2)
    for batch in range(5):
        table.upsert(rows(spark, [("u", batch, "x"), ("u", 100, str(batch))]), "w", batch)
    table.vacuum(2)
    assert len(list_names(spark, f"{table.path}/commits")) == 2 and len(content(table)) == 6
    used = {json.dumps(v) for v in table.last().buckets.values()}
    assert len(list_names(spark, f"{table.path}/data")) <= len(used) + 2


def test_ingest_tells_what_became_of_each_document(spark):
    from groundwell.plans import ingest
    from groundwell.sources.files import list_names as names

    path = f"{stage_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = spark.createDataFrame(
        [("a", "T", "a.md", "one\ntwo", ["x"]), ("b", "", "b.md", " \n", []), ("c", None, "c.md", "# H\nbody", []),
         ("d", "", "d.md", "first", []), ("d", "", "d.md", "second", []), (None, "", "", "text", [])],
        "document_id string, title string, source_ref string, text string, tags array<string>")
    store = ingest.chunk_table(spark, f"{path}/chunks", buckets=4)
    for _ in range(2):
        told = ingest.ingest_texts(docs, store, f"{path}/archive", "load", 0)
        assert sorted(map(str, map(tuple, told.collect()))) == sorted(map(str, [
            ("a", 2, "ok", None), ("b", 0, "refused", "text_required"), ("c", 1, "ok", None), ("d", 0, "refused", "document_repeated"),
            ("d", 0, "refused", "document_repeated"), (None, 0, "refused", "document_id_required")]))
        assert sorted(r.chunk_id for r in store.read().collect()) == ["a#0", "a#1", "c#0"]
        assert sorted(r.document_id for r in spark.read.parquet(f"{path}/archive/load-0").collect()) == ["a", "c"]
    assert len(names(spark, f"{path}/chunks/commits")) == 1
