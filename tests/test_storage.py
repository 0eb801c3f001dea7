"""Sources, sinks, stored tables, publishing and the registered queries."""

import json

import pytest
from pyspark.sql import functions as F

from groundwell.catalog import ORACLES, QUERIES
from groundwell.functions import identity as ids
from groundwell.operators import versions
from groundwell.operators.stages import materialize, stage_folder
from groundwell.plans.publish import build_and_publish
from groundwell.sources import reports, sinks, tables
from tools.check import compare

SMALL = "/root/testdata/sf0.001"


def test_files_and_golden_cases(spark, tmp_path):
    (tmp_path / "docs" / "a").mkdir(parents=True)
    (tmp_path / "docs" / "a" / "x y.md").write_text("# 标题\n\n正文", encoding="utf-8")
    row = tables.read_documents(spark, f"file:{tmp_path}/docs", "s", "markdown").first()
    assert (row.source_ref, row.document_id, row.content) == ("a/x y.md", "a_x_y.md", "# 标题\n\n正文")
    cases = [{"case_id": "g1", "query": "q", "knowledge_scope": "s", "expected_chunk_ids": ["a"],
              "forbidden_chunk_ids": ["b"]}]
    (tmp_path / "golden.json").write_text(json.dumps(cases), encoding="utf-8")
    assert tables.read_golden_cases(spark, str(tmp_path / "golden.json")).first().expected_chunk_ids == ["a"]


def test_tables_are_created_once(spark, tmp_path):
    names = tables.create_tables(spark, "memory_test", str(tmp_path / "db"))
    assert tables.create_tables(spark, "memory_test") == names
    assert spark.table("memory_test.memory_items").columns == tables.SCHEMAS["memory_items"].names
    spark.range(1).select(F.lit("old").alias("v")).write.saveAsTable("memory_test.old_docs", path=str(tmp_path / "o"))
    spark.range(1).select(F.lit("new").alias("v")).write.saveAsTable("memory_test.new_docs", path=str(tmp_path / "n"))
    for table, value in (("old_docs", "old"), ("new_docs", "new")):
        versions.switch_view(spark, "memory_test.live", f"memory_test.{table}")
        assert spark.table("memory_test.live").first().v == value
    spark.sql("DROP DATABASE memory_test CASCADE")


def test_manifest_ranges_are_replaced(spark, tmp_path):
    def rows(version, text):
        return spark.createDataFrame([(version, text, "paragraph", "D", 0, "h", 1, "p")],
                                     tables.SCHEMAS["document_chunk_manifests"])

    path = str(tmp_path / "m")
    versions.write_manifests(rows(1, "a").unionByName(rows(25, "b")), path, 10)
    versions.write_manifests(rows(2, "c"), path, 10)
    assert {r.chunk_id for r in spark.read.parquet(path).collect()} == {"b", "c"}


def test_bounded_error_cuts_on_a_character(spark):
    text = "é" * 2000
    got = spark.createDataFrame([(text,), (" ",), ("x",)], "m string").select(ids.bounded_error(F.col("m")).alias("e"))
    long, blank, short = [r.e for r in got.collect()]
    assert long.endswith("...[truncated]") and len(long.encode()) <= 2048 and set(long[:-14]) == {"é"}
    assert blank == "document build failed" and short == "x"


def test_upload_report_request(spark):
    body = json.dumps({"pid": "p", "progress": 2, "extra_upload_info": [
        {"filename": "a.mp4", "key": "k/a", "filesize": 10, "status": 0}, {"filename": "b", "key": "k/b", "filesize": 4,
                                                                           "status": 0}]})
    done = json.dumps({"pid": "p", "progress": 2, "extra_upload_info": [
        {"filename": "a.mp4", "key": "k/a", "filesize": 10, "uploaded_size": 10, "status": 3, "upload_time": 9}]})
    files = reports.parse_reports(spark.createDataFrame([(body,), (done,)], "body string"))
    got = reports.batch_progress(files, reports.WHOLE_FILE_CODES).first()
    assert (got.files, got.pending, got.success, got.bytes, got.uploaded_bytes, got.completion) == (2, 1, 1, 14, 10, 0.5)


def test_log_is_kept_by_day(spark, tmp_path):
    answers = spark.createDataFrame([("s", "u", "q", "a", True, ["c#0"], "", "2024-03-01 10:00:00")],
                                    "session_id string, user_id string, question string, answer string, "
                                    "used_knowledge boolean, retrieved_chunk_ids array<string>, model string, created_at "
                                    "string").withColumn("created_at", F.to_timestamp("created_at"))
    sinks.append_log(sinks.log_records(answers, "mock-chat", "e"), str(tmp_path / "log"))
    files = list((tmp_path / "log" / "log_date=2024-03-01").glob("*.json"))
    record = json.loads(files[0].read_text(encoding="utf-8"))
    assert record["chat_model"] == "mock-chat" and record["retrieved_chunk_ids"] == ["c#0"]


def test_repeated_publication_builds_nothing(spark):
    from groundwell.operators.structure import ChunkPolicy

    docs = spark.createDataFrame([("s", f"d{i}", "a.md", "markdown", f"# T\n\nBody {i}.") for i in range(3)],
                                 "knowledge_scope string, document_id string, source_ref string, format string, "
                                 "content string")
    nothing = {n: spark.createDataFrame([], tables.SCHEMAS[n]) for n in
               ("document_sources", "document_versions", "document_chunk_manifests")}
    aliases = spark.createDataFrame([("live", "ctx_documents_a")], "alias string, collection string")
    policy, now = ChunkPolicy(160, 0), F.lit("2024-01-01").cast("timestamp")
    done = build_and_publish(docs, policy, "ctx_documents_b", "live", "ctx_documents_a", nothing["document_sources"],
                             nothing["document_versions"], nothing["document_chunk_manifests"], aliases, 64, now)
    assert [r.outcome for r in done.outcomes.collect()] == ["activated"]
    assert done.aliases.first().collection == "ctx_documents_b"
    assert {r.status for r in done.versions.collect()} == {"active"}
    assert done.sources.filter("active_version_id IS NULL").count() == 0
    again = versions.ingest(docs, policy, "ctx_documents_b", materialize(done.sources), materialize(done.versions),
                            done.manifests)
    assert [(r.noop, r.embed_batches, r.chunk_count) for r in again.results.collect()] == [(True, 0, 1)] * 3


def test_stage_folder_follows_the_session(spark, monkeypatch):
    folder = stage_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder


def test_every_query_has_unique_lower_case_name():
    assert len(QUERIES) > 150 and set(ORACLES) <= set(QUERIES)
    assert all(name == name.lower() for name in QUERIES)


@pytest.mark.parametrize("name", [
    "c01_line_chunks", "c16_structured_chunks", "j04_lexical_search", "b10_token_window", "q06_summary_update",
    "m07_batch_resolution", "b07_quota_merge", "a04_manifest_digests", "t02_window_stream"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from tools.check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name]).startswith("ok")


def test_ranges_that_agree_are_not_joined(spark):
    from pyspark.sql import functions as F

    from groundwell.operators import points
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("point_id"), F.lit("s").alias("knowledge_scope"),
                                      F.concat(F.lit("c"), "id").alias("chunk_id"), F.md5(F.col("id").cast("string")).alias("content_hash"), "id").cache()
    kept = points.range_fingerprints(rows).cache()
    assert kept.count() <= points.RANGES and points.reconcile_ranges(rows, rows.repartition(7), kept).count() == 0
    changed = rows.filter("id <> 5").withColumn("content_hash", F.when(F.col("id") == 7, "other").otherwise(F.col("content_hash")))
    changed = changed.withColumn("chunk_id", F.when(F.col("id") == 11, None).otherwise(F.col("chunk_id")))
    changed = changed.unionByName(rows.filter("id = 9")).unionByName(rows.filter("id = 1").withColumn("point_id", F.lit("new")))
    expected = sorted(map(tuple, points.reconcile(rows, changed).collect()))
    assert len(expected) == 5 and expected == sorted(map(tuple, points.reconcile_ranges(rows, changed, kept).collect()))
    assert expected == sorted(map(tuple, points.reconcile_ranges(rows, changed).collect()))
    # A swap of two hashes keeps every count, and is found.
    pair = rows.withColumn("content_hash", F.when(F.col("id") == 3, F.md5(F.lit("4"))).when(F.col("id") == 4, F.md5(F.lit("3"))).otherwise(F.col("content_hash")))
    assert points.reconcile_ranges(rows, pair, kept).count() == 2
    assert points.reconcile_ranges(rows.limit(0), rows.limit(0)).count() == 0
