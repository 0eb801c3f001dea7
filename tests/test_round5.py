"""Findings of the fourth round: documents without content, and the exact search of chat prompts."""

from __future__ import annotations

import uuid

import duckdb
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwell.catalog import ORACLES, QUERIES
from groundwell.operators import blocks, vector
from groundwell.operators.stages import stage_folder
from tools.check import compare

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(spark, query, rows):
    folder = f"{stage_folder(spark)}/odd-{uuid.uuid4().hex}"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCUMENTS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    told = compare(spark, con, folder, query, QUERIES[query], ORACLES[query])
    assert told.startswith("ok") and "TYPES" not in told, told


# Blank and missing texts of stored and new documents, among them finished, building and failed versions.
BLANK = [(i, ("one. two.", "", None, " \n\t")[i * 7 // 5 % 4], f"src{i % 3}") for i in range(24)]


def test_v05_registers_documents_without_content_and_fails_their_builds(spark):
    same_as_sql(spark, "v05_ingest", [*BLANK, (30, "# only", "src1"), (31, "text", None), (None, "text", "src1")])


def test_s15_keeps_a_blank_text_that_need_not_be_there(spark):
    same_as_sql(spark, "s15_ingest_status", BLANK)


def test_v04_fails_versions_of_documents_without_content(spark):
    same_as_sql(spark, "v04_saved_manifests", BLANK)


def test_f1_questions_meet_points_as_matrices_and_rank_them_as_pairs_did(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SCAN_POINTS", 40)
    monkeypatch.setattr(blocks, "SCAN_PAIRS", 100)
    monkeypatch.setattr(blocks, "SCAN_PRODUCTS", 7)
    random = np.random.default_rng(5)
    drawn = random.normal(size=(200, 8))
    # Every fourth vector is a copy of one of four, so places are shared by many points; some point elsewhere, some nowhere.
    vectors = [drawn[i % 16] if i % 4 == 0 else drawn[i] for i in range(200)]
    points = [(f"p{i * 7919 % 200:03d}", "hot" if i < 170 else "cold", [float(x) for x in v], f"text {i}") for i, v in enumerate(vectors)]
    points += [("flat", "hot", [0.0] * 8, ""), ("short", "hot", [1.0, 2.0], ""), ("none", "hot", None, "")]
    asked = [(i, ("hot", "cold", "hot", "absent")[i % 4], [float(x) for x in drawn[i * 4 % 200] + (i % 3)], (3, 60, 0, 5)[i % 5 % 4])
             for i in range(40)]
    stored = spark.createDataFrame(points, "point_id string, scope string, vector array<float>, text string")
    questions = spark.createDataFrame(asked, "query_id long, scope string, query_vector array<float>, _limit int")
    met = vector.nearest(questions, stored, "scope", F.col("_limit"))
    assert "FlatMapCoGroupsInArrow" in met._jdf.queryExecution().toString()
    every = blocks.usable(stored, "vector").join(blocks.usable(questions, "query_vector"), ["scope", blocks.DIM])
    ranked = every.withColumn("score", vector._score()).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))).filter("rank <= _limit")
    columns = ["query_id", "rank", "point_id", "score", "scope", "text", "_limit"]
    expected = sorted(map(tuple, ranked.select(*columns).collect()))
    assert sorted(map(tuple, met.select(*columns).collect())) == expected and len(expected) > 300


def test_f1_scores_are_rounded_as_spark_rounds_them(spark):
    edges = [k / 1e7 for k in range(-95, 100, 5)] + [(2 * k + 1) / 2e6 for k in range(0, 5000, 7)]
    scores = [*edges, *[float(np.nextafter(x, s)) for x in edges for s in (-1, 1)], *np.random.default_rng(3).uniform(-1, 1, 500).tolist()]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i long, x double").select("i", F.round("x", 6).alias("r")).collect()
    assert [round(r.r * 1e6) for r in sorted(rows)] == blocks._rounded(np.array(scores)).astype(int).tolist()
