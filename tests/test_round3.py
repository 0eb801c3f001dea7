"""Findings of the third round."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.operators import structure, vector, versions
from groundwell.operators.structure import ChunkPolicy
from groundwell.sources import tables


def test_a_failing_build_of_another_worker_stays_building(spark):
    documents = spark.createDataFrame([(str(i), f"{i}.md", "# a\n\nb\n\n```\nopen") for i in (1, 2)], "document_id string, source_ref string, content string")
    documents = documents.withColumns({"knowledge_scope": F.lit("s"), "format": F.lit("markdown")})
    policy = ChunkPolicy(max_tokens=40)
    sources = spark.createDataFrame([(1, "s", "1", "1.md", None), (2, "s", "2", "2.md", None)],
                                    "id long, knowledge_scope string, document_id string, source_ref string, active_version_id long")
    built = versions.builds_of(documents, policy, "ctx_documents_a")
    number = F.col("document_id").cast("long")
    stored = built.select(
        number.alias("id"), number.alias("document_source_id"), *versions.VERSION_KEY[1:], F.when(number == 1, "building").otherwise("pending").alias("status"),
        F.lit(0).cast("long").alias("chunk_count"), F.lit("").alias("error_message"), F.lit(None).cast("timestamp").alias("activated_at"))
    done = versions.ingest(documents, policy, "ctx_documents_a", sources, stored, spark.createDataFrame([], tables.SCHEMAS["document_chunk_manifests"]))
    assert {(r.id, r.status) for r in done.versions.collect()} == {(1, "building"), (2, "failed")}


def test_pairs_are_ranked_without_their_payload(spark):
    points = spark.createDataFrame([(i, "t", [1.0, float(i)], f"text {i}") for i in range(40)], "point_id long, tenant string, vector array<double>, text string")
    asked = spark.createDataFrame([(q, "t", [1.0, float(q)]) for q in range(3)], "query_id long, tenant string, query_vector array<double>")
    found = vector.nearest(asked, points, "tenant", 2, F.col("point_id") != F.col("query_id"))
    assert all(r.text == f"text {r.point_id}" for r in found.collect()) and found.count() == 6
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line]
    assert windows and "text" not in plan[plan.index("row_number"):].split("Relation")[0]


def test_packs_are_the_longest_that_fit(spark):
    texts = ["", "One. Two! Three?", "abcdefghijkl. mn. o", "no end at all here", "。！a", "12345. 6789012345. x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (1, 4, 5, 9, 30):
        for r in df.select("t", structure.packed_sentences(F.col("t"), limit).alias("packs")).collect():
            assert "".join(r.packs) == r.t and all(0 < len(p) <= limit for p in r.packs)
            for pack, after in zip(r.packs, r.packs[1:]):
                assert pack[-1] in ".!?。！？\n" or len(pack) == limit
