from pyspark.sql import functions as F

from groundwell.llm import line_dedup, mixing


def deduped(df):
    return line_dedup.dedup_lines(df).select(
        "page.doc_id", "n_lines", "n_dropped", F.length("kept").cast("long").alias("kept_chars"),
        F.sha2("kept", 256).alias("kept_sha256"))


def test_line_dedup_edges(edges, nothing, against_sql):
    rows = against_sql(deduped(edges), line_dedup.SQL, documents=edges)
    assert len(rows) == edges.count()
    assert deduped(nothing).count() == 0


def test_line_dedup_keeps_columns_and_order(edges):
    kept = {r.page.doc_id: (r.kept, r.n_dropped) for r in line_dedup.dedup_lines(edges).collect() if r.page.source == "a"}
    assert kept[1] == ("own one\n", 2) and kept[2] == ("", 2) and kept[3] == (None, 0)


def mixed(df):
    return mixing.mix(df).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def test_mixing_edges(edges, nothing, against_sql):
    rows = against_sql(mixed(edges), mixing.SQL, documents=edges)
    assert len(rows) == edges.count()
    assert mixed(nothing).count() == 0


def test_mixing_meets_targets_and_emits_copies(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")).alias("text"),
        F.when(F.col("id") % 10 < 1, "big").when(F.col("id") % 10 < 5, "mid").when(F.col("id") % 10 < 9, "s").alias("source"))
    found = mixing.mix(docs)
    by = {r.source: r for r in found.groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"),
        F.max("source_size").alias("size")).collect()}
    assert len(by) == 4
    assert abs(sum(r.target for r in by.values()) - sum(r.size for r in by.values())) < 1e-6
    for r in by.values():
        assert r.most <= 3 and r.target <= 3 * r.size + 1e-9 and abs(r.taken - r.target) < 0.02 * r.target + 200
    out = mixing.emitted(found)
    assert out.columns == docs.columns and out.count() == found.agg(F.sum("copies")).first()[0]
    assert sorted(map(tuple, found.select("row.doc_id", "copies").collect())) == sorted(
        map(tuple, mixing.mix(docs.repartition(7)).select("row.doc_id", "copies").collect()))
