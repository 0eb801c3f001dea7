import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import neighbours, quality

SF = "/root/testdata/sf0.01"


def exact(rows, queries, k):
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q, v in queries:
        far = np.sqrt(((data - np.array(v, float)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(far[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = found(neighbours.search(vectors, vectors.filter("vec_id % 20 = 0")))
    truth = exact(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert got.keys() == truth.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in truth[q]}) / 10 for q in truth]) >= 0.9
    data = dict(rows)
    for q, hits in got.items():
        for v, score in hits:
            assert score == pytest.approx(float(np.sqrt(((np.array(data[v], float) - np.array(data[q], float)) ** 2).sum())), abs=1e-12)


def test_all_lists_and_a_lenient_test_are_exact_with_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 8)
    draw = np.random.default_rng(3)
    good = [(i, [float(x) for x in draw.normal(size=24)]) for i in range(200)] + [(1000 + i, [0.5] * 24) for i in range(300)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None] + [1.0] * 23), (2005, [1.0] * 5),
           (None, [1.0] * 24), (2006, [float("inf")] * 24)]
    df = spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id bigint, embedding array<double>, rank int")
    got = found(neighbours.search(df, df.filter("vec_id % 20 = 0 OR vec_id > 1990"), probed=1.0, strict=50.0))
    truth = exact(good, [r for r in good if r[0] % 20 == 0], 10)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in truth.items()}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [5.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert {q: [v for v, _ in h] for q, h in found(neighbours.search(df, df.filter("vec_id = 1"))).items()} == {1: [2, 2]}
    assert neighbours.search(df.limit(0), df).count() == 0
    assert neighbours.search(df.filter("vec_id = 1"), df.filter("vec_id = 1")).count() == 0


def test_quality_on_held_out_labels(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = labels.filter(F.col("doc_id") % 2 == 0)
    held = labels.filter(F.col("doc_id") % 2 == 1)
    out = quality.classify(documents, told).select("row.doc_id", "keep", "score").join(held, "doc_id").collect()
    good = [r.keep for r in out if r.quality]
    poor = [r.keep for r in out if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.1


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("a", "p", 0.9)] * 400 + [("a", "q", 0.1)] * 2 + [("b", "p", 0.2)] * 300 + [("c", "p", 0.0)]
    out = {(r.host, r.path): r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    assert out["a", "p"].path_share > 0.85 and out["b", "p"].path_share < 0.3
    assert 0.1 < out["a", "q"].path_share < out["a", "p"].path_share
    assert out["c", "p"].host_share > 0.05


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, 1), (2, 0), (None, 1), (99, 0), (6, None)], "doc_id bigint, quality int")
    out = quality.classify(edges, labels)
    assert out.count() == edges.count() and out.filter("score IS NULL OR keep IS NULL").count() == 0
    assert out.select("row.*").columns == edges.columns
    untaught = quality.classify(edges, labels.limit(0)).collect()
    assert all(r.keep and r.evidence == 0 for r in untaught) and len(untaught) == edges.count()
    assert quality.classify(nothing, labels).count() == 0


def nearest_by_loops(rows, asked, k=10):
    out = {}
    for q, v in asked:
        far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [i for _, i in far[:k]]
    return out


def test_neighbours_with_other_dimensions(spark):
    """One odd vector, whichever its hash, takes nothing from the others; other dimensions have neighbours of their own."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)] + [(i, draw.normal(size=5).tolist()) for i in range(300, 330)]
    rows += [(400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = [r for r in rows if r[0] % 20 == 0]
    got = found(neighbours.search(df, df.filter("vec_id % 20 = 0"), probed=1.0, strict=50.0))
    expected = nearest_by_loops(rows, asked)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: v for q, v in expected.items() if v}


def test_neighbours_beyond_the_probed_lists(spark):
    """Copies fill the lists that are not probed: all queries still get ten."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(8)] + [(100 + i, [50.0, 50.0, 50.0, 50.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(neighbours.search(df, df))
    assert {q: [v for v, _ in h] for q, h in got.items()} == nearest_by_loops(rows, rows)
