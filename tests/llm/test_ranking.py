import math
import random
import re
from collections import Counter

import pytest

from groundwell.llm import ranking

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, top=20):
    docs = [(name, Counter(terms_of(text)), len(terms_of(text))) for name, text in documents]
    docs = [d for d in docs if d[2]]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, counts, _ in docs for t in counts)
    out = []
    for item, text in items:
        found = []
        for name, counts, size in docs:
            m, score = 75 + 25 * size * n // total, 0
            for t in terms_of(text):
                if t in counts:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                found.append((-score, name if name is not None else -2 ** 63, name))
        out += [(item, rank, name, -score) for rank, (score, _, name) in enumerate(sorted(found, key=lambda r: r[:2])[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, rows=400):
    draw = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"R{i}é" for i in range(400)]

    def text(n):
        return draw.choice([" ", ", ", "-"]).join(draw.choice(common if draw.random() < 0.7 else rare) for _ in range(n))

    documents = [(i, text(draw.choice([0, 1, 3, 20, 60, 300]))) for i in range(rows)]
    documents += [(rows + i, documents[5][1]) for i in range(60)] + [(3, documents[3][1]), (None, documents[9][1]), (None, None)]
    items = [(i, text(draw.choice([1, 2, 8, 40]))) for i in range(25)] + [(25, None), (26, "..."), (27, "unknown words"), (3, documents[7][1]),
                                                                     (None, "c1 c1 R5é")]
    return documents, items


@pytest.mark.parametrize(("rows", "first", "block", "top"), [(16_384, 64, 4 << 20, 20), (50, 4, 300, 20), (7, 2, 4 << 20, 3)])
def test_matches_brute_force(spark, monkeypatch, rows, first, block, top):
    monkeypatch.setattr(ranking, "FIRST", first)
    monkeypatch.setattr(ranking, "BLOCK_BYTES", block)
    documents, items = corpus(first)
    df = spark.createDataFrame([(*r, 1, "x") for r in documents], "doc_id bigint, text string, score int, terms string").repartition(5)
    got = rows_of(ranking.ranked_search(df, spark.createDataFrame(items, "item_id bigint, text string"), top=top))
    assert got == brute(documents, items, top) and got


def test_bounds_rule_most_pairs_out(monkeypatch):
    """The bounds do the work: exact scores are formed for few of the documents that share a term with an item."""
    documents, questions = corpus(3, 2000)
    items = ranking.Items([(i, (t or "").encode()) for i, t in questions])
    found = [Counter(items.numbers[w.encode()] for w in terms_of(t) if w.encode() in items.numbers) for _, t in documents]
    sizes = [len(terms_of(t)) for _, t in documents]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    items.weigh(n, Counter(t for c in found for t in c))
    np = ranking.np
    vectors = sorted(((np.array(list(c)), np.array([1000000000 * f // (1000 * f + 12 * (75 + 25 * s * n // total)) for f in c.values()]), i)
                      for i, (c, s) in enumerate(zip(found, sizes)) if c), key=lambda v: -float((v[1].astype(float) ** 2).sum()))
    best, formed, shared = ranking.Best(len(items.names), 20, {}), 0, 0
    for at in range(0, len(vectors), 100):
        part = vectors[at:at + 100]
        owner = np.repeat(np.arange(len(part)), [len(v[0]) for v in part])
        block = ranking.Block(np.array([v[2] for v in part]), owner, np.concatenate([v[0] for v in part]),
                              np.concatenate([v[1] for v in part]), np.array([float((v[1].astype(float) ** 2).sum()) ** 0.5 for v in part]))
        for i, (terms, values) in enumerate(items.terms):
            if len(terms):
                rows, scores = block.search(terms, values, items.tails[i], int(best.floors[i]))
                formed += len(rows)
                shared += sum(bool(set(v[0].tolist()) & set(terms.tolist())) for v in part)
                best.add(i, block.ids[rows], scores)
    assert formed < shared / 4


def test_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "Same LINE other"), (2, "word é"), (3, "")], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert rows_of(ranking.ranked_search(edges, items)) == brute(rows, [(1, "Same LINE other"), (2, "word é"), (3, "")])
    assert ranking.ranked_search(nothing, items).count() == 0
    assert ranking.ranked_search(edges, items.limit(0)).count() == 0


def test_query_against_sql(spark, against_sql):
    folder = "/root/testdata/sf0.001"
    documents, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    assert against_sql(ranking.op13(spark, folder), ranking.SQL, documents=documents.select("doc_id", "text"), benchmark=benchmark)
