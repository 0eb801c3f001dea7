import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import jaccard
from groundwell.llm.components import components

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, size, num, den):
    """(number of n-grams, component) per row."""
    grams = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams.append({tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if grams[a] and den * both >= num * (len(grams[a]) + len(grams[b]) - both):
                top[find(a)] = find(b)
    names = {}
    for i, (name, _) in enumerate(rows):
        names.setdefault(find(i), []).append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return Counter((rows[i][0], len(grams[i]), least[find(i)]) for i in range(len(rows))), len(names)


def near_copies(seed, bases, copies):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "x!"]
    rows, name = [], 0
    for _ in range(bases):
        words = draw.choices(vocabulary, k=draw.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 45, 90, 200]))
        for _ in range(draw.randint(1, copies)):
            own = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                place = draw.randrange(len(own))
                own[place:place + draw.choice([0, 1])] = [draw.choice(vocabulary + ["new%d" % draw.randrange(999)])]
            rows.append((name, draw.choice([" ", "\n", "  "]).join(own).upper() if draw.random() < .2 else " ".join(own)))
            name += 1
    draw.shuffle(rows)
    return rows


def joined(spark, rows, size, num, den):
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, n string").repartition(5)
    return Counter(map(tuple, jaccard.join(df, size, num, den).collect()))


@pytest.mark.parametrize("size,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2), (1, 80, 100, 3)])
def test_matches_brute_force(spark, size, num, den, seed):
    rows = near_copies(seed, 60, 7)
    assert joined(spark, rows, size, num, den) == brute(rows, size, num, den)[0]


def test_large_group_of_near_copies(spark):
    draw = random.Random(4)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(250):
        own = list(base)
        for _ in range(draw.randint(0, 7)):
            own[draw.randrange(150)] = f"n{draw.randrange(10 ** 6)}"
        rows.append((1000 - i, " ".join(own)))
    assert joined(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)[0]


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()] + [(None, "only null"), (20, "a b c d"), (21, "A B\nC  D"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, jaccard.join(df, 3, 90, 100).collect())) == brute(rows, 3, 90, 100)[0]
    assert jaccard.join(nothing, 3, 90, 100).count() == 0


def test_keep_one_leaves_one_row_per_component(spark, edges, nothing):
    rows = near_copies(8, 30, 5)
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], "something else entirely here now"), (None, rows[2][1]), (None, "lonely null id text row"),
             (None, "lonely null id text row"), (900, ""), (900, None), (901, " ")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, label int")
    kept = jaccard.keep_one(df, 5, 80, 100)
    assert kept.columns == df.columns
    found, parts = brute(rows, 5, 80, 100)
    wordless = sum(1 for _, t in rows if not (t or "").strip())
    out = kept.collect()
    assert len(out) == parts and sum(1 for r in out if not (r.text or "").strip()) == wordless
    least = {c for (_, n, c), _ in found.items() if n}
    assert {r.doc_id for r in out if (r.text or "").strip()} == least
    assert jaccard.keep_one(nothing, 5, 80, 100).columns == nothing.columns
    assert jaccard.keep_one(nothing, 5, 80, 100).count() == 0
    assert jaccard.keep_one(edges, 5, 80, 100).columns == edges.columns


def test_schemes_give_linked_sets_an_equal_piece():
    """Whatever is taken out and put in within the limit, a hash is shared."""
    draw = np.random.default_rng(5)
    for num, den in ((80, 100), (90, 100)):
        schemes = jaccard.Schemes(num, den)
        for n in [*range(1, 40), 63, 100, 251, 600]:
            for _ in range(6):
                x = draw.integers(0, 2 ** 63, n, dtype=np.uint64)
                drop = draw.integers(0, n + 1)
                y = np.concatenate([x[drop:], draw.integers(0, 2 ** 63, draw.integers(0, n // 4 + 1), dtype=np.uint64)])
                both = n - drop
                if not len(y) or both * den < num * (n + len(y) - both):
                    continue
                told = [set(jaccard.cut(np.sort(s), np.array([len(s)]), np.array([1]), schemes)[0].tolist()) for s in (x, y)]
                assert told[0] & told[1], (num, n, len(y), both)


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 100)], "a bigint, b bigint")
    found = {r.node: r.label for r in components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 100}
    assert components(links.filter(F.lit(False))).count() == 0
