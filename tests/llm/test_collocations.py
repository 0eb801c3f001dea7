import random
import re
from collections import Counter

import pytest

from groundwell.llm import collocations

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, order=3, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, order + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i:i + size])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i:i + size]
                longer[inner] = max(longer[inner], a)
    out = []
    for (lang, words), a in candidates.items():
        if longer[lang, words] and 100 * longer[lang, words] >= covered * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    result = []
    for lang in {r[0] for r in out}:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(r for r in out if r[0] == lang)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("order", "least", "top", "numbered"), [(3, 4, 2000, 10 ** 6), (2, 3, 5, 10 ** 6), (4, 3, 2000, 0), (3, 1, 7, 0)])
def test_matches_brute_force(spark, monkeypatch, order, least, top, numbered):
    monkeypatch.setattr(collocations, "NUMBERED", numbered)
    draw = random.Random(order * 10 + least)
    words = ["a", "B", "c", "É", "d\x1ce", "-", "New", "York", "日本"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!? "]) for _ in range(draw.randint(0, 40))),
             draw.choice(["en", "en", None, "und", "de"])) for _ in range(120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, a int, phrase string").repartition(5)
    got = rows_of(collocations.collocations(df, order=order, least=least, top=top))
    assert got == brute(rows, order, least, 50, top) and got


def test_edges(spark, edges, nothing):
    rows = [(r.text, r.lang) for r in edges.collect()]
    got = rows_of(collocations.collocations(edges, least=2))
    assert got == brute(rows, least=2)
    assert any(r[2].startswith("word word") for r in got)
    assert collocations.collocations(nothing).count() == 0


def test_scores_pass_64_bits(spark):
    """Counts of a size that no small table has go through the same decimals."""
    a, part = 3_000_000_000, 4_000_000_000
    df = spark.createDataFrame([(a, part, part + 1)], "a bigint, l bigint, r bigint")
    wide = {c: df[c].cast("decimal(15,0)") for c in df.columns}
    assert df.withColumns(wide).selectExpr(collocations.SCORE + " AS s").first().s == 1_000_000 * a * a // (part * (part + 1))


def test_query_against_sql(spark, against_sql):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    assert against_sql(collocations.op12(spark, "/root/testdata/sf0.001"), collocations.SQL, documents=documents)
