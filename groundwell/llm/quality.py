"""Quality classifier with hierarchical empirical Bayes.

1. **Evidence.** A logistic regression over shares of character-class pairs and a few statistics of the whole text, trained
   on at most ``SAMPLE`` labelled documents, gives each document a log likelihood ratio: its log odds less those of the
   classes in training.
2. **Posteriors.** Soft counts of good documents are summed per host and per path of a host. A host's share is shrunk towards
   the share of the whole corpus, a path's towards its host's; how far, follows from the variance between groups beyond
   chance (method of moments), so sparse sites borrow the most.
3. **Decision.** The posterior of the path is the prior of the document, its evidence is added, and a document is rejected
   below ``THRESHOLD``.

Texts are not shuffled: evidence is computed where a text is read, once for the sums and once for the decision. Sums are
aggregated before the exchange, so a host with a third of all documents is one row per task. Posteriors are written to a
table, whose size decides how it is joined.

Defined results: a null or empty text has evidence like any other, from its statistics; a null host or path is one of its
own; labels that are null, of unknown documents or contradictory (both classes) are not used; without both classes among
the labels evidence is 0 for all and every document stays; repeated rows are scored one by one; an empty table gives no
rows. Other columns pass through in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import key_of, query, table, whole_texts
from groundwell.llm.shingles import slices, word_hashes
from groundwell.operators.stages import materialize

#: Labelled documents that train the classifier, at most: those with the smallest hashes of their ids.
SAMPLE = 10_000
THRESHOLD = 0.3
#: Evidence of one document counts for at most so much.
LIMIT = 8.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[10, 13]] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[[ord(c) for c in "aeiou"]] = 6
_CLASS[[ord(c) for c in ".,;:"]] = 7
_CLASS[[ord(c) for c in "'\"-()"]] = 8
_CLASS[ord("!")] = 9
_CLASS[[ord(c) for c in "?"]] = 10
_CLASS[[ord(c) for c in "|/\\_=+"]] = 11
_CLASS[[ord(c) for c in "#$%&*@^~"]] = 12
_CLASS[[ord(c) for c in "<>{}[]"]] = 13
_CLASS[192:] = 14
_CLASS[128:192] = 15
PAIRS = 256
FEATURES = PAIRS + 8


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text: square roots of the shares of class pairs, then statistics of words and lines."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for first, data, offsets in slices(texts):
        n = np.diff(offsets)
        rows = len(n)
        row = np.repeat(np.arange(rows), n)
        kind = _CLASS[data]
        if len(data) > 1:
            same = row[1:] == row[:-1]
            pair = row[1:] * PAIRS + kind[:-1].astype(np.int64) * 16 + kind[1:]
            counts = np.bincount(pair[same], minlength=rows * PAIRS).reshape(rows, PAIRS)
            out[first:first + rows, :PAIRS] = np.sqrt(counts / np.maximum(1, n - 1)[:, None])
        hashes, owner = word_hashes(data, offsets)
        words = np.bincount(owner, minlength=rows)
        order = np.lexsort((hashes, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(hashes[order].view(np.int64)) != 0) | (np.diff(owner[order]) != 0)
        edges = np.flatnonzero(fresh)
        runs = np.diff(edges, append=len(order))
        most = np.zeros(rows)
        np.maximum.at(most, owner[order][edges], runs)
        distinct = np.bincount(owner[order][edges], minlength=rows)
        repeat = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=rows)
        share = lambda x: x / np.maximum(1, words)
        lines = np.bincount(row[kind == 2], minlength=rows) + 1
        out[first:first + rows, PAIRS:] = np.stack([
            np.log1p(words) / 8, share(distinct), share(most), share(repeat), np.log1p(share(n)) / 4,
            np.log1p(share(lines)), share(distinct) * np.log1p(words) / 8, (words == 0)], 1)
    return out


class Classifier:
    """Logistic regression on standardised features. ``prior``: log odds of the classes in training."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0, prior: float = 0.0):
        self.weights, self.bias, self.prior = weights, bias, prior

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 25) -> Classifier:
        """By Newton steps with a ridge."""
        if not len(y) or y.min() == y.max():
            return Classifier()
        x = x.astype(np.float64)
        mean, scale = x.mean(0), x.std(0) + 0.02
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        rate = y.mean()
        return Classifier((w[:-1] / scale).astype(np.float32), float(w[-1] - (w[:-1] * mean / scale).sum()),
                          float(np.log(rate / (1 - rate))))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return np.clip(x.astype(np.float64) @ self.weights + self.bias - self.prior, -LIMIT, LIMIT)


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """Fit on a bounded sample of labelled documents."""
    usable = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
              .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
              .filter("label = top").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).drop("top"))

    @F.arrow_udf("array<float>")
    def measured(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))

    rows = (whole_texts(documents).select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
            .join(F.broadcast(usable), "id").select("id", "label", measured("text").alias("x"))
            .orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).toArrow())
    x = rows.column("x").combine_chunks()
    return Classifier.fit(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), FEATURES), rows.column("label").to_numpy())


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame) -> DataFrame:
    """``host, path, shift``, from rows of ``host, path, good``: log odds of the path's posterior share, with the shares."""
    sums = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")))
    hosts = sums.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    corpus, docs = sums.agg(F.sum("good"), F.sum("n")).first()
    corpus = min(max((corpus or 0.0) / max(docs or 0, 1), 1e-3), 1 - 1e-3)
    host_weight = _weight(hosts, F.lit(corpus), "host_good", "host_n")
    shrunk = hosts.withColumn("host_share", (F.col("host_good") + host_weight * corpus) / (F.col("host_n") + host_weight))
    both = sums.join(shrunk, "host")
    path_weight = _weight(both, F.col("host_share"), "good", "n")
    share = (F.col("good") + path_weight * F.col("host_share")) / (F.col("n") + path_weight)
    return both.select("host", "path", "host_share", share.alias("path_share"),
                       _logit(F.least(F.lit(1 - 1e-3), F.greatest(F.lit(1e-3), share))).alias("shift"))


def _weight(groups: DataFrame, centre: Column, good: str, n: str) -> float:
    """Prior weight in documents: by moments, the spread of group shares beyond what their sizes explain."""
    share = F.col(good) / F.col(n)
    total, spread, chance, mean = groups.agg(
        F.sum(n), F.sum(F.col(n) * (share - centre) ** 2), F.sum(centre * (1 - centre)), F.sum(F.col(n) * centre * (1 - centre))).first()
    if not total:
        return 1.0
    within = mean / total
    between = max((spread - chance) / total, 1e-9)
    return float(min(max(within / between - 1, 1.0), 1e4))


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
             path: str = "lang", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns), ``evidence, host_share, path_share, score, keep`` of every document."""
    model = train(documents, labels, doc_id, text, label)

    @F.arrow_udf("double")
    def weighed(texts: pa.Array) -> pa.Array:
        return pa.array(model.evidence(features(texts)))

    evidence = weighed(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keys = [key_of(host).alias("host"), key_of(path).alias("path")]
    good = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model.prior))))
    scored = documents.select(*keys, evidence.alias("evidence")).withColumn("good", good)
    prior = materialize(posteriors(scored))
    if model.weights is None:
        threshold = 0.0
    return (
        documents.select(F.struct("*").alias("row"), *keys, evidence.alias("evidence")).join(prior, ["host", "path"])
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.col("shift")))))
        .select("row", "evidence", "host_share", "path_share", "score", (F.col("score") >= threshold).alias("keep")))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = classify(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"), table(spark, folder, "labels"))
    return found.select("row.doc_id", "evidence", "host_share", "path_share", "score", "keep")
