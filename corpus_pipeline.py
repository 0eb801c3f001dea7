"""The training-data pipeline over ``documents``: which documents stay, how often, and as which token ids.

Each stage takes the documents that its predecessor kept, with all their columns, and returns those that it keeps; the last
one returns a row per written document. ``run`` writes every stage to the shared folder and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwell.llm.common import table
from groundwell.llm.decontamination import decontaminate
from groundwell.llm.jaccard import keep_one
from groundwell.llm.mixing import emitted, mix
from groundwell.llm.quality import classify
from groundwell.llm.tokens import read_digests, written
from groundwell.operators.stages import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return classify(docs, table(spark, sf_dir, "labels")).filter("keep").select("row.*")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs, 5, 80, 100)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return emitted(mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the written token files."""
    return read_digests(spark, written(docs))


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", unseen),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: No SQL states the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
