"""From documents to a live, verified collection: ingest, snapshot, verify, activate. Every stage result is written
before the next one starts, so a failed stage restarts from the last written table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.vectors import hash_embedding
from groundwell.operators import evaluate, vector, versions
from groundwell.operators.stages import materialize
from groundwell.operators.structure import ChunkPolicy


class Published(NamedTuple):
    sources: DataFrame
    versions: DataFrame
    manifests: DataFrame
    points: DataFrame
    aliases: DataFrame
    outcomes: DataFrame


def golden_report(cases: DataFrame, points: DataFrame) -> DataFrame:
    """A01, A02 over the points of a collection: the question of each case searched in its scope."""
    asked = cases.select(F.col("case_id").alias("query_id"), "knowledge_scope", hash_embedding(F.col("query")).alias("query_vector"))
    hits = materialize(vector.search_documents(asked, points, evaluate.RANKS).select(
        F.col("query_id").alias("case_id"), "rank", "chunk_id", "knowledge_scope"))
    return evaluate.report(evaluate.case_results(cases, hits), evaluate.hit_failures(cases, hits))


def build_and_publish(documents: DataFrame, policy: ChunkPolicy, collection: str, alias: str, current: str,
                      sources: DataFrame, state: DataFrame, manifests: DataFrame, aliases: DataFrame, vector_size: int,
                      now: Column, golden: DataFrame | None = None) -> Published:
    """Build ``documents`` into ``collection`` and move ``alias`` from ``current`` to it when every scope verifies.

    With a ``golden`` set, its questions are asked of the new points first, and the alias stays where it is unless every
    case finds what it expects and nothing that it forbids.
    """
    built = versions.ingest(documents, policy, collection, sources, state, manifests)
    stored_versions, stored_manifests = materialize(built.versions), materialize(built.manifests)
    points = materialize(built.points)
    rows = materialize(versions.snapshot_chunks(stored_versions, built.sources, stored_manifests).filter(
        F.col("collection") == collection))
    # Claimed is what the ingest made, found is what has been stored: a row lost on the way shows in the digest.
    made = versions.snapshot_chunks(built.versions, built.sources, built.manifests).filter(F.col("collection") == collection)
    digests = materialize(versions.manifest_digests(made))
    claimed = digests.select(*versions.SNAPSHOT_KEY, F.col("manifest_digest").alias("claimed_digest"))
    report = materialize(versions.verify(rows, claimed, points, vector_size, now))
    members = versions.latest_versions(stored_versions, built.sources).filter(F.col("collection") == collection)
    issues = versions.snapshot_issues(members, stored_versions, built.sources)
    asked = report.select(
        *versions.SNAPSHOT_KEY, F.lit(alias).alias("alias"), F.lit(current).alias("from_collection"),
        F.when(F.col("reject_reason").isNull(), F.col("manifest_digest")).alias("report_digest"),
        F.col("point_count").alias("report_points"), "verified_at")
    outcomes = versions.activation_outcomes(asked, digests, aliases, issues, now)
    if golden is not None:
        failed = ~golden_report(golden, points).select("passed").scalar()
        outcomes = outcomes.withColumn("outcome", F.when(
            failed & (F.col("outcome") == "activated"), "golden_set_failed").otherwise(F.col("outcome")))
    outcomes = materialize(outcomes)
    # One alias serves all scopes, so a single refused scope keeps it where it is.
    refused = outcomes.filter(F.col("outcome") != "activated").agg(F.count(F.lit(1)).alias("n")).scalar()
    accepted = outcomes.filter(refused == 0)
    live = members.join(accepted.select(*versions.SNAPSHOT_KEY), versions.SNAPSHOT_KEY, "left_semi")
    new_sources, new_versions = versions.activate_versions(built.sources, stored_versions, live, now)
    return Published(new_sources, new_versions, stored_manifests, points,
                     versions.switched_aliases(aliases, accepted), outcomes)
