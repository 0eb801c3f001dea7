"""Keyed tables stored in hash buckets: an upsert reads and writes the buckets that it touches, and nothing else.

A table is a folder. ``data/<commit>/_bucket=<n>`` holds the rows of a bucket as one commit left them, and ``commits/<number>``
is a small file that says which commit holds each bucket now. A commit writes new folders first and its file last, by a
rename, so a reader sees all of it or nothing, a job that dies leaves the table as it was, and two writers cannot both
make the same commit. Each writer numbers its batches; a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators.points import delete as without
from groundwell.operators.points import upsert as merged
from groundwell.operators.stages import empty
from groundwell.sources.files import create_file, list_names, read_text, remove

BUCKETS = 256


@dataclass(frozen=True)
class Commit:
    """Where the buckets are, the last batch of each writer, and values that a writer keeps with its batches."""

    number: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)


class BucketTable:
    """``keys`` name a row. Their number of buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        made = {"keys": keys, "buckets": buckets, "columns": self.schema.fieldNames()}
        if not create_file(spark, f"{self.path}/table", json.dumps(made)):
            made_before = json.loads(read_text(spark, f"{self.path}/table"))
            if (made_before["keys"], made_before["columns"]) != (keys, made["columns"]):
                raise ValueError(f"{path} is a table of other keys or columns")
            made = made_before
        self.buckets = made["buckets"]

    # --- reading ---------------------------------------------------------------------------------------------------

    def last(self) -> Commit:
        names = sorted(n for n in list_names(self.spark, f"{self.path}/commits") if n.isdigit())
        return Commit(**json.loads(read_text(self.spark, f"{self.path}/commits/{names[-1]}"))) if names else Commit()

    def read(self) -> DataFrame:
        commit = self.last()
        return self._rows(commit, list(commit.buckets))

    def _rows(self, commit: Commit, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{commit.buckets[b]}/_bucket={b}" for b in buckets if b in commit.buckets]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else empty(self.spark, self.schema)

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, commit: Commit | None = None) -> tuple[DataFrame, list[str]]:
        """The stored rows of the buckets in which ``rows`` (with the key columns) fall, and these buckets."""
        found = sorted(str(r[0]) for r in rows.select(self.bucket()).distinct().collect())
        return self._rows(commit or self.last(), found), found

    # --- writing ---------------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, writer: str, batch: int, order: Column | None = None, notes: dict[str, int] | None = None) -> list[str]:
        """The last row of a key by ``order`` wins; without an order a repeated key stops the job. Returns the buckets written."""
        def changed(held: DataFrame) -> DataFrame:
            if order is not None:
                return merged(held.withColumn("_key", self._name()), rows.withColumn("_key", self._name()), "_key", order).drop("_key")
            # Keys are checked for themselves, so that rows are exchanged once only, into their buckets.
            names = rows.select(self._name().alias("_key"))
            twice = names.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).first()
            if twice is not None:
                raise ValueError(f"a key is written twice without an order: {twice['_key']}")
            kept = held.withColumn("_key", self._name()).join(names, "_key", "left_anti").drop("_key")
            return kept.unionByName(rows.select(*held.columns))

        return self._change(rows, writer, batch, changed, notes)

    def insert(self, rows: DataFrame, writer: str, batch: int) -> list[str]:
        """Rows whose key is not stored yet, one for each."""
        def added(held: DataFrame) -> DataFrame:
            fresh = rows.dropDuplicates(self.keys).join(held.select(*self.keys), self.keys, "left_anti")
            return held.unionByName(fresh.select(*held.columns))

        return self._change(rows, writer, batch, added)

    def delete(self, keys: DataFrame, writer: str, batch: int) -> list[str]:
        return self._change(keys, writer, batch, lambda held: without(
            held.withColumn("_key", self._name()), keys.select(self._name().alias("_key")).distinct(), "_key").drop("_key"))

    def _name(self) -> Column:
        return F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})

    def _change(self, rows: DataFrame, writer: str, batch: int, change, notes: dict[str, int] | None = None) -> list[str]:
        commit = self.last()
        if commit.writers.get(writer, -1) >= batch:
            return []
        held, buckets = self.touched(rows, commit)
        folder = f"{commit.number + 1:012d}-{uuid.uuid4().hex}"
        after = change(held).select(*self.schema.fieldNames()).withColumn("_bucket", self.bucket())
        after.repartition(max(1, min(len(buckets), self.buckets)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        full = {n.removeprefix("_bucket=") for n in list_names(self.spark, f"{self.path}/data/{folder}")}
        places = {b: p for b, p in commit.buckets.items() if b not in buckets} | {b: folder for b in buckets if b in full}
        following = Commit(commit.number + 1, places, commit.writers | {writer: batch}, commit.notes | (notes or {}))
        if not create_file(self.spark, f"{self.path}/commits/{following.number:012d}", json.dumps(following.__dict__)):
            remove(self.spark, f"{self.path}/data/{folder}")
            raise RuntimeError(f"another writer changed {self.path} meanwhile")
        return buckets

    def vacuum(self, keep: int = 10) -> None:
        """Delete folders that none of the last ``keep`` commits reads, and the files of the commits before."""
        names = sorted(n for n in list_names(self.spark, f"{self.path}/commits") if n.isdigit())
        used = set()
        for name in names[-keep:]:
            used |= set(json.loads(read_text(self.spark, f"{self.path}/commits/{name}"))["buckets"].values())
        for folder in list_names(self.spark, f"{self.path}/data"):
            if folder not in used and folder < names[-1]:
                remove(self.spark, f"{self.path}/data/{folder}")
        for name in names[:-keep]:
            remove(self.spark, f"{self.path}/commits/{name}")
