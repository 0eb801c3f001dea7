"""Declared schemas, table readers and the mapping of the input tables onto the operator inputs."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2 and f[2]) for f in fields])


_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()

# The stored tables. A third element marks a nullable column.
SCHEMAS: dict[str, T.StructType] = {
    "document_sources": _struct(
        ("id", _L), ("knowledge_scope", _S), ("document_id", _S), ("source_ref", _S),
        ("active_version_id", _L, True), ("created_at", _TS, True), ("updated_at", _TS, True)),
    "document_versions": _struct(
        ("id", _L), ("document_source_id", _L), ("content_hash", _S), ("parser_version", _S),
        ("chunk_policy_hash", _S), ("status", _S), ("target_collection", _S), ("chunk_count", _L),
        ("error_message", _S), ("created_at", _TS, True), ("activated_at", _TS, True), ("updated_at", _TS, True)),
    "document_chunk_manifests": _struct(
        ("document_version_id", _L), ("chunk_id", _S), ("structure_kind", _S), ("heading_path", _S),
        ("ordinal", _L), ("content_hash", _S), ("token_count", _L), ("point_id", _S)),
    "memory_items": _struct(
        ("id", _L), ("user_id", _S), ("kind", _S), ("memory_key", _S), ("value", _S), ("status", _S),
        ("version", _L), ("created_at", _TS, True), ("updated_at", _TS, True)),
    "memory_item_evidence": _struct(
        ("memory_item_id", _L), ("user_id", _S), ("source_session_id", _S), ("source_message_id", _L),
        ("source_role", _S), ("operation", _S), ("evidence_text", _S), ("created_at", _TS, True)),
    "recent_chat_messages": _struct(
        ("id", _L), ("session_id", _S), ("user_id", _S), ("role", _S), ("content", _S), ("created_at", _TS)),
    "session_summaries": _struct(
        ("session_id", _S), ("user_id", _S), ("content", _S), ("last_message_id", _L), ("version", _L),
        ("created_at", _TS, True), ("updated_at", _TS, True)),
}

GOLDEN_CASES = T.StructType([
    T.StructField("case_id", _S), T.StructField("query", _S), T.StructField("knowledge_scope", _S),
    T.StructField("expected_chunk_ids", T.ArrayType(_S)), T.StructField("forbidden_chunk_ids", T.ArrayType(_S)),
    T.StructField("notes", _S),
])


#: A session that reads a few small files may ask for so many partitions. Unset, files are split as the session says.
READ_PARTITIONS = "spark.groundwell.readPartitions"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one input table."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> list[str]:
    """Create the stored tables that do not exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    for name, schema in SCHEMAS.items():
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(SCHEMAS)


def read_documents(spark: SparkSession, path: str, scope: str, fmt: str) -> DataFrame:
    """Files below ``path`` as documents; the relative path is both the source reference and the basis of the
    document id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # The reader reports full URIs, so the part after the folder is what counts.
    root = path.split(":", 1)[-1].rstrip("/") + "/"
    ref = F.substring_index(F.col("path"), root, -1)
    return files.select(
        F.lit(scope).alias("knowledge_scope"),
        F.regexp_replace(ref, "[^A-Za-z0-9_.:-]", "_").alias("document_id"),
        ref.alias("source_ref"),
        F.lit(fmt).alias("format"),
        F.decode("content", "UTF-8").alias("content"),
    )


def read_golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array file of golden cases."""
    return spark.read.schema(GOLDEN_CASES).option("multiLine", "true").json(path)


def read_messages_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """S03 option: messages from a relational store; filters and limits are pushed down by the source."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


# --- the given tables as operator inputs ------------------------------------------------------------------------


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("lang").alias("title"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("source_ref"),
        "text",
        F.array("lang", "source").alias("tags"),
    )


def structured_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(
        F.col("source").alias("knowledge_scope"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("source_ref"),
        F.lit("markdown").alias("format"),
        F.col("text").alias("content"),
        F.col("lang").alias("title"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return as_messages(read(spark, folder, "conversations"))


def as_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.pmod("conv_id", F.lit(37)).cast("string").alias("user_id"),
        "role",
        F.col("text").alias("content"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("turn").cast("decimal(18,6)")))
        .alias("created_at"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("tenant"), F.col("embedding").alias("vector"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Events as memory candidates; the event id is the arrival position and, plus one, the cited message id."""
    return as_candidates(read(spark, folder, "events"))


def as_candidates(events: DataFrame) -> DataFrame:
    kinds = {"view": "preference", "click": "goal", "signup": "identity", "purchase": "project_fact",
             "error": "constraint"}
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.lit("events").alias("session_id"),
        F.col("event_id").alias("position"),
        F.when(k % 4 == 3, "forget").otherwise("upsert").alias("operation"),
        F.coalesce(*[F.when(F.col("event_type") == e, F.lit(m)) for e, m in kinds.items()]).alias("kind"),
        F.concat(F.lit("k"), (k % 5).cast("string")).alias("key"),
        F.concat(F.lit("Value "), F.floor(F.col("value") / 20).cast("string")).alias("value"),
        F.lit(1.0).alias("confidence"),
        F.array(F.col("event_id") + 1).alias("source_message_ids"),
    )


def dialogue_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One Markdown document per conversation turn: headings, a colon line and a fenced block around the text."""
    turn = F.col("turn").cast("string")
    body = F.concat(
        F.lit("# "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\n\n## Turn "), turn,
        F.lit("\n\n```text\n"), F.col("text"), F.lit("\n```\n\nNotes:\n"), F.col("text"),
    )
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn)
    return read(spark, folder, "conversations").select(
        F.concat(F.lit("conv"), (F.col("conv_id") % 7).cast("string")).alias("knowledge_scope"),
        key.alias("document_id"),
        F.col("role").alias("title"),
        F.concat(F.lit("dialogue/"), key, F.lit(".md")).alias("source_ref"),
        F.lit("markdown").alias("format"),
        body.alias("text"),
        body.alias("content"),
        F.array("role").alias("tags"),
    )
