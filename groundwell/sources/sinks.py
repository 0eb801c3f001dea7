"""Append sinks: chat turns, conversation log and raw text archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import or_default

ARCHIVE_BUCKETS = 256


def append_turns(turns: DataFrame, path: str) -> None:
    """S05."""
    turns.write.mode("append").parquet(path)


def log_records(answers: DataFrame, chat_model: str, embedding_model: str) -> DataFrame:
    """One record per answer. ``answers`` has the request and answer columns and created_at."""
    return answers.select(
        "session_id", "user_id", "question", "answer", "used_knowledge", "retrieved_chunk_ids",
        or_default(F.coalesce("model", F.lit("")), chat_model).alias("chat_model"),
        F.lit(embedding_model).alias("embedding_model"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        F.to_date("created_at").alias("log_date"),
    )


def append_log(records: DataFrame, path: str) -> None:
    """S06 sink: JSON lines in one folder per calendar day."""
    records.write.mode("append").partitionBy("log_date").json(path)


def archive_texts(documents: DataFrame, path: str, buckets: int = ARCHIVE_BUCKETS, mode: str = "append") -> None:
    """The raw text of every document, in hash buckets instead of one file each."""
    bucketed = documents.select("document_id", "text", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).alias("bucket"))
    bucketed.repartition(F.col("bucket")).write.mode(mode).partitionBy("bucket").parquet(path)
