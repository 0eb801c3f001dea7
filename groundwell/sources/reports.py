"""Upload reports (S08, A10): nested JSON requests to one row per file, and the state of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("filesize", T.LongType()),
    T.StructField("uploaded_size", T.LongType()), T.StructField("status", T.IntegerType()),
    T.StructField("upload_time", T.LongType()), T.StructField("cost_time", T.LongType()),
    T.StructField("error_info", T.StringType()), T.StructField("file_type", T.StringType()),
    T.StructField("cloud_type", T.StringType()),
])
REQUEST = T.StructType([
    T.StructField("pid", T.StringType()), T.StructField("progress", T.IntegerType()),
    T.StructField("extra_upload_info", T.ArrayType(FILE)),
])

# Two code sets are in use. Reports of whole files know four codes, resumable uploads five.
WHOLE_FILE_CODES = {"pending": (0, 1), "failed": (2,), "success": (3,)}
RESUMABLE_CODES = {"pending": (0, 1, 2), "success": (3,), "failed": (4,)}


def parse_reports(requests: DataFrame) -> DataFrame:
    """``requests`` has the JSON in ``body``; works on streams as well."""
    parsed = requests.withColumn("r", F.from_json("body", REQUEST))
    kept = [c for c in requests.columns if c != "body"]
    return parsed.select(*kept, "r.pid", "r.progress", F.explode("r.extra_upload_info").alias("f")).select(
        *kept, "pid", "progress", "f.*")


def batch_progress(files: DataFrame, codes: dict[str, tuple[int, ...]]) -> DataFrame:
    """A10: latest report per file, then counts and bytes per batch. A report without a time is the oldest; reports
    of one time are ordered by status and sizes, so that the choice is the same on every run."""
    at = F.coalesce("upload_time", F.lit(0))
    latest = files.groupBy("pid", "key").agg(
        F.max_by(F.struct("status", "filesize", "uploaded_size"), F.struct(
            at, "status", "uploaded_size", "filesize")).alias("l")
    ).select("pid", "key", "l.*")
    return latest.groupBy("pid").agg(
        F.count(F.lit(1)).alias("files"),
        *[F.count_if(F.col("status").isin(*values)).alias(name) for name, values in codes.items()],
        F.sum("filesize").alias("bytes"),
        F.sum(F.coalesce("uploaded_size", F.lit(0))).alias("uploaded_bytes"),
    ).withColumn("completion", F.round(F.col("success") / F.col("files"), 6))
