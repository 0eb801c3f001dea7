"""Stage results written to shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
_own: list[str] = []
_made: list[str] = []


def stage_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session without one uses a folder of its own, which goes when
    the process ends and is not written into the session's settings."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{SETTING} must name a shared folder on a cluster")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Used where several branches read one expensive result: they would compute it again each, and a lost executor would
    force all of them back to the source.
    """
    path = f"{stage_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows of ``schema``, which the optimizer knows to be none; a list without rows is read by Python tasks."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)


def clear(spark: SparkSession) -> None:
    """Delete all stages of this process, on whatever file system they are. Results that are still lazy read their stages,
    so the caller writes what it needs first."""
    while _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
