"""Small files on whatever file system Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under a name of its own and rename it; false if ``path`` is there already."""
    where, files = _at(spark, path)
    if files.exists(where):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, False)
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    where, files = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    where, files = _at(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)
