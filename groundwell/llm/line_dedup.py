"""Line dedup by site-relative frequency.

Pages are grouped by host. For every line, the pages of the host that hold it are counted (once each) and divided by the
pages of the host; lines above ``max_ratio`` that stand on at least ``min_pages`` pages are boilerplate and are dropped.

Only DataFrame functions are used. Texts are never shuffled: counting moves 64-bit line hashes, summed before the
exchange, so a hot host or line costs one row per task. A host has at most (mean lines of its pages) / ``max_ratio``
boilerplate lines, so the list that is joined back to each page is bounded. Two lines of one host with equal hashes count
as one line.

Defined results: a null text has no lines and stays null; an empty text is one blank line; blank lines are never counted
or dropped; a null host is a host of its own; repeated rows are pages of their own; an empty table gives no rows. Other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.common import key_of, query, table
from groundwell.operators.stages import materialize


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, text: str, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``host_key, dropped``: the hashes of each host's boilerplate lines."""
    keyed = pages.select(key_of(host).alias("host_key"), F.col(text).alias("text"))
    totals = keyed.groupBy("host_key").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    counts = (keyed.select("host_key", F.explode(hashes).alias("line")).groupBy("host_key", "line")
              .agg(F.count(F.lit(1)).alias("holding")).filter(F.col("holding") >= min_pages))
    return (counts.join(totals, "host_key").filter(F.col("holding") / F.col("pages") > max_ratio)
            .groupBy("host_key").agg(F.collect_list("line").alias("dropped")))


def dedup_lines(pages: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1,
                min_pages: int = 2) -> DataFrame:
    """All columns of ``pages`` in a struct ``page``, with ``kept`` (the text without boilerplate), ``n_lines`` and
    ``n_dropped``."""
    found = materialize(boilerplate(pages, text, host, max_ratio, min_pages))
    packed = pages.select(F.struct("*").alias("page"), key_of(host).alias("host_key"), _lines(F.col(text)).alias("lines"))
    stays = F.filter("lines", lambda x: _blank(x) | ~F.array_contains("dropped", F.xxhash64(x)))
    return packed.join(found, "host_key", "left").select(
        "page", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), "lines",
        F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(stays).alias("stays"),
    ).select("page", F.array_join("stays", "\n").alias("kept"),
             F.greatest(F.lit(0), "n_lines").cast("long").alias("n_lines"),
             F.greatest(F.lit(0), F.col("n_lines") - F.size("stays")).cast("long").alias("n_dropped"))


SQL = r"""
WITH pages AS (
  SELECT row_number() OVER () AS page, doc_id, text, source,
         CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS host FROM documents
), lines AS (
  SELECT page, host, i, lines[i] AS line FROM (
    SELECT page, host, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
      SELECT page, host, string_split(text, chr(10)) AS lines FROM pages WHERE text IS NOT NULL))
), totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
frequent AS (
  SELECT host, line FROM lines JOIN totals USING (host) WHERE trim(line, ' ') <> ''
  GROUP BY host, line HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) / any_value(pages) > 0.1
), folded AS (
  SELECT page, count(*) AS n_lines, count(frequent.line) AS n_dropped,
         coalesce(string_agg(lines.line, chr(10) ORDER BY i) FILTER (frequent.line IS NULL), '') AS kept
  FROM lines LEFT JOIN frequent USING (host, line) GROUP BY page
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN length(kept)::BIGINT END AS kept_chars,
       CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM pages LEFT JOIN folded USING (page)
"""


@query("op7_line_dedup", SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return dedup_lines(documents).select(
        "page.doc_id", "n_lines", "n_dropped", F.length("kept").cast("long").alias("kept_chars"),
        F.sha2("kept", 256).alias("kept_sha256"))
