"""Mixing sources to target weights by systematic sampling.

Sources, in code point order with null last, weigh 5, 2, 1, repeating. They share the corpus size by weight; a target stops
at ``cap`` times its source's size and the excess is shared again among the others. Every document of a source expects
target / size copies. Within a source the expected copies are summed up in a fixed order, one offset is added, and a
document is emitted once for every integer boundary that its share of the sum crosses.

Only DataFrame functions are used. The order is size class, then md5 of the id, then size, which spreads each class evenly.
Prefix sums have two levels: documents are ranked within buckets (source, size class, first two digits of the md5), whose
counts are summed up in a narrow table, so that one source with a third of all rows is ranked in many tasks.

Defined results: a null text has size 0; documents of size 0 may be emitted but take no words; a source of size 0 has target
0; a null source is a source of its own; a null id is ordered by the md5 of the empty text; rows that tie on id and size are
interchangeable; an empty table gives no rows. Other columns pass through in ``row``. Ids are expected to be mostly distinct:
rows that share one id are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.common import key_of, query, table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to a table of ``source_key, source_size``, one row per source.

    With sources in ascending order of cap / weight, the common level per weight is the largest of (what is left after the
    earlier caps) / (what weight is left): below it each earlier source is capped, above it none is.
    """
    whole = Window.partitionBy()
    place = Window.orderBy(F.col("source_key") == "n", "source_key")
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumns({
            "left": F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        })
        .withColumn("level", F.max(F.col("left").cast("double") / F.col("weight_left")).over(whole))
        .select("source_key", "source_size",
                F.least(F.col("source_size").cast("double") * cap, F.col("level") * F.col("weight")).alias("target"))
    )


def mix(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED,
        keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """``row`` (the columns ``keep``), ``size, source_size, target, copies`` for every document. Only what ``row`` holds is
    shuffled beside the keys."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    size = words(F.col(text))
    key = {"source_key": key_of(source), "size": size, "digest": digest}
    digits = F.col("size").cast("string")
    bucket = {"class": F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int"), "slice": F.substring("digest", 1, 2)}
    names = ["source_key", "class", "slice"]

    narrow = documents.select(*[c.alias(n) for n, c in key.items()]).withColumns(bucket)
    counts = narrow.groupBy(names).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = counts.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    earlier = Window.partitionBy("source_key").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "source_key")), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    plan = (
        counts.select(*names, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        .join(targets(sizes), "source_key")
        .withColumns({"offset": offset,
                      "expected": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)})
    )
    ordered = Window.partitionBy(names).orderBy("digest", "size")
    share = F.col("expected") - F.floor("expected")
    crossed = (F.floor(F.col("offset") + F.col("rank") * share) - F.floor(F.col("offset") + (F.col("rank") - 1) * share))
    return (
        documents.select(F.struct(*keep).alias("row"), *[c.alias(n) for n, c in key.items()]).withColumns(bucket)
        .join(plan, names)
        .withColumn("rank", F.col("before") + F.row_number().over(ordered))
        .select("row", "size", "source_size", "target", (F.floor("expected") + crossed).cast("int").alias("copies"))
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it was drawn."""
    return (mixed.filter(F.col("copies") > 0)
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS source_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), sizes AS (
  SELECT source_key, sum(size)::BIGINT AS source_size,
         list_value(5, 2, 1)[((row_number() OVER (ORDER BY source_key = 'n', source_key) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source_key
), levels AS (
  SELECT *, max((sum_all - capped)::DOUBLE / (weight_all - weight_used)) OVER () AS level FROM (
    SELECT *, sum(source_size) OVER () AS sum_all, sum(weight) OVER () AS weight_all,
      coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
      coalesce(sum(weight) OVER (ORDER BY source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_used
    FROM sizes)
), aims AS (
  SELECT source_key, source_size, least(source_size::DOUBLE * 3, level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(source_size::DOUBLE * 3, level * weight) / source_size ELSE 0.0 END AS expected,
         ('0x' || substr(md5('mix-1|' || source_key), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS shift
  FROM levels
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY
    length(size::VARCHAR) * 10 + substr(size::VARCHAR, 1, 1)::INT, digest, size) AS rank
  FROM docs
)
SELECT doc_id, size, source_size, target,
  (size * (floor(expected) + floor(shift + rank * (expected - floor(expected)))
                           - floor(shift + (rank - 1) * (expected - floor(expected)))))::BIGINT AS taken
FROM ranked JOIN aims USING (source_key)
"""


@query("op8_source_mixing", SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), keep=("doc_id",))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
