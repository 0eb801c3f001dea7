"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.operators.stages import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``: the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours, then follows that label once more, so that chains
    shrink by half. Every round is written to the shared folder, which cuts the lineage.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low"))
                         .select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        heard = (both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("label").alias("low"))
                 .withColumnRenamed("a", "node"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(nearer.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        if after.filter("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
