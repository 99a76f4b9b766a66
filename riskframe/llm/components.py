"""Connected components over edge tables, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge (a, b) names.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so a chain of n nodes needs about log n rounds.  Rounds are written to the shared
    folder; only one count per round reaches the driver.  Hub nodes pre-aggregate by ``min``
    before the shuffle.  No edges give an empty table.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")),
                     "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        low = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        moved = written(low.join(hop, "low").select("node", F.col("component").alias("before"),
                                                    F.least("low", "next").alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("before <> component").isEmpty():
            return labels
