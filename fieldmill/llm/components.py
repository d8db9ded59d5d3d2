"""Connected components of a link table, as Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of a link; the label is the least node of its component.

    Each round a node takes the least label among itself and its neighbours, then the label of that label, so chains
    shorten by more than half a round. Every round is written, which ends its lineage, and replaces the table of the
    round before. Whether a label changed is the only result that comes to the driver. A node with many links is pre-aggregated by ``min`` before its shuffle.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = stored(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near")))
        best = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        new = stored(best.join(jump, "best", "left").select(
            "node", F.least("best", "further").alias("label"), (F.least("best", "further") < F.col("label")).alias("changed")), "labels")
        discard(labels)
        labels = new.select("node", "label")
        if new.filter("changed").isEmpty():
            discard(edges)
            return labels
