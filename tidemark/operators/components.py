"""Connected components by smallest label, with path halving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of the component as its name.

    Each round takes the smallest label among the neighbours (a combinable ``min``, so a node with very
    many edges is reduced before the shuffle) and then replaces a label by that label's own label, which
    makes the number of rounds logarithmic on long chains. Rounds go on until no neighbour offers a smaller
    label; every round is written to the checkpoint folder.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut_lineage(both.filter("src <> dst").distinct())
    labels = nodes.select("node", F.col("node").alias("component"))
    while True:
        offered = (
            both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("offer"))
        )
        step = labels.join(offered, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("offer", "component")).alias("component")
        )
        step = cut_lineage(step)
        if not step.filter("old <> component").limit(1).count():
            return step.select("node", "component")
        parent = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = step.join(parent, "component").select("node", F.least("component", "up").alias("component"))
