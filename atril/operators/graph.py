"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril.session import materialise


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `component`) of every linked node, the component being its smallest node.

    Every round a node takes the smallest label among its neighbours and itself, and then the label of the node
    that label names, which shortens chains by half.  Rounds are written to the shared folder.  A node with very many
    links is one row on the side of the labels; its links are on the side AQE can split.
    """
    one_way = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialise(one_way.unionByName(one_way.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        taken = materialise(labels.join(around, "node").select(
            "node", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved")), "labels")
        further = taken.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialise(taken.join(further, "component").select("node", F.least("component", "next").alias("component")), "labels")
        if taken.where("moved").isEmpty():
            return labels
