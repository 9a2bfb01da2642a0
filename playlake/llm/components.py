"""Connected components of an undirected graph, by distributed minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlake.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node of `edges` (a, b); label is the smallest node reachable.

    Each round a node takes the least label among itself and its neighbours, then the label of that
    label; rounds grow with the logarithm of a component's diameter on usual graphs, and each is
    written to the shared folder. Stops when no label changes.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label").unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = scratch.save(after, f"{name}-{step}")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = after
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
