"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: `links` (a, b) as an undirected graph; the component is its smallest node.

    Each round every node takes the smallest label among its neighbours and then that label's own label, so paths
    shorten by half. Only counts reach the driver; each round is written, so lost executors cost one round, and what it
    supersedes is deleted.
    """
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component"), F.lit(True).alias("moved")))
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        ends = labels.select(F.col("node").alias("to"), F.col("component").alias("end"))
        component = F.least("to", "end")
        new = scratch.keep(hooked.join(ends, "to").select("node", component.alias("component"), (component != F.col("old")).alias("moved")))
        scratch.drop(labels)
        labels = new
        if labels.where("moved").isEmpty():
            scratch.drop(edges)
            return labels
