"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.lineage import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, comp): the smallest node that each linked node reaches.

    Each round takes the least label among a node and its neighbours, then the label of that label;
    minima combine in the map tasks, so a hub costs no more than its links.  Labels are written each
    round, and rounds grow with the logarithm of the longest chain.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near")))
        lower = stored(labels.join(near, labels["node"] == near["a"])
                       .select("node", "comp", F.least("comp", "near").alias("low")))
        parent = lower.select(F.col("node").alias("up"), F.col("low").alias("top"))
        jumped = stored(lower.join(parent, lower["low"] == parent["up"])
                        .select("node", F.least("low", "top").alias("comp"), (F.col("comp") != F.least("low", "top")).alias("moved")))
        labels = jumped.select("node", "comp")
        if jumped.filter("moved").isEmpty():
            return labels
