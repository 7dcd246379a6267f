"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Links (a, b) -> (node, component): the smallest node that can be reached.

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, twice (pointer jumping), so chains shrink fourfold; every
    round is stored as a table in the shared folder.  Nodes with many links are spread by the partial
    aggregation before each shuffle.  No links: an empty result.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(max_rounds):
        near = (both.join(label.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = label.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("low"))
        for to in ("low1", "low2"):  # the label of the label, twice
            up = label.select(F.col("node").alias("low"), F.col("component").alias(to))
            step = step.join(up, "low", "left").select("node", "component", F.least("low", to).alias("low"))
        new = stored(step.withColumnRenamed("low", "new"))
        if not new.where("new <> component").limit(1).count():
            return label
        label = new.select("node", F.col("new").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
