"""Connected components by contraction joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, small


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is one node of the component, the same for all of it.

    Each round hooks every node to the least of itself and its neighbours and replaces nodes by their hooks in the links;
    links inside a hook vanish, and rounds end when none is left. Hooks are minima with map-side combining, so a hub is
    no hot task; no graph is gathered anywhere. Self-links give single components, an empty table an empty result.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels, left = scratch.save(nodes.select("node", F.col("node").alias("root")), "labels"), links.where("a <> b")
    while True:
        both = left.select("a", "b").union(left.select("b", "a"))
        hooks = scratch.save(both.groupBy(F.col("a").alias("from")).agg(F.least("a", F.min("b")).alias("to")).where("from <> to"), "hooks")
        near = small(hooks)
        a, b = near.toDF("a", "a2"), near.toDF("b", "b2")
        left = scratch.save(left.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")).where("a <> b").distinct(), "left")
        labels = scratch.save(labels.join(near.toDF("root", "up"), "root", "left").select(
            "node", F.coalesce("up", "root").alias("root")), "labels")
        if not left.limit(1).count():
            return labels
