"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shuffled


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node, least) with ``least`` lowered to the smallest one that chains of ``links`` (a, b) reach.

    Every node that a link names must be among the nodes; a node without links
    keeps its value. Works on the linked nodes alone. Each round gives a node
    the smallest root that its neighbours point to, and roots that lost are
    joined to what they lost to, so that the number of rounds grows with the
    logarithm of the longest chain. The rounds are written to the shared folder;
    nothing passes through the driver.
    """
    edges = links.where("a <> b").select("a", "b")
    edges = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = nodes.join(shuffled(edges.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
    # roots are ordered by (least, node): two nodes can share a least value
    state = saved(linked.select("node", F.struct("least", "node").alias("root")))
    while True:
        seen = edges.join(shuffled(state.select(F.col("node").alias("b"), "root")), "b").groupBy("a").agg(F.min("root").alias("near"))
        told = state.join(shuffled(seen.withColumnRenamed("a", "node")), "node")
        # what a node has seen, its root learns too
        lower = told.where("near < root").select(F.col("root.node").alias("node"), "near").unionByName(told.select("node", F.least("near", "root").alias("near")))
        lower = lower.groupBy("node").agg(F.min("near").alias("near"))
        hooked = saved(state.join(shuffled(lower), "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")))
        # then every node takes its root's root
        up = hooked.select(F.col("node").alias("up"), F.col("root").alias("next"))
        state = saved(hooked.join(shuffled(up), F.col("root.node") == F.col("up")).select("node", F.least("root", "next").alias("root")))
        if hooked.where("moved").isEmpty():
            break
    return nodes.join(shuffled(state.select("node", F.col("root.least").alias("root_least"))), "node", "left").select("node", F.coalesce("root_least", "least").alias("least"))
