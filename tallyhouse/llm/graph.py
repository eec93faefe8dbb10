"""Connected components by min-label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node it can reach.

    Each round a node takes the least label among its own and its neighbours',
    offers it to its current root as well, and then follows one pointer. Rounds
    grow with the logarithm of the longest path; every round is a written table,
    so nothing is recomputed when an executor is lost. Labels come together in
    pre-aggregated minima, so a node with many links is no hot key.
    """
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), f"{name}-both")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = (both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node"))
                .agg(F.min("label").alias("near")))
        own = labels.join(near, "node")
        offers = (own.select("node", F.least("label", "near").alias("label"))
                  .union(own.select(F.col("label"), F.least("label", "near")))
                  .groupBy("node").agg(F.min("label").alias("label")))
        hooked = scratch.cut(offers, f"{name}-{turn}h")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        new = scratch.cut(hooked.join(up, "label", "left").select(
            "node", F.coalesce("_up", "label").alias("label")), f"{name}-{turn}")
        changed = new.join(labels.withColumnRenamed("label", "_old"), "node").where("label != _old").limit(1).count()
        scratch.drop([f"{name}-{turn - 1}", f"{name}-{turn}h"])
        labels = new
        if not changed:
            scratch.drop([f"{name}-both"])
            return labels
