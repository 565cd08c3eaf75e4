"""Connected components of an edge table, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`(node, root)` of every node that has an edge `(a, b)`; the root is the least node it reaches.

    Each round, every node takes the least root among its own and its
    neighbours' and then that root's root, so long chains shorten by halves.
    Rounds are written to the shared folder; only a count reaches the driver.
    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.save(both, "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "root": "theirs"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        low = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "theirs").alias("root"))
        low = scratch.save(low, "low")
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("above"))
        fresh = scratch.save(low.join(jump, "root", "left").select("node", "old", F.coalesce("above", "root").alias("root")), "labels")
        moved = fresh.where("old <> root").limit(1).count()
        scratch.drop(labels, low)
        labels = fresh.select("node", "root")
        if not moved:
            scratch.drop(both)
            return labels
