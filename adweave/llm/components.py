"""Connected components of an edge table by minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small, stored


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, for every node of edges (columns a, b), stored.

    Each round takes the least label among a node and its neighbours, then the label
    of that label; rounds are about the logarithm of the longest path. Neighbours are
    aggregated before the shuffle, so a node with many edges is no hot task. Labels of
    few nodes are broadcast. Loops and repeated edges don't count; no edges give no rows.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    e = stored(both.filter("u <> v").distinct(), "edges")
    label = stored(e.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("comp")), "labels")
    while True:
        known = small(label.select("node", "comp"))
        own = label.select("node", "comp", F.col("comp").alias("old"))
        near = e.join(known.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "comp", F.lit(None).cast("long").alias("old"))
        lower = own.union(near).groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old"))
        up = known.toDF("comp", "top")
        new = stored(lower.join(up, "comp", "left").select("node", F.least("comp", "top").alias("comp"), "old"), "labels")
        moved = not new.filter("old <> comp").isEmpty()
        forget(label)
        label = new
        if not moved:
            out = stored(label.select("node", "comp"), "labels")
            forget(e, label)
            return out
