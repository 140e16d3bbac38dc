"""Connected components of a large sparse graph by label passing and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``id, label``: for every end of an edge (``a, b``) the smallest id that it reaches.

    ``labels`` may give a start: ids with labels that are reachable from them.
    A round takes the least label among a node and its neighbours, and then the
    label of that label, so that chains shrink by half. Minima are taken before
    rows leave a task, so a node with very many neighbours is no bottleneck.
    Only the number of changed labels reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    ids = both.select(F.col("a").alias("id")).distinct()
    if labels is None:
        now = stored(ids.withColumn("label", F.col("id")))
    else:
        known = labels.select("id", "label")
        now = stored(known.union(ids.join(known, "id", "left_anti").withColumn("label", F.col("id"))))
    while True:
        offered = both.join(now.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("label").alias("label"))
        # A label also offers itself to the node that it names, so merging two stars moves their centres.
        upward = both.join(now.withColumnRenamed("id", "b"), "b").join(now.select(F.col("id").alias("a"), F.col("label").alias("own")), "a").select(
            F.col("own").alias("id"), F.col("label").alias("label")
        )
        least = now.union(offered).union(upward).groupBy("id").agg(F.min("label").alias("label"))
        least = stored(least)
        jumped = least.join(least.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select(
            "id", F.least("label", "next").alias("label")
        )
        following = stored(jumped)
        changed = following.join(now.withColumnRenamed("label", "old"), "id", "left").where("old IS NULL OR label <> old").limit(1).count()
        now = following
        if not changed:
            return now
