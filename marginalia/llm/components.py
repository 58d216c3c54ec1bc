"""Connected components over pairs, in rounds that are each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize


def components(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(key, group): the least key of each key's connected component over pairs (a, b).

    Labels go to the neighbours and are then followed one step (a label's own label); rounds grow as the logarithm of
    the longest chain. The driver only learns whether a round changed anything. Empty pairs give no rows."""
    edges = materialize(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, "a").select("a", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = step.join(labels.select(F.col("a").alias("l"), F.col("l").alias("ll")), "l", "left").select("a", "was", F.coalesce(F.least("l", "ll"), "l").alias("l"))
        new = materialize(jump, "labels")
        labels = new.select("a", "l")
        if new.where("l != was").limit(1).count() == 0:
            return labels.select(F.col("a").alias("key"), F.col("l").alias("group"))
    raise RuntimeError("components need more rounds")
