"""Connected components of links, kept in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of links (a, b long).

    Labels are lowered to the least one among neighbours and then to their own label's label, which makes chains of hops
    shrink by half; each round is written to the shared folder. A node with very many links is pre-aggregated as a
    receiver and split by skew handling as a sender.
    """
    with scratch():
        links = links.select("a", "b").where("a <> b")
        both = stored(links.union(links.select("b", "a")).distinct(), "links")
        labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
            lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
            jump = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
            new = lower.join(jump, "component", "left").select("node", "old", F.least("component", "jump").alias("component"))
            new = stored(new, "labels")
            changed = new.where("component < old").count()
            labels = new.select("node", "component")
            if not changed:
                return stored(labels, "components", outlive=True)
