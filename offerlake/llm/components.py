"""Connected components of a graph of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns vertex, component (the smallest vertex it reaches), for the vertices with links.

    Each round takes the smallest label of the neighbours, then the label of that label. Rounds are
    written to the shared folder, so lineage stays short and a lost executor repeats one round at most.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    if both.isEmpty():
        return both.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    labels = both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.col("vertex")).alias("component"))
    labels = stage(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("vertex").alias("b"), "component"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("near"))
        least = labels.join(near, "vertex").select("vertex", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        hop = least.select(F.col("vertex").alias("component"), F.col("component").alias("further"))
        stepped = stage(least.join(hop, "component", "left").select("vertex", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        drop(labels)
        labels = stepped.select("vertex", "component")
        labels.staged_at = stepped.staged_at
        if stepped.where("component <> was").isEmpty():
            return labels
