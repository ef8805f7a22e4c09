"""Connected components of a table of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the links (a, b).

    Each round maps every node to the least of itself and its neighbours and contracts the links by that map; what
    is left at least halves where it can shrink at all, so rounds grow with the logarithm of the widest component.
    """
    links = common.pin(links.filter("a <> b").select("a", "b").distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("component"))
    rounds = 0
    while not links.isEmpty():
        least = links.union(links.select("b", "a")).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        to_a, to_b = least.select("a", F.col("to").alias("_a")), least.select(F.col("a").alias("b"), F.col("to").alias("_b"))
        labels = labels.join(least.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        links = common.pin(links.join(to_a, "a").join(to_b, "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        rounds += 1
        if rounds % 3 == 0:  # rounds read pinned links, so that only now and then labels need a cut of their own
            labels = common.pin(labels)
    return labels
