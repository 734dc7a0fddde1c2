"""Distributed connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst): root is the smallest node of its component.

    Each round links every node to the smallest one it knows of; the number of rounds grows with the
    logarithm of the longest path. The minima are written down before they meet the edges, so that a
    hub's rows are a plain skewed join, which Spark splits. Nothing but counts reaches the driver.
    """
    links = cut_lineage(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select("dst", "src")).toDF("src", "dst")
        least = cut_lineage(both.groupBy("src").agg(F.least("src", F.min("dst")).alias("least")))
        wide = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        wide = cut_lineage(wide)
        least = cut_lineage(wide.groupBy("src").agg(F.min("dst").alias("least")))
        met = wide.join(least, "src")
        links = met.filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        links = cut_lineage(links.union(least.select("src", "least")).distinct())
    return links.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(links.select("dst", "dst").distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
