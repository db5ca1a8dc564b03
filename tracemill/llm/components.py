"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut_lineage


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Links (a, b) rewired to the smallest neighbour m of each node: from larger neighbours, or from the smaller ones and itself."""
    around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if both:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of links (a, b) of one orderable type; root is the smallest node reachable.

    Each round is a few shuffles over the links, and their number shrinks to one per node; what a node with many links
    receives is combined before the shuffle, and joins on it can be split. Rounds grow with the logarithm of the longest
    path. Links of a node with itself are dropped; no links give no rows.
    """
    canonical = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = cut_lineage(canonical(links))
    seen = state(links)
    while seen[0]:
        links = cut_lineage(canonical(_stars(canonical(_stars(links, True)), False)))
        before, seen = seen, state(links)
        if seen == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
