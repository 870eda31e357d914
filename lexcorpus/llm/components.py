"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps are one grouping (the smallest neighbour of each node, combined before the exchange)
and one join, so a node with very many links is neither collected nor paired with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, keep


def _star(links: DataFrame, small: bool) -> DataFrame:
    """``links`` (a > b) with each node's neighbours hung on the smallest of them."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least, "a")
    if small:  # the neighbours below a node, and the node itself
        hung = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    else:  # the neighbours above a node
        top = F.least("a", "least")
        hung = joined.where("b > a").select(F.col("b").alias("a"), top.alias("b")).unionByName(
            least.where("a > least").select("a", F.col("least").alias("b"))
        )
    hung = hung.where("a > b")
    return hung.distinct() if small else hung


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)`` but the components' smallest nodes."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    current, mark = keep(pairs, "links"), None
    while True:
        stepped = keep(_star(_star(current, small=False), small=True), "links")
        discard(current)
        current = stepped
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
