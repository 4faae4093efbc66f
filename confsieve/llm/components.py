"""Connected components of a link table by large-star and small-star rounds, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confsieve.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node but the roots; the root is the smallest node of its component.

    Each round hangs neighbours on the smallest node near them; their number is logarithmic in the size of a component. A node with
    many links is never gathered: minima are aggregates, and they meet the links in a join of two written tables, which can be split.
    The driver gets a count and a checksum a round.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    edges, mark = cut_lineage(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "links-min")
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct(), "links")  # here v < u
        lowest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")), "links-min")
        hung = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut_lineage(hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
