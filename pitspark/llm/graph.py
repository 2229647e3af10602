"""Connected components of a link table, without ever holding a component in one place.

Large-star and small-star steps in turn: each hangs the neighbours of a node under the smallest of them.
Both are a grouped minimum and an equi-join, so a node with very many links is pre-aggregated and its join
side can be split. The driver sees one checksum a round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.session import durable


def _hang(links: DataFrame, own: str, other: str) -> DataFrame:
    """For links (own, other): every other, and own itself, under the smallest of them all."""
    least = links.groupBy(own).agg(F.least(F.col(own), F.min(other)).alias("_m"))
    under = links.join(least, own).select(F.col(other).alias("a"), F.col("_m").alias("b"))
    return under.unionByName(least.select(F.col(own).alias("a"), F.col("_m").alias("b"))).where("a <> b")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every linked node that is not its component's smallest; links are undirected and
    may repeat. Nulls and links of a node to itself count for nothing."""
    edges = (links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
             .where(f"{a} is not null and {b} is not null").where("a <> b").distinct())
    edges, before = durable(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        small = _hang(large.where("a <> b").distinct(), "a", "b")
        edges = durable(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
