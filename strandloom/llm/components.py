"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each linked id reaches, for ids that are not the smallest themselves.

    links has two columns of ids, without nulls. Every round joins each link with the smallest neighbour of one of its ends:
    rows of a hub spread over many tasks, as Spark splits the links' side of the join. Rounds are written to shared storage.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = materialize(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialize(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(least, "u").filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = materialize(moved.union(least.select("u", F.col("low").alias("v"))).distinct(), "small-stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
