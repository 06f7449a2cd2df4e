"""Genome-wide analyses of events, clusters and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.operators.ordered import neighbour, quantiles
from strandloom.sources.storage import stored


def event_balance(inits: DataFrame, terms: DataFrame, chrom_sizes: DataFrame, width: int) -> DataFrame:
    """Tiles with initiations less terminations, and the sum with the next tile (null for a chromosome's last)."""
    events = inits.select("chrom", "pos", F.lit(1).alias("d")).unionByName(terms.select("chrom", "pos", F.lit(-1).alias("d")))
    n = events.groupBy("chrom", F.expr(f"(pos - 1) div {width} * {width} + 1").alias("s")).agg(F.sum("d").alias("balance"))
    tiles = iv.tile_genome(chrom_sizes, width).join(n, ["chrom", "s"], "left").withColumn("balance", F.coalesce("balance", F.lit(0)))
    tiles = neighbour(tiles, ["chrom"], "s", [], {"next": "balance"}, ahead=True, width=iv.BIN * width)
    return tiles.withColumn("smooth2", F.col("balance") + F.col("next")).drop("next")


def cluster_size_table(clusters: DataFrame) -> DataFrame:
    """For each gap the number of clusters of 1 and of more than 1, 2, 3, 5 and 10 members, and the median width of those of more than one."""
    over = [F.count_if(F.col("eff") > k).alias(f"n_over_{k}") for k in (1, 2, 3, 5, 10)]
    clusters = stored(clusters, "clusters")
    wide = clusters.select("gap", F.when(F.col("eff") > 1, F.col("e") - F.col("s") + 1).alias("width"))
    counts = clusters.groupBy("gap").agg(F.count_if(F.col("eff") == 1).alias("n1"), *over)
    return counts.join(quantiles(wide, ["gap"], "width", {"median_width": 0.5}), "gap")


def cluster_by_replicate(events: DataFrame, gap: int, order: list[str]) -> DataFrame:
    """Clusters of each replicate, with the distance to the closest of another replicate and whether one overlaps."""
    own = iv.cluster_by_gap(events, gap, ["chrom", "rep"], order).withColumn("cid", F.concat_ws(":", "rep", "chrom", "s"))
    out = None
    for rep in ("BC", "BD"):
        mine, others = own.filter(F.col("rep") == rep), own.filter(F.col("rep") != rep)
        near = iv.nearest(mine, others, "cid")
        hit = iv.overlaps_any(mine, others, "cid").select("cid", F.lit(True).alias("hit"))
        part = near.join(hit, "cid", "left").withColumn("reproducible", F.coalesce("hit", F.lit(False))).drop("hit")
        out = part if out is None else out.unionByName(part)
    return out.drop("cid")


def membership_counts(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Numbers of a's rows by whether they overlap b and c."""
    out = a.select(key)
    for name, other in (("in_b", b), ("in_c", c)):
        hit = iv.overlaps_any(a, other, key).select(key, F.lit(True).alias(name))
        out = out.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.groupBy("in_b", "in_c").agg(F.count(F.lit(1)).alias("n"))


def distance_contingency(events: DataFrame, features: DataFrame, gap: int, near: int) -> DataFrame:
    """Events by the size class of their cluster: number, number within near of a feature, and further."""
    from strandloom.functions.columns import size_class

    labelled = iv.label_clusters(events, gap, ["chrom"], ["id"])
    sizes = labelled.groupBy("chrom", "cluster").agg(F.count(F.lit(1)).alias("eff"))
    dist = iv.nearest(events, features, "id").select("id", "distance")
    df = labelled.join(sizes, ["chrom", "cluster"]).join(dist, "id").withColumn("class", size_class("eff"))
    return df.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") <= near).alias("near"), F.count_if(F.col("distance") > near).alias("far")
    )
