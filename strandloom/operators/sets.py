"""Unions, labelled stacks and set comparisons of tables and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as iv


def stack_labelled(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """All rows of the parts, with the name of their part."""
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def union_replicates(parts: dict[str, DataFrame], label: str, total: str | None = None) -> DataFrame:
    """The parts under their names and, with total, all of them again under that name."""
    every = reduce(DataFrame.unionByName, parts.values())
    return stack_labelled(parts | ({total: every} if total else {}), label)


def reproducible(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a with reproducible: whether a row overlaps any of b; those that don't are specific to a."""
    hit = iv.overlaps_any(a, b, key).select(key, F.lit(True).alias("reproducible"))
    return a.join(hit, key, "left").withColumn("reproducible", F.coalesce("reproducible", F.lit(False)))


def merge_callers(events: DataFrame, gap: int, key: str, caller: str, part: list[str] | None = None) -> DataFrame:
    """Events of all callers linked at gap: the smallest key, span, number and number of callers of each group."""
    part = part or ["chrom"]
    df = iv.label_clusters(events, gap, part, [key])
    agg = [F.min(key).alias(key), F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"), F.count_distinct(caller).alias("callers")]
    return df.groupBy(*part, "cluster").agg(*agg).drop("cluster")
