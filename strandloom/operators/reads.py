"""Filters and row selections on reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.sources.storage import stored

from .ordered import numbered


def filter_min_length(df: DataFrame, seq: str, n: int) -> DataFrame:
    return df.filter(F.length(seq) >= n)


def filter_min_events(df: DataFrame, values: str, n: int) -> DataFrame:
    return df.filter(F.size(values) >= n)


def count_dropped(df: DataFrame, values: str, n: int) -> DataFrame:
    """One row: reads with fewer than n events, and all."""
    return df.agg(F.count_if(F.size(values) < n).alias("dropped"), F.count(F.lit(1)).alias("n"))


def tb_indicator(df: DataFrame, call: str) -> DataFrame:
    """Positions called T (ind 0) or B (1)."""
    from strandloom.functions.columns import indicator

    return df.filter(F.col(call).isin("T", "B")).withColumn("ind", indicator(call))


def t_sites(df: DataFrame, call: str) -> DataFrame:
    return df.filter(F.col(call).isin("T", "B", "X"))


def filter_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(column).isin(values))


def filter_ids(df: DataFrame, column: str, allowed: DataFrame, key: str) -> DataFrame:
    return df.join(allowed.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def filter_contains(df: DataFrame, column: str, parts: DataFrame, part: str, q: int = 8) -> DataFrame:
    """Rows whose column holds one of any number of parts. Null parts count for nothing, an empty one is in all but null values.

    Of each part the piece of q characters that the fewest parts have, or the whole part if it is shorter, is sought among the pieces of the column's different
    values; a part whose piece is found is then compared whole.
    """
    wanted = parts.select(F.col(part).alias("__part")).filter("__part is not null").distinct()
    if not wanted.filter("__part = ''").isEmpty():
        return df.filter(F.col(column).isNotNull())
    size = F.least(F.length("__part"), F.lit(q))
    pieces = wanted.withColumn("__k", size).withColumn("__g", F.explode(F.expr("transform(sequence(1, length(__part) - __k + 1), i -> substring(__part, i, __k))"))).distinct()
    counts = pieces.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    rarest = pieces.join(counts, "__g").groupBy("__part").agg(F.min(F.struct("__n", "__g"))["__g"].alias("__g"))
    rarest = stored(rarest, "rarest-pieces")
    lengths = [r[0] for r in rarest.select(F.length("__g")).distinct().collect()]  # q at most
    values = df.select(F.col(column).alias("__v")).filter("__v is not null").distinct()
    cut = [F.expr(f"transform(sequence(1, greatest(length(__v) - {k - 1}, 1)), i -> substring(__v, i, {k}))") for k in lengths]
    cells = values.withColumn("__g", F.explode(F.array_distinct(F.concat(*cut)))) if cut else values.limit(0).withColumn("__g", F.lit(""))
    met = cells.join(rarest, "__g").filter(F.contains("__v", "__part")).select(F.col("__v").alias(column)).distinct()
    return df.join(met, column, "left_semi").select(*df.columns)


def fraction_slice(df: DataFrame, name: str, lo: float, hi: float) -> DataFrame:
    """Rows whose rank by name, as a share of all, lies between lo and hi, exactly."""
    share = F.col("__n") / F.col("__all")
    return numbered(df, [name]).withColumn("__f", share).filter((F.col("__f") > lo) & (F.col("__f") < hi)).drop("__n", "__all", "__f")


def minmax_invert(df: DataFrame, value: str, out: str) -> DataFrame:
    """1 - (x - min) / (max - min) over all rows; null if all are equal."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = 1 - F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    return df.join(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")  # one row


def drop_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in columns."""
    kinds = dict(df.dtypes)
    ok = [F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)) for c in columns]
    return df.filter(reduce(Column.__and__, ok))


def trim_border(df: DataFrame, values: str, n: int) -> DataFrame:
    """Arrays without their first and last n values; shorter ones go."""
    return df.filter(F.size(values) > 2 * n).withColumn(values, F.slice(values, F.lit(n + 1), F.size(values) - 2 * n))


def filter_quality(df: DataFrame, quality: str, above: float, size: Column, least: int) -> DataFrame:
    return df.filter((F.col(quality) > above) & (size >= least))


def filter_length_agreement(df: DataFrame, n: str, ref: str, most: int, most_share: float, mod_share: Column, low: float) -> DataFrame:
    """Reads whose length agrees with the reference's, with low_share: whether they have few modified bases."""
    gap = F.abs(F.col(ref) - F.col(n))
    kept = df.filter((F.col(n) > 0) & (gap <= most) & (gap / F.col(n) <= most_share))
    return kept.withColumn("low_share", F.coalesce(mod_share < low, F.lit(False)))


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != key]), F.struct(*order)).alias("__x"))
    return first.select(key, "__x.*")


def best_alignment(aln: DataFrame, key: str, flag: str, length: str) -> DataFrame:
    """Of the primary alignments (flag 0 or 16) of each read the longest; ties by the other columns in order."""
    rest = [c for c in aln.columns if c != key]
    top = F.max(F.struct(F.col(length).alias("__l"), F.struct(*rest).alias("__x"))).alias("__m")
    return aln.filter(F.col(flag).isin(0, 16)).groupBy(key).agg(top).select(key, "__m.__x.*")
