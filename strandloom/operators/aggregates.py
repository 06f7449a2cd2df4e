"""Grouped summaries of reads, calls, alignments and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles


def conditional_share(df: DataFrame, hit: str, by: str) -> DataFrame:
    """(class, n, n_true, share) for each value of by and for all rows; null counts as not satisfied."""
    grouped = df.withColumn("__hit", F.coalesce(hit, F.lit(False))).rollup(by)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if("__hit").alias("n_true"))
    return out.select(F.coalesce(by, F.lit("all")).alias("class"), "n", "n_true", (F.col("n_true") / F.col("n")).alias("share"))


def read_percent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of value for each read, nulls left out, with their number."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def base_counts(seqs: DataFrame, seq: str, letters: str = "TBLEIU") -> DataFrame:
    """One row of letter counts over all sequences, and the ratio of the modified ones to T."""
    n = {b: F.sum(F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))) for b in letters}
    df = seqs.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{b.lower()}") for b, c in n.items()])
    mods = reduce(Column.__add__, [F.col(f"n_{b.lower()}") for b in letters if b != "T"])
    return df.withColumn("mod_ratio", F.try_divide(mods, "n_t"))


def read_mod_share(df: DataFrame, key: str, call: str, mod: str = "B", base: str = "T") -> DataFrame:
    """For each read the share of mod among mod and base; null without either."""
    n = df.groupBy(key).agg(F.count_if(F.col(call) == mod).alias("n_mod"), F.count_if(F.col(call) == base).alias("n_base"))
    return n.withColumn("share", F.try_divide("n_mod", F.col("n_mod") + F.col("n_base")))


def content_ratio(df: DataFrame, key: str, call: str, mod: str, cano: str, plus: int = 1, bins: int = 20) -> DataFrame:
    """Histogram (bin, n) over 0..1 of n_mod / (n_mod + n_cano + plus) of the reads."""
    n = df.groupBy(key).agg(F.count_if(F.col(call) == mod).alias("m"), F.count_if(F.col(call) == cano).alias("c"))
    ratio = F.col("m") / (F.col("m") + F.col("c") + plus)
    at = F.least(F.floor(ratio * bins), F.lit(bins - 1))
    return n.filter(F.col("m") + F.col("c") + plus > 0).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def alignment_summary(aln: DataFrame, flag: str = "flag", length: str = "length") -> DataFrame:
    """One row of counts of alignments: aligned, not aligned, and long and short aligned ones."""
    aligned = F.col(flag).isin(0, 16, 2048, 2064)
    return aln.agg(
        F.count_if(aligned).alias("aligned"),
        F.count_if(F.col(flag) == 4).alias("unaligned"),
        F.count_if(aligned & (F.col(length) > 6000)).alias("long"),
        F.count_if(aligned & (F.col(length) < 200)).alias("short"),
    )


def alignment_types(aln: DataFrame, flag: str = "flag") -> DataFrame:
    """Number of alignments by type and strand."""
    kind = F.when(F.col(flag).isin(0, 16), "primary").when(F.col(flag).isin(2048, 2064), "supplementary").when(F.col(flag) == 4, "none").otherwise("other")
    strand = F.when(F.col(flag).isin(0, 2048), "+").when(F.col(flag).isin(16, 2064), "-").otherwise("*")
    return aln.groupBy(kind.alias("kind"), strand.alias("strand")).agg(F.count(F.lit(1)).alias("n"))


def tract_count_histogram(reads: DataFrame, tracts: DataFrame, key: str) -> DataFrame:
    """Number of reads (reads) by number of tracts (n), reads without any included."""
    n = tracts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return reads.select(key).join(n, key, "left").groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("reads"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n, density) of values in lo..hi; the last bin holds hi. Density is n by the number within and the bin's width."""
    by = by or []
    width = (hi - lo) / bins
    at = F.when(F.col(value) == hi, bins - 1).otherwise(F.floor((F.col(value) - lo) / width)).cast("int")
    inside = df.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    n = inside.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("__t")) if by else n.agg(F.sum("n").alias("__t"))
    n = n.join(total, by) if by else n.join(F.broadcast(total), how="inner")  # one row
    return n.withColumn("density", F.col("n") / (F.col("__t") * width)).drop("__t")


def error_tally(df: DataFrame, error: str) -> DataFrame:
    """Number of rows by error message; null are those processed."""
    return df.groupBy(F.coalesce(error, F.lit("processed")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def threshold_reassign(df: DataFrame, value: str, threshold: float, target: float) -> DataFrame:
    """value above the threshold becomes min(target / (1 - u), 1), u the share of rows below it; the others 0."""
    u = df.agg(F.avg((F.col(value) < threshold).cast("int")).alias("__u"))
    df = df.join(F.broadcast(u))  # one row
    new = F.least(F.try_divide(F.lit(target), 1 - F.col("__u")), F.lit(1.0))
    return df.withColumn("reassigned", F.when(F.col(value) > threshold, new).otherwise(0.0)).drop("__u")


def split_mixture(reads: DataFrame, percent: str, error: str, target: float, bins: int = 101, max_error: float = 0.1, min_high: float = 0.05) -> DataFrame:
    """Reads with two labels mixed in, told apart by the histogram of their percent (0..1).

    Of reads under max_error the fullest bin is sought, and leftwards from it the first bin under a quarter of it; if that lies
    beyond a tenth of the range, half its place is the threshold. Reads above get min(target / share above, 100), others 0;
    all get null if no such bin exists or the share above is under min_high.
    """
    good = reads.filter(F.col(error) < max_error)
    at = F.least(F.floor(F.col(percent) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    counts = good.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    every = reads.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    peak = every.agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("p"), F.max("n").alias("top"))
    low = every.join(F.broadcast(peak)).filter((F.col("bin") < F.col("p")) & (F.col("n") < F.col("top") / 4)).agg(F.max("bin").alias("low"))
    t = low.select(F.when(F.col("low") > 0.1 * bins, F.col("low") / bins / 2).alias("threshold"))
    share = good.join(F.broadcast(t)).agg(F.first("threshold").alias("threshold"), F.avg((F.col(percent) > F.col("threshold")).cast("int")).alias("share"))
    ok = (F.col("share") >= min_high) & F.col("threshold").isNotNull()
    high = F.when(F.col(percent) > F.col("threshold"), F.least(F.try_divide(F.lit(target), "share"), F.lit(100.0))).otherwise(0.0)
    return reads.join(F.broadcast(share)).withColumn("assigned", F.when(ok, high)).drop("share")


def sweep_summary(df: DataFrame, param: str, values: list[str]) -> DataFrame:
    """Means of values for each value of a parameter."""
    return df.groupBy(param).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def describe5(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., min, q1, median, mean, q3, max)"""
    mean = F.sum(F.col(value) * F.col("__w")) / F.sum(F.when(F.col(value).isNotNull(), F.col("__w")))
    aggs = [F.min(value).alias("min"), mean.alias("mean"), F.max(value).alias("max")]
    out = quantiles(df, by or [], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, aggs)
    return out.select(*(by or []), "min", "q1", "median", "mean", "q3", "max")


def value_table(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def residual_std(df: DataFrame, prediction: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Population deviation of prediction - truth."""
    d = F.col(prediction) - F.col(truth)
    return df.groupBy(*(by or [])).agg(F.stddev_pop(d).alias("std"))


def position_frequency_matrix(seqs: DataFrame, seq: str) -> DataFrame:
    """(position from 1, base, n, share) over aligned sequences of equal length."""
    letters = seqs.select(F.posexplode(F.split(seq, "")).alias("p", "base")).filter("base != ''")
    n = letters.groupBy((F.col("p") + 1).alias("position"), "base").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("position")))


def label_mean(df: DataFrame, sample: str, target: str, length: str) -> DataFrame:
    return df.groupBy(sample).agg(F.avg(target).alias("target"), F.sum(length).alias("length"))


def window_mod_fraction(df: DataFrame, key: str, idx: str, base: str, mods: dict[str, str], width: int, threshold: float = 0.5) -> DataFrame:
    """For windows of width positions, the share of positions of base T whose probability exceeds the threshold, for each mod; nulls left out."""
    win = F.expr(f"{idx} div {width}").alias("win")
    hit = lambda c: F.avg(F.when((F.col(base) == "T") & F.col(c).isNotNull(), (F.col(c) > threshold).cast("int")))
    return df.groupBy(key, win).agg(*[hit(c).alias(m) for m, c in mods.items()])


def kmer_percentile(df: DataFrame, kmer: str, p: str, threshold: float) -> DataFrame:
    """For each k-mer the percentile 100 - 100 * threshold of p, between neighbours in proportion, and the number of samples."""
    return quantiles(df, [kmer], p, {"percentile": 1 - threshold}, [F.coalesce(F.sum(F.when(F.col(p).isNotNull(), F.col("__w"))), F.lit(0)).alias("nsample")]).select(kmer, "percentile", "nsample")
