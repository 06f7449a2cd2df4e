"""Windows and segments of ordered series: signals of reads by position. A read is one partition of each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandloom.functions.columns import col


def frame(key: str, idx: str, lo: int | None = None, hi: int | None = None):
    """Rows lo..hi around the current one, None for all; without either the plain order."""
    w = Window.partitionBy(key).orderBy(idx)
    if lo is None and hi is None:
        return w
    return w.rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)


def running_mean(x, n: int, key: str, idx: str, order: WindowSpec | None = None) -> Column:
    """Mean of the zero-padded means of n values from, and up to, each position; order may be another than that of the read."""
    x, order = col(x), order or frame(key, idx)
    return (F.sum(x).over(order.rowsBetween(0, n - 1)) + F.sum(x).over(order.rowsBetween(-(n - 1), 0))) / (2 * n)


def rolling_mean_centered(x, w: int, key: str, idx: str) -> Column:
    """Mean of the w values around, nulls left out, fewer at the ends."""
    return F.avg(col(x)).over(frame(key, idx, -(w // 2), (w - 1) // 2))


def weighted_smooth(df: DataFrame, x: str, weights: list[float], key: str, idx: str, out: str) -> DataFrame:
    """Weighted mean over full windows of len(weights) values (odd); towards the ends the mean of the values up to twice the distance from the end."""
    h = len(weights) // 2
    at = frame(key, idx)
    full = sum((F.lag(x, h - k).over(at) * w if k < h else F.lead(x, k - h).over(at) * w for k, w in enumerate(weights)), F.lit(0)) / sum(weights)
    left, right = F.row_number().over(at) - 1, F.count(F.lit(1)).over(Window.partitionBy(key)) - F.row_number().over(at)
    df = df.withColumns({"__l": left, "__r": right, "__full": full})
    edge = None
    for d in range(h):
        mean = F.avg(x).over(frame(key, idx, -d, d))
        edge = F.when(F.least("__l", "__r") == d, mean) if edge is None else edge.when(F.least("__l", "__r") == d, mean)
    smooth = F.col("__full") if edge is None else F.coalesce(edge, F.col("__full"))
    return df.withColumn(out, smooth).drop("__l", "__r", "__full")


def runmean(x, k: int, key: str, idx: str, align: str = "center", complete: bool = True) -> Column:
    """Mean of k values, centred or to the right; null where values are missing (complete) or over fewer."""
    lo, hi = (-(k // 2), (k - 1) // 2) if align == "center" else (0, k - 1)
    w = frame(key, idx, lo, hi)
    mean = F.avg(col(x)).over(w)
    return F.when(F.count(col(x)).over(w) == k, mean) if complete else mean


def rolling_median_detrend(df: DataFrame, x: str, w: int, key: str, idx: str, out: str) -> DataFrame:
    """x less the median of the w values around, by the read's population deviation of that."""
    med = F.percentile(x, 0.5).over(frame(key, idx, -(w // 2), (w - 1) // 2))
    df = df.withColumn("__d", F.col(x) - med)
    return df.withColumn(out, F.try_divide("__d", F.stddev_pop("__d").over(Window.partitionBy(key)))).drop("__d")


def rolling_std_of_mean(df: DataFrame, x: str, n_std: int, n_mean: int, key: str, idx: str, out: str) -> DataFrame:
    """Mean of the last n_mean sample deviations of the last n_std values; null until full."""
    a, b = frame(key, idx, -(n_std - 1), 0), frame(key, idx, -(n_mean - 1), 0)
    df = df.withColumn("__s", F.when(F.count(x).over(a) == n_std, F.stddev_samp(x).over(a)))
    return df.withColumn(out, F.when(F.count("__s").over(b) == n_mean, F.avg("__s").over(b))).drop("__s")


def diff(x, key: str, idx: str) -> Column:
    return F.lead(col(x)).over(frame(key, idx)) - col(x)


def prefix_sums(x, key: str, idx: str) -> tuple[Column, Column]:
    w = frame(key, idx, None, 0)
    return F.sum(col(x)).over(w), F.sum(col(x) * col(x)).over(w)


def tstat(df: DataFrame, x: str, w: int, key: str, idx: str, out: str) -> DataFrame:
    """|mean of the w values from here - mean of the w before| by the root of their variances' sum over w; 0 where a window isn't full."""
    left, right = frame(key, idx, -w, -1), frame(key, idx, 0, w - 1)

    def moments(win):
        n = F.count(x).over(win)
        m, q = F.sum(x).over(win) / w, F.sum(F.col(x) * F.col(x)).over(win) / w
        return n, m, F.greatest(q - m * m, F.lit(1e-100))

    (nl, ml, vl), (nr, mr, vr) = moments(left), moments(right)
    t = F.abs(mr - ml) / F.sqrt((vl + vr) / w)
    return df.withColumn(out, F.when((nl == w) & (nr == w), t).otherwise(0.0))


def active_range(df: DataFrame, step: str, threshold: float, key: str, idx: str, margin: int = 10) -> DataFrame:
    """(key, first, last): first and last position whose step exceeds the threshold, widened by margin within the read."""
    hot = F.when(F.abs(F.col(step)) > threshold, F.col(idx))
    ends = df.groupBy(key).agg(F.min(hot).alias("a"), F.max(hot).alias("b"), F.max(idx).alias("n")).filter("a is not null")
    return ends.select(key, F.greatest(F.col("a") - margin, F.lit(0)).alias("first"), F.least(F.col("b") + margin, "n").alias("last"))


def islands(df: DataFrame, keep: Column, key: str, idx: str, low: str | None = None) -> DataFrame:
    """(key, start, end, length[, low]): maximal runs of positions that satisfy keep; low is the least value of a column."""
    df = df.withColumn("__k", F.coalesce(keep, F.lit(False)))
    df = df.withColumn("__g", F.col(idx) - F.sum(F.col("__k").cast("int")).over(frame(key, idx, None, 0)))
    extra = [F.min(low).alias("low")] if low else []
    runs = df.filter("__k").groupBy(key, "__g").agg(F.min(idx).alias("start"), F.max(idx).alias("end"), F.count(F.lit(1)).alias("length"), *extra)
    return runs.drop("__g")


def first_run(df: DataFrame, keep: Column, n: int, key: str, idx: str) -> DataFrame:
    """(key, start) of the first run of n positions or more."""
    return islands(df, keep, key, idx).filter(F.col("length") >= n).groupBy(key).agg(F.min("start").alias("start"))


def downsample(df: DataFrame, x: str, r: int, key: str, idx: str) -> DataFrame:
    """Every r-th position with the mean of the r values around."""
    return df.withColumn("smooth", rolling_mean_centered(x, r, key, idx)).filter(F.col(idx) % r == 0)


def longest_band_run(
    df: DataFrame, x: str, key: str, idx: str, lo: float, hi: float, peak: float, smooth: int, least: int, flat: float, flat_smooth: int, flat_least: int
) -> DataFrame:
    """(key, start, end) of the longest run whose smoothed value lies between lo and hi and somewhere exceeds peak.

    Runs are tried from the longest down, while the positions in the band that are left number more than least; reads of which
    no more than flat_least positions exceed flat when smoothed by flat_smooth have none.
    """
    df = df.withColumns({"__s": rolling_mean_centered(x, smooth, key, idx), "__f": rolling_mean_centered(x, flat_smooth, key, idx)})
    busy = df.groupBy(key).agg(F.count_if(F.col("__f") > flat).alias("__n")).filter(F.col("__n") > flat_least).select(key)
    band = df.withColumn("__neg", -F.col("__s"))
    runs = islands(band, (F.col("__s") > lo) & (F.col("__s") < hi), key, idx, low="__neg").join(busy, key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.desc("length"), "start")
    tried = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("__left", F.sum("length").over(Window.partitionBy(key)) - tried)
    good = runs.filter((-F.col("low") > peak) & (F.col("__left") > least))
    best = good.groupBy(key).agg(F.max(F.struct("length", (-F.col("start")).alias("m"), "start", "end")).alias("x"))
    return best.select(key, "x.start", "x.end")


def chunk(df: DataFrame, n: int, least: int, key: str, idx: str) -> DataFrame:
    """Adds block (blocks of n positions); the last one goes if it has fewer than least."""
    df = df.withColumn("block", F.expr(f"{idx} div {n}"))
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, "block"))).filter(F.col("__n") >= least).drop("__n")


def tumbling_windows(df: DataFrame, x: str, n: int, key: str, idx: str) -> DataFrame:
    """(key, win, values): full blocks of n values in order."""
    g = df.groupBy(key, F.expr(f"{idx} div {n}").alias("win")).agg(F.sort_array(F.collect_list(F.struct(idx, x))).alias("v"))
    return g.filter(F.size("v") == n).select(key, "win", F.transform("v", lambda e: e[x]).alias("values"))


def halo_windows(arrays: DataFrame, values: str, size: int, pad: int) -> DataFrame:
    """Zero-padded windows of size values of an array, stepping size - 2 pad: (..., win, values)."""
    step = size - 2 * pad
    n = F.ceil(F.size(values) / step).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0).cast("double"), k)
    padded = F.concat(zeros(pad), F.transform(values, lambda x: x.cast("double")), zeros(size))
    df = arrays.withColumns({"__p": padded, "__n": n}).filter("__n > 0")
    df = df.withColumn("win", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return df.withColumn(values, F.slice("__p", F.col("win") * step + 1, F.lit(size))).drop("__p", "__n")


def overlapped_windows(df: DataFrame, n: int, m: int, key: str, idx: str) -> DataFrame:
    """Rows in each of m tilings by windows of n, shifted by n // m: (..., phase, win); all tilings of a read keep as many full windows."""
    shift = n // m
    size = F.max(idx).over(Window.partitionBy(key)) + 1
    least = F.expr(f"(__size - {(m - 1) * shift}) div {n}")
    df = df.withColumn("__size", size).withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    df = df.withColumn("win", F.expr(f"floor(({idx} - phase * {shift}) / {n})"))
    return df.filter((F.col("win") >= 0) & (F.col("win") < least)).drop("__size")


def overlap_consensus(scores: DataFrame, n: int, m: int, key: str, *score: str) -> DataFrame:
    """(key, idx, score...): medians over the tilings of overlapped_windows' window scores, nulls left out."""
    shift = n // m
    first = F.col("win") * n + F.col("phase") * shift
    spread = scores.select(key, *score, F.explode(F.sequence(first, first + n - 1)).alias("idx"))
    return spread.groupBy(key, "idx").agg(*[F.percentile(c, 0.5).alias(c) for c in score])


def with_successor(df: DataFrame, columns: list[str], key: str, idx: str) -> DataFrame:
    """Each row with the columns of the next, as next_...; the last goes."""
    w = frame(key, idx)
    out = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"__n": F.lead(F.lit(1)).over(w)})
    return out.filter("__n is not null").drop("__n")


def neighbour_triple(df: DataFrame, x: str, key: str, idx: str) -> DataFrame:
    w = frame(key, idx)
    out = df.withColumns({"prev": F.lag(x).over(w), "next": F.lead(x).over(w), "__a": F.lag(F.lit(1)).over(w), "__b": F.lead(F.lit(1)).over(w)})
    return out.filter("__a is not null and __b is not null").drop("__a", "__b")


def segment_summary(df: DataFrame, peaks: Column, x: str, key: str, idx: str, rate: float) -> DataFrame:
    """(key, seg, start, length, mean, std) between consecutive peaks, in seconds; before the first peak there is none."""
    df = df.withColumn("seg", F.sum(peaks.cast("int")).over(frame(key, idx, None, 0))).filter("seg > 0")
    g = df.groupBy(key, "seg").agg(F.min(idx).alias("a"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    var = F.greatest((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n")), F.lit(0.0))
    return g.select(key, "seg", (F.col("a") / rate).alias("start"), (F.col("n") / rate).alias("length"), (F.col("s") / F.col("n")).alias("mean"), F.sqrt(var).alias("std"))
