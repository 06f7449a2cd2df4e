"""Rank statistics, distributions and per-read normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.storage import stored

from . import intervals as iv
from .ordered import along, cumulated


def weighted_ranks(df: DataFrame, by: list[str], columns: dict[str, str], weight: str) -> DataFrame:
    """Adds, for columns of one type, out: column, twice the mean rank of the column's value within by, where a row counts weight times.

    Ranks are made on the distinct values of all columns at once, whose weights are summed before they meet in one order.
    """
    values = [F.struct(F.lit(out).alias("__c"), F.col(c).alias("__v")) for out, c in columns.items()]
    at = df.select(*by, weight, F.explode(F.array(*values)).alias("x")).groupBy(*by, "x.__c", "x.__v").agg(F.sum(weight).alias("__w"))
    ranks = cumulated(at, [*by, "__c"], "__v", {"__to": "__w"})
    ranks = stored(ranks.select(*by, "__c", "__v", (2 * F.col("__to") - F.col("__w") + 1).alias("__r")), "ranks")
    for out, c in columns.items():
        of = ranks.filter(F.col("__c") == out).select(*by, F.col("__v").alias(c), F.col("__r").alias(out))
        df = df.join(of.hint("merge"), [*by, c])  # files of ranks are much smaller than their rows, so Spark would broadcast millions
    return df


def correlation(df: DataFrame, by: list[str], a: str, b: str, weight: str) -> DataFrame:
    """(by..., n, r): product-moment correlation with whole weights, from sums."""
    w, x, y = F.col(weight).cast("double"), F.col(a).cast("double"), F.col(b).cast("double")
    s = df.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"))
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    var = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    return s.select(*by, F.col("n").cast("long").alias("n"), F.when(var > 0, cov / F.sqrt(var)).alias("r"))


def spearman(df: DataFrame, a: str, b: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Rank correlation over rows where both are known, equal values sharing their mean rank; rows of a track weigh by their width."""
    by = by or []
    one_type = df.schema[a].dataType == df.schema[b].dataType
    x, y = (F.col(c) if one_type else F.col(c).cast("double") for c in (a, b))
    known = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # equal pairs count together
    pairs = known.groupBy(*by, x.alias("__x"), y.alias("__y")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__w"))
    ranked = weighted_ranks(pairs, by, {"__ra": "__x", "__rb": "__y"}, "__w")
    return correlation(ranked, by, "__ra", "__rb", "__w")


def common_breakpoints(tracks: dict[str, DataFrame]) -> DataFrame:
    """Runs (chrom, s, e) cut where any track changes, with each track's value; null where it has none.

    Starts and ends of all runs go along the chromosome together; the last change of each track is its value.
    """
    changes = None
    for name, t in tracks.items():
        begin = F.struct(F.col("s").alias("at"), F.lit(1).alias("known"), F.col("value").cast("double").alias("v"))
        end = F.struct((F.col("e") + 1).alias("at"), F.lit(0).alias("known"), F.lit(None).cast("double").alias("v"))
        both = t.select("chrom", F.explode(F.array(begin, end)).alias(name)).select("chrom", F.col(f"{name}.at").alias("s"), name)
        changes = both if changes is None else changes.unionByName(both, allowMissingColumns=True)
    at = changes.groupBy("chrom", "s").agg(*[F.max(n).alias(n) for n in tracks])
    at = stored(at, "breakpoints")
    at = along(at, ["chrom"], "s", [], {f"__{n}": ("max", n) for n in tracks}, after={"__n": "s"}).filter("__n is not null")
    return at.select("chrom", "s", (F.col("__n") - 1).alias("e"), *[F.col(f"__{n}.v").alias(n) for n in tracks])


def corr_matrix(tracks: dict[str, DataFrame]) -> DataFrame:
    """(a, b, n, r): rank correlations of all pairs of tracks over the bases that both cover."""
    runs = common_breakpoints(tracks).withColumn("__w", F.col("e") - F.col("s") + 1)
    names = list(tracks)
    pairs = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y")) for i, x in enumerate(names) for y in names[i + 1 :]]
    long = runs.select("__w", F.explode(F.array(*pairs)).alias("p")).select("__w", "p.*")
    return spearman(long, "x", "y", "__w", ["a", "b"])


def ecdf(df: DataFrame, x: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., x, share): the weighted share of values up to x, for each different x; nulls are left out. Weights are 0 or more."""
    by = by or []
    at = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__w"))
    at = cumulated(at, by, x, {"__to": "__w"}, {"__every": "__w"})
    return at.select(*by, x, (F.col("__to") / F.col("__every")).alias("share"))


def kde(df: DataFrame, x: str, lo: float, hi: float, n: int, bw: float, by: list[str] | None = None) -> DataFrame:
    """(by..., i, at, density): Gaussian kernel density at n + 1 places. Equal values are counted before the kernel is taken."""
    by = by or []
    at = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    grid = at.withColumn("i", F.explode(F.expr(f"sequence(0, {n})"))).withColumn("at", lo + F.col("i") * ((hi - lo) / n))
    z = (F.col("at") - F.col(x)) / bw
    kernel = F.exp(-0.5 * z * z) / (bw * (2 * 3.141592653589793) ** 0.5)
    return grid.groupBy(*by, "i", "at").agg((F.sum(F.col("__c") * kernel) / F.sum("__c")).alias("density"))


def per_read(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """df with aggregates of its reads, in one pass: a read's rows meet in a task."""
    read = Window.partitionBy(key)
    return df.withColumns({name: c.over(read) for name, c in aggs.items()})


def robust_z(df: DataFrame, x: str, mask: Column, key: str, out: str, scale: float = 1.4826) -> DataFrame:
    """(x - median) by the scaled median distance from it, both over positions outside the mask."""
    df = df.withColumn("__m", mask)
    df = per_read(df, key, {"__med": F.percentile(F.when(~F.col("__m"), F.col(x)), 0.5)})
    df = per_read(df, key, {"__mad": F.percentile(F.when(~F.col("__m"), F.abs(F.col(x) - F.col("__med"))), 0.5)})
    return df.withColumn(out, F.try_divide(F.col(x) - F.col("__med"), F.col("__mad") * scale)).drop("__m", "__med", "__mad")


def mean_norm(df: DataFrame, x: str, mask: Column, key: str, out: str) -> DataFrame:
    """(x - mean) / mean of squares, over positions outside the mask."""
    kept = F.when(~mask, F.col(x))
    df = per_read(df, key, {"__m": F.avg(kept), "__q": F.avg(kept * kept)})
    return df.withColumn(out, F.try_divide(F.col(x) - F.col("__m"), "__q")).drop("__m", "__q")


def moment_match(df: DataFrame, x: str, theory: str, mask: Column, key: str, out: str) -> DataFrame:
    """x moved to the mean of theory, and to a deviation halfway to it, by moments outside the mask; reads without a deviation go."""
    a, b = F.when(~mask, F.col(x)), F.when(~mask, F.col(theory))
    df = per_read(df, key, {"__ma": F.avg(a), "__mb": F.avg(b), "__sa": F.stddev_pop(a), "__sb": F.stddev_pop(b)})
    moved = (F.col(x) - F.col("__ma")) * ((F.col("__sb") + F.col("__sa")) / 2) / F.col("__sa") + F.col("__mb")
    return df.filter(F.col("__sa") > 0).withColumn(out, moved).drop("__ma", "__mb", "__sa", "__sb")


def _within(z: Column, bound: float) -> Column:
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-bound)), F.lit(bound)))


def iqr_scale(df: DataFrame, x: str, key: str, out: str, bound: float = 5.0) -> DataFrame:
    """(x - median) by the distance of the quartiles of the read, within the bound; null in reads without spread."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    z = F.try_divide(F.col(x) - F.col("__q")[1], F.col("__q")[2] - F.col("__q")[0])
    return per_read(df, key, {"__q": q}).withColumn(out, _within(z, bound)).drop("__q")


def iqr_summary(events: DataFrame, samples: str, key: str, bound: float = 5.0) -> DataFrame:
    """events with mean, std, low and high of their samples, an array, scaled like iqr_scale over all samples of the read; samples of 0 stay 0, null ones are left out.

    Events without samples get nulls. Reads without spread too, but for samples of 0.
    """
    q = F.percentile("__x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q")
    scale = events.select(key, F.explode(samples).alias("__x")).groupBy(key).agg(q)
    df = events.join(scale, key, "left").withColumn("__s", F.filter(samples, lambda x: x.isNotNull()))
    mid, wide = F.col("__q")[1], F.col("__q")[2] - F.col("__q")[0]
    z = lambda x: F.when(x == 0, 0.0).otherwise(_within(F.try_divide(x - mid, wide), bound))
    df = df.withColumn("__z", F.transform("__s", z))
    n = F.when(F.size("__z") > 0, F.size("__z"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("mean", total("__z") / n)
    std = F.sqrt(total(F.transform("__z", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n)
    return df.withColumns({"std": std, "low": F.array_min("__z"), "high": F.array_max("__z")}).drop("__q", "__s", "__z")


def pad(values: str, n: int) -> Column:
    """An array cut or filled with zeros to n values."""
    return F.slice(F.concat(F.col(values), F.array_repeat(F.lit(0).cast("double"), n)), 1, n)


def percentile_shift(df: DataFrame, x: str, key: str, out: str, fixed: float | None = 20.0) -> DataFrame:
    """(x - p25) / fixed, or by p60 - p20 without fixed."""
    q = F.percentile(x, F.array(F.lit(0.2), F.lit(0.25), F.lit(0.6)))
    width = F.lit(fixed) if fixed else F.col("__q")[2] - F.col("__q")[0]
    return per_read(df, key, {"__q": q}).withColumn(out, F.try_divide(F.col(x) - F.col("__q")[1], width)).drop("__q")


def high_share(df: DataFrame, x: str, key: str, above: float = 10.0) -> DataFrame:
    """For each read the share of values above a bound."""
    return df.groupBy(key).agg((F.count_if(F.col(x) > above) / F.count(F.lit(1))).alias("share"))


def quantile_match(df: DataFrame, x: str, key: str, out: str, p25: float, p75: float) -> DataFrame:
    """x moved so that its quartiles are p25 and p75, and its square as out_square."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    z = F.try_divide(F.col(x) - F.col("__q")[0], F.col("__q")[1] - F.col("__q")[0]) * (p75 - p25) + p25
    return per_read(df, key, {"__q": q}).withColumn(out, z).withColumn(f"{out}_square", F.col(out) * F.col(out)).drop("__q")


def p75_scale(df: DataFrame, x: str, length: str, key: str, out: str) -> DataFrame:
    """(x - p75) / p75 as out, and length by its mean as out_length."""
    df = per_read(df, key, {"__q": F.percentile(x, 0.75), "__l": F.avg(length)})
    return df.withColumns({out: F.try_divide(F.col(x) - F.col("__q"), "__q"), f"{out}_length": F.try_divide(length, "__l")}).drop("__q", "__l")


def affine_fit_rescale(
    df: DataFrame, x: str, expected: str, use: Column, key: str, out: str, trim: float = 0.8, limit: float | None = 0.25, flat: float = 0.0
) -> DataFrame:
    """(x - a) / b with a and b of the line of x on expected, fitted twice by least squares over the positions in use: the second time
    without those whose residual is among the largest, beyond the trim percentile. Reads go whose mean squared error there exceeds limit, and
    those whose slope b is flat or less by amount."""

    def fit(df: DataFrame, keep: Column, a: str, b: str) -> DataFrame:
        xs, es = F.when(keep, F.col(x).cast("double")), F.when(keep, F.col(expected).cast("double"))
        return per_read(df, key, {b: F.regr_slope(xs, es), a: F.regr_intercept(xs, es)})

    df = fit(df.withColumn("__u", use & F.col(expected).isNotNull()), F.col("__u"), "__a0", "__b0")
    df = df.withColumn("__r", F.abs(F.col(x) - F.col("__a0") - F.col("__b0") * F.col(expected)))
    df = per_read(df, key, {"__c": F.percentile(F.when(F.col("__u"), F.col("__r")), trim)})
    df = fit(df, F.col("__u") & (F.col("__r") <= F.col("__c")), "__a", "__b")
    df = df.filter(F.abs("__b") > flat).withColumn(out, (F.col(x) - F.col("__a")) / F.col("__b"))
    if limit is not None:
        gap = F.when(F.col("__u"), (F.col(out) - F.col(expected)) * (F.col(out) - F.col(expected)))
        df = per_read(df, key, {"__e": F.avg(gap)}).filter(F.col("__e") <= limit).drop("__e")
    return df.drop("__u", "__a0", "__b0", "__r", "__c", "__a", "__b")


def motif_enrichment(features: DataFrame, hits: DataFrame, key: str, by: str, half: int = 1000) -> DataFrame:
    """For each class the share of features(mid) that have a hit, a range, within half bases."""
    from .aggregates import conditional_share

    wide = features.withColumns({"s": F.col("mid") - half, "e": F.col("mid") + half})
    return conditional_share(iv.with_hit(wide, hits), "hit", by)


def enrichment_over_shuffles(
    features: DataFrame, hits: DataFrame, gaps: DataFrame, chrom_sizes: DataFrame, key: str, by: str, reps: int, seed: int, half: int = 1000
) -> DataFrame:
    """motif_enrichment() of features(key, chrom, s, e, by), of their middles, next to the median, q01 and q99 of the share among reps shuffles of all of them.

    Shuffles keep the widths of a chromosome's features and clear of the gaps, like shuffle_intervals(); features without a place count in none.
    """
    from .sampling import shuffle_intervals

    hits = stored(hits.select("chrom", "s", "e").distinct(), "hits")  # both sides ask for them, and a scan may be costly
    middle = F.expr("(s + e) div 2").alias("mid")
    shares = motif_enrichment(features.select(key, "chrom", by, middle), hits, key, by, half)
    many = features.select(key, "chrom", "s", "e").withColumn("rep", F.explode(F.expr(f"sequence(1, {reps})")))
    drawn = shuffle_intervals(many, gaps, chrom_sizes, key, seed, salt="rep").filter("s is not null").select("rep", "chrom", middle)
    drawn = drawn.select("rep", "chrom", (F.col("mid") - half).alias("s"), (F.col("mid") + half).alias("e"))
    null = iv.with_hit(drawn, hits).groupBy("rep").agg(F.avg(F.col("hit").cast("int")).alias("share"))
    q = F.percentile("share", F.array(F.lit(0.5), F.lit(0.01), F.lit(0.99))).alias("q")
    null = null.agg(q).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("q01"), F.col("q")[2].alias("q99"))
    return shares.join(F.broadcast(null))  # one row
