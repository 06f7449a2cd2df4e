"""k-mer tables: extraction, distributions, comparison and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from .ordered import cumulated, quantiles


def kmers(seqs: DataFrame, seq: str, k: int, piece: int = 32) -> DataFrame:
    """All overlapping k-mers with their positions p, from 1; sequences shorter than k have none.

    Sequences are cut in short pieces that overlap by k - 1 first, in one pass: a substring is found by counting from the begin, so that
    a k-mer costs what its place in the piece does, and a long sequence little more than its length.
    """
    cut = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{piece + k - 1}}})).{{1,{piece}}}"), 1)
    # outer: else Spark tests first whether there is an element, for which it makes all of them once more
    pieces = seqs.select("*", F.posexplode_outer(cut).alias("__at", "__piece")).drop(seq).filter(F.length("__piece") >= k)
    inside = pieces.select("*", F.explode_outer(F.sequence(F.lit(1), F.length("__piece") - (k - 1))).alias("__i"))
    kmer = F.substring(F.col("__piece"), F.col("__i"), F.lit(k))
    return inside.withColumns({"p": F.col("__at") * piece + F.col("__i"), "kmer": kmer}).drop("__piece", "__at", "__i")


def series_kmers(df: DataFrame, key: str, idx: str, base: str, k: int) -> DataFrame:
    """The k-mer that begins at each position of a series of letters; positions too close to the end go."""
    w = Window.partitionBy(key).orderBy(idx)
    parts = [F.col(base), *[F.lead(base, i).over(w) for i in range(1, k)]]
    return df.withColumn("kmer", F.concat(*parts)).filter("kmer is not null")


def kmer_stats(df: DataFrame, kmer: str, value: str) -> DataFrame:
    return df.groupBy(kmer).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def expected_pairs(table: DataFrame, kmer: str, mean: str) -> DataFrame:
    """From a table of k-mers the expected step of each (k+1)-mer: mean of its last k-mer less that of its first."""
    a = table.select(F.col(kmer).alias("a"), F.substring(kmer, 2, 100).alias("mid"), F.col(mean).alias("ma"))
    b = table.select(F.col(kmer).alias("b"), F.expr(f"substring({kmer}, 1, length({kmer}) - 1)").alias("mid"), F.col(mean).alias("mb"))
    pairs = a.join(b, "mid")
    return pairs.select(F.concat("a", F.expr("right(b, 1)")).alias("kmer"), (F.col("mb") - F.col("ma")).alias("expected"))


def delta_table(a: DataFrame, b: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Absolute difference of the means of two tables (kmer, n, mean), with both counts; k-mers of one only go."""
    x = a.select(kmer, F.col("n").alias("n_a"), F.col("mean").alias("mean_a"))
    y = b.select(kmer, F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    return x.join(y, kmer).withColumn("delta", F.abs(F.col("mean_a") - F.col("mean_b")))


def top_by_delta(a: DataFrame, b: DataFrame, n: int = 30) -> DataFrame:
    return delta_table(a, b).filter("delta is not null").orderBy(F.desc("delta"), "kmer").limit(n)


def rank_sums(df: DataFrame, by: str, value: str, sample: str, first: str) -> DataFrame:
    """(by, n1, n2, r1, ties) of two samples, ties sharing their mean rank: twice the rank sum is whole. Rows without by or value are left out."""
    known = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    at = known.groupBy(by, value).agg(F.count_if(F.col(sample) == first).alias("c1"), F.count(F.lit(1)).alias("c"))
    at = cumulated(at, [by], value, {"__k": "c"})
    at = at.withColumn("r2", 2 * F.col("__k") - F.col("c") + 1)
    return at.groupBy(by).agg(
        F.sum("c1").alias("n1"), (F.sum("c") - F.sum("c1")).alias("n2"), F.sum(F.col("r2") * F.col("c1")).alias("r1x2"), F.sum(F.expr("c * c * c - c")).alias("ties")
    )


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution, by the polynomial 7.1.26 of Abramowitz and Stegun (error under 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, by: str, value: str, sample: str, first: str) -> DataFrame:
    """(by, n1, n2, u, z, p): U of the first sample, and the normal approximation with the correction for ties."""
    r = rank_sums(df, by, value, sample, first).filter("n1 > 0 and n2 > 0")
    n = F.col("n1") + F.col("n2")
    u = F.col("r1x2") / 2 - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide("ties", n * (n - 1)))
    r = r.withColumns({"u": u, "__v": var})
    r = r.withColumn("z", F.when(F.col("__v") > 0, (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt("__v")))
    return r.select(by, "n1", "n2", "u", "z", normal_tail(F.col("z")).alias("p"))


def ks_2samp(df: DataFrame, by: str, value: str, sample: str, first: str, terms: int = 20) -> DataFrame:
    """(by, n1, n2, d, p): largest difference of the two distribution functions, and its asymptotic p. Rows without by or value are left out."""
    known = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    at = known.groupBy(by, value).agg(F.count_if(F.col(sample) == first).alias("c1"), F.count_if(F.col(sample) != first).alias("c2"))
    at = cumulated(at, [by], value, {"__k1": "c1", "__k2": "c2"}, {"n1": "c1", "n2": "c2"})
    # the difference over the common denominator is whole
    gap = F.max(F.abs(F.col("__k1") * F.col("n2") - F.col("__k2") * F.col("n1")))
    d = at.groupBy(by, "n1", "n2").agg(gap.alias("gap")).filter("n1 > 0 and n2 > 0").withColumn("d", F.col("gap") / (F.col("n1") * F.col("n2")))
    x2 = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) * F.col("d") * F.col("d")
    tail = sum((2.0 * (-1) ** (j - 1) * F.exp(-2.0 * j * j * x2) for j in range(2, terms + 1)), 2.0 * F.exp(-2.0 * x2))
    return d.select(by, "n1", "n2", "d", F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)).alias("p"))


def top_by_p(tests: DataFrame, deltas: DataFrame, n: int = 30) -> DataFrame:
    """The n k-mers of smallest p, with the difference of their means and both counts."""
    joined = tests.select("kmer", "p").join(deltas.select("kmer", "delta", "n_a", "n_b"), "kmer")
    return joined.orderBy("p", "kmer").limit(n)


def kmer_ranges(*samples: DataFrame, kmer: str = "kmer", value: str = "value") -> DataFrame:
    """(kmer, lo, hi): the union of the samples' ranges from the 0.2 to the 99.8 percentile."""
    out = None
    for df in samples:
        q = quantiles(df, [kmer], value, {"lo": 0.002, "hi": 0.998})
        out = q if out is None else out.unionByName(q)
    return out.groupBy(kmer).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def kmer_histogram(df: DataFrame, ranges: DataFrame, bins: int = 50, floor: float = 1e-7, kmer: str = "kmer", value: str = "value", strict: bool = False) -> DataFrame:
    """(kmer, bin, lo, width, p): smoothed distribution of each k-mer's values over its range.

    Densities of empty bins at the ends become floor, others are drawn between their neighbours that are not empty; then
    each k-mer's sum to 1. With strict, all empty bins become floor and none is drawn.
    """
    spread = ranges.filter("hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    inside = df.join(spread, kmer).filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")
    counts = inside.groupBy(kmer, at).agg(F.count(F.lit(1)).alias("n"))
    grid = spread.withColumn("bin", F.explode(F.expr(f"sequence(0, {bins - 1})"))).join(counts, [kmer, "bin"], "left")
    total = F.sum("n").over(Window.partitionBy(kmer))
    grid = grid.withColumn("d", F.coalesce(F.col("n") / (total * F.col("width")), F.lit(0.0)))
    filled = F.when((F.col("d") == 0) & F.col("bin").isin(0, bins - 1), floor).when(F.col("d") > 0, F.col("d"))
    grid = grid.withColumn("f", F.greatest("d", F.lit(floor)) if strict else filled)
    back = Window.partitionBy(kmer).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(kmer).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("f").isNotNull(), F.struct("bin", "f"))
    grid = grid.withColumns({"a": F.last(mark, True).over(back), "b": F.first(mark, True).over(ahead)})
    between = F.col("a.f") + (F.col("b.f") - F.col("a.f")) * (F.col("bin") - F.col("a.bin")) / (F.col("b.bin") - F.col("a.bin"))
    grid = grid.withColumn("v", F.greatest(F.coalesce("f", between), F.lit(floor)))
    share = F.col("v") / F.sum("v").over(Window.partitionBy(kmer))
    return grid.select(kmer, "bin", "lo", "width", share.alias("p"))


def bin_lookup(df: DataFrame, hist: DataFrame, kmer: str = "kmer", value: str = "value", outside: float = -16.11809565095832, bins: int = 50) -> DataFrame:
    """df with lp, the log of its value's share in its k-mer's histogram, and out: whether the value lies outside, where lp is outside."""
    edges = hist.filter("bin = 0").select(kmer, "lo", "width")
    table = hist.select(kmer, "bin", "p")
    at = F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("int")
    df = df.join(edges, kmer, "left").withColumn("bin", F.when((at >= 0) & (at < bins), at))
    df = df.join(table, [kmer, "bin"], "left")
    return df.withColumns({"lp": F.coalesce(F.ln("p"), F.lit(outside)), "out": F.col("p").isNull()}).drop("lo", "width", "bin", "p")


def loglik_ratio(df: DataFrame, ref: DataFrame, cmp: DataFrame, key: str, idx: str, window: int = 4, **lookup) -> DataFrame:
    """df with lp_ref, lp_cmp and ratio, their difference smoothed over window positions around."""
    df = bin_lookup(df, ref, **lookup).withColumnsRenamed({"lp": "lp_ref", "out": "out_ref"})
    df = bin_lookup(df, cmp, **lookup).withColumnsRenamed({"lp": "lp_cmp", "out": "out_cmp"})
    w = Window.partitionBy(key).orderBy(idx).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn("ratio", F.avg(F.col("lp_cmp") - F.col("lp_ref")).over(w))


def pwm_scan(seqs: DataFrame, seq: str, pwm: list[dict[str, float]], share: float = 0.8) -> DataFrame:
    """Windows (p from 1, score) whose score under a position weight matrix is at least the share of the largest possible one.

    Letters outside the matrix score nothing and their windows go. The matrix is a short list.
    """
    k = len(pwm)
    top = sum(max(col.values()) for col in pwm)
    score = None
    for i, weights in enumerate(pwm):
        # the letter is sought once; others are at 0, where no weight is
        at = F.instr(F.lit("".join(weights)), F.substring("kmer", i + 1, 1))
        one = F.get(F.array(F.lit(None), *[F.lit(v) for v in weights.values()]), at)
        score = one if score is None else score + one
    found = kmers(seqs, seq, k)
    if (words := _reaching(pwm, share * top)) is not None:
        found = found.filter(F.col("kmer").isin(words))
    return found.withColumn("score", score).filter(F.col("score") >= share * top)


def _reaching(pwm: list[dict[str, float]], least: float, most: int = 4096) -> list[str] | None:
    """The words whose score is least or more, and those short of it by rounding; None if they, or their beginnings that could, are more than most."""
    words = {"": 0.0}
    for i, weights in enumerate(pwm):
        rest = sum(max(col.values()) for col in pwm[i + 1 :])
        words = {w + b: s + v for w, s in words.items() for b, v in weights.items() if s + v + rest >= least - 1e-6 * (1 + abs(least))}
        if len(words) > most:
            return None
    return list(words)
