"""Interval algebra: coverage as runs, overlap and nearest joins, clusters, tiles and profiles.

Intervals are 1-based and closed: chrom, s, e. A track is a table of disjoint runs (chrom, s, e, value). Overlap joins
meet in bins of positions, so that each pair is found once and no chromosome is compared whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from strandloom.sources.storage import stored

from .ordered import along, last_before, neighbour, quantiles, running

BIN = 10_000


def coverage(iv: DataFrame, weights: dict[str, Column] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Runs (chrom, s, e, depths...) of equal depth, up to the last end; weights name depth columns (default: depth of 1 each)."""
    keys = keys or ["chrom"]
    weights = weights or {"depth": F.lit(1)}
    w = [c.cast("long").alias(n) for n, c in weights.items()]
    ends = [(-c).cast("long").alias(n) for n, c in weights.items()]
    steps = iv.select(*keys, F.col("s").alias("pos"), *w).unionAll(iv.select(*keys, (F.col("e") + 1).alias("pos"), *ends))
    at = steps.groupBy(*keys, "pos").agg(*[F.sum(n).alias(n) for n in weights])
    runs = along(at, keys, "pos", [], {f"__{n}": ("sum", n) for n in weights}, after={"next": "pos"})
    runs = runs.filter("next is not null")
    return runs.select(*keys, F.col("pos").alias("s"), (F.col("next") - 1).alias("e"), *[F.col(f"__{n}").alias(n) for n in weights])


def stranded_depth(iv: DataFrame, right_scale: float = 1.0) -> DataFrame:
    """Runs with depth l of strand + and r of strand -, where l + r > 0."""
    depths = {"l": (F.col("strand") == "+").cast("int"), "r": (F.col("strand") == "-").cast("int")}
    runs = coverage(iv, depths).filter("l + r > 0")
    return runs if right_scale == 1.0 else runs.withColumn("r", F.col("r") * right_scale)


def rfd(iv: DataFrame, min_depth: int = 0, null_as_zero: bool = False) -> DataFrame:
    """Fork directionality (r - l) / (l + r) of each run; null where l + r is min_depth or less."""
    runs = stranded_depth(iv)
    value = F.when(F.col("l") + F.col("r") > min_depth, (F.col("r") - F.col("l")) / (F.col("l") + F.col("r")))
    return runs.withColumn("rfd", F.coalesce(value, F.lit(0.0)) if null_as_zero else value)


def strand_balance(iv: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row (n_plus, n_minus, ratio, scale): scale is what the depth of strand - is multiplied by, 1 within the tolerance."""
    n = iv.agg(F.count_if(F.col("strand") == "+").alias("n_plus"), F.count_if(F.col("strand") == "-").alias("n_minus"))
    n = n.withColumn("ratio", F.try_divide("n_plus", "n_minus"))
    return n.withColumn("scale", F.when(F.abs(F.col("ratio") - 1) > tolerance, F.col("ratio")).otherwise(F.lit(1.0)))


def strand_fraction(iv: DataFrame) -> DataFrame:
    """Runs with l / (l + r) and r / (l + r)."""
    runs = stranded_depth(iv)
    total = F.col("l") + F.col("r")
    return runs.select("chrom", "s", "e", (F.col("l") / total).alias("lf"), (F.col("r") / total).alias("rf"))


def _binned(df: DataFrame, bin_width: int) -> DataFrame:
    return df.withColumn("__bin", F.explode(F.expr(f"sequence(s div {bin_width}, e div {bin_width})")))


def fitted_width(a: DataFrame, b: DataFrame, least: int = 64) -> int:
    """Width of bins for overlap_join(): the larger mean width of both sides, so that a row is in two bins in the mean and meets few that it does not overlap."""
    mean = F.avg(F.col("e") - F.col("s") + 1)
    found = a.agg(mean.alias("a")).crossJoin(b.agg(mean.alias("b"))).first()
    return max(least, *(math.ceil(x or 0) for x in found))


def overlap_join(a: DataFrame, b: DataFrame, bin_width: int | None = BIN) -> DataFrame:
    """All pairs of a row of a and one of b on the same chromosome with a common base; b's chrom, s and e become chrom_b, s_b, e_b.

    Both are dealt to bins of positions; a pair is kept in the first bin that both reach, so it comes once. Without bin_width it is fitted
    to the rows' widths, for which both sides are read once more.
    """
    bin_width = bin_width or fitted_width(a, b)
    right = _binned(b, bin_width).withColumnsRenamed({"s": "s_b", "e": "e_b"})
    pairs = _binned(a, bin_width).join(right, ["chrom", "__bin"])
    first = F.expr(f"greatest(s, s_b) div {bin_width}")
    return pairs.filter((F.col("s") <= F.col("e_b")) & (F.col("s_b") <= F.col("e")) & (F.col("__bin") == first)).drop("__bin")


def overlaps_any(a: DataFrame, b: DataFrame, key: str, negate: bool = False, bin_width: int | None = BIN) -> DataFrame:
    """Rows of a with (negate: without) a common base with any of b. key is unique in a."""
    slim = b.select("chrom", "s", "e").distinct()
    hit = overlap_join(a.select(key, "chrom", "s", "e"), slim, bin_width).select(key).distinct()
    return a.join(hit, key, "left_anti" if negate else "left_semi")


def nearest(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a with distance to the closest of b on its chromosome: bases between, 0 if they touch or overlap, null if there is none.

    Both sets run along the chromosome together: the largest end of b before, and the smallest start after, each row.
    """
    left = a.select(key, "chrom", "s", "e").withColumns({"__b": F.lit(0), "b_s": F.lit(None).cast("long"), "b_e": F.lit(None).cast("long")})
    right = b.select(F.lit(None).cast(a.schema[key].dataType).alias(key), "chrom", "s", "e", F.lit(1).alias("__b"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    both = left.unionByName(right)
    ends = running(both, ["chrom"], "s", ["__b"], {"before": ("max", "b_e")})
    ends = running(ends, ["chrom"], "s", ["__b"], {"after": ("min", "b_s")}, back=True)
    # of rows of b with the same start the forward run misses those behind a's row, which the backward run has
    gap = F.least(F.col("s") - F.col("before") - 1, F.col("after") - F.col("e") - 1)
    gap = F.when(gap < 0, F.lit(0)).otherwise(gap)
    found = ends.filter("__b = 0").select(key, gap.alias("distance"))
    return a.join(found, key)


def with_hit(a: DataFrame, b: DataFrame, out: str = "hit") -> DataFrame:
    """a with whether a range of b overlaps it: of those of b that begin before its end, the furthest end decides.

    Both are merged in one order once, so that many rows of a, as of many shuffles, are answered from one index of b.
    """
    reach = running(b.select("chrom", "s", "e"), ["chrom"], "s", ["e"], {"__reach": ("max", "e")})
    at = a.withColumn("__at", F.col("e"))
    found = last_before(at, reach.select("chrom", F.col("s").alias("__at"), "__reach"), ["chrom"], "__at", ["__reach"])
    return found.select(*a.columns, F.coalesce(F.col("__reach") >= F.col("s"), F.lit(False)).alias(out))


def nearest_self(df: DataFrame, key: str, start: str = "pos", end: str | None = None) -> DataFrame:
    """Points (chrom, pos), or ranges with start and end, with the distance to the closest other one of their chromosome: 0 if they touch or overlap, null if there is none.

    Of those before in order, the one that reaches furthest is the closest, even if others begin later; of those after, the next.
    """
    end = end or start
    order = [c for c in (end, key) if c != start]
    near = along(df, ["chrom"], start, order, {"__p": ("max", end)}, after={"__n": start}, strict=True)
    back, ahead = F.col(start) - F.col("__p") - 1, F.col("__n") - F.col(end) - 1
    closest = F.least(back, ahead)
    return near.withColumn("distance", F.when(closest.isNotNull(), F.greatest(closest, F.lit(0)))).drop("__p", "__n")


def track_at(points: DataFrame, track: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Points (chrom, pos, ...) with the value of the track's run that holds them, null if none does."""
    right = _binned(track, bin_width).select(F.col("chrom").alias("__c"), F.col("__bin").alias("__b"), F.col("s").alias("__s"), F.col("e").alias("__e"), F.col("value").alias("__v"))
    left = points.withColumn("__bin", F.expr(f"pos div {bin_width}"))
    cond = (F.col("chrom") == F.col("__c")) & (F.col("__bin") == F.col("__b")) & F.col("pos").between(F.col("__s"), F.col("__e"))
    return left.join(right, cond, "left").select(*points.columns, F.col("__v").alias("value"))


def lift_coords(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Points moved by the offset of the block (chrom, s, e, offset) that holds them; others go."""
    moved = track_at(points, blocks.withColumnRenamed("offset", "value")).filter("value is not null")
    return moved.withColumn("pos", F.col("pos") + F.col("value")).drop("value")


def islands(runs: DataFrame, keep: Column, value: str = "value") -> DataFrame:
    """Maximal unions (chrom, s, e, length, low) of adjacent runs that all satisfy keep; low is the least value."""
    some = neighbour(runs.filter(keep), ["chrom"], "s", [], {"__pe": "e"})
    some = some.withColumn("__new", F.when(F.col("s") == F.col("__pe") + 1, 0).otherwise(1))
    some = running(some, ["chrom"], "s", [], {"__id": ("sum", "__new")})
    out = some.groupBy("chrom", "__id").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min(value).alias("low"))
    return out.select("chrom", "s", "e", (F.col("e") - F.col("s") + 1).alias("length"), "low")


def label_clusters(iv: DataFrame, gap: int | Column, part: list[str], order: list[str]) -> DataFrame:
    """Adds cluster, its number along the chromosome: a new one begins where s - (previous e) - 1 >= gap."""
    df = neighbour(iv, part, "s", order, {"__pe": "e"})
    joined = (F.col("s") - F.col("__pe") - 1) < gap
    df = df.withColumn("__new", F.when(joined, 0).otherwise(1))
    return running(df, part, "s", order, {"cluster": ("sum", "__new")}).drop("__pe", "__new")


def cluster_by_gap(iv: DataFrame, gap: int, part: list[str] | None = None, order: list[str] | None = None, ranges: bool = False) -> DataFrame:
    """Single linkage along the chromosome: (part..., s, e, eff): first start, last start (ranges: last end) and size."""
    part = part or ["chrom"]
    df = label_clusters(iv, gap, part, order or [])
    end = F.max("e" if ranges else "s").alias("e")
    return df.groupBy(*part, "cluster").agg(F.min("s").alias("s"), end, F.count(F.lit(1)).alias("eff")).drop("cluster")


def cluster_sweep(iv: DataFrame, gaps: list[int], order: list[str] | None = None) -> DataFrame:
    """cluster_by_gap for each of some gaps, gap among the keys. The list of gaps is short.

    Each row's place along the chromosome and the row before it are found once; only rows that begin a cluster are dealt to their
    gaps, and a cluster ends before the next beginning.
    """
    order = order or []
    df = along(iv.withColumn("__one", F.lit(1)), ["chrom"], "s", order, {"__n": ("sum", "__one")}, before={"__pe": "e", "__ps": "s"})
    begins = F.filter(F.array(*[F.lit(g) for g in gaps]), lambda g: F.coalesce(F.col("s") - F.col("__pe") - 1 >= g, F.lit(True)))
    starts = stored(df.select("chrom", "s", *[c for c in order if c != "s"], "__n", "__ps", F.explode(begins).alias("gap")), "cluster-starts")
    starts = along(starts, ["gap", "chrom"], "s", order, after={"__n_after": "__n", "__e": "__ps"})
    last = iv.groupBy("chrom").agg(F.count(F.lit(1)).alias("__all"), F.max("s").alias("__last"))
    size = F.coalesce("__n_after", F.col("__all") + 1) - F.col("__n")
    return starts.join(last, "chrom").select("gap", "chrom", "s", F.coalesce("__e", "__last").alias("e"), size.alias("eff"))


def cluster_spread(iv: DataFrame, gap: int, order: list[str] | None = None, scale: float = 1.4826) -> DataFrame:
    """Clusters with the median of their starts and the scaled median distance from it."""
    df = label_clusters(iv, gap, ["chrom"], order or [])
    df = stored(df.select("chrom", "cluster", "s"), "clusters")
    aggs = [F.min("s").alias("first"), F.sum("__w").alias("eff")]
    med = quantiles(df, ["chrom", "cluster"], "s", {"med": 0.5}, aggs)
    near = df.join(med, ["chrom", "cluster"]).withColumn("off", F.abs(F.col("s") - F.col("med")))
    out = quantiles(near, ["chrom", "cluster", "med", "first", "eff"], "off", {"mad": 0.5})
    return out.select("chrom", "med", F.col("first").alias("s"), "eff", (F.col("mad") * scale).alias("mad"))


def tile_genome(chrom_sizes: DataFrame, width: int) -> DataFrame:
    """Tiles (chrom, s, e) of a width, the last one of a chromosome cut."""
    first = F.explode(F.expr(f"sequence(cast(1 as bigint), size, cast({width} as bigint))")).alias("s")
    return chrom_sizes.select("chrom", "size", first).select("chrom", "s", F.least(F.col("s") + width - 1, "size").alias("e"))


def bin_mean(points: DataFrame, value: str, chrom_sizes: DataFrame, width: int) -> DataFrame:
    """Tiles with the mean value of the points in them; null without any."""
    at = points.groupBy("chrom", F.expr(f"(pos - 1) div {width} * {width} + 1").alias("s")).agg(F.sum(value).alias("__v"), F.count(value).alias("n"))
    tiles = tile_genome(chrom_sizes, width).join(at, ["chrom", "s"], "left")
    return tiles.select("chrom", "s", "e", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("__v", "n").alias("mean"))


def binned_average(track: DataFrame, chrom_sizes: DataFrame, width: int) -> DataFrame:
    """Tiles with the mean of a track's values over their bases, bases without a run counting 0."""
    cut = track.withColumn("__t", F.explode(F.expr(f"sequence((s - 1) div {width}, (e - 1) div {width})")))
    start = F.col("__t") * width + 1
    part = F.least("e", start + width - 1) - F.greatest("s", start) + 1
    sums = cut.groupBy("chrom", start.alias("s")).agg(F.sum(F.col("value") * part).alias("__v"))
    tiles = tile_genome(chrom_sizes, width).join(sums, ["chrom", "s"], "left")
    return tiles.select("chrom", "s", "e", (F.coalesce("__v", F.lit(0)) / (F.col("e") - F.col("s") + 1)).alias("mean"))


def meta_profile(features: DataFrame, track: DataFrame, half: int, by: str, step: int = 1, bin_width: int = BIN) -> DataFrame:
    """(by, offset, n, total): sum and number of track values at each offset -half..half of features(mid); total / n is the mean.

    An overlap of a feature and a run counts where it begins and is taken back where it ends; sums along a class's few offsets give the profile.
    Real values are added as whole numbers of a step of 25 digits below the largest, so that what is taken back leaves nothing behind; those that aren't finite count as missing.
    """
    scale = None
    if isinstance(track.schema["value"].dataType, DoubleType | FloatType):
        track = track.withColumn("value", F.col("value").cast("double")).filter(F.abs("value") < float("inf"))
        most = track.agg(F.max(F.abs("value"))).first()[0] or 1.0
        scale = (10.0 ** min(-math.floor(math.log10(most)) - 1, 300), 1e25)
        track = track.withColumn("value", F.round(F.col("value") * scale[0] * scale[1]).cast("decimal(38,0)"))
    wide = features.withColumns({"s": F.col("mid") - half, "e": F.col("mid") + half})
    met = overlap_join(wide, track.select("chrom", "s", "e", "value").filter("value is not null"), bin_width)
    lo, hi = F.greatest("s", "s_b") - F.col("mid"), F.least("e", "e_b") - F.col("mid")
    # offsets that are multiples of step
    first, last = (F.ceil(lo / step) * step).cast("long"), (F.floor(hi / step) * step).cast("long")
    one = F.lit(1).cast("long")
    ends = F.array(F.struct(first.alias("offset"), one.alias("n"), F.col("value").alias("total")), F.struct((last + step).alias("offset"), (-one).alias("n"), (-F.col("value")).alias("total")))
    steps = met.filter(first <= last).select(by, F.explode(ends).alias("x")).select(by, "x.*")
    steps = steps.groupBy(by, "offset").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    every = F.explode(F.sequence(F.lit(-(half // step) * step).cast("long"), F.lit(half // step * step).cast("long"), F.lit(step).cast("long")))
    grid = steps.select(by).distinct().select(by, every.alias("offset"), F.lit(0).cast("long").alias("n"), F.lit(0).cast(steps.schema["total"].dataType).alias("total"))
    at = steps.unionByName(grid).groupBy(by, "offset").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    run = Window.partitionBy(by).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"n": F.sum("n").over(run), "total": F.sum("total").over(run)}).filter((F.col("n") > 0) & (F.col("offset") <= half))
    return at if scale is None else at.withColumn("total", F.col("total").cast("double") / scale[1] / scale[0])


def inner_region(features: DataFrame, chrom_sizes: DataFrame, margin: int, blacklist: DataFrame, key: str) -> DataFrame:
    """Features further than margin from both ends of their chromosome and outside the blacklist."""
    inside = features.join(chrom_sizes, "chrom").filter(f"s > {margin} and e < size - {margin}").drop("size")
    return overlaps_any(inside, blacklist, key, negate=True)


def filter_alignments(aln: DataFrame, min_quality: int = 10) -> DataFrame:
    """Primary alignments that are no duplicates, of min_quality, properly paired if paired; one of each (chrom, s, e, strand)."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    good = ~flag(1024) & ~flag(256) & (F.col("mapq") >= min_quality) & (~flag(1) | flag(2))
    return aln.filter(good).select("chrom", "s", "e", "strand").distinct()


def region_gaps(regions: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """The parts (chrom, s, e) of chromosomes that no region covers."""
    ends = regions.select("chrom", "s", "e").unionByName(chrom_sizes.selectExpr("chrom", "size + 1 s", "size + 1 e"))
    df = running(ends, ["chrom"], "s", ["e"], {"__to": ("max", "e")}, strict=True)
    df = df.withColumn("__to", F.coalesce("__to", F.lit(0)))
    return df.filter("s > __to + 1").select("chrom", (F.col("__to") + 1).alias("s"), (F.col("s") - 1).alias("e"))


def with_integral(track: DataFrame, value: str = "value") -> DataFrame:
    """Runs with area, the sum of value times width over the runs before."""
    df = track.withColumn("__a", F.col(value) * (F.col("e") - F.col("s") + 1))
    return running(df, ["chrom"], "s", [], {"area": ("sum", "__a")}, strict=True).drop("__a")


def window_sums(points: DataFrame, track: DataFrame, windows: dict[str, tuple[int, int]], value: str = "value") -> DataFrame:
    """points(chrom, pos, id) with, for each name: (from, to), the sum of value over bases pos + from .. pos + to.

    Uses the integral of the track up to the windows' ends; bases without a run count 0. No run is expanded to bases.
    """
    runs = stored(with_integral(stored(track.select("chrom", "s", "e", value), "track"), value), "integral")
    marks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(sign).alias("sign"), (F.col("pos") + d).alias("at")) for n, (a, b) in windows.items() for sign, d in ((1, b), (-1, a - 1))])
    asked = points.select("id", "chrom", F.explode(marks).alias("m")).select("id", "chrom", "m.*")
    # runs and marks go along the chromosome together: a mark takes the last run that begins at it or before
    left = runs.select("chrom", F.col("s").alias("at"), F.lit(0).alias("kind"), F.struct("s", "e", F.col(value).alias("v"), "area").alias("run"), *[F.lit(None).cast(t).alias(c) for c, t in (("id", points.schema["id"].dataType), ("n", "string"), ("sign", "int"))])
    right = asked.select("chrom", "at", F.lit(1).alias("kind"), F.lit(None).cast(left.schema["run"].dataType).alias("run"), "id", "n", "sign")
    both = running(left.unionByName(right), ["chrom"], "at", ["kind"], {"__s": ("max", "run")})
    upto = F.col("__s.area") + F.col("__s.v") * (F.least("at", "__s.e") - F.col("__s.s") + 1)
    found = both.filter("kind = 1").groupBy("id").agg(*[F.sum(F.when(F.col("n") == n, F.col("sign") * F.coalesce(upto, F.lit(0)))).alias(n) for n in windows])
    return points.join(found, "id")


def oem(points: DataFrame, iv: DataFrame, win: int) -> DataFrame:
    """points(id, chrom, pos) with origin efficiency: the mean share of strand + over the win bases before, less that over the win from pos on.

    Bases without depth count 0; null where a window leaves the covered part of the chromosome.
    """
    track = strand_fraction(iv).withColumnRenamed("lf", "value")
    sums = window_sums(points, track, {"before": (-win, -1), "after": (0, win - 1)})
    ends = iv.groupBy("chrom").agg(F.max("e").alias("__end"))
    value = (F.col("before") - F.col("after")) / win
    inside = (F.col("pos") - win >= 1) & (F.col("pos") + win - 1 <= F.col("__end"))
    return sums.join(ends, "chrom", "left").withColumn("oem", F.when(inside, value)).drop("before", "after", "__end")


def shuffle_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)
