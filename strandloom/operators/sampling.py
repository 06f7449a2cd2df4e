"""Seeded sampling, splits and shuffles. Draws depend on keys and the seed alone, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.storage import stored

from . import intervals as iv
from .ordered import along, last_before, numbered, running


def draw(seed: int, *keys) -> Column:
    """A uniform number of 0..1 for each key: the first 13 digits of an md5, which any engine can follow."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / float(1 << 52)


def limit_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in the order of a draw for their key."""
    return df.withColumn("__d", draw(seed, F.col(key))).orderBy("__d", key).drop("__d")


def holdout(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """df with held_out for about the fraction of keys."""
    return df.withColumn("held_out", draw(seed, F.col(key)) < fraction)


def split_by_chrom(df: DataFrame, chrom: str, test: str = "chr11") -> DataFrame:
    """df with split: test on one chromosome, train elsewhere and where it is not known."""
    return df.withColumn("split", F.when(F.col(chrom) == test, "test").otherwise("train"))


def subsample_by_value(df: DataFrame, value: str, rules: dict, key: str, seed: int) -> DataFrame:
    """Rows kept with the probability given for their value; others stay."""
    p = F.lit(1.0)
    for v, keep in rules.items():
        p = F.when(F.col(value) == v, F.lit(float(keep))).otherwise(p)
    return df.filter(draw(seed, F.col(key)) < p)


def weighted_subsequences(reads: DataFrame, key: str, seq: str, weight: str, n: int, length: int, seed: int) -> DataFrame:
    """(draw, key, start, piece): n draws of reads by weight, and of each a piece of length from a uniform start.

    Draws and cumulated weights are merged in one order, so that each draw meets the one read before it; bins of the order follow the number of reads.
    Reads shorter than length, or of no weight, are not drawn.
    """
    steps = 1 << 52
    able = reads.filter((F.length(seq) >= length) & (F.col(weight) > 0)).select(key, F.col(weight).cast("double").alias("__w"))
    able = able.withColumns({"__p": F.floor(draw(seed, key) * (1 << 30)), "__one": F.lit(1)})
    size = able.agg(F.count(F.lit(1)), F.sum("__w")).first()
    bins = max(16, size[0] >> 18)
    upto = running(able, ["__one"], "__p", [key], {"__to": ("sum", "__w")}, width=max(1, (1 << 30) // bins))
    # a draw is a whole number of steps, so the first one at or after a weight's begin is exact
    begin = (F.col("__to") - F.col("__w")) / F.lit(float(size[1] or 1))
    breaks = upto.select("__one", F.ceil(begin * steps).alias("__at"), begin.alias("__a"), key)
    draws = reads.sparkSession.range(n).select(F.lit(1).alias("__one"), F.floor(draw(seed + 1, "id") * steps).alias("__at"), F.col("id").alias("draw"))
    met = last_before(draws, breaks, ["__one"], "__at", ["__a", key], width=steps // bins).select("draw", key)
    met = met.join(reads.select(key, seq), key)
    start = F.floor(draw(seed + 2, "draw") * (F.length(seq) - length + 1)).cast("int")
    return met.withColumn("start", start).select("draw", key, "start", F.substring(F.col(seq), F.col("start") + 1, F.lit(length)).alias("piece"))


def augment_mix(df: DataFrame, key: str, values: str, label: str, seed: int) -> DataFrame:
    """Each example's first half with the last half of another, and the mean of their labels.

    The other is the next in a drawn order of all, of the last the first: each example is partner once, every two are with odds of 1 in n - 1, and none is its own but a single one.
    """
    placed = numbered(df.select(key, values, label).withColumn("__u", draw(seed, key)), ["__u", key])
    partner = placed.select(F.col("__n").alias("__j"), F.col(values).alias("__v"), F.col(label).alias("__l"))
    met = placed.withColumn("__j", (F.col("__n") + 1) % F.col("__all")).join(partner, "__j")
    half = F.floor(F.size(values) / 2).cast("int")
    mixed = F.concat(F.slice(values, F.lit(1), half), F.slice("__v", half + 1, F.greatest(F.size("__v") - half, F.lit(0))))
    return met.select(key, mixed.alias(values), ((F.col(label) + F.col("__l")) / 2).alias(label))


def augment_noise(df: DataFrame, key: str, values: str, seed: int) -> DataFrame:
    """Arrays scaled by 0.9 + 0.2 u."""
    u = 0.9 + 0.2 * draw(seed, F.col(key))
    return df.withColumn("__u", u).withColumn(values, F.zip_with(values, F.array_repeat("__u", F.size(values)), lambda x, y: x * y)).drop("__u")


def augment_up_down(df: DataFrame, key: str, values: str, seed: int) -> DataFrame:
    """Arrays with one value, at a drawn place, doubled or left out, as drawn."""
    place = F.floor(draw(seed, F.col(key)) * F.size(values)).cast("int") + 1
    at = df.withColumns({"__p": place, "__up": draw(seed + 1, F.col(key)) < 0.5}).filter(F.size(values) > 0)
    n = F.size(values)
    keep = F.when(F.col("__up"), F.col("__p")).otherwise(F.col("__p") - 1)
    out = F.concat(F.slice(values, F.lit(1), keep), F.slice(values, F.when(F.col("__up"), F.col("__p")).otherwise(F.col("__p") + 1), n))
    return at.withColumn(values, out).drop("__p", "__up")


def permuted(df: DataFrame, by: list[str], key: str, column: str, seed: int) -> DataFrame:
    """df(by..., key, column) with the column's values dealt anew among the rows of each by, in a drawn order."""
    drawn = numbered(df.withColumn("__u", draw(seed, key, *by)), ["__u", key], by).select(*by, "__n", column)
    return numbered(df.drop(column), [key], by).join(drawn, [*by, "__n"]).drop("__n", "__all")


def shuffle_intervals(features: DataFrame, gaps: DataFrame, chrom_sizes: DataFrame, key: str, seed: int, salt: str | None = None) -> DataFrame:
    """Features (key, chrom, s, e) at drawn places of their chromosome, outside the gaps, with the widths of the chromosome's features dealt
    anew among them; s and e are null where no free run is wide enough.

    Each start that keeps a feature clear of gaps and within its chromosome is drawn alike. A feature of e = s + d ends at any free position that lies d or more
    behind its run's begin. Free positions are numbered by this distance t, and at one distance by the runs that reach it, longest first: those of a width
    d are all numbers from one on, which only d decides, and a number falls between two lengths of runs, where as many runs reach each distance.
    So two merges in order and a join by the run's place lead from a draw to a start; rows are those of features and runs.
    """
    extra = [salt] if salt else []
    asked = features.select(key, *extra, "chrom", (F.col("e") - F.col("s")).alias("__d"))
    asked = permuted(asked, [*extra, "chrom"], key, "__d", seed + 1).withColumnRenamed("__d", "__t")
    free = iv.region_gaps(gaps, chrom_sizes).select("chrom", F.col("s").alias("__s"), (F.col("e") - F.col("s") + 1).alias("__l"))
    runs = stored(numbered(free.withColumn("__m", -F.col("__l")), ["__m", "__s"], ["chrom"]), "free-runs")
    # from a distance that is some runs' length on, fewer runs reach on; from 0 on, all do
    lengths = runs.groupBy("chrom", F.col("__l").alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    lengths = lengths.unionByName(runs.groupBy("chrom").agg(F.lit(0).cast("long").alias("__t"), F.lit(0).cast("long").alias("__c")))
    lengths = along(lengths, ["chrom"], "__t", [], {"__gone": ("sum", "__c")}, after={"__ahead": "__t"})
    lengths = lengths.join(runs.groupBy("chrom").agg(F.count(F.lit(1)).alias("__runs")), "chrom").withColumn("__reach", F.col("__runs") - F.col("__gone"))
    lengths = lengths.withColumn("__span", (F.coalesce("__ahead", "__t") - F.col("__t")) * F.col("__reach"))
    steps = along(stored(lengths, "lengths"), ["chrom"], "__t", [], {"__upto": ("sum", "__span")})
    steps = stored(steps.select("chrom", "__t", (F.col("__upto") - F.col("__span")).alias("__from"), "__reach", "__upto"), "steps")
    all_of = steps.groupBy("chrom").agg(F.max("__upto").alias("__total"))
    asked = last_before(asked, steps.withColumn("__base", F.col("__t")), ["chrom"], "__t", ["__base", "__from", "__reach"]).join(all_of, "chrom", "left")
    least = F.col("__from") + (F.col("__t") - F.col("__base")) * F.col("__reach")
    count = F.greatest(F.col("__total") - least, F.lit(0))
    place = F.when(count > 0, least + F.floor(draw(seed, key, *extra, "chrom") * count))
    asked = stored(asked.select(key, *extra, "chrom", F.col("__t").alias("__d"), place.alias("__at")), "draws")
    sure = last_before(asked.filter("__at is not null"), steps.filter("__reach > 0").withColumnRenamed("__from", "__at").withColumn("__from", F.col("__at")), ["chrom"], "__at", ["__t", "__from", "__reach"])
    sure = sure.withColumns({"__n": (F.col("__at") - F.col("__from")) % F.col("__reach"), "__end": F.col("__t") + F.expr("(__at - __from) div __reach")})
    start = F.col("__s") + F.col("__end") - F.col("__d")
    placed = sure.join(runs.select("chrom", "__n", "__s"), ["chrom", "__n"]).select(key, *extra, "chrom", start.alias("s"), (start + F.col("__d")).alias("e"))
    nowhere = asked.filter("__at is null").select(key, *extra, "chrom", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"))
    return placed.unionByName(nowhere)


def null_quantiles(features: DataFrame, gaps: DataFrame, chrom_sizes: DataFrame, hits: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """Median, 1 and 99 percent quantiles of the share of shuffled features that overlap hits, over reps shuffles; features without a place count in none."""
    many = features.withColumn("rep", F.explode(F.expr(f"sequence(1, {reps})")))
    drawn = shuffle_intervals(many, gaps, chrom_sizes, key, seed, salt="rep").filter("s is not null").select("rep", "chrom", "s", "e")
    share = iv.with_hit(drawn, hits).groupBy("rep").agg(F.avg(F.col("hit").cast("int")).alias("share"))
    q = F.percentile("share", F.array(F.lit(0.5), F.lit(0.01), F.lit(0.99))).alias("q")
    return share.agg(q).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("q01"), F.col("q")[2].alias("q99"))
