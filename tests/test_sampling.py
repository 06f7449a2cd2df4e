"""Numbering over ranges, merges in order, and draws that rest on them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import reads, sampling
from strandloom.operators.ordered import last_before, numbered


@pytest.fixture
def ranges(spark):
    """Ranges are not joined again, so that several tasks number their rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_common_beginning_fills_several_ranges(spark, ranges):
    """Most names begin alike; nulls come first; every row has the place that sorting gives."""
    names = [f"read_channel_1_read_{random.Random(i).randrange(10**9):09d}" for i in range(3000)] + ["a", "z", None]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    out = numbered(df.withColumn("task", F.lit(0)), ["name"])
    rows = out.select("name", "__n", "__all", F.col("__n")).collect()
    want = sorted(names, key=lambda n: (n is not None, n or ""))
    assert [r["name"] for r in sorted(rows, key=lambda r: r["__n"])] == want and {r["__all"] for r in rows} == {3003}
    sizes = df.repartitionByRange("name").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 2000
    kept = {r["name"] for r in reads.fraction_slice(df, "name", 0.2, 0.7).collect()}
    assert kept == {n for i, n in enumerate(want) if 0.2 < i / 3003 < 0.7}


@pytest.mark.parametrize("kind", ["double", "int", "string", "date"])
def test_any_type_and_groups(spark, ranges, kind):
    draw = random.Random(2)
    rows = [(draw.choice(["x", "x", "x", "y", None]), draw.randrange(0, 400), i) for i in range(500)]
    value = F.date_add(F.lit("2020-01-01").cast("date"), F.col("v")) if kind == "date" else F.col("v").cast(kind)
    df = spark.createDataFrame(rows, "g string, v int, id int").withColumn("v", value)
    out = numbered(df, ["v", "id"], ["g"]).collect()
    for g in ("x", "y", None):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        assert [r["__n"] for r in mine] == list(range(len(mine))) and {r["__all"] for r in mine} == {len(mine)}
    assert not numbered(df.limit(0), ["v"]).count()


@pytest.mark.parametrize("width", [1, 7, 1 << 17])
def test_the_last_break_before(spark, width):
    draw = random.Random(3)
    breaks = [(draw.choice("ab"), draw.randrange(200), i) for i in range(60)]
    points = [(draw.choice("abc"), draw.randrange(200), i) for i in range(300)]
    out = last_before(spark.createDataFrame(points, "c string, p long, id int"), spark.createDataFrame(breaks, "c string, p long, b int"), ["c"], "p", ["b"], width)
    for r in out.collect():
        want = max(((p, b) for c, p, b in breaks if c == r["c"] and p <= r["p"]), default=(None, None))
        assert r["b"] == want[1]
    assert out.count() == 300


def test_each_example_is_partner_once(spark, ranges):
    df = spark.createDataFrame([(i, [float(i)] * 4, float(i)) for i in range(101)], "id int, v array<double>, y double")
    out = {r["id"]: r["v"] for r in sampling.augment_mix(df, "id", "v", "y", 4).collect()}
    partners = [v[2] for v in out.values()]
    assert sorted(partners) == [float(i) for i in range(101)] and all(v[0] == i != v[2] for i, v in out.items())
    assert sampling.augment_mix(df.filter("id = 5"), "id", "v", "y", 4).first()["v"] == [5.0] * 4


def test_every_admissible_start_has_equal_odds(spark):
    """Gaps leave runs of 4, 9 and 2 positions; features of three widths, over many repetitions."""
    sizes = spark.createDataFrame([("c", 20), ("d", 5)], "chrom string, size long")
    gaps = spark.createDataFrame([("c", 5, 6), ("c", 16, 18)], "chrom string, s long, e long")
    features = spark.createDataFrame([(1, "c", 1, 3), (2, "c", 3, 3), (3, "c", 2, 9), (4, "d", 1, 9), (5, "d", 1, 2)], "id int, chrom string, s long, e long")
    n = 4000
    many = features.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    out = sampling.shuffle_intervals(many, gaps, sizes, "id", 7, salt="rep").collect()
    assert len(out) == 5 * n
    free = {"c": {*range(1, 5), *range(7, 16), *range(19, 21)}, "d": set(range(1, 6))}
    at, dealt = Counter(), Counter()
    for r in out:
        if r["s"] is None:
            assert r["chrom"] == "d"
            continue
        assert set(range(r["s"], r["e"] + 1)) <= free[r["chrom"]]
        at[r["chrom"], r["e"] - r["s"], r["s"]] += 1
        dealt[r["id"], r["e"] - r["s"]] += 1
    for chrom, d in (("c", 0), ("c", 2), ("c", 7), ("d", 1)):
        starts = [s for s in range(1, 21) if set(range(s, s + d + 1)) <= free[chrom]]
        seen = {s: c for (k, w, s), c in at.items() if (k, w) == (chrom, d)}
        mean = sum(seen.values()) / len(starts)
        assert sorted(seen) == starts and sum(seen.values()) == n and all(abs(c - mean) < 5 * mean**0.5 for c in seen.values())
    # widths of a chromosome go to each of its features alike, each once a repetition
    assert all(abs(dealt[i, d] - n / 3) < 5 * (n / 3) ** 0.5 for i in (1, 2, 3) for d in (0, 2, 7))


def test_draws_by_weight_are_exact(spark):
    draw = random.Random(6)
    rows = [(i, "ACGT" * 5, draw.choice([0.0, 1.0, 2.5, 1000.0])) for i in range(200)] + [(900, "AC", 5.0)]
    out = sampling.weighted_subsequences(spark.createDataFrame(rows, "id int, seq string, w double"), "id", "seq", "w", 3000, 8, 1).collect()
    weight, total = {i: w for i, _, w in rows if i != 900}, sum(w for i, _, w in rows if i != 900)
    seen = Counter(r["id"] for r in out)
    assert len(out) == 3000 and len({r["draw"] for r in out}) == 3000 and all(weight[i] > 0 for i in seen)
    heavy = sum(c for i, c in seen.items() if weight[i] == 1000)
    assert abs(heavy / 3000 - sum(w for w in weight.values() if w == 1000) / total) < 0.03


def test_summaries_of_scaled_samples(spark):
    import numpy as np

    from strandloom.operators.stats import iqr_summary

    rows = [(1, 0, [3.0, 0.0, 900.0]), (1, 1, [4.0, 5.5]), (1, 2, []), (1, 3, None), (2, 0, [7.0, 7.0, 0.0, 7.0, 7.0])]
    out = {(r["r"], r["i"]): (r["mean"], r["std"], r["low"], r["high"]) for r in iqr_summary(spark.createDataFrame(rows, "r int, i int, v array<double>"), "v", "r").collect()}
    x = np.array([3, 0, 900, 4, 5.5])
    wide = np.percentile(x, 75) - np.percentile(x, 25)
    for i, v in ((0, [3.0, 0.0, 900.0]), (1, [4.0, 5.5])):
        z = np.where(np.array(v) == 0, 0, np.clip((np.array(v) - np.median(x)) / wide, -5, 5))
        assert np.allclose(out[1, i], (z.mean(), z.std(), z.min(), z.max()))
    assert out[1, 2] == out[1, 3] == (None,) * 4 and out[2, 0][0] is None


def test_values_that_hold_one_of_many_parts(spark):
    """Far more parts than a plan could list; short, empty and null ones too."""
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    values = [f"read_{word(12)}" for _ in range(400)] + ["", None, "abé\U0001f600", "read_x"]
    parts = [v[5 : 5 + draw.randint(9, 12)] for v in values[:40]] + [word(draw.randint(9, 14)) + "q" for _ in range(100_000)] + ["\U0001f600", "read_x", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, name string")
    out = reads.filter_contains(df, "name", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    known = set(filter(None, parts))
    want = {i for i, v in enumerate(values) if v and any(v[a:b] in known for a in range(len(v)) for b in range(a + 1, len(v) + 1))}
    assert {r["id"] for r in out.collect()} == want and len(want) >= 42 and out.columns == ["id", "name"]
    few = lambda ps: {r["id"] for r in reads.filter_contains(df, "name", spark.createDataFrame([(p,) for p in ps], "p string"), "p").collect()}
    assert few([""]) == {i for i, v in enumerate(values) if v is not None} and few([None]) == set() == few([])
    assert few(["d"]) == {i for i, v in enumerate(values) if v and "d" in v}


def test_shares_of_strings_and_dates(spark):
    from strandloom.operators.stats import ecdf

    rows = [(draw, f"name_{draw:03d}") for draw in (random.Random(4).choices(range(50), k=500))]
    out = {r["s"]: r["share"] for r in ecdf(spark.createDataFrame(rows, "i int, s string"), "s").collect()}
    assert out == {s: sum(x <= s for _, x in rows) / 500 for _, s in rows}
