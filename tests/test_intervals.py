"""Interval operators: properties, and cases at the edges of bins."""

import random

import pytest

from strandloom.operators import intervals as iv
from strandloom.operators import sampling as sm


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, chrom string, s long, e long")


def test_distances_of_touching_and_separate_ranges(spark):
    a, b = frame(spark, [(1, "c", 10, 20), (2, "c", 23, 24), (3, "d", 1, 2)]), frame(spark, [(9, "c", 21, 21)])
    out = {r.id: r.distance for r in iv.nearest(a, b, "id").collect()}
    assert out == {1: 0, 2: 1, 3: None}


def test_joins_over_bins_equal_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("ab"), s := rng.randrange(1, 3000), s + rng.randrange(0, 400)) for i in range(n)]
    x, y = make(120), make(100)
    got = {(r.id, r.id_b) for r in iv.overlap_join(frame(spark, x), frame(spark, y).withColumnRenamed("id", "id_b"), 100).collect()}
    assert got == {(p[0], q[0]) for p in x for q in y if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3]}
    near = {r.id: r.distance for r in iv.nearest(frame(spark, x), frame(spark, y), "id").collect()}
    assert near == {p[0]: min(max(0, q[2] - p[3] - 1, p[2] - q[3] - 1) for q in y if q[1] == p[1]) for p in x}


def test_bin_width_does_not_change_running_values(spark):
    from strandloom.operators.ordered import along

    rng = random.Random(5)
    df = frame(spark, [(i, rng.choice("ab"), rng.randrange(1, 500), i % 7) for i in range(300)])
    run = lambda w: sorted(map(tuple, along(df, ["chrom"], "s", ["id"], {"t": ("sum", "e"), "m": ("max", "e")}, {"p": "e"}, {"n": "e"}, width=w).collect()), key=str)
    assert run(7) == run(10_000)
    back = lambda w: sorted(map(tuple, along(df, ["chrom"], "s", ["id"], {"t": ("sum", "e")}, back=True, strict=True, width=w).collect()), key=str)
    assert back(7) == back(10_000)


def test_clusters_keep_members_and_gaps(spark):
    rng = random.Random(6)
    pts = frame(spark, [(i, "c", s := rng.randrange(1, 400_000), s) for i in range(300)])
    out = sorted((r.s, r.e, r.eff) for r in iv.cluster_by_gap(pts, 1500, order=["id"]).collect())
    assert sum(r[2] for r in out) == 300
    assert all(b[0] - a[1] - 1 >= 1500 for a, b in zip(out, out[1:]))
    assert all(s == e for s, e, n in out if n == 1)


def test_shuffled_intervals_avoid_gaps_and_keep_widths(spark):
    feat = frame(spark, [(i, "c", 100 * i + 1, 100 * i + 1 + i % 40) for i in range(200)])
    gaps = spark.createDataFrame([("c", 500, 3000), ("c", 9000, 9100)], "chrom string, s long, e long")
    sizes = spark.createDataFrame([("c", 30_000)], "chrom string, size long")
    out = sm.shuffle_intervals(feat, gaps, sizes, "id", 3).collect()
    assert len(out) == 200 and sorted(r.e - r.s for r in out) == sorted(i % 40 for i in range(200))
    assert all(r.e < lo or r.s > hi for r in out for lo, hi in ((500, 3000), (9000, 9100))) and all(1 <= r.s and r.e <= 30_000 for r in out)
    again = sm.shuffle_intervals(feat.repartition(7), gaps, sizes, "id", 3).collect()
    assert sorted(out) == sorted(again)


def test_draws_follow_weights(spark):
    reads = spark.createDataFrame([(1, "A" * 50, 1.0), (2, "C" * 50, 3.0), (3, "G" * 5, 9.0)], "id long, seq string, w double")
    out = sm.weighted_subsequences(reads, "id", "seq", "w", 2000, 20, 1).collect()
    assert len(out) == 2000 and {r.id for r in out} == {1, 2} and all(len(r.piece) == 20 for r in out)
    assert 0.7 < sum(r.id == 2 for r in out) / 2000 < 0.8


def test_empty_inputs(spark):
    none = frame(spark, [])
    some = frame(spark, [(1, "c", 5, 9)])
    assert iv.coverage(none).count() == 0
    assert iv.nearest(none, some, "id").count() == 0
    assert iv.nearest(some, none, "id").first().distance is None
    assert iv.overlap_join(some, none.withColumnRenamed("id", "i2")).count() == 0
    assert iv.cluster_by_gap(none, 10).count() == 0


def test_shuffled_intervals_keep_all_features(spark):
    """Dense gaps: each feature lands clear of them, on each admissible start alike, or nowhere if no run is wide enough."""
    from collections import Counter

    from strandloom.operators.sampling import shuffle_intervals

    sizes = spark.createDataFrame([("c", 1000), ("d", 50)], "chrom string, size long")
    gaps = spark.createDataFrame([("c", s, s + 39) for s in range(60, 1000, 60)] + [("d", 1, 50)], "chrom string, s long, e long")
    features = [(i, "c", 500, 500 + w) for i, w in enumerate([15] * 400 + [19] * 50 + [58, 59, 900])] + [(1000, "d", 1, 3)]
    out = {r.id: r for r in shuffle_intervals(spark.createDataFrame(features, "id long, chrom string, s long, e long"), gaps, sizes, "id", 5).collect()}
    assert set(out) == {f[0] for f in features}
    taken = {x for s in range(60, 1000, 60) for x in range(s, s + 40)}
    # widths are dealt anew: two of c are too wide for any run, whoever has them, and d has no free position
    placed = [r for r in out.values() if r.s is not None]
    assert Counter(r.e - r.s for r in placed) == {15: 400, 19: 50, 58: 1} and all(r.chrom == "c" for r in placed)
    assert out[1000].s is None and all(r.e is None and r.chrom == ("d" if r.id == 1000 else "c") for r in out.values() if r.s is None)
    assert all(r.s >= 1 and r.e <= 1000 and not taken & set(range(r.s, r.e + 1)) for r in placed)
    assert sum(out[i].s is not None and out[i].e - out[i].s != 15 for i in range(400)) > 0
    starts = Counter(r.s for r in placed)
    assert len(starts) > 60 and max(starts.values()) < 20


def test_expected_signal_joins_every_kmer(spark):
    from pyspark.sql import functions as F

    from strandloom.operators.joins import expected_signal

    table = spark.range(4**8).select(F.col("id").cast("string").alias("kmer"), F.col("id").alias("expected"))
    assert expected_signal(table.select("kmer"), table, "kmer", "expected").count() == 4**8


@pytest.mark.parametrize("seed", range(3))
def test_nearest_other_range(spark, seed):
    """Nested, equal, touching and lonely ranges; width one too."""
    draw = random.Random(seed)
    rows = [(i, draw.choice("aab"), s := draw.randrange(1, 400_000 if i % 3 else 300), s + draw.choice([0, 0, 3, 40, 200_000])) for i in range(120)]
    rows += [(900, "a", 50, 60), (901, "a", 50, 60), (902, "a", 61, 70), (903, "z", 1, 5)]
    out = iv.nearest_self(spark.createDataFrame(rows, "id int, chrom string, s long, e long"), "id", "s", "e").collect()
    for r in out:
        others = [max(0, b[2] - r["e"] - 1, r["s"] - b[3] - 1) for b in rows if b[1] == r["chrom"] and b[0] != r["id"]]
        assert r["distance"] == min(others, default=None)
    assert len(out) == len(rows)


@pytest.mark.parametrize("large", [1e16, 1e300, 1e-290])
def test_profiles_of_small_values_next_to_large_ones(spark, large):
    """What a large value leaves behind when it is taken back would drown the small ones."""
    features = spark.createDataFrame([("c", 100, "x")], "chrom string, mid long, by string")
    track = spark.createDataFrame([("c", 80, 89, large), ("c", 95, 105, large / 1e16), ("c", 106, 107, float("nan"))], "chrom string, s long, e long, value double")
    out = {r["offset"]: r["total"] for r in iv.meta_profile(features, track, 20, "by").collect()}
    assert set(out) == {*range(-20, -10), *range(-5, 6)}
    assert all(abs(out[o] / large - 1) < 1e-12 for o in range(-20, -10)) and all(abs(out[o] / large * 1e16 - 1) < 1e-8 for o in range(-5, 6))


def test_bins_follow_the_widths(spark):
    a = spark.createDataFrame([(i, "c", 37 * i % 5000, 37 * i % 5000) for i in range(300)], "id int, chrom string, s long, e long")
    b = spark.createDataFrame([(i, "c", 91 * i % 5000, 91 * i % 5000 + i % 300) for i in range(300)], "fid int, chrom string, s long, e long")
    assert iv.fitted_width(a, b) == 151 and iv.fitted_width(a, b.limit(0)) == 64
    want = sorted((r.id, q.fid) for r in a.collect() for q in b.collect() if q.s <= r.s <= q.e)
    assert sorted(map(tuple, iv.overlap_join(a, b, None).select("id", "fid").collect())) == want
