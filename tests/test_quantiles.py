"""Quantiles from sums over bins of values against sorted lists."""

import random

from strandloom.operators import aggregates, kmers, stats
from strandloom.operators.ordered import quantiles


def exact(values, p):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] if low == at else (low + 1 - at) * values[low] + (at - low) * values[low + 1]


def test_quantiles_of_any_spread(spark):
    """A third of the rows in one group, values that grow tenfold, ties, nulls, a group of nulls and a null group."""
    r = random.Random(3)
    rows = [("hot", 10.0 ** r.uniform(-3, 9)) for _ in range(2000)] + [("ties", float(r.randrange(5))) for _ in range(501)]
    rows += [(f"g{i % 40}", r.choice([None, r.gauss(0, 1)])) for i in range(2000)] + [("none", None)] * 3 + [(None, float(i)) for i in range(8)] + [("one", 7.0)]
    points = {"a": 0.0, "b": 0.002, "c": 0.25, "d": 0.5, "e": 0.998, "f": 1.0}
    got = quantiles(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], "x", points).collect()
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    assert len(got) == len(groups)
    for row in got:
        for name, p in points.items():
            want = exact(groups[row.k], p)
            assert row[name] == want or abs(row[name] - want) <= 1e-12 * abs(want)


def test_describe_and_percentile_of_odd_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", None), ("b", None), (None, 9)], "k string, x long")
    got = {r.k: tuple(r)[1:] for r in aggregates.describe5(df, "x", ["k"]).collect()}
    assert got == {"a": (1, 1.75, 2.5, 2.5, 3.25, 4), "b": (None,) * 6, None: (9, 9.0, 9.0, 9.0, 9.0, 9)}
    assert [tuple(r) for r in aggregates.describe5(df, "x").collect()] == [(1, 2.5, 4.0, 14 / 3, 6.5, 9)]
    empty = df.filter("false")
    assert [tuple(r) for r in aggregates.describe5(empty, "x").collect()] == [(None,) * 6]
    assert aggregates.describe5(empty, "x", ["k"]).count() == 0
    assert {tuple(r) for r in aggregates.kmer_percentile(df, "k", "x", 0.5).collect()} == {("a", 2.5, 2), ("b", None, 0), (None, 9.0, 1)}


def test_ecdf_of_values_far_apart(spark):
    values = [10.0 ** (i % 300 - 150) for i in range(900)]
    got = sorted(tuple(r) for r in stats.ecdf(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect())
    assert got == [(v, (i + 1) / 300) for i, v in enumerate(sorted(set(values)))]


def test_tests_of_two_samples_with_a_hot_group(spark):
    """Rank sums and distribution functions against sorted lists; a group holds most rows, with values far apart, ties and nulls."""
    r = random.Random(4)
    rows = [("hot", r.choice([10.0 ** r.uniform(-9, 9), 1.0, 2.0]), r.choice("ab")) for _ in range(1500)]
    rows += [(f"g{i % 9}", r.choice([None, float(r.randrange(7))]), r.choice("ab")) for i in range(300)] + [(None, 1.0, "a"), ("lone", 1.0, "a")]
    df = spark.createDataFrame(rows, "k string, x double, s string").repartition(5)
    u = {row.k: row.u for row in kmers.mann_whitney(df, "k", "x", "s", "a").collect()}
    d = {row.k: row.d for row in kmers.ks_2samp(df, "k", "x", "s", "a").collect()}
    groups = {k for k, _, _ in rows} - {None, "lone"}
    assert set(u) == set(d) == groups
    for k in groups:
        a, b = ([x for key, x, s in rows if key == k and x is not None and s == side] for side in "ab")
        assert u[k] == sum((x > y) + (x == y) / 2 for x in a for y in b)
        gap = max(abs(sum(x <= v for x in a) / len(a) - sum(y <= v for y in b) / len(b)) for v in {*a, *b})
        assert abs(d[k] - gap) < 1e-12


def test_ranks_are_not_broadcast(spark):
    """The size of their files says little about that of their rows."""
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randrange(9), r.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame([(k, x, y, 1) for k, x, y in set(rows)], "k string, x long, y long, w long")
    ranked = stats.weighted_ranks(df, ["k"], {"a": "x", "b": "y"}, "w")
    assert "BroadcastHashJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    found = ranked.collect()
    assert len(found) == len(set(rows))
    for row in found:
        for rank, v in ((row.a, 1), (row.b, 2)):
            own = [x[v] for x in set(rows) if x[0] == row.k]
            at = row.x if v == 1 else row.y
            assert rank == 2 * sum(x < at for x in own) + own.count(at) + 1
