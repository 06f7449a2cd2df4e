"""Calls of steps on rows written by hand, and scorers of windows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import calling


def steps(spark, rows):
    return spark.createDataFrame(rows, "r long, i long, x double, t double, b double, base string")


def called(df, **options):
    out = calling.call_tm(df, "x", "t", "b", "base", 0.4, **options)
    return "".join(x["called"] for x in out.orderBy("r", "i").collect())


#: One read of steps: nearer B, nearer T, no difference between levels, other base, far from both.
B, T, N, G, FAR = (0.9, 0.0, 1.0, "T"), (0.1, 0.0, 1.0, "T"), (0.1, 0.0, 0.1, "T"), (0.9, 0.0, 1.0, "G"), (9.0, 0.0, 1.0, "T")


def read(spark, *of, key=1):
    return steps(spark, [(key, i, *s) for i, s in enumerate(of)])


@pytest.mark.parametrize(
    "of,plain,both",
    [
        ((B, B, B), "BBB", "TBB"),  # the first step has none before it
        ((T, B, B, T), "TBBT", "TXBX"),  # neighbours that disagree cancel
        ((N, B, N, N, B), "XBXXB", "XBXXB"),  # one that counts speaks for the pair, unless its own pair does not count
        ((T, T, N, B), "TTXB", "TTTB"),
        ((G, B, G, T), "GBGT", "GBGX"),  # steps of other bases have a say
        ((B,), "B", "T"),
        ((N,), "X", "X"),
    ],
)
def test_coupled_steps(spark, of, plain, both):
    df = read(spark, *of)
    assert called(df) == plain
    got = called(df, both=("r", "i"))
    # the rule by places: sums of the sides of a step and the one before
    s = [abs(t - b) > 0.4 for _, t, b, _ in of]
    pair = [s[0], *[x or y for x, y in zip(s[1:], s)]]
    side = [int(abs(x - b) < abs(x - t)) if p else 10 for (x, t, b, _), p in zip(of, pair)]
    total = [side[0], *[x + y for x, y in zip(side[1:], side)]]
    rule = "".join(
        base if base != "T" else "X" if not p or (i and n == 1) else "B" if n in (2, 11) else "T" for i, (p, n, (_, _, _, base)) in enumerate(zip(pair, total, of))
    )
    assert got == rule


def test_steps_far_from_both_levels(spark):
    assert called(read(spark, B, FAR, T)) == "BBT"
    assert called(read(spark, B, FAR, T), near=0.5) == "BXT"
    assert called(read(spark, B, FAR, T), near=0.5, both=("r", "i")) == "TBX"


def test_reads_do_not_couple(spark):
    df = read(spark, T).union(read(spark, B, B, key=2))
    assert called(df, both=("r", "i")) == "TTB"
    unknown = steps(spark, [(1, 0, 0.9, None, 1.0, "T"), (1, 1, 0.9, 0.0, 1.0, "T")])
    assert called(unknown, both=("r", "i")) == "XB"


class Counted:
    """Leaves a line in a file whenever it is unpacked."""

    def __init__(self, path):
        self.path = path

    def __setstate__(self, state):
        self.__dict__ = state
        with open(self.path, "a") as f:
            f.write(f"{os.getpid()}\n")

    def predict(self, x):
        return [x.mean(axis=(1, 2)), x.sum(axis=(1, 2))[:, None]]


def test_a_worker_unpacks_a_model_once(spark, tmp_path):
    path = str(tmp_path / "unpacked")
    windows = spark.range(400).repartition(16).select("id", F.expr("array(double(id), double(id + 1), double(id + 5))").alias("v"))
    scores = calling.score_windows(windows, ["id"], "v", Counted(path), ("mean", "total"))
    assert {r["id"]: (r["mean"], r["total"]) for r in scores.collect()} == {i: (i + 2.0, 3.0 * i + 6) for i in range(400)}
    scores.collect()
    pids = open(path).read().split()
    assert len(pids) == len(set(pids))


def test_windows_of_other_lengths_and_null_ones(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [4.0]), (4, []), (5, [3.0, 5.0])]
    windows = spark.createDataFrame(rows, "id long, v array<double>")

    class Last:
        def predict(self, x):
            return x[:, -1, 0] if x.shape[1] else np.full(len(x), np.nan)

    out = {r["id"]: r["score"] for r in calling.score_windows(windows, ["id"], "v", Last()).collect()}
    assert out == {1: 2.0, 2: None, 3: 4.0, 4: None, 5: 5.0}
    with pytest.raises(Exception, match="outputs"):
        calling.score_windows(windows, ["id"], "v", Counted("/dev/null"), ("a", "b", "c")).collect()


def test_the_logistic_scorer_stays_in_the_plan(spark):
    rows = [(1, [1.0, 2.0, 6.0]), (2, None), (3, [4.0]), (4, [])]
    df = calling.score_windows(spark.createDataFrame(rows, "id long, v array<double>"), ["id"], "v", calling.Logistic((0.3, -0.2, 0.1), -1.0))
    assert "InArrow" not in df._jdf.queryExecution().executedPlan().toString()
    out = {r["id"]: r["score"] for r in df.collect()}
    want = {i: 1 / (1 + np.exp(-(0.3 * np.mean(v) - 0.2 * np.std(v) + 0.1 * len(v) - 1))) for i, v in rows if v}
    assert out[2] is None and out[4] is None and all(abs(out[i] - x) < 1e-12 for i, x in want.items())
