"""Fork detection on reads drawn by hand."""

import os
import random
import time
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from strandloom.operators.calling import best_partition, find_peaks
from strandloom.plans import forks as fk
from strandloom.queries.calling import SMALL, _small
from strandloom.queries.fork_sql import fork_sql
from strandloom.sources import tables

S = fk.LETTERS


def line(*corners, n=6001):
    """Values at 0, 10, 20 ... of a line through corners (x, y)."""
    x = np.arange(n) * 10.0
    return x, np.interp(x, [c[0] for c in corners], [c[1] for c in corners])


def tracts(x, y):
    at = fk.corner_points(x, y, S.tolerance)
    return fk.detect_tracts(x[at], fk.flatten_spikes(x[at], y[at], S.spike), S.min_jump)


# a rise over 1000 bases and a fall over 9000 is a fork to the right
RIGHT = [(20000, 0), (21000, 1), (30000, 0)]
LEFT = [(40000, 0), (49000, 1), (50000, 0)]


def test_corner_points_keep_what_bends():
    x, y = line((0, 0), (20000, 0), (21000, 1), (30000, 0), (60000, 0))
    assert x[fk.corner_points(x, y, 0.25)].tolist()[1:-1] == [20000, 21000, 30000]


def test_directions():
    (r,) = tracts(*line((0, 0), *RIGHT, (60000, 0)))
    assert (r.dir, r.start, r.end) == ("R", 20000, 30000) and r.score == pytest.approx(9)
    assert r.jump_score == pytest.approx(10 * (1 - S.min_jump))
    (left,) = tracts(*line((0, 0), *LEFT, (60000, 0)))
    assert (left.dir, left.start, left.end) == ("L", 40000, 50000) and left.score == pytest.approx(-9)
    (even,) = tracts(*line((0, 0), (20000, 0), (25000, 1), (30000, 0), (60000, 0)))
    assert (even.dir, even.score) == ("?", 0)


def test_flat_reads_have_none():
    assert tracts(*line((0, 0.1), (60000, 0.1))) == []
    assert fk.detect_tracts(np.array([0.0, 1.0]), np.array([0.0, 1.0]), 0.44) == []


def test_narrow_spikes_are_flattened():
    x, y = np.array([0.0, 400, 800, 5000]), np.array([0.1, 0.9, 0.2, 0.2])
    assert fk.flatten_spikes(x, y, 1000).tolist() == pytest.approx([0.1, 0.15, 0.2, 0.2])


def test_diverging_tracts_make_an_initiation():
    x, y = line((0, 0), (10000, 0), (19000, 1), (20000, 0), (24000, 0), (25000, 1), (34000, 0), (60000, 0))
    found = tracts(x, y)
    assert [t.dir for t in found] == ["L", "R"]
    assert fk.detect_inits(found, x, y, S) == [(22000, 10000, 20000, 24000, 34000)]
    assert fk.detect_terms(found, x, y, S) == []


def test_converging_tracts_make_a_termination():
    x, y = line((0, 0), (10000, 0), (11000, 1), (20000, 0), (24000, 0), (33000, 1), (34000, 0), (60000, 0))
    found = tracts(x, y)
    assert [t.dir for t in found] == ["R", "L"]
    assert fk.detect_inits(found, x, y, S) == []
    assert fk.detect_terms(found, x, y, S) == [(22000, 10000, 20000, 24000, 34000)]


def test_doubtful_partner_gets_its_direction():
    a, b = fk.Tract(0, 1000, 3, "L", -9.0), fk.Tract(5000, 7000, 3, "?", 0.0)
    x = np.arange(0, 8000, 10.0)
    assert len(fk.detect_inits([a, b], x, np.zeros(len(x)), S)) == 1
    assert (b.dir, b.score, b.jump_score) == ("R", 5, 5)


def test_a_certain_right_takes_any_partner_unless_mirrored():
    x = np.arange(0, 8000, 10.0)
    pair = lambda: [fk.Tract(0, 1000, 3, "?", -9.0), fk.Tract(5000, 7000, 3, "R", 9.0)]
    assert len(fk.detect_inits(pair(), x, np.zeros(len(x)), S)) == 1
    assert fk.detect_inits(pair(), x, np.zeros(len(x)), fk.Settings(mirror=True)) == []


def test_overlaps_leave_the_larger_score():
    t = [fk.Tract(0, 100, 1, "R", 3), fk.Tract(50, 150, 1, "L", -5), fk.Tract(200, 300, 1, "?", 0)]
    assert [x.start for x in fk.resolve_overlaps(t)] == [50, 200]


def test_detect_forks_gates_and_columns(spark):
    x, y = line((0, 0), (10000, 0), (19000, 1), (20000, 0), (24000, 0), (25000, 1), (34000, 0), (60000, 0))
    rows = [("good", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [("flat", i, float(i), 0.01 * (i % 2)) for i in range(500)] + [("holes", i, float(i), None) for i in range(50)]
    df = spark.createDataFrame(rows, "read_id string, idx int, x double, y double")
    out = fk.detect_forks(df, "read_id", "idx", "x", "y", fk.Settings(min_std=0.2)).collect()
    assert {r.read_id for r in out} == {"good"}
    assert [r.dir for r in sorted(out, key=lambda r: r.id) if r.kind == "tract"] == ["L", "R"]
    assert sum(r.kind == "init" for r in out) == 1


def test_best_partition_finds_steps():
    v = np.array([0, 0, 0, 5, 5, 5, 5, 1, 1, 1], float)
    assert best_partition(v, 0.5, 1, 10) == [3, 7, 10]
    assert best_partition(v, 1000.0, 1, 5) == [5, 10]
    for ends in (best_partition(np.random.default_rng(1).normal(size=40), 0.1, 2, 6),):
        sizes = np.diff([0, *ends])
        assert sizes.min() >= 2 and sizes.max() <= 6


def test_peaks_need_height_and_threshold():
    quiet = np.zeros(40)
    peak = quiet.copy()
    peak[10:13] = [1.0, 3.0, 1.0]
    assert find_peaks(peak, quiet, (4, 6), (1.4, 1.0), 0.65) == [11]
    assert find_peaks(peak / 3, quiet, (4, 6), (1.4, 1.0), 0.65) == []
    assert find_peaks(quiet, peak, (4, 6), (1.4, 1.0), 0.65) == [11]


def slow_overlaps(tracts):
    """The rule as it is told: while a tract starts inside another, the first pair is decided."""
    tracts = list(tracts)
    while pair := next(((a, b) for a in range(len(tracts)) for b in range(len(tracts)) if a != b and tracts[b].start <= tracts[a].start < tracts[b].end), None):
        a, b = pair
        tracts.pop(b if abs(tracts[a].score) > abs(tracts[b].score) else a)
    return tracts


@pytest.mark.parametrize("ordered", [True, False])
def test_overlaps_go_as_told(ordered):
    draw = random.Random(ordered)
    for _ in range(150):
        tracts = [fk.Tract(s := draw.randrange(30), s + draw.randrange(12), i, score=draw.randrange(-4, 5)) for i in range(draw.randrange(14))]
        if ordered:
            tracts.sort(key=lambda t: (t.start, t.end))
        assert [t.jump_score for t in fk.resolve_overlaps(tracts)] == [t.jump_score for t in slow_overlaps(tracts)]


def test_many_tracts_of_a_read():
    draw = random.Random(8)
    tracts = sorted((fk.Tract(s := draw.randrange(10**6), s + draw.randrange(3000), i, score=draw.random()) for i in range(10_000)), key=lambda t: t.start)
    start = time.time()
    left = fk.resolve_overlaps(tracts)
    assert time.time() - start < 3 and all(a.end <= b.start for a, b in zip(left, left[1:]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
@pytest.mark.parametrize("change", [{"mirror": True}, {"min_jump": 0.15, "tolerance": 0.1, "smoothing": 2}, {"low_plateau": 0.7, "min_distance": 0, "jump_score": 0, "score": 0.1}])
def test_recursive_sql_follows_the_settings(spark, change):
    """Kinds and places of all rows agree under settings other than those of the queries."""
    at = "/root/testdata/sf0.01"
    settings = replace(SMALL, **change)
    sig = tables.view(spark, at, "sig")
    found = fk.detect_forks(_small(sig), "read_id", "idx", "x", "y", settings)
    got = Counter((r.kind, r.read_id, r.id, *((r.start, r.end, r.dir) if r.kind == "tract" else (r.s1, r.e1, r.s2, r.e2))) for r in found.collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/events.parquet'")
    ctes = fork_sql(f"select read_id as r, idx, read_id * 100000::double + idx * 100::double as x, least(v100, 10000) / 10000 as y from ({tables.SQL['sig']})", settings)
    want = Counter()
    for r, l, inits, terms in con.execute(f"with {ctes} select r, l, inits, terms from ends").fetchall():
        want.update(("tract", r, i, t["s"], t["e"], t["d"]) for i, t in enumerate(l))
        for kind, spots in (("init", inits), ("term", terms)):
            want.update((kind, r, i, t["s1"], t["e1"], t["s2"], t["e2"]) for i, t in enumerate(spots))
    assert got == want and {k[0] for k in got} == {"tract", "init", "term"}
