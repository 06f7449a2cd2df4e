"""Operators on sequences against plain Python, across the pieces that they are cut in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.columns import motif_positions
from strandloom.operators import arrays
from strandloom.operators import kmers as km

RNG = np.random.default_rng(2)
SEQS = [(i, "".join(RNG.choice(list("ACGT\nN"), n))) for i, n in enumerate((0, 1, 3, 4, 5, 31, 32, 33, 35, 36, 64, 1000, 5000))] + [(90, "A😀T" * 50 + "é"), (91, None)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "id long, seq string")


@pytest.mark.parametrize("k", [1, 4, 40])
def test_kmers_are_all_there(seqs, k):
    found = km.kmers(seqs, "seq", k)
    assert found.columns == ["id", "p", "kmer"]
    assert sorted(map(tuple, found.collect())) == sorted((i, p + 1, s[p : p + k]) for i, s in SEQS if s for p in range(len(s) - k + 1))


def test_windows_of_a_matrix_are_all_there(seqs):
    pwm = [{"A": 2, "C": -1, "T": 0}, {"G": 1.5, "T": 1}, {"A": 0, "C": 1}]
    want = []
    for i, s in SEQS:
        for p in range(len(s or "") - 2):
            parts = [w.get(s[p + j]) for j, w in enumerate(pwm)]
            if None not in parts and sum(parts) >= 0.6 * 4.5:
                want.append((i, p + 1, sum(parts)))
    assert sorted(map(tuple, km.pwm_scan(seqs, "seq", pwm, 0.6).select("id", "p", "score").collect())) == sorted(want)
    assert km._reaching([{b: 1 for b in "ACGT"}] * 10, 1) is None


def test_probabilities_meet_their_bases_in_the_row_of_the_sequence(seqs):
    rng = np.random.default_rng(3)
    tags = {i: ([int(x) for x in rng.integers(0, 4, 6)], [int(x) for x in rng.integers(0, 256, 6)]) for i, _ in SEQS}
    df = seqs.join(seqs.sparkSession.createDataFrame([(i, *t) for i, t in tags.items()], "id long, mm array<int>, ml array<int>"), "id")
    want = []
    for i, s in SEQS:
        sites = [p for p, b in enumerate(s or "") if b == "T"]
        nth = -1
        for skip, ml in zip(*tags[i], strict=True):
            nth += skip + 1
            if nth < len(sites):
                want.append((i, sites[nth], ml / 255))
    found = arrays.decode_mm_ml(df, ["id"], "seq", "mm", "ml", "T")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # the sequences never leave their rows
    df = seqs.withColumns({"mm": F.array(F.lit(1)), "ml": F.array(F.lit(7)), "tag": F.lit("T+B,1;"), "probs": F.array(F.lit(7))})
    for out in (arrays.decode_mm_ml(df, ["id"], "seq", "mm", "ml", "T"), arrays.decode_multi_mod(df, "id", "seq", "tag", "probs")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("motif", ["TA", "AA", "T"])
def test_motifs_are_found_once(seqs, motif):
    want = []
    for i, s in SEQS:
        at = (s or "").find(motif)
        while at >= 0:
            want.append((i, at))
            at = s.find(motif, at + len(motif))
    assert sorted(map(tuple, seqs.select("id", F.explode(motif_positions("seq", motif))).collect())) == sorted(want)
