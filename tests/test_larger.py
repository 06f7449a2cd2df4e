"""Queries against their SQL on other tables than the smallest, where they once differed."""

import os

import duckdb
import pandas as pd
import pytest

from strandloom import catalog

DATA = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@given
def test_lines_that_are_almost_flat_do_not_scale(spark):
    # at 0.1 the second line of three reads has a slope under 0.01
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DATA}/events.parquet'")
    want = sorted(con.execute(catalog.ORACLES["J15_affine_fit_rescale"]).fetchall())
    found = sorted(tuple(r) for r in catalog.QUERIES["J15_affine_fit_rescale"](spark, DATA).select("read_id", "idx", "x").collect())
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) <= 1e-6 * abs(b[2]) + 0.0101 for a, b in zip(found, want, strict=True))


#: Reads with points that are equally far from a line but for the last bit: letters and values of their positions.
EQUALLY_FAR = {
    5339: ("BBBBABBBTTTBATBTBTBATBATBTBBTTTTTAABBABATBBBBBBBBBBABBBTBBBBTBTBBTTABTTBBTTBBTBBB", "41 55 87 84 52 66 84 94 22 27 42 41 26 31 57 10 42 1 87 40 46 88 88 41 94 25 86 70 8 24 48 0 8 19 24 40 97 59 72 51 34 86 90 41 73 81 66 56 50 58 95 48 73 95 78 16 99 57 89 93 9 62 46 64 79 1 17 43 95 1 30 81 71 35 45 96 83 5 98 82 96"),
    15093: ("BBBATABTTBBTATTTBTTTTTBBTTTTATTBTBTTTTTTBTBBTTTTTTTTBTTTBABBBTT", "80 60 80 60 0 60 40 0 20 80 80 0 20 40 0 20 80 0 20 20 0 40 40 40 40 20 20 20 40 40 0 80 40 40 0 0 20 0 40 40 60 20 40 60 20 40 40 40 0 20 40 0 40 0 20 0 40 0 40 80 80 20 0"),
}


def test_corner_points_are_those_of_the_sql(spark, tmp_path):
    kinds = {"T": "view", "B": "purchase", "A": "click"}
    rows = [(kinds[b], float(v), read, i) for read, (letters, values) in EQUALLY_FAR.items() for i, (b, v) in enumerate(zip(letters, values.split(), strict=True))]
    events = pd.DataFrame(rows, columns=["event_type", "value", "user_id", "at"])
    events = events.assign(event_id=range(len(rows)), ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(events.pop("at"), unit="s"), props="")
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    result = con.execute(catalog.ORACLES["K14_detect_forks"])
    names = [d[0] for d in result.description]
    found = catalog.QUERIES["K14_detect_forks"](spark, str(tmp_path)).select(*names).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(result.fetchall(), key=str)
