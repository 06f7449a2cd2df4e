"""Sequences and text files of calls against plain expressions, and how often they are worked out."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom import catalog
from strandloom.sources import reads, tables

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n", "0_9", "aZ", "The quick brown fox jumps over the lazy dog", "ABCXYZabcxyz[]`{@", "Straße É ſ K İ 😀 naïve\x00\x7f", "x" * 5000 + "é\n" * 9]


def test_sequences_are_those_of_the_expression(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = docs.selectExpr("doc_id read_id", f"translate(lower(regexp_replace(text, '[^A-Za-z]', '')), {tables._LETTERS}) seq")
    found = tables.view(spark, str(tmp_path), "seqs")
    assert found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_ratios_are_written_as_formatting_would(spark):
    r = random.Random(6)
    shares = [k / 1000 for k in range(1001)] + [math.nextafter(k / 200, side) for k in range(201) for side in (-1, 2)] + [r.random() for _ in range(2000)]
    ratios = [*shares, None, 0.0, -0.0, -0.001, -3.456, 1.0, 1.004, 1.005, 99.995, 1e12 / 7, 1e-300, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([("a", ratios), ("b", []), ("c", None)], "read string, ratio array<double>")
    plain = F.transform("ratio", lambda x: F.when(x.isNull(), "nan").otherwise(F.format_string("%.2f", x)))
    want = [(f">{row.read}\n{row.t}",) for row in df.filter("ratio is not null").select("read", F.array_join(plain, " ").alias("t")).collect()]
    assert sorted(map(tuple, reads.ratio_lines(df).collect())) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_files_of_calls_are_written_from_sequences_made_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(reads, "write_lines", lambda lines, path, write=reads.write_lines: (written.append(lines), write(lines, path)))
    assert catalog.QUERIES["A1_A2_calls"](spark, DATA).count() > 0
    assert len(written) == 2
    for lines in written:
        assert not [f for f in lines.inputFiles() if "documents" in f]
        assert "translate(" not in lines._jdf.queryExecution().optimizedPlan().toString()
