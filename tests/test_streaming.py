"""A stream of read files gives what the batch gives."""

from strandloom.plans.forks import Settings, detect_forks
from strandloom.streaming.reads import read_stream, stream_forks

SETTINGS = Settings(min_std=0.1, smoothing=4, min_amplitude=0.2, min_jump=0.3)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, i, float(i * 100), 1.0 if 20 + r <= i < 30 + r else 0.0) for r in range(6) for i in range(80)]
    df = spark.createDataFrame(rows, "read_id int, idx int, x double, y double")
    for k in range(3):
        df.filter(df.read_id % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = read_stream(spark, str(tmp_path / "in" / "*"), df.schema, 1)
    q = stream_forks(stream, str(tmp_path / "out"), str(tmp_path / "check"), "read_id", "idx", "x", "y", SETTINGS)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = detect_forks(df, "read_id", "idx", "x", "y", SETTINGS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
