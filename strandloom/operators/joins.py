"""Joins of reads, calls, percents and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_tracks(calls: DataFrame, ratios: DataFrame, keys: list[str]) -> DataFrame:
    return calls.join(ratios, keys)


def attach_sequence(reads: DataFrame, records: DataFrame, key1: str, key2: str) -> DataFrame:
    """reads with seq of the record of their first key, else of their second, and seq_found. records: (key1, key2, seq); the smallest seq of a key."""
    first = records.filter(F.col("key1").isNotNull()).groupBy(F.col("key1").alias(key1)).agg(F.min("seq").alias("__s1"))
    second = records.filter(F.col("key2").isNotNull()).groupBy(F.col("key2").alias(key2)).agg(F.min("seq").alias("__s2"))
    out = reads.join(first, key1, "left").join(second, key2, "left").withColumn("seq", F.coalesce("__s1", "__s2"))
    return out.withColumn("seq_found", F.col("seq").isNotNull()).drop("__s1", "__s2")


def route_reads(reads: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """reads with their shard; reads that the index lacks go."""
    return reads.join(index, key)


def merge_annotations(reads: DataFrame, template: DataFrame, alignment: DataFrame, key: str) -> DataFrame:
    a = template.withColumn("has_template", F.lit(True))
    b = alignment.withColumn("has_alignment", F.lit(True))
    out = reads.join(a, key, "left").join(b, key, "left")
    return out.fillna(False, ["has_template", "has_alignment"])


def annotation_gaps(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_template")).alias("no_template"), F.count_if(~F.col("has_alignment")).alias("no_alignment"))


def join_percent(reads: DataFrame, percents: DataFrame, name: str, key: Column, percent: str) -> DataFrame:
    """reads with the percent of the first row of their standard name (by percent); ones whose percent is null go."""
    table = percents.withColumn("__k", key).groupBy("__k").agg(F.min_by(percent, F.struct(F.col(percent).isNull(), percent)).alias(percent))
    return reads.join(table, F.col(name) == F.col("__k")).filter(F.col(percent).isNotNull()).drop("__k")


def expected_signal(df: DataFrame, table: DataFrame, kmer: str, expected: str) -> DataFrame:
    """df with the expected level of its k-mer; positions whose k-mer the table lacks go. Spark broadcasts the table if its size allows."""
    return df.join(table.select(kmer, expected), kmer)


def calibrated_threshold(df: DataFrame, table: DataFrame, kmer: str, value: str, threshold: str) -> DataFrame:
    """df with modified: whether value exceeds its k-mer's threshold; null for k-mers without."""
    return df.join(table.select(kmer, threshold), kmer, "left").withColumn("modified", F.col(value) > F.col(threshold))


def agree_alignments(a: DataFrame, b: DataFrame, key: str, tolerance: int) -> DataFrame:
    """Rows of a whose read b places on the same chromosome, fewer than tolerance bases away."""
    other = b.select(F.col(key).alias("__k"), F.col("chrom").alias("__c"), F.col("pos").alias("__p"))
    near = (F.col(key) == F.col("__k")) & (F.col("chrom") == F.col("__c")) & (F.abs(F.col("pos") - F.col("__p")) < tolerance)
    return a.join(other, near, "left_semi")


def assign_to_segment(points: DataFrame, segments: DataFrame, key: str, bin_width: int = 1000) -> DataFrame:
    """points(key, at) with seg of the segments(key, seg, a, b) that strictly contain them."""
    s = segments.withColumn("__bin", F.explode(F.expr(f"sequence(cast(a div {bin_width} as bigint), cast(b div {bin_width} as bigint))")))
    p = points.withColumn("__bin", F.expr(f"cast(at div {bin_width} as bigint)"))
    return p.join(s, [key, "__bin"]).filter("a < at and at < b").drop("__bin", "a", "b")


def nearest_centre(points: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """points(key, id, at) with the closest at of centres(key, at) of the same read, the lower of two equally close ones."""
    both = points.select(key, "id", "at", F.lit(None).cast("double").alias("c")).unionByName(centres.select(key, F.lit(None).cast(points.schema["id"].dataType).alias("id"), "at", F.col("at").cast("double").alias("c")))
    w = Window.partitionBy(key).orderBy("at", F.col("id").isNotNull())
    back = F.last("c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("c", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"__b": back, "__a": ahead}).filter("id is not null")
    pick = F.when(F.col("__b").isNull() | (F.col("__a") - F.col("at") < F.col("at") - F.col("__b")), F.col("__a")).otherwise(F.col("__b"))
    return both.select(key, "id", "at", pick.alias("centre"))


def update_by_key(df: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    new = updates.select(key, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return df.join(new, key, "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def match_signal_reads(calls: DataFrame, signal: DataFrame, key: str, n_calls: str, n_signal: str) -> DataFrame:
    """Reads of both; a read whose lengths differ fails the job."""
    same = F.assert_true(F.col(n_calls) == F.col(n_signal), F.concat(F.lit("lengths differ for read "), F.col(key).cast("string")))
    return calls.join(signal, key).filter(same.isNull())
