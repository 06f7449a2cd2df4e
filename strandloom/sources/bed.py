"""Interval files: BED, track rows and fork tables. Positions are 1-based and closed inside, and converted here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.columns import direction_strand, roman_chrom

BED6 = "chrom string, start long, end long, name string, score double, strand string"
FORKS = "chrom string, start long, end long, direction string, file string, read string, strand string, jump_score double, score double"
EVENTS = "chrom string, mid long, s1 long, e1 long, s2 long, e2 long, file string, read string, strand string"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (chrom, s, e, name, score, strand) of BED files with 3 to 6 columns."""
    df = spark.read.csv(path, sep="\t", schema=BED6, comment="#")
    return df.select("chrom", (F.col("start") + 1).alias("s"), F.col("end").alias("e"), "name", "score", "strand")


def to_bed(iv: DataFrame) -> DataFrame:
    """Rows of a BED6 file; absent columns are '.', 0 and '.'."""
    has = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in iv.columns else F.lit(other)
    return iv.select("chrom", (F.col("s") - 1).alias("start"), F.col("e").alias("end"), has("name", ".").alias("name"), has("score", "0").alias("score"), has("strand", ".").alias("strand"))


def write_bed(iv: DataFrame, path: str) -> None:
    to_bed(iv).write.csv(path, sep="\t", header=False)


def bedgraph(track: DataFrame, value: str = "value") -> DataFrame:
    return track.select("chrom", (F.col("s") - 1).alias("start"), F.col("e").alias("end"), F.col(value).alias("value"))


def write_track(track: DataFrame, path: str, value: str = "value") -> None:
    bedgraph(track, value).write.csv(path, sep="\t", header=False)


def read_forks(spark: SparkSession, path: str) -> DataFrame:
    """Forks of all files of a folder, with Roman chromosome names, the strand of their direction, and their file."""
    df = spark.read.csv(path, sep="\t", header=True, schema=FORKS).withColumn("source", F.input_file_name())
    return df.withColumns({"chrom": roman_chrom("chrom"), "strand": direction_strand("direction")})


def fork_rows(tracts: DataFrame, min_jump: float | None = None, min_score: float | None = None) -> DataFrame:
    """Rows of a fork file: tracts with a direction and, with the bounds, of that jump score and score or more."""
    kept = tracts.filter("dir != '?'")
    if min_jump is not None:
        kept = kept.filter((F.col("jump_score") >= min_jump) & (F.col("score") >= (min_score or 0)))
    rounded = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    return kept.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("dir").alias("direction"), "file", "read", "strand", rounded("jump_score").alias("JumpScore"), rounded("score").alias("AsymScore"))


def event_rows(events: DataFrame) -> DataFrame:
    """Rows of an event file: middle and the ends of both tracts."""
    whole = [F.col(c).cast("long").alias(c) for c in ("mid", "s1", "e1", "s2", "e2")]
    return events.select("chrom", *whole, "file", "read", "strand")


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", header=True)


def read_reads_bed(spark: SparkSession, path: str, chroms: int = 16) -> DataFrame:
    """Read intervals (chrom, s, e, strand) on the numbered chromosomes."""
    names = [f"chr{i + 1}" for i in range(chroms)]
    return read_bed(spark, path).filter(F.col("chrom").isin(names)).select("chrom", "s", "e", "strand")


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """Scores (chrom, pos, value) of fixedStep blocks; a block's rows keep their order in its file.

    A block is one record of the text reader, cut at the word fixedStep, so blocks of any file are read in parallel.
    """
    blocks = spark.read.text(path, lineSep="fixedStep").filter(F.contains("value", F.lit("chrom=")))
    lines = F.split(F.rtrim("value"), "\n")
    head = F.get(lines, F.lit(0))
    field = lambda k, d: F.coalesce(F.nullif(F.regexp_extract(head, rf"{k}=(\S+)", 1), F.lit("")), F.lit(d))
    df = blocks.select(field("chrom", "").alias("chrom"), field("start", "1").cast("long").alias("__s"), field("step", "1").cast("long").alias("__d"), F.posexplode(F.slice(lines, F.lit(2), F.size(lines))).alias("__i", "__v"))
    return df.filter("trim(__v) != ''").select("chrom", (F.col("__s") + F.col("__d") * F.col("__i")).alias("pos"), F.trim("__v").cast("double").alias("value"))
