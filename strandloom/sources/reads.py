"""Readers and writers of calls, reads, alignments and tables of reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import columns as c


def _records(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Two-line records (head, body, file) of files whose records begin with >."""
    df = spark.read.text(path, lineSep=">", pathGlobFilter=glob).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    lines = F.split("value", "\n")
    return df.filter("trim(value) != ''").select(F.get(lines, F.lit(0)).alias("head"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("body"), "file")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Reads (file, read, chrom, strand, start, end, seq, ratio) of *.fa files and their siblings with ratios.

    A file's ratios are in the one named _ratio, else _ratio_B, and belong to the read of their own name; ratio is an array,
    null for reads without, with null for nan.
    """
    calls = _records(spark, path, "*.fa")
    calls = calls.select("file", *[v.alias(k) for k, v in c.parse_header("head").items()], F.trim("body").alias("seq"))
    ratios = _records(spark, path, "*.fa_ratio*").withColumns({"kind": F.regexp_extract("file", r"(_ratio(?:_B)?)$", 1), "file": F.regexp_replace("file", r"_ratio(_B)?$", "")})
    name = c.parse_header("head")["read"]
    ratios = ratios.select("file", name.alias("read"), "kind", ratio_values("body").alias("ratio"))
    ratios = ratios.filter("kind != ''").groupBy("file", "read").agg(F.min_by("ratio", "kind").alias("ratio"))
    return calls.join(ratios, ["file", "read"], "left")


def ratio_values(line) -> Column:
    """Numbers separated by spaces as an array, null for nan."""
    return F.transform(F.split(F.trim(line), " +"), lambda x: F.when(x != "nan", x.try_cast("double")))


def call_lines(df: DataFrame) -> DataFrame:
    """Text records of called sequences: value is two lines."""
    head = F.format_string(">%s {'mapped_chrom': '%s', 'mapped_strand': '%s', 'mapped_start': %d, 'mapped_end': %d}", "read", "chrom", "strand", "start", "end")
    return df.select(F.concat_ws("\n", head, "seq").alias("value"))


def ratio_lines(df: DataFrame) -> DataFrame:
    """Text records of ratios: value is two lines, numbers of two decimals separated by spaces, nan for null."""
    shares = F.array(*[F.lit(f"{k / 100:.2f}") for k in range(101)])

    def text(x: Column) -> Column:
        # shares clearly nearest to one of two decimals are looked up; formatting takes many times as long
        near = F.abs(x * 100 - F.rint(x * 100)) < 0.49
        return F.when(x.isNull(), "nan").when((x > 0) & (x <= 1) & near, F.get(shares, F.rint(x * 100).cast("int"))).otherwise(F.format_string("%.2f", x))

    values = F.transform("ratio", text)
    return df.filter("ratio is not null").select(F.concat_ws("\n", F.concat(F.lit(">"), "read"), F.array_join(values, " ")).alias("value"))


def percent_lines(df: DataFrame) -> DataFrame:
    """A read's name, mean percent, error and modification, separated by spaces."""
    return df.select(F.format_string("%s %.4f %.4f %s", "read", "percent", "error", "mod").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def read_percent(spark: SparkSession, path: str) -> DataFrame:
    """(readname, percent as a share, error, mod) of a file separated by spaces."""
    df = spark.read.csv(path, sep=" ", schema="readname string, percent double, error double, mod string")
    return df.withColumn("percent", F.col("percent") / 100)


def read_manifest(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(filename and the columns with their types) of a CSV with a header, in any order."""
    df = spark.read.csv(path, header=True)
    return df.select("filename", *[F.col(n).try_cast(t).alias(n) for n, t in columns.items()])


def read_dataset(spark: SparkSession, path: str, lists: list[str], numbers: list[str] = ()) -> DataFrame:
    """A sample sheet separated by semicolons: list cells become arrays; None, False and the empty string become null."""
    df = spark.read.csv(path, header=True, sep=";")
    for name in df.columns:
        v = F.when(~F.col(name).isin("None", "False", ""), F.col(name))
        if name in lists:
            v = F.from_json(v, "array<string>", {"allowSingleQuotes": "true"})
        elif name in numbers:
            v = v.try_cast("double")
        df = df.withColumn(name, v)
    return df


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(key1, key2, seq, qual) of four-line records: key1 is the name's first two fields by _, key2 its first word up to _.

    A record begins at a line with @ whose next but one line begins with +; a text record ends before the next such name.
    """
    df = spark.read.text(path, lineSep="\n@").filter("trim(value) != ''")
    lines = F.split(F.regexp_replace("value", "^@", ""), "\n")
    name = F.get(lines, F.lit(0))
    df = df.select(name.alias("name"), F.get(lines, F.lit(1)).alias("seq"), F.get(lines, F.lit(2)).alias("plus"), F.get(lines, F.lit(3)).alias("qual"))
    df = df.filter(F.startswith("plus", F.lit("+")))
    key2 = F.substring_index(F.substring_index("name", " ", 1), "_", 1)
    return df.select(F.substring_index("name", "_", 2).alias("key1"), key2.alias("key2"), "seq", "qual")


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alignments of SAM lines: name, flag, chrom, pos, mapq, cigar, seq, nm and md; header lines and ones of 12 fields or fewer go."""
    f = lines.filter(~F.startswith(value, F.lit("@"))).select(F.split(value, "\t").alias("f")).filter(F.size("f") > 12)
    at = lambda i: F.get("f", F.lit(i))
    return f.select(at(0).alias("name"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), at(3).cast("long").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), c.edit_tag(at(11)).alias("nm"), c.edit_tag(at(12)).alias("md"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def read_seq_summary(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, filename) of tab-separated summaries, whose columns are found by their names."""
    df = spark.read.csv(path, header=True, sep="\t")

    def find(pattern: str) -> str:
        for name in df.columns:
            if re.search(pattern, name, re.I):
                return name
        raise ValueError(f"no column like {pattern} among {df.columns}")

    return df.select(F.col(find(r"^read_?id$")).alias("read_id"), F.col(find(r"file_?name")).alias("filename"))


def write_partitioned_reads(reads: DataFrame, path: str, shard: str) -> DataFrame:
    """Writes reads to a folder for each shard and returns the index (read_id, shard)."""
    reads.repartition(shard, F.pmod(F.xxhash64("read_id"), F.lit(8))).write.partitionBy(shard).parquet(path)
    return reads.sparkSession.read.parquet(path).select("read_id", shard)


def save_kmer_table(samples: DataFrame, path: str) -> None:
    samples.write.parquet(path)


def load_kmer_table(spark: SparkSession, path: str, kmer: str = "kmer", value: str = "value") -> DataFrame:
    """Stored samples as a table (kmer, n, mean) made anew."""
    return spark.read.parquet(path).groupBy(kmer).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def mod_site_rows(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("read_id").alias("id"), F.col("chrom").alias("mapped_chrom"), F.col("strand").alias("mapped_strand"), "pos", "log")


def alignment_stats(aln: DataFrame) -> DataFrame:
    """One row for each alignment(name, flag, cigar, md): type, length on the reference, insertions, deletions, trimmed and mismatches."""
    kind = F.when(F.col("flag").isin(0, 16), "primary").when(F.col("flag").isin(2048, 2064), "supplementary").when(F.col("flag") == 4, "none").otherwise("other")
    stats = {"length": c.cigar_ref_len("cigar")} | c.cigar_stats("cigar") | c.md_mismatches("md")
    return aln.select("name", kind.alias("type"), "flag", *[v.alias(k) for k, v in stats.items()])
