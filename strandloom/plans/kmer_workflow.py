"""From signals to modified sites: k-mer tables refined in rounds, likelihood ratios, sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.columns import genome_pos
from strandloom.operators import kmers as km
from strandloom.operators import stats as st
from strandloom.sources.storage import stored


def refine_kmer_table(df: DataFrame, key: str, kmer: str, value: str, mask: Column, rounds: int = 6) -> DataFrame:
    """(kmer, n, mean) after rounds of matching each read's moments to the current table and averaging anew.

    The samples are the same in every round; only the table, of 4^k rows at most, is written between them.
    """
    table = stored(km.kmer_stats(df, kmer, value).select(kmer, "n", "mean"), "kmer-table")
    for _ in range(rounds):
        joined = df.join(table.select(kmer, F.col("mean").alias("__t")), kmer)
        moved = st.moment_match(joined, value, "__t", mask, key, "__x")
        table = stored(km.kmer_stats(moved, kmer, "__x").select(kmer, "n", "mean"), "kmer-table")
    return table


def emit_mod_sites(
    df: DataFrame, reads: DataFrame, key: str, idx: str, motif: Column, k: int, global_threshold: float, ratio_threshold: float, min_length: int
) -> DataFrame:
    """(key, chrom, strand, pos, log): motif positions whose smoothed ratio exceeds its threshold, on the genome.

    df: positions with lp_ref and ratio; reads: (key, chrom, strand, start_, end_). Reads go that are shorter than min_length, or whose mean
    lp_ref outside the motif is below the global threshold.
    """
    df = df.withColumn("__m", motif)
    good = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.avg(F.when(~F.col("__m"), F.col("lp_ref"))).alias("__g"))
    good = good.filter((F.col("__n") >= min_length) & (F.col("__g") >= global_threshold)).select(key)
    hits = df.filter(F.col("__m") & (F.col("ratio") > ratio_threshold)).join(good, key, "left_semi").join(reads, key)
    pos = genome_pos("strand", "start_", "end_", F.col(idx) + k // 2)
    return hits.select(key, "chrom", "strand", pos.alias("pos"), F.col("ratio").alias("log"))
