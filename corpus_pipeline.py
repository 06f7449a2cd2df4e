"""The corpus pipeline: documents go through STAGES, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, null_safe, read_table
from strandloom.llm.decontaminate import decontaminate
from strandloom.llm.langid import identify
from strandloom.llm.line_dedup import line_dedup
from strandloom.llm.registry import learnable, mixture
from strandloom.llm.simhash import near_duplicates, one_of_each

#: A document stays if its language holds at least this share of its words.
MIN_SHARE = 0.4
#: Texts are near copies if the sets of their 5-word shingles are similar by 0.8 or more; fingerprints that differ in so many bits or fewer make candidates.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 3


#: Columns that operators use; a stage puts all others aside, whatever their names.
CORE = ["doc_id", "text", "lang", "source"]


def _aside(docs: DataFrame) -> DataFrame:
    """docs with the columns other than CORE in one, __rest."""
    rest = [c for c in docs.columns if c not in CORE]
    return docs.select(*CORE, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest")) if rest else docs.select(*CORE)


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in CORE else F.col("__rest").getField(c).alias(c) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, with lang as predicted. Null texts, ones without a letter and mixtures go; rows that repeat stay or go together."""
    out = identify(_aside(docs), learnable(docs))
    kept = out.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return _whole(kept.withColumn("lang", F.col("lang_pred")), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents or more share, but for their first occurrence; those that lose all lines go. n_chars, if there, follows.

    Rows that repeat a document count once and each lose the same lines. Null texts are empty.
    """
    out = _whole(line_dedup(_aside(docs), min_docs=10, keep_first=True).filter("n_dropped < n_lines"), docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the smallest doc_id. Null texts are empty; of empty ones one stays.

    Links of fingerprints (op5) and of minimum hashes are candidates, which the sets of shingles themselves confirm or not.
    """
    return one_of_each(docs, near_duplicates(docs, SHINGLE, RADIUS, SIMILARITY)).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; rows that repeat stay or go together."""
    return _whole(decontaminate(_aside(docs), read_table(spark, sf_dir, "benchmark")), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with domain, n_tokens, epochs, last_tokens and tokens, which replace columns of these names.

    Null and empty texts are never in it. Rows that repeat a document get the same numbers.
    """
    added = ["domain", "n_tokens", "epochs", "last_tokens", "tokens"]
    chosen = mixture(docs, budget_share=0.8).withColumnRenamed("text_hash", "__text_hash")
    chosen = chosen.groupBy("doc_id", "__text_hash").agg(*[F.max(c).alias(c) for c in added])
    marked = docs.drop(*added).withColumn("__text_hash", F.xxhash64("text"))
    return null_safe(marked, chosen, ["doc_id", "__text_hash"], "inner").drop("__text_hash")


STAGES = [
    ("language identification", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the trained model of the first stage; tests hold near dedup against all pairs, and the other stages one by one against what they must keep and drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
