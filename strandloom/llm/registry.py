"""The queries of this package's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import read_table
from .decontaminate import benchmark_matches
from .langid import identify
from .licenses import PHRASES, TEMPLATES, WORDS, license_scan
from .line_dedup import bitmap_text, line_dedup
from .mixing import mix
from .ngram_join import ngram_components
from .pii import pseudonymize
from .quality import quality_rules
from .secrets import secret_scan, spans_text
from .simhash import near_duplicates
from .spelling import count_words, variants
from .vector_codes import codebooks_sha256, vector_codes
from .warc import derivatives, responses


#: Integer weights of the mixture of op1 and of the pipeline's last stage; nodes not named get 1.
DOMAIN_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}


def _weights(column: str, weights: dict[str, int]):
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def mixture(docs: DataFrame, budget_share: float = 0.6, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """Domains are d0, d1 and d2: the digits that end the source's name, modulo 3; other is the domain of the rest."""
    number = F.try_to_number(F.regexp_extract("source", "([0-9]{1,9})$", 1), F.lit("999999999"))
    domain = F.coalesce(F.concat(F.lit("d"), (number.cast("long") % 3).cast("string")), F.lit("other"))
    weight = {"domain": _weights("domain", DOMAIN_WEIGHTS), "lang": _weights("lang", LANG_WEIGHTS), "source": F.lit(1)}
    return mix(docs, domain, weight, budget_share, max_epochs, seed)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *counts, "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"), bitmap_text("keep_bitmap").alias("keep_bitmap"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(read_table(spark, sf_dir, "documents"))
    kinds = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *kinds, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("found").alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"), n_words=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that language identification may learn from; held out are those whose remainder is 1."""
    return docs.filter((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = identify(docs.select("doc_id", "text"), learnable(docs))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(read_table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return out.withColumns(joined).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(responses(read_table(spark, sf_dir, "pages")))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "source_headers", "block")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, key=b"a key that a user of the operator keeps secret")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(read_table(spark, sf_dir, "documents")))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"), n_words=5, percent=80)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_quality_rules, op3_line_dedup, op4_secret_scan, op5_simhash, op6_language_id, op7_license_scan, op8_warc_derivatives, op9_decontamination, op10_pii_pseudonyms,
        op11_spelling, op12_ngram_join, op13_vector_codes,
    )
}
ORACLES = oracles.ALL | {"op7_license_scan": oracles.op7(TEMPLATES, PHRASES, WORDS)}
