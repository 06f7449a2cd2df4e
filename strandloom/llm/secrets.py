"""Secret scans: fixed patterns, and long tokens that look drawn at random.

Two Markov models of characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples: what the patterns find, and the words of sampled documents. A long token's log-likelihood ratio under
the two decides whether it is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .spans import with_matches

#: Kinds in the order of ties, with their patterns.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MIN_ASSIGNED = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"


def scan_patterns(docs: DataFrame, min_token: int = 16) -> DataFrame:
    """docs (doc_id, text) with base (spans), values (what they hold) and tokens (other long tokens with their places)."""
    df = docs.withColumn("__t0", F.coalesce("text", F.lit("")))
    spans, masked = [], "__t0"
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        # kinds are sought in the whole text; the masked one keeps tokens from overlapping them
        df = with_matches(df, "__t0", pattern, f"__{kind}")
        if kind == "assign":
            value = lambda x: F.regexp_extract(x.value, PATTERNS["assign"], 1)
            df = df.withColumn("__assign", F.filter("__assign", lambda x: F.length(value(x)) >= MIN_ASSIGNED))
        spans.append(f"transform(__{kind}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}'))")
    df = df.withColumn("base", F.expr(f"sort_array(concat({', '.join(spans)}))").cast(SPAN))
    df = df.withColumn("values", F.expr(f"transform(concat(__assign, __access, __hex), x -> regexp_extract(x.value, '[A-Za-z0-9+/_=-]*$', 0))"))
    for kind in PATTERNS:
        after = f"__t_{kind}"
        df = df.withColumn(after, F.when(F.size("base") > 0, F.col(masked)))
        df = with_matches(df, after, PATTERNS[kind], f"__again_{kind}", masked=f"__m_{kind}").drop(f"__again_{kind}")
        df = df.withColumn(f"__m_{kind}", F.coalesce(f"__m_{kind}", F.col(masked)))
        masked = f"__m_{kind}"
    df = with_matches(df, masked, TOKEN % min_token, "tokens")
    return df.drop("text", *[c for c in df.columns if c.startswith("__")])


def bigram_counts(tokens: DataFrame) -> DataFrame:
    """Counts (first, second, n) of neighbouring characters of the alphabet in tokens(token)."""
    pair = F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))"))
    pairs = tokens.filter("length(token) > 1").select(pair.alias("pair"))
    pairs = pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(random: DataFrame, ordinary: DataFrame, weight: float = 20.0) -> list[float]:
    """log P(second | first) under the random model less that under the ordinary one, first by first.

    Each model counts a pair weight times the share of its second character among all seconds beforehand, so that pairs
    after a rare character follow the model's mix of characters. The counts that come here are of pairs of the alphabet: 67 x 67 at most.
    """
    n, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    logs = []
    for counts in (random, ordinary):
        table = [[0.0] * n for _ in range(n)]
        for pair, count in counts.collect():
            table[at[pair[0]]][at[pair[1]]] += count
        total = sum(map(sum, table)) + n
        mix = [(sum(row[j] for row in table) + 1) / total for j in range(n)]
        logs.append([math.log((x + weight * mix[j]) / (sum(row) + weight)) for row in table for j, x in enumerate(row)])
    return [a - b for a, b in zip(*logs, strict=True)]


def _doubles(values: list) -> str:
    return f"cast(split('{' '.join(format(v, '.6g') for v in values)}', ' ') as array<double>)"


def secret_scan(
    docs: DataFrame, min_ratio: float = 16.0, min_token: int = 16, sample_docs: int = 2000, min_word: int = 8, min_shared: int = 3
) -> DataFrame:
    """One row for each document: doc_id, base and found, both arrays of spans struct<start, rank, end, kind>.

    base holds the matches of PATTERNS (of assign those whose value has MIN_ASSIGNED characters), found also tokens of
    min_token characters or more of the alphabet, a letter among them, whose log-likelihood ratio is min_ratio or more, under the kind
    markov. Places are in code points. The random model learns from the values of all matches of the patterns, the
    ordinary one from tokens of min_word characters and more in about sample_docs documents, chosen by a hash of id
    and text, without what the patterns find in them, that min_shared of these documents have: random strings don't recur. Without
    any match, or without recurring tokens, that model knows no pairs and ratios stay near zero: no token is added.

    Null texts are empty; empty texts have no spans; time grows with the length of a text and of a token. Rows that repeat
    a document each come back. Other columns of docs are not used.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", "text")
    scanned = materialize(scan_patterns(rows, min_token), "secret-spans")
    random = bigram_counts(scanned.select(F.explode("values").alias("token")))
    parts = max(1, scanned.count() // sample_docs)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == 0)
    clean = F.coalesce("text", F.lit(""))
    for pattern in PATTERNS.values():
        clean = F.regexp_replace(clean, pattern, " ")
    tokens = sample.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(TOKEN % min_word), F.lit(0)))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_shared)
    ordinary = bigram_counts(shared)
    ratios = log_ratios(random, ordinary)
    codes = [0] * 128
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i
    code = "cast(split('" + " ".join(map(str, codes)) + "', ' ') as array<int>)"
    # a token's characters are numbered once, and pairs are neighbours in that array: a long token costs its length
    numbers = f"transform(split(x.value, ''), c -> get({code}, ascii(c)))"
    pairs = f"zip_with({numbers}, slice({numbers}, 2, length(x.value)), (a, b) -> coalesce(get({_doubles(ratios)}, a * {len(ALPHABET)} + b), 0D))"
    llr = f"aggregate({pairs}, 0D, (a, v) -> a + v)"
    rank = len(PATTERNS)
    markov = f"transform(filter(tokens, x -> x.value rlike '[A-Za-z]' and {llr} >= {min_ratio}), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', 'markov'))"
    return scanned.select("doc_id", "base", F.expr(f"sort_array(concat(base, cast({markov} as {SPAN})))").alias("found"))


def spans_text(spans: str):
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
