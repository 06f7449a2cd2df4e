"""Quality rules whose thresholds come from the corpus.

Every document gets counts from its words and lines. Their distributions are gathered for each language and
source in mergeable quantile sketches with a relative error (counts in buckets whose bounds grow by a constant
factor), merged to sketches of the language and of the corpus. Fences drawn from the sketches' quartiles, those of small groups
drawn towards their language's and the corpus's, are joined to the documents and decide which stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, null_safe

#: Words of a window of base_counts().
WINDOW = 8
#: metric: (what sketches hold, a document's value, the square of its standard error, whether a low fence holds too). Sketches hold shares
#: expected after one more case of either kind (the rule of succession): they are never zero, so that the quartiles of a group in which
#: most documents have no case still differ, by the documents' lengths. Repeated words come by whole windows. Standard errors take cases as independent, and lengths of words as counts.
METRICS = {
    **{
        name: (f"({n} + {case}) / ({of} + {2 * case})", f"{n} / {of}", f"{n} / {of} * (1 - {n} / {of}) / {of}", False)
        for name, n, of, case in (
            ("symbol_share", "n_symbols", "word_chars", 1),
            ("dup_line_share", "n_dup_lines", "n_lines", 1),
            ("repeat_share", "n_repeat_words", "n_words", WINDOW),
        )
    },
    "word_length": ("word_chars / n_words", "word_chars / n_words", "word_chars / n_words / n_words", True),
}
GROUP = ["lang", "source"]


def base_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words to docs; null texts are empty.

    n_repeat_words counts the words that stand in a window of so many words found twice or more in the text.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("__l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__h": F.expr("transform(__w, w -> xxhash64(w))"),
        }
    )
    # __h and __s stand twice in what uses them, so that they stay columns and are not computed again for each element
    df = df.withColumn(
        "__win",
        F.expr(f"if(size(__h) < {window}, array(), transform(sequence(1, size(__h) - {window - 1}), i -> xxhash64(slice(__h, i, {window}))))"),
    )
    df = df.withColumn(
        "__s",
        F.expr(
            "if(size(array_distinct(__win)) < size(__win),"
            " sort_array(transform(__win, (h, i) -> named_struct('h', h, 'i', i))), cast(array() as array<struct<h: bigint, i: int>>))"
        ),
    )
    df = df.withColumn("__same", F.expr("zip_with(__s, slice(__s, 2, size(__s)), (a, b) -> coalesce(a.h = b.h, false))"))
    df = df.withColumn(
        "__pos",
        F.expr(
            "sort_array(filter(zip_with(zip_with(__s, __same, (p, x) -> named_struct('i', p.i, 'x', x)),"
            " concat(array(false), __same), (p, y) -> if(p.x or y, p.i, null)), i -> i is not null))"
        ),
    )
    covered = (
        "aggregate(__pos, named_struct('n', 0L, 'end', 0), (a, i) ->"
        f" named_struct('n', a.n + i + {window} - greatest(i, a.end), 'end', i + {window}), a -> a.n)"
    )
    return df.withColumn("n_repeat_words", F.expr(covered)).drop("__w", "__l", "__h", "__win", "__s", "__same", "__pos")


def quantile_sketches(rows: DataFrame, metrics: list[str], keys: list[str], growth: float = 1.02) -> DataFrame:
    """Sketches (keys..., metric, bucket, n): bucket b counts values in (growth^(b-1), growth^b], null those of 0 or less.

    Sketches of disjoint rows merge by adding n. A value of a bucket is off by at most (growth - 1) / 2 of itself.
    """
    bucket = lambda m: F.when(F.col(m) > 0, F.ceil(F.ln(m) / math.log(growth))).cast("int")
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(m).alias("bucket")) for m in metrics])).alias("x"))
    return long.select(*keys, "x.*").groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float], growth: float = 1.02) -> DataFrame:
    """One row (keys..., metric, total, and a column for each quantile) for each sketch."""
    by = [*keys, "metric"]
    run = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    df = sketches.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    value = F.coalesce(F.pow(F.lit(growth), F.col("bucket")) * F.lit(2 / (growth + 1)), F.lit(0.0))
    at = [F.min(F.when(F.col("upto") >= F.col("total") * q, value)).alias(name) for name, q in quantiles.items()]
    return df.groupBy(*by).agg(F.first("total").alias("total"), *at)


def measured(counts: DataFrame) -> DataFrame:
    """What sketches hold of each row of base_counts(): lang, source and METRICS. Rows need a word."""
    return counts.select(*GROUP, *[F.expr(e).alias(m) for m, (e, *_) in METRICS.items()])


def fences(rows: DataFrame, reach: float = 4.0, prior_docs: int = 200, growth: float = 1.02) -> DataFrame:
    """One row (lang, source, and low and high of each metric) for each group in rows(lang, source, metrics...).

    A language's quartiles are means of its own and the corpus's, which count as prior_docs documents; a group's, of its own and its language's.
    So a group's own documents count the more, the more there are, without a size at which another rule sets in. A fence lies reach times
    the quartiles' distance beyond them, and by the sketches' error (a factor of growth) further, so that rows all alike pass.
    """
    names = list(METRICS)
    fine = materialize(quantile_sketches(rows, names, GROUP, growth), "quality-sketches")
    quartiles = {"q1": 0.25, "q3": 0.75}
    levels = []
    for keys in (GROUP, GROUP[:1], []):
        merged = fine.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        levels.append(sketch_quantiles(merged, keys, quartiles, growth))
    own, lang, corpus = (d.withColumnsRenamed({"total": f"n{i}", "q1": f"q1_{i}", "q3": f"q3_{i}"}) for i, d in enumerate(levels))
    df = null_safe(null_safe(own, lang, ["lang", "metric"], "left"), corpus, ["metric"], "left")

    def drawn(n: Column, own: Column, parent: Column) -> Column:
        return (n * own + prior_docs * parent) / (n + prior_docs)

    quartile = {q: drawn(F.col("n0"), F.col(f"{q}_0"), drawn(F.col("n1"), F.col(f"{q}_1"), F.col(f"{q}_2"))) for q in quartiles}
    df = df.select(*GROUP, "metric", *[c.alias(q) for q, c in quartile.items()])
    spread = (F.col("q3") - F.col("q1")) * reach
    out = []
    for name, (*_, low) in METRICS.items():
        this = F.col("metric") == name
        out.append(F.max(F.when(this, (F.col("q3") + spread) * growth)).alias(f"high_{name}"))
        if low:
            out.append(F.max(F.when(this, (F.col("q1") - spread) / growth)).alias(f"low_{name}"))
    return df.groupBy(*GROUP).agg(*out)


def quality_rules(docs: DataFrame, reach: float = 4.0, prior_docs: int = 200, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """One row for each document: doc_id, lang, source, its counts, base_failed, kept and the rules it broke.

    base_failed: fewer than min_words words or none, or over max_repeat percent of them in repeated windows. Sketches hold
    the documents that pass this. A document is kept if it passes and lies within the fences of its group: reach
    times the distance of the quartiles beyond them (see fences), and reach times its own standard error, which short documents need. Null or empty texts have no words and fail; null languages and sources are groups of their own.
    Rows that repeat a document count each time. Other columns of docs are not used.
    """
    counts = base_counts(docs.select("doc_id", "text", *GROUP)).drop("text")
    failed = (F.col("n_words") < max(min_words, 1)) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    counts = materialize(counts.withColumn("base_failed", failed), "quality-counts")
    joined = null_safe(counts, fences(measured(counts.filter("not base_failed")), reach, prior_docs), GROUP, "left")
    broken = []
    for name, (_, value, variance, low) in METRICS.items():
        value, doubt = (F.when(~F.col("base_failed"), F.expr(x)) for x in (value, f"sqrt({variance}) * {float(reach)}D"))
        broken.append(F.when(value - doubt > F.col(f"high_{name}"), F.lit(f"high_{name}")))
        if low:
            broken.append(F.when(value + doubt < F.col(f"low_{name}"), F.lit(f"low_{name}")))
    joined = joined.withColumn("broken", F.array_compact(F.array(*broken)))
    joined = joined.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    return joined.drop(*[c for c in joined.columns if c.startswith(("high_", "low_"))])
