"""Places of pattern matches in texts, with Spark's own string and array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def with_prefix_sums(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds out: sums of the values before each element of column, an array of ints (null: empty).

    Works in blocks, so that a long array costs little more than its length. Every intermediate array is
    used twice by the next step, which keeps Spark from computing it again for each element.
    """
    t, b = f"__{out}_t", f"__{out}_b"
    df = df.withColumn(
        b,
        F.expr(
            f"if(coalesce(size({column}), 0) <= 0, cast(array() as array<array<int>>),"
            f" transform(sequence(0, (size({column}) - 1) div {BLOCK}), k -> slice({column}, k * {BLOCK} + 1, {BLOCK})))"
        ),
    )
    df = df.withColumn(
        t, F.expr(f"aggregate({b}, array(0), (a, x) -> array_append(a, element_at(a, -1) + aggregate(x, 0, (s, v) -> s + v)))")
    )
    within = "slice(aggregate(x, array(s), (a, v) -> array_append(a, element_at(a, -1) + v)), 1, size(x))"
    return df.withColumn(out, F.expr(f"flatten(zip_with({b}, slice({t}, 1, size({b})), (x, s) -> {within}))")).drop(t, b)


def with_matches(df: DataFrame, text: str, pattern: str, out: str, masked: str | None = None) -> DataFrame:
    """Adds out: array<struct<start, end, value>> of pattern's leftmost matches in text, in code points, end exclusive.

    masked names a column that gets the text with its matches blanked. Texts without a match skip all but the search.
    """
    m, g, n, p = f"__{out}_m", f"__{out}_g", f"__{out}_n", f"__{out}_p"
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    df = df.withColumn(n, F.expr(f"flatten(zip_with({g}, {m}, (x, y) -> array(length(x), coalesce(length(y), 0))))"))
    df = with_prefix_sums(df, n, p)
    # after the gap and the match come the next gap and match: a match starts at every second sum
    starts = f"filter({p}, (v, i) -> i % 2 = 1)"
    df = df.withColumn(
        out,
        F.expr(f"zip_with(slice({starts}, 1, size({m})), {m}, (s, v) -> named_struct('start', s, 'end', s + length(v), 'value', v))"),
    )
    if masked:
        blank = f"array_join(flatten(zip_with({g}, {m}, (x, y) -> array(x, repeat(' ', coalesce(length(y), 0))))), '')"
        df = df.withColumn(masked, F.expr(f"if(size({m}) > 0, {blank}, {text})"))
    return df.drop(m, g, n, p)
