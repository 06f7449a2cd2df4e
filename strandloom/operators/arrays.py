"""Decoding of modification tags and orientation of per-base values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.columns import col


def _decoded(seq, skips, probs, base) -> Column:
    """An array of (pos, value): the n-th probability belongs to the occurrence of base after its skips. All is found in the row of the sequence."""
    seq, skips, probs, base = col(seq), col(skips), col(probs), col(base)
    # numbers of the occurrences, from 0
    nth = F.aggregate(
        skips, F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda a, x: F.struct((a.at + F.coalesce(x + 1, F.lit(0))).alias("at"), F.array_append(a.out, a.at + F.coalesce(x + 1, F.lit(0))).alias("out")),
        lambda a: a.out,
    )
    # the beginning that holds all of them is enough, and is cut without a look at each letter
    start = F.call_function("substring_index", seq, base, (F.array_max(nth) + 2).cast("int"))
    places = F.filter(F.transform(F.split(start, ""), lambda x, i: F.when(x == base, i)), lambda i: i.isNotNull())
    at = F.struct(F.transform(nth, lambda n: n.cast("int")).alias("nth"), places.alias("places"), probs.alias("ml"))
    found = F.transform(F.array(at), lambda s: F.transform(s.nth, lambda n, k: F.struct(F.get(s.places, n).alias("pos"), (F.get(s.ml, k) / 255).alias("value"))))[0]
    return F.filter(found, lambda x: x.pos.isNotNull())


def decode_mm_ml(df: DataFrame, key: list[str], seq: str, skips: str, probs: str, base: str) -> DataFrame:
    """(key..., pos from 0, value): the n-th probability belongs to the occurrence of base after its skips; value is ml / 255.

    skips and probs are arrays of whole numbers; entries past the last occurrence go.
    """
    return df.select(*key, F.explode_outer(_decoded(seq, skips, probs, F.lit(base))).alias("x")).filter("x is not null").select(*key, "x.*")


def decode_multi_mod(df: DataFrame, key: str, seq: str, tag: str, probs: str) -> DataFrame:
    """(key, mod, pos, value) of tags such as 'T+B,1,0;T+E,2;': the letter before the sign is the base, that after it the modification.

    probs is one array for all groups in their order.
    """
    groups = F.transform(F.filter(F.split(tag, ";"), lambda x: x != ""), lambda t: F.struct(t.alias("t"), F.transform(F.slice(F.split(t, ","), 2, F.size(F.split(t, ","))), lambda x: x.cast("int")).alias("mm")))
    df = df.select(key, seq, probs, groups.alias("__g"))
    before = lambda k: F.aggregate(F.slice("__g", F.lit(1), k), F.lit(0), lambda n, g: n + F.size(g.mm))
    parts = F.transform("__g", lambda g, k: F.struct(g.t.alias("t"), g.mm.alias("mm"), F.slice(probs, before(k) + 1, F.size(g.mm)).alias("ml")))
    groups = df.select(key, seq, F.explode_outer(parts).alias("g")).filter("g is not null")
    groups = groups.select(key, seq, F.substring("g.t", 3, 1).alias("mod"), F.substring("g.t", 1, 1).alias("base"), "g.mm", "g.ml").filter(F.col("base").isin(*"ACGTN"))
    return groups.select(key, "mod", F.explode_outer(_decoded(seq, "mm", "ml", "base")).alias("x")).filter("x is not null").select(key, "mod", "x.*")


def orient(values, strand) -> Column:
    return F.when(col(strand) == "-", F.reverse(col(values))).otherwise(col(values))


def keep_modified(df: DataFrame, key: str, value: str, threshold: float, n: int) -> DataFrame:
    """Keys with at least n values above the threshold."""
    return df.groupBy(key).agg(F.count_if(F.col(value) > threshold).alias("n")).filter(F.col("n") >= n)
