"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget flows from the root: each node shares its budget among its children in proportion to their
weights, but gives none more than its subtree holds. What a short child leaves goes to its siblings; only when
a whole subtree is short does its share pass to its parent's siblings. Leaves then read seeded epochs: whole
ones, and of the last the prefix of tokens that fills the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, null_safe

LEVELS = ["domain", "lang", "source"]


def share_among_siblings(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds budget to children(parent..., weight, capacity, parent_budget): the water-filling shares.

    Children are ordered by capacity for each unit of weight; a child is short if that is under the level the
    budget reaches among it and the later ones. Others get that level times their weight, rounded down, and
    siblings with weight zero get nothing.
    """
    ratio = F.col("capacity") / F.col("weight")
    rest = Window.partitionBy(*parent)
    order = rest.orderBy(F.col("__ratio").asc_nulls_last(), *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    df = children.withColumn("__ratio", F.when(F.col("weight") > 0, ratio))
    live_capacity = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0))
    df = df.withColumn(
        "__level",
        F.try_divide(
            F.col("parent_budget") - F.coalesce(F.sum(live_capacity).over(before), F.lit(0)),
            F.sum("weight").over(after),
        ),
    )
    level = F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(rest)
    budget = F.when(F.coalesce(F.col("weight"), F.lit(0)) <= 0, F.lit(0)).otherwise(
        F.least("capacity", F.coalesce(F.floor(level * F.col("weight")), F.col("capacity")))
    )
    return df.withColumn("budget", budget.cast("long")).drop("__ratio", "__level")


def leaf_budgets(
    leaves: DataFrame, budget_share: float, max_epochs: int, weight: dict[str, Column]
) -> DataFrame:
    """Budgets of the leaves(domain, lang, source, n_tokens). weight: for each level a column of the node's keys."""
    nodes = {3: leaves.withColumn("capacity", F.col("n_tokens") * max_epochs)}
    nodes[2] = nodes[3].groupBy(*LEVELS[:2]).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("capacity").alias("capacity"))
    nodes[1] = nodes[2].groupBy(*LEVELS[:1]).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("capacity").alias("capacity"))
    root = nodes[1].agg(F.floor(F.sum("n_tokens") * F.lit(budget_share)).alias("parent_budget")).withColumn("__one", F.lit(1))
    up = nodes[1].withColumn("__one", F.lit(1)).join(root, "__one")
    for depth in (1, 2, 3):
        keys = LEVELS[: depth - 1]
        if depth > 1:
            parents = up.select(*keys, F.col("budget").alias("parent_budget"))
            up = null_safe(nodes[depth], parents, keys, "inner")
        up = up.withColumn("weight", weight[LEVELS[depth - 1]].cast("double"))
        up = share_among_siblings(up, keys or ["__one"])
    return up.select(*LEVELS, "n_tokens", "weight", "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    weight: dict[str, Column],
    budget_share: float = 0.5,
    max_epochs: int = 4,
    seed: int = 7,
    buckets_hex: int = 3,
) -> DataFrame:
    """One row (doc_id, text_hash, domain, lang, source, n_tokens, epochs, last_tokens, tokens) for each document read.

    epochs are whole readings, last_tokens the tokens of a part reading, tokens their total. A token is a word
    [^\\x20\\x09-\\x0D]+; null and empty texts have none and are never read. The order of an epoch is that of
    md5(seed:epoch:doc_id), then doc_id, then the text's hash; null ids count as the empty string. Rows that
    repeat id and text are read one after the other. Null domains, languages and sources are nodes of their own.
    Budgets are rounded down, so that up to a token a node is not spent. Other columns are not used. A leaf's order is cut by the
    first buckets_hex digits: the sums of the buckets show the one that the prefix ends in, and only that one's rows are
    sorted, so that no leaf meets in one task.
    """
    counted = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        domain.cast("string").alias("domain"),
        "lang",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    )
    slim = materialize(counted.filter("n_tokens > 0"), "mix-tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))
    plan = leaf_budgets(leaves, budget_share, max_epochs, weight).filter("budget > 0")
    plan = plan.select(
        *LEVELS,
        F.expr("budget div n_tokens").alias("epochs"),
        (F.col("budget") % F.col("n_tokens")).alias("part"),
    )
    rows = null_safe(slim, materialize(plan, "mix-budgets"), LEVELS, "inner")
    key = [F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    rows = rows.withColumn("order_key", F.md5(F.concat_ws(":", *key)))
    rows = rows.withColumn("bucket", F.substring("order_key", 1, buckets_hex))
    by_bucket = [*LEVELS, "bucket"]
    sums = materialize(rows.groupBy(*by_bucket).agg(F.sum("n_tokens").alias("in_bucket")), "mix-buckets")
    # a leaf's buckets are summed up in groups of the same first digit, and the few groups along the leaf
    sums = sums.withColumn("group", F.substring("bucket", 1, 1))
    by_group = [*LEVELS, "group"]

    def upto(value: str, part: list[str], order: str) -> Column:
        earlier = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    groups = sums.groupBy(*by_group).agg(F.sum("in_bucket").alias("in_group"))
    groups = groups.withColumn("group_start", upto("in_group", LEVELS, "group")).drop("in_group")
    starts = null_safe(sums.withColumn("start", upto("in_bucket", by_group, "bucket")), groups, by_group, "inner")
    starts = starts.withColumn("start", F.col("start") + F.col("group_start")).drop("group", "group_start")
    placed = null_safe(rows, starts, by_bucket, "inner")
    whole, none = F.expr("start + in_bucket <= part"), F.expr("start >= part")
    within = Window.partitionBy(*by_bucket).orderBy("order_key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    cut = placed.filter(~whole & ~none).withColumn("last_tokens", F.greatest(F.lit(0), F.least("n_tokens", F.col("part") - before)))
    rest = placed.filter(whole | none).withColumn("last_tokens", F.when(whole, F.col("n_tokens")).otherwise(F.lit(0)))
    out = rest.unionByName(cut).withColumn("last_tokens", F.col("last_tokens").cast("long"))
    out = out.withColumn("tokens", F.expr("epochs * n_tokens + last_tokens")).filter("tokens > 0")
    return out.select("doc_id", "text_hash", *LEVELS, "n_tokens", "epochs", "last_tokens", "tokens")
