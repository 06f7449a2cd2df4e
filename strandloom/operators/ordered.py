"""Windows along a chromosome without bringing one into a task.

Positions are cut in bins; a window over each bin, and one over the few values that bins add up to, together give
what a window over the whole chromosome would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.storage import stored

WIDTH = 1 << 17
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _both(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(a, b)


def along(
    df: DataFrame, part: list[str], pos: str, order: list[str], sums: dict[str, tuple[str, str]] | None = None,
    before: dict[str, str] | None = None, after: dict[str, str] | None = None, back: bool = False, strict: bool = False, width: int = WIDTH,
) -> DataFrame:
    """Adds running aggregates and neighbours' values along pos within part, in one pass over the bins.

    sums: out: (sum, max or min, column), from the start (back: from the end) up to the row, or with strict up to the one
    before. before and after: out: column, the value in the row before and after, null at the ends. order breaks ties of pos.
    Rows whose part or pos is null have no place and go.
    """
    sums, before, after = sums or {}, before or {}, after or {}
    turn = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    df = df.withColumn("__bin", F.expr(f"{pos} div {width}"))
    by, at = [*part, "__bin"], F.struct(pos, *order)
    struct = lambda columns: F.struct(*[F.col(c).alias(out) for out, c in columns.items()])
    edges = [_AGG[k](c).alias(f"__t_{out}") for out, (k, c) in sums.items()]
    edges += [F.max_by(struct(before), at).alias("__last")] * bool(before) + [F.min_by(struct(after), at).alias("__next")] * bool(after)
    bins = Window.partitionBy(*part).orderBy("__bin")
    earlier = Window.partitionBy(*part).orderBy(turn("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [_AGG[k](f"__t_{out}").over(earlier).alias(f"__c_{out}") for out, (k, _) in sums.items()]
    carried += [F.lag("__last").over(bins).alias("__last")] * bool(before) + [F.lead("__next").over(bins).alias("__next")] * bool(after)
    carried = df.groupBy(*by).agg(*edges).select(*by, *carried)
    inside = Window.partitionBy(*by).orderBy(pos, *order)
    run = Window.partitionBy(*by).orderBy(*[turn(c) for c in [pos, *order]]).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    new = {f"__i_{out}": _AGG[k](c).over(run) for out, (k, c) in sums.items()}
    if before:
        new["__before"] = F.lag(struct(before)).over(inside)
    if after:
        new["__after"] = F.lead(struct(after)).over(inside)
    df = df.withColumns(new).join(carried, by)
    out = {out: _both(k, F.col(f"__i_{out}"), F.col(f"__c_{out}")) for out, (k, _) in sums.items()}
    out |= {o: F.coalesce("__before", "__last")[o] for o in before} | {o: F.coalesce("__after", "__next")[o] for o in after}
    df = df.withColumns(out)
    extra = [f"__{x}_{o}" for o in sums for x in "ic"] + ["__before", "__last"] * bool(before) + ["__after", "__next"] * bool(after)
    return df.drop("__bin", *extra)


def running(df: DataFrame, part: list[str], pos: str, order: list[str], specs: dict[str, tuple[str, str]], **how) -> DataFrame:
    """along() with running aggregates only."""
    return along(df, part, pos, order, sums=specs, **how)


def neighbour(df: DataFrame, part: list[str], pos: str, order: list[str], columns: dict[str, str], ahead: bool = False, width: int = WIDTH) -> DataFrame:
    """along() with the values of the row before, or after, only."""
    return along(df, part, pos, order, **{"after" if ahead else "before": columns}, width=width)


def cumulated(at: DataFrame, by: list[str], value: str, upto: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Adds sums over the rows of at up to value, of any type, within by, and over all of them: upto and totals are out: column. at has a row for each by and value.

    Rows are cut in ranges of by and value, as many as their size asks for; the ranges' sums carry the total along, so that no by meets in one task.
    """
    cut = at.repartitionByRange(*by, value).sortWithinPartitions(*by, value).withColumn("__p", F.spark_partition_id())
    cut = stored(cut, "ranges")
    parts = cut.groupBy(*by, "__p").agg(*[F.sum(c).alias(f"__s_{out}") for out, c in (upto | (totals or {})).items()])
    group = Window.partitionBy(*(by or [F.lit(1)]))
    earlier = group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"__s_{out}").over(earlier), F.lit(0)).alias(f"__c_{out}") for out in upto]
    parts = parts.select(*by, "__p", *carried, *[F.sum(f"__s_{out}").over(group).alias(out) for out in totals or {}])
    run = Window.partitionBy(*by, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({f"__i_{out}": F.sum(c).over(run) for out, c in upto.items()})
    # without by there is a row for each range
    cut = cut.join(parts if by else F.broadcast(parts), [*by, "__p"])
    cut = cut.withColumns({out: F.col(f"__c_{out}") + F.col(f"__i_{out}") for out in upto})
    return cut.drop("__p", *[f"__{x}_{out}" for out in upto for x in "ci"])


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], aggs: list[Column] | None = None) -> DataFrame:
    """(by..., aggs..., points...): the exact quantile of each group's values at each of points, between neighbours in proportion.

    aggs are over the different values of a group, null among them, where __w is how often each occurs. Nulls in by make a group;
    quantiles leave nulls out; without by there is one row. Sums over bins of values give the ranks: a group's values never meet in one task.
    """
    df = df.withColumn("__g", F.struct(*by) if by else F.struct(F.lit(1)))
    at = stored(df.groupBy("__g", value).agg(F.count(F.lit(1)).alias("__w")), "values")
    aggs = [*(aggs or []), F.sum("__w").alias("__rows")]
    base = at.groupBy("__g").agg(*aggs) if by else at.agg(*aggs).withColumn("__g", F.struct(F.lit(1)))
    at = cumulated(at.filter(F.col(value).isNotNull()), ["__g"], value, {"__to": "__w"}, {"__all": "__w"})
    place = {name: p * (F.col("__all") - 1) for name, p in points.items()}
    ranked = lambda rank: F.min(F.when(F.col("__to") > rank, F.col(value)))
    ends = [c for n, p in place.items() for c in (ranked(F.floor(p)).alias(f"__a_{n}"), ranked(F.ceil(p)).alias(f"__b_{n}"))]
    found = at.groupBy("__g", "__all").agg(*ends)

    def between(name: str) -> Column:
        low, high = F.floor(place[name]), F.ceil(place[name])
        mixed = (high - place[name]) * F.col(f"__a_{name}") + (place[name] - low) * F.col(f"__b_{name}")
        return F.when(low == high, F.col(f"__a_{name}")).otherwise(mixed).cast("double").alias(name)

    found = found.select("__g", *[between(name) for name in points])
    return base.join(found, "__g", "left").select(*["__g.*"] * bool(by), *[c for c in base.columns if c not in ("__g", "__rows")], *points)


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "__n", total: str = "__all") -> DataFrame:
    """Adds each row's place (from 0) in order, of any types, and how many rows there are; within by, if given, nulls of which make a group. order ends with a key, or ties are
    placed as they come.

    Rows are cut in ranges of the order, as many as their size asks for, and sorted there; only the ranges' sizes meet in one place, a row a task. So neither
    a common beginning nor a large group brings more rows to one task than another.
    """
    by = by or []
    cut = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # the rest of the id after a task's number counts the task's rows
    cut = cut.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i"))
    cut = stored(cut, "ranges")
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.select("__p", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__o"), F.sum("__c").over(Window.partitionBy(F.lit(1))).alias("__t"))
    cut = cut.join(F.broadcast(sizes), "__p").withColumn(out, F.col("__o") + F.col("__i"))  # a row for each task
    if not by:
        return cut.withColumn(total, F.col("__t")).drop("__p", "__i", "__o", "__t")
    cut = cut.withColumn("__g", F.struct(*by))
    first = cut.groupBy("__g").agg(F.min(out).alias("__f"), F.count(F.lit(1)).alias(total))
    return cut.join(first, "__g").withColumn(out, F.col(out) - F.col("__f")).drop("__p", "__i", "__o", "__t", "__g", "__f")


def last_before(points: DataFrame, breaks: DataFrame, part: list[str], pos: str, payload: list[str], width: int = WIDTH) -> DataFrame:
    """points with the payload of the last of breaks, in pos and then payload, that lies at or before their pos within part; nulls if none does.

    Both are merged in one order, cut in bins of pos: each row is there once, however far it is to the break before.
    """
    held = F.struct(pos, *payload)
    a = breaks.select(*part, pos, F.lit(0).alias("__kind"), held.alias("__b"))
    b = points.select(*part, pos, F.lit(1).alias("__kind"), F.struct(*[c for c in points.columns if c not in (*part, pos)]).alias("__row"))
    met = running(a.unionByName(b, allowMissingColumns=True), part, pos, ["__kind"], {"__found": ("max", "__b")}, width=width).filter("__kind = 1")
    return met.select(*part, pos, "__row.*", *[F.col("__found")[c].alias(c) for c in payload])
