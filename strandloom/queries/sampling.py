"""Queries of sampling, splits and shuffles: H3-H9, H11, H12."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import sampling as sm

from .registry import query

K = "read_id"


def _draw(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::bigint / 4503599627370496"


ARRAYS = "a as (select read_id, list(v100::double order by idx) as v, max(v100) % 2 as label from sig group by read_id)"


def _arrays(sig):
    v = F.transform(F.sort_array(F.collect_list(F.struct("idx", "v100"))), lambda x: x.v100.cast("double"))
    return sig.groupBy(K).agg(v.alias("v"), (F.max("v100") % 2).cast("double").alias("label"))


@query("H3_limit_reads", "sig", sql="n as (select read_id, idx, v100, row_number() over (partition by read_id order by v100 desc, idx) as k from sig) select read_id, idx, v100 from n where k <= 5")
def _(sig):
    return sm.limit_per_group(sig.withColumn("neg", -F.col("v100")), [K], ["neg", "idx"], 5).select(K, "idx", "v100")


@query("H4_shuffle", "pts", sql="select * from pts")
def _(pts):
    return sm.shuffle(pts, "id", 3)


@query("H5_holdout", "pts", sql=f"select *, {_draw(3, 'id')} < 0.1 as held_out from pts")
def _(pts):
    return sm.holdout(pts, "id", 0.1, 3)


@query("H6_split_by_chrom", "pts", sql="s as (select case when chrom = 'chr11' then 'test' else 'train' end as split from pts) select split, count(*) as n from s group by split")
def _(pts):
    return sm.split_by_chrom(pts, "chrom").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("H7_subsample_by_value", "pts", sql=f"select * from pts where {_draw(5, 'id')} < case rep when 'BC' then 0.2 when 'BD' then 0.5 else 1 end")
def _(pts):
    return sm.subsample_by_value(pts, "rep", {"BC": 0.2, "BD": 0.5}, "id", 5)


@query(
    "H8_weighted_subsequences", "seqs",
    sql=f"""w as (select read_id, seq, read_id % 5 as w, floor({_draw(11, 'read_id')} * 1073741824) as p from seqs where length(seq) >= 40 and read_id % 5 > 0), t as (select *, sum(w) over (order by p, read_id) as upto, sum(w) over () as total from w),
    d as (select i as draw, {_draw(12, 'i')} as u, {_draw(13, 'i')} as v from range(500) r(i))
    select draw, read_id, floor(v * (length(seq) - 39))::int as start, substr(seq, floor(v * (length(seq) - 39))::int + 1, 40) as piece from d join t on (upto - w) / total <= u and u < upto / total""",
)
def _(seqs):
    return sm.weighted_subsequences(seqs.withColumn("w", F.col(K) % 5), K, "seq", "w", 500, 40, 11)


@query(
    "H9_augment_mix", "sig",
    sql=f"""{ARRAYS}, n as (select *, row_number() over (order by {_draw(7, 'read_id')}, read_id) as i, count(*) over () as m from a)
    select p.read_id, list_concat(p.v[:len(p.v) // 2], n.v[len(p.v) // 2 + 1:]) as v, (p.label + n.label)::double / 2 as label from n p join n on n.i = p.i % p.m + 1""",
)
def _(sig):
    return sm.augment_mix(_arrays(sig), K, "v", "label", 7)


@query("H9_augment_noise", "sig", sql=f"{ARRAYS} select read_id, label::double as label, list_transform(v, lambda x: x * (0.9::double + 0.2::double * ({_draw(7, 'read_id')}))) as v from a")
def _(sig):
    return sm.augment_noise(_arrays(sig), K, "v", 7)


@query(
    "H9_augment_up_down", "sig",
    sql=f"""{ARRAYS}, p as (select *, floor({_draw(7, 'read_id')} * len(v))::int + 1 as p, {_draw(8, 'read_id')} < 0.5 as up from a)
    select read_id, label::double as label, list_concat(v[:case when up then p else p - 1 end], v[case when up then p else p + 1 end:]) as v from p""",
)
def _(sig):
    return sm.augment_up_down(_arrays(sig), K, "v", 7)


def _places(gaps: str, features: str, by: str, seed: int, *keys: str) -> str:
    """placed: the rows of features(by..., fid, d), widths dealt anew within by, with start: an end drawn among the free positions d or more behind
    their run's begin, in the order of this distance and then of the runs, longest first."""
    return f"""r as ({gaps} union all select chrom, size + 1, size + 1 from chrom_sizes),
    m as (select chrom, s, coalesce(max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding), 0) as top from r),
    free as (select chrom, top + 1 as s, s - top - 1 as n, row_number() over (partition by chrom order by s - top - 1 desc, top) - 1 as k from m where s > top + 1),
    f as ({features}), o as (select *, row_number() over (partition by {by} order by fid) as i, row_number() over (partition by {by} order by {_draw(seed + 1, *keys)}, fid) as j from f),
    dealt as (select a.* exclude (d), b.d from o a join o b on {" and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))} and a.i = b.j),
    total as (select chrom, d, sum(n - d)::bigint as total from free join (select distinct chrom, d from dealt) using (chrom) where n > d group by all),
    steps as (select chrom, n as t0, lead(n) over (partition by chrom order by n) as t1, (select count(*) from free g where g.chrom = u.chrom and g.n > u.n) as reach from (select distinct chrom, n from free union select distinct chrom, 0 from free) u),
    reached as (select *, sum((t1 - t0) * reach) over (partition by chrom order by t0)::bigint as upto from steps where t1 is not null),
    drawn as (select dealt.*, floor(({_draw(seed, *keys)}) * total)::bigint as place, total from dealt left join total using (chrom, d)),
    ends as (select a.*, (select max(upto) from reached where reached.chrom = a.chrom) - total + place as nth from drawn a),
    placed as (select ends.* exclude (i, j, nth, place, total), free.s + t0 + (nth - upto + (t1 - t0) * reach) // reach - d as start from ends left join reached on reached.chrom = ends.chrom and nth < upto and nth >= upto - (t1 - t0) * reach
      left join free on free.chrom = ends.chrom and k = (nth - upto + (t1 - t0) * reach) % reach)"""


@query(
    "H11_shuffle_intervals", "feat", "chrom_sizes", "pts",
    sql=f"{_places('select chrom, pos as s, pos + 20 as e from pts', 'select fid, chrom, e - s as d from feat', 'chrom', 13, 'fid', 'chrom')} select fid, chrom, start as s, start + d as e from placed",
)
def _(feat, sizes, pts):
    gaps = pts.selectExpr("chrom", "pos s", "pos + 20 e")
    return sm.shuffle_intervals(feat.select("fid", "chrom", "s", "e"), gaps, sizes, "fid", 13)


@query(
    "H12_null_quantiles", "feat", "chrom_sizes", "pts",
    sql=f"""{_places("select chrom, pos as s, pos + 20 as e from pts where rep = 'BD'", 'select fid, chrom, e - s as d, rep from feat, range(1, 11) t(rep)', 'rep, chrom', 13, 'fid', 'rep', 'chrom')},
    x as (select rep, exists (select 1 from pts where pts.rep = 'BC' and pts.chrom = placed.chrom and pos between start and start + d) as hit from placed where start is not null),
    sh as (select rep, avg(hit::int) as share from x group by rep)
    select round(quantile_cont(share, 0.5), 9) as median, round(quantile_cont(share, 0.01), 9) as q01, round(quantile_cont(share, 0.99), 9) as q99 from sh""",
)
def _(feat, sizes, pts):
    gaps, hits = pts.filter("rep = 'BD'").selectExpr("chrom", "pos s", "pos + 20 e"), pts.filter("rep = 'BC'").selectExpr("chrom", "pos s", "pos e")
    out = sm.null_quantiles(feat.select("fid", "chrom", "s", "e"), gaps, sizes, hits, "fid", 10, 13)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])
