"""Queries of the interval family: G1-G10, D9-D14, F15-F18, E14-E16, E19-E21, B24, B43, S1-S4, A11."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import intervals as iv_ops

from .registry import query

STEPS = """steps as (select chrom, s as pos, 1 as d, case when strand = '+' then 1 else 0 end as l from iv union all
  select chrom, e + 1, -1, case when strand = '+' then -1 else 0 end from iv),
bp as (select chrom, pos, sum(d)::bigint as d, sum(l)::bigint as l from steps group by all),
cov as (select chrom, pos as s, lead(pos) over w - 1 as e, sum(d) over w::bigint as depth, sum(l) over w::bigint as l from bp window w as (partition by chrom order by pos)),
runs as (select chrom, s, e, depth, l, depth - l as r from cov where e is not null)"""
SIZES = "(select max(e)::bigint as last from feat)"


@query("G1_coverage", "iv", sql=f"{STEPS} select chrom, s, e, depth from runs")
def _(iv):
    return iv_ops.coverage(iv)


@query("G2_rfd", "iv", sql=f"{STEPS} select chrom, s, e, l, r, case when l + r > 2 then (r - l) / (l + r) end as rfd from runs where l + r > 0")
def _(iv):
    return iv_ops.rfd(iv, min_depth=2)


@query(
    "G3_strand_balance", "iv",
    sql="""n as (select count(*) filter (strand = '+') as n_plus, count(*) filter (strand = '-') as n_minus from iv)
    select n_plus, n_minus, n_plus / n_minus as ratio, case when abs(n_plus / n_minus - 1) > 0.01 then n_plus / n_minus else 1 end as scale from n""",
)
def _(iv):
    return iv_ops.strand_balance(iv)


@query("G4_strand_fraction", "iv", sql=f"{STEPS} select chrom, s, e, l / depth as lf, r / depth as rf from runs where depth > 0")
def _(iv):
    return iv_ops.strand_fraction(iv)


@query(
    "G5_meta_profile", "feat", "iv",
    sql=f"""{STEPS}, mids as (select fid, chrom, (s + e) // 2 as mid, 'size' || (length(status) % 3) as class from feat)
    select class, off as "offset", count(*) as n, sum(depth)::bigint as total from
      (select class, r.depth, unnest(range(-10, 11)) * 100 as off, mid, r.s, r.e from mids m join (select * from runs where depth > 0) r on m.chrom = r.chrom and r.s <= mid + 1000 and r.e >= mid - 1000)
    where mid + off between s and e group by all""",
)
def _(feat, iv):
    mids = feat.selectExpr("fid", "chrom", "(s + e) div 2 mid", "concat('size', length(status) % 3) class")
    track = iv_ops.coverage(iv).filter("depth > 0").withColumnRenamed("depth", "value")
    return iv_ops.meta_profile(mids, track, 1000, "class", step=100)


@query(
    "G5_profile_of_ratios", "feat", "iv",
    sql=f"""{STEPS}, mids as (select fid, chrom, (s + e) // 2 as mid, 'size' || (length(status) % 3) as class from feat)
    select class, off as "offset", count(*) as n, round(sum(1 / depth), 6) as total from
      (select class, r.depth, unnest(range(-10, 11)) * 100 as off, mid, r.s, r.e from mids m join (select * from runs where depth > 0) r on m.chrom = r.chrom and r.s <= mid + 1000 and r.e >= mid - 1000)
    where mid + off between s and e group by all""",
)
def _(feat, iv):
    mids = feat.selectExpr("fid", "chrom", "(s + e) div 2 mid", "concat('size', length(status) % 3) class")
    track = iv_ops.coverage(iv).filter("depth > 0").withColumn("value", 1 / F.col("depth"))
    return iv_ops.meta_profile(mids, track, 1000, "class", step=100).withColumn("total", F.round("total", 6))


@query("G6_tile_genome", "chrom_sizes", sql="select chrom, s, least(s + 4999, size) as e from (select chrom, size, unnest(range(1, size + 1, 5000)) as s from chrom_sizes)")
def _(sizes):
    return iv_ops.tile_genome(sizes, 5000)


@query(
    "G7_inner_region", "feat", "chrom_sizes", "pts",
    sql="""select f.chrom, f.s, f.e, status, fid from feat f join chrom_sizes using (chrom) where f.s > 50000 and f.e < size - 50000
    and not exists (select 1 from pts p where p.chrom = f.chrom and p.rep = 'BD' and p.pos between f.s and f.e + 200)""",
)
def _(feat, sizes, pts):
    black = pts.filter("rep = 'BD'").selectExpr("chrom", "pos - 200 s", "pos e")
    return iv_ops.inner_region(feat, sizes, 50000, black, "fid")


@query(
    "G8_filter_alignments", "lineitem",
    sql="""a as (select 'chr' || (l_suppkey % 16 + 1) as chrom, l_orderkey as s, l_orderkey + l_partkey as e, case when l_linenumber % 2 = 0 then '+' else '-' end as strand, ((l_orderkey + l_suppkey) * 37 % 2048)::int as flag, (l_partkey % 60)::int as mapq from lineitem)
    select distinct chrom, s, e, strand from a where flag & 1024 = 0 and flag & 256 = 0 and mapq >= 10 and (flag & 1 = 0 or flag & 2 != 0)""",
)
def _(lineitem):
    aln = lineitem.selectExpr(
        "concat('chr', l_suppkey % 16 + 1) chrom", "l_orderkey s", "l_orderkey + l_partkey e", "if(l_linenumber % 2 = 0, '+', '-') strand",
        "cast((l_orderkey + l_suppkey) * 37 % 2048 as int) flag", "cast(l_partkey % 60 as int) mapq",
    )
    return iv_ops.filter_alignments(aln)


@query(
    "G9_event_balance", "pts", "chrom_sizes",
    sql="""tiles as (select chrom, s, least(s + 4999, size) as e from (select chrom, size, unnest(range(1, size + 1, 5000)) as s from chrom_sizes)),
    n as (select chrom, (pos - 1) // 5000 * 5000 + 1 as s, sum(case rep when 'BC' then 1 else -1 end)::bigint as d from pts group by all),
    b as (select t.chrom, t.s, t.e, coalesce(d, 0) as d from tiles t left join n using (chrom, s))
    select chrom, s, e, d as balance, case when count(*) over w = 2 then (sum(d) over w)::bigint end as smooth2 from b window w as (partition by chrom order by s rows between current row and 1 following)""",
)
def _(pts, sizes):
    from strandloom.plans.genome import event_balance

    return event_balance(pts.filter("rep = 'BC'"), pts.filter("rep = 'BD'"), sizes, 5000)


@query(
    "G10_region_gaps", "feat", "chrom_sizes",
    sql="""r as (select chrom, s, e from feat union all select chrom, size + 1, size + 1 from chrom_sizes),
    m as (select chrom, s, coalesce(max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding), 0) as top from r)
    select chrom, top + 1 as s, s - 1 as e from m where s > top + 1""",
)
def _(feat, sizes):
    return iv_ops.region_gaps(feat, sizes)


PTS_FEAT = "(select p.id, p.chrom, p.pos, f.fid, f.s, f.e from pts p join feat f on p.chrom = f.chrom and p.pos between f.s and f.e)"


def _ranges(pts):
    return pts.selectExpr("id", "chrom", "rep", "pos s", "pos e")


@query("D9_overlap_join", "pts", "feat", sql=f"select id, chrom, pos, fid, s, e from {PTS_FEAT}")
def _(pts, feat):
    pairs = iv_ops.overlap_join(_ranges(pts).drop("rep"), feat.select("fid", "chrom", "s", "e"), bin_width=None)
    return pairs.selectExpr("id", "chrom", "s pos", "fid", "s_b s", "e_b e")


@query("D10_overlaps_any", "feat", "pts", sql="select chrom, s, e, status, fid from feat f where exists (select 1 from pts p where p.chrom = f.chrom and p.pos between f.s and f.e)")
def _(feat, pts):
    return iv_ops.overlaps_any(feat, _ranges(pts), "fid", bin_width=None)


@query("D10_overlaps_none", "feat", "pts", sql="select chrom, s, e, status, fid from feat f where not exists (select 1 from pts p where p.chrom = f.chrom and p.pos between f.s and f.e)")
def _(feat, pts):
    return iv_ops.overlaps_any(feat, _ranges(pts), "fid", negate=True, bin_width=None)


@query("D11_nearest", "pts", "feat", sql="select id, p.chrom, min(greatest(0, f.s - pos - 1, pos - f.e - 1))::bigint as distance from pts p left join feat f on p.chrom = f.chrom group by all")
def _(pts, feat):
    return iv_ops.nearest(_ranges(pts), feat, "id").select("id", "chrom", "distance")


@query(
    "D12_nearest_self", "pts",
    sql="""n as (select *, least(pos - lag(pos) over w - 1, lead(pos) over w - pos - 1) as d from pts window w as (partition by chrom order by pos, id))
    select id, chrom, pos, rep, case when d is not null then greatest(d, 0)::bigint end as distance from n""",
)
def _(pts):
    return iv_ops.nearest_self(pts, "id")


@query(
    "D12_nearest_ranges", "feat",
    sql="""d as (select a.fid, min(greatest(b.s - a.e - 1, a.s - b.e - 1, 0))::bigint as distance from feat a join feat b on a.chrom = b.chrom and a.fid <> b.fid group by a.fid)
    select fid, chrom, s, e, distance from feat left join d using (fid)""",
)
def _(feat):
    return iv_ops.nearest_self(feat.select("fid", "chrom", "s", "e"), "fid", "s", "e")


@query("D13_track_at", "pts", "iv", sql=f"{STEPS} select id, p.chrom, pos, rep, depth as value from pts p left join runs r on p.chrom = r.chrom and pos between r.s and r.e")
def _(pts, iv):
    return iv_ops.track_at(pts, iv_ops.coverage(iv).withColumnRenamed("depth", "value"))


BLOCKS = "select chrom, (k * 3000 + 1)::bigint as s, (k * 3000 + 2000)::bigint as e, (k * 17 - 40)::bigint as shift from chrom_sizes, range(0, 500) t(k)"


@query("D14_lift_coords", "pts", "chrom_sizes", sql=f"b as ({BLOCKS}) select id, p.chrom, pos + shift as pos, rep from pts p join b on p.chrom = b.chrom and pos between b.s and b.e")
def _(pts, sizes):
    blocks = sizes.select("chrom", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("k"))
    blocks = blocks.selectExpr("chrom", "cast(k * 3000 + 1 as bigint) s", "cast(k * 3000 + 2000 as bigint) e", "cast(k * 17 - 40 as bigint) offset")
    return iv_ops.lift_coords(pts, blocks)


def _clusters(gap, part="chrom", src="pts"):
    return f"""l as (select *, case when pos - lag(pos) over (partition by {part} order by pos, id) - 1 < {gap} then 0 else 1 end as fresh from {src}),
    c as (select *, sum(fresh) over (partition by {part} order by pos, id) as cl from l)"""


@query("F14_islands", "iv", sql=f"""{STEPS}, k as (select *, case when s = lag(e) over w + 1 then 0 else 1 end as fresh from runs where depth >= 5 window w as (partition by chrom order by s)),
    c as (select *, sum(fresh) over (partition by chrom order by s) as cl from k)
    select chrom, min(s) as s, max(e) as e, max(e) - min(s) + 1 as length, min(depth) as low from c group by chrom, cl""")  # fmt: skip
def _(iv):
    return iv_ops.islands(iv_ops.coverage(iv), F.col("depth") >= 5, "depth")


@query("F15_cluster_by_gap", "pts", sql=f"{_clusters(1500)} select chrom, min(pos) as s, max(pos) as e, count(*) as eff from c group by chrom, cl")
def _(pts):
    return iv_ops.cluster_by_gap(_ranges(pts), 1500, order=["id"])


@query("F15_cluster_spread", "pts", sql=f"""{_clusters(1500)}, m as (select chrom, cl, median(pos)::double as med from c group by all)
    select chrom, med, min(pos) as s, count(*) as eff, round(quantile_cont(abs(pos - med), 0.5) * 1.4826, 6) as mad from c join m using (chrom, cl) group by chrom, cl, med""")  # fmt: skip
def _(pts):
    return iv_ops.cluster_spread(_ranges(pts), 1500, ["id"]).withColumn("mad", F.round("mad", 6))


#: The distances of the sweep, fixed values.
GAPS = [1, 10, 50, 100, 250, 500, 750, 1000, 1250, 1500, 1750, 2000, 2500, 3000, 4000, 5000, 7500, 10000, 20000, 50000, 75000, 100000]


@query(
    "F16_cluster_sweep", "pts",
    sql=f"""g as (select p.*, gap from pts p, (select unnest({GAPS}) as gap)), {_clusters('gap', 'gap, chrom', 'g')}
    select gap, chrom, min(pos) as s, max(pos) as e, count(*) as eff from c group by gap, chrom, cl""",
)
def _(pts):
    return iv_ops.cluster_sweep(_ranges(pts), GAPS, ["id"])


@query(
    "E14_cluster_size_table", "pts",
    sql=f"""g as (select p.*, gap from pts p, (select unnest({GAPS}) as gap)), {_clusters('gap', 'gap, chrom', 'g')},
    k as (select gap, max(pos) - min(pos) + 1 as width, count(*) as eff from c group by gap, chrom, cl)
    select gap, count(*) filter (eff = 1) as n1, count(*) filter (eff > 1) as n_over_1, count(*) filter (eff > 2) as n_over_2, count(*) filter (eff > 3) as n_over_3,
      count(*) filter (eff > 5) as n_over_5, count(*) filter (eff > 10) as n_over_10, quantile_cont(width, 0.5) filter (eff > 1)::double as median_width from k group by gap""",
)
def _(pts):
    from strandloom.plans.genome import cluster_size_table

    return cluster_size_table(iv_ops.cluster_sweep(_ranges(pts), GAPS, ["id"]))


CLUSTER_REP = _clusters(1500, "chrom, rep")


@query(
    "F17_cluster_by_replicate", "pts",
    sql=f"""{CLUSTER_REP}, k as (select chrom, rep, min(pos) as s, max(pos) as e, count(*) as eff from c group by chrom, rep, cl)
    select a.*, (select min(greatest(0, b.s - a.e - 1, a.s - b.e - 1)) from k b where b.chrom = a.chrom and b.rep != a.rep)::bigint as distance,
      exists (select 1 from k b where b.chrom = a.chrom and b.rep != a.rep and a.s <= b.e and b.s <= a.e) as reproducible from k a""",
)
def _(pts):
    from strandloom.plans.genome import cluster_by_replicate

    return cluster_by_replicate(_ranges(pts), 1500, ["id"])


@query(
    "F18_oem", "pts", "iv",
    sql=f"""{STEPS}, f as (select chrom, s, e, l / depth as lf from runs where depth > 0), ends as (select chrom, max(e) as last from iv group by chrom),
    q as (select id, chrom, pos from pts),
    m as (select id, sum(lf * greatest(0, least(f.e, pos - 1) - greatest(f.s, pos - 1000) + 1)) as b, sum(lf * greatest(0, least(f.e, pos + 999) - greatest(f.s, pos) + 1)) as a
      from q join f on q.chrom = f.chrom and f.s <= pos + 999 and f.e >= pos - 1000 group by id)
    select id, q.chrom, pos, round(case when pos - 1000 >= 1 and pos + 999 <= last then (coalesce(b, 0) - coalesce(a, 0)) / 1000 end, 6) as oem from q left join ends using (chrom) left join m using (id)""",
)
def _(pts, iv):
    return iv_ops.oem(pts.select("id", "chrom", "pos"), iv, 1000).withColumn("oem", F.round("oem", 6))


@query("E19_bin_mean", "pts", "chrom_sizes", sql="""tiles as (select chrom, s, least(s + 999, size) as e from (select chrom, size, unnest(range(1, size + 1, 1000)) as s from chrom_sizes)),
    n as (select chrom, (pos - 1) // 1000 * 1000 + 1 as s, count(*) as n, sum(id % 100)::bigint as v from pts group by all)
    select t.chrom, t.s, t.e, coalesce(n, 0) as n, v / n as mean from tiles t left join n using (chrom, s)""")  # fmt: skip
def _(pts, sizes):
    return iv_ops.bin_mean(pts.withColumn("score", F.col("id") % 100), "score", sizes, 1000)


@query(
    "E20_binned_average", "iv", "chrom_sizes",
    sql=f"""{STEPS}, tiles as (select chrom, s, least(s + 999, size) as e from (select chrom, size, unnest(range(1, size + 1, 1000)) as s from chrom_sizes)),
    m as (select t.chrom, t.s, sum(depth * (least(r.e, t.e) - greatest(r.s, t.s) + 1))::bigint as v from tiles t join runs r on t.chrom = r.chrom and r.s <= t.e and r.e >= t.s group by all)
    select t.chrom, t.s, t.e, coalesce(v, 0) / (t.e - t.s + 1) as mean from tiles t left join m using (chrom, s)""",
)
def _(iv, sizes):
    track = iv_ops.coverage(iv).withColumnRenamed("depth", "value")
    return iv_ops.binned_average(track, sizes, 1000)


@query(
    "E21_membership_counts", "feat", "pts", "iv",
    sql="""f as (select fid, exists (select 1 from pts p where p.chrom = f.chrom and p.rep = 'BC' and pos between f.s and f.e) as in_b, exists (select 1 from pts p where p.chrom = f.chrom and p.rep = 'BD' and pos between f.s and f.e) as in_c from feat f)
    select in_b, in_c, count(*) as n from f group by all""",
)
def _(feat, pts, iv):
    from strandloom.plans.genome import membership_counts

    r = _ranges(pts)
    return membership_counts(feat, r.filter("rep = 'BC'"), r.filter("rep = 'BD'"), "fid")


@query(
    "E15_conditional_share", "pts", "feat",
    sql="""f as (select rep, exists (select 1 from feat where feat.chrom = p.chrom and p.pos between feat.s and feat.e) as hit from pts p)
    select coalesce(rep, 'all') as class, count(*) as n, count(*) filter (hit) as n_true, count(*) filter (hit) / count(*) as share from f group by grouping sets ((rep), ())""",
)
def _(pts, feat):
    from strandloom.operators.aggregates import conditional_share

    r = _ranges(pts)
    hit = iv_ops.overlaps_any(r, feat, "id").select("id", F.lit(True).alias("hit"))
    return conditional_share(r.join(hit, "id", "left"), "hit", "rep")


@query(
    "E16_distance_contingency", "pts", "feat",
    sql=f"""d as (select p.id, min(greatest(0, f.s - pos - 1, pos - f.e - 1)) as dist from pts p join feat f on p.chrom = f.chrom group by all), {_clusters(1500)},
    k as (select chrom, cl, count(*) as eff from c group by all),
    x as (select case when eff <= 1 then 'spo' when eff <= 4 then '2-4' when eff <= 12 then '5-12' else '13+' end as class, dist from c join k using (chrom, cl) left join d using (id))
    select class, count(*) as n, count(*) filter (dist <= 2000) as near, count(*) filter (dist > 2000) as far from x group by class""",
)
def _(pts, feat):
    from strandloom.plans.genome import distance_contingency

    return distance_contingency(_ranges(pts), feat, 1500, 2000)


@query("B24_resize", "feat", sql="select chrom, fid, (s + e) // 2 - 500 as c_s, (s + e) // 2 + 499 as c_e, case when fid % 2 = 0 then s else e - 999 end as t_s, case when fid % 2 = 0 then s + 999 else e end as t_e, s - 50 as x_s, e + 50 as x_e from feat")
def _(feat):
    from strandloom.functions import columns as c

    strand = F.when(F.col("fid") % 2 == 0, "+").otherwise("-")
    out = {}
    for k, (s, e) in {"c": c.resize_center("s", "e", 1000), "t": c.resize_start("s", "e", strand, 1000), "x": c.expand("s", "e", 50)}.items():
        out |= {f"{k}_s": s, f"{k}_e": e}
    return feat.select("chrom", "fid", *[v.alias(k) for k, v in out.items()])


@query("B43_clamp", "feat", "chrom_sizes", sql="select fid, f.chrom, greatest(f.s - 2000, 1) as s, least(f.e + 2000, 1500000) as e from feat f join chrom_sizes using (chrom)")
def _(feat, sizes):
    wide = feat.selectExpr("fid", "chrom", "s - 2000 s", "e + 2000 e").join(F.broadcast(sizes), "chrom")
    return wide.select("fid", "chrom", F.greatest("s", F.lit(1)).alias("s"), F.least("e", F.col("size") - 500).alias("e"))


@query("S1_union_replicates", "pts", sql="select id, chrom, pos, rep from pts where rep = 'BC' union all select id, chrom, pos, rep from pts where rep = 'BD' union all select id, chrom, pos, 'all' from pts")
def _(pts):
    from strandloom.operators.sets import union_replicates

    return union_replicates({"BC": pts.filter("rep = 'BC'"), "BD": pts.filter("rep = 'BD'")}, "rep", total="all").select("id", "chrom", "pos", "rep")


@query("S2_stack_labelled", "pts", "feat", sql="select chrom, pos as s, 'event' as source from pts union all select chrom, s, 'feature' from feat")
def _(pts, feat):
    from strandloom.operators.sets import stack_labelled

    return stack_labelled({"event": pts.selectExpr("chrom", "pos s"), "feature": feat.select("chrom", "s")}, "source")


REPRO = """select id, exists (select 1 from pts q where q.rep = 'BD' and q.chrom = p.chrom and abs(q.pos - p.pos) <= 500) as hit from pts p where rep = 'BC'"""


@query("S3_reproducible", "pts", sql=f"h as ({REPRO}) select id, hit as reproducible from h")
def _(pts):
    from strandloom.operators.sets import reproducible

    wide = _ranges(pts).withColumns({"s": F.col("s") - 250, "e": F.col("e") + 250})
    return reproducible(wide.filter("rep = 'BC'"), wide.filter("rep = 'BD'"), "id").select("id", "reproducible")


@query("S4_merge_callers", "pts", sql=f"{_clusters(2000)} select chrom, min(id)::bigint as id, min(pos) as s, max(pos) as e, count(*) as n, count(distinct rep) as callers from c group by chrom, cl")
def _(pts):
    from strandloom.operators.sets import merge_callers

    return merge_callers(_ranges(pts), 2000, "id", "rep")


@query("A11_track_rows", "iv", sql=f"{STEPS} select chrom, s - 1 as start, e as \"end\", depth as value from runs where depth > 0")
def _(iv):
    from strandloom.sources.bed import bedgraph

    return bedgraph(iv_ops.coverage(iv), "depth").filter("value > 0")
