"""Queries of k-mer tables: E5, E8, D7, H1, H2, J5, J6, J10, J16, A17."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import kmers as km

from .joins import KM, k3
from .registry import query

HALF = "a as (select kmer, v100 from k3 where kmer is not null and read_id % 2 = 0), b as (select kmer, v100 from k3 where kmer is not null and read_id % 2 = 1)"
DELTA = f"{KM}, {HALF}, ta as (select kmer, count(*) as n_a, sum(v100) / count(*) as mean_a from a group by kmer), tb as (select kmer, count(*) as n_b, sum(v100) / count(*) as mean_b from b group by kmer), d as (select *, abs(mean_a - mean_b) as delta from ta join tb using (kmer))"


def halves(sig):
    k = k3(sig)
    return k.filter("read_id % 2 = 0"), k.filter("read_id % 2 = 1")


def samples(sig):
    return k3(sig).withColumn("sample", F.when(F.col("read_id") % 2 == 0, "a").otherwise("b"))


@query("E5_kmer_stats", "sig", sql=f"{KM} select kmer, n, (mean * n)::bigint as total, mean from tab")
def _(sig):
    return km.kmer_stats(k3(sig), "kmer", "v100").select("kmer", "n", "total", "mean")


@query("E5_kmer_steps", "sig", sql="d as (select call || lead(call) over w as kmer, lead(v100) over w - v100 as d from sig window w as (partition by read_id order by idx)) select kmer, count(*) as n, sum(d)::bigint as total, sum(d) / count(*) as mean from d where kmer is not null group by kmer")
def _(sig):
    from strandloom.operators.series import diff

    d = sig.withColumn("d", diff("v100", "read_id", "idx"))
    return km.kmer_stats(km.series_kmers(d, "read_id", "idx", "call", 2), "kmer", "d")


@query("H1_top_kmers_by_delta", "sig", sql=f"{DELTA} select kmer, n_a, mean_a, n_b, mean_b, delta from d order by delta desc, kmer limit 30")
def _(sig):
    a, b = (km.kmer_stats(h, "kmer", "v100") for h in halves(sig))
    return km.top_by_delta(a, b, 30)


RANKSUM = f"""{KM}, s as (select kmer, v100, case when read_id % 2 = 0 then 1 else 0 end as f from k3 where kmer is not null), v as (select kmer, v100, sum(f)::bigint as c1, count(*) as c from s group by all),
r as (select *, 2 * coalesce(sum(c) over (partition by kmer order by v100 rows between unbounded preceding and 1 preceding), 0) + c + 1 as r2 from v),
g as (select kmer, sum(c1)::bigint as n1, (sum(c) - sum(c1))::bigint as n2, sum(r2 * c1)::double / 2 as r1, sum(c * c * c - c)::double as ties from r group by kmer),
u as (select kmer, n1, n2, r1 - n1 * (n1 + 1) / 2 as u, n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) as var from g where n1 > 0 and n2 > 0),
z as (select *, (u - n1 * n2 / 2) / sqrt(var) as z from u), e as (select *, 1 / (1 + 0.3275911::double * abs(z) / sqrt(2)) as t from z),
p as (select kmer, n1, n2, u, z, t * (0.254829592::double + t * (-0.284496736::double + t * (1.421413741::double + t * (-1.453152027::double + t * 1.061405429::double)))) * exp(-z * z / 2) as p from e)"""


@query("J5_mann_whitney", "sig", sql=f"{RANKSUM} select kmer, n1, n2, u, round(z, 6) as z, round(p, 6) as p from p")
def _(sig):
    t = km.mann_whitney(samples(sig), "kmer", "v100", "sample", "a")
    return t.select("kmer", "n1", "n2", "u", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(
    "H2_top_kmers_by_p", "sig",
    sql=f"{RANKSUM}, {HALF}, ta as (select kmer, count(*) as n_a, sum(v100) / count(*) as ma from a group by kmer), tb as (select kmer, count(*) as n_b, sum(v100) / count(*) as mb from b group by kmer) select kmer, round(p, 6) as p, abs(ma - mb) as delta, n_a, n_b from p join ta using (kmer) join tb using (kmer) order by round(p, 6), kmer limit 30",
)
def _(sig):
    tests = km.mann_whitney(samples(sig), "kmer", "v100", "sample", "a").withColumn("p", F.round("p", 6))
    a, b = (km.kmer_stats(h, "kmer", "v100") for h in halves(sig))
    return km.top_by_p(tests, km.delta_table(a, b), 30)


@query(
    "J6_ks_2samp", "sig",
    sql=f"""{KM}, s as (select kmer, v100, read_id % 2 = 0 as f from k3 where kmer is not null), v as (select kmer, v100, count(*) filter (f) as c1, count(*) filter (not f) as c2 from s group by all),
    r as (select kmer, sum(c1) over (partition by kmer order by v100) as k1, sum(c2) over (partition by kmer order by v100) as k2, (sum(c1) over (partition by kmer))::bigint as n1, (sum(c2) over (partition by kmer))::bigint as n2 from v)
    select kmer, n1, n2, max(abs(k1 * n2 - k2 * n1))::double / (n1 * n2) as d from r where n1 > 0 and n2 > 0 group by kmer, n1, n2""",
)
def _(sig):
    return km.ks_2samp(samples(sig), "kmer", "v100", "sample", "a").drop("p")


HIST = f"""{KM}, {HALF}, ra as (select kmer, quantile_cont(v100, 0.002) as lo, quantile_cont(v100, 0.998) as hi from a group by kmer union all select kmer, quantile_cont(v100, 0.002), quantile_cont(v100, 0.998) from b group by kmer),
rg as (select kmer, min(lo) as lo, max(hi) as hi from ra group by kmer), sp as (select *, (hi - lo) / 10 as width from rg where hi > lo)"""


def _hist_sql(src: str, out: str) -> str:
    return f"""{out}_c as (select kmer, least(floor((v100 - lo) / width), 9)::int as bin, count(*) as n from {src} join sp using (kmer) where v100 >= lo and v100 <= hi group by all),
{out}_g as (select sp.*, i::int as bin, coalesce(n / (sum(n) over (partition by sp.kmer) * width), 0) as d from sp cross join range(0, 10) t(i) left join {out}_c on {out}_c.kmer = sp.kmer and {out}_c.bin = i),
{out}_f as (select *, case when d = 0 and bin in (0, 9) then 1e-7 when d > 0 then d end as f from {out}_g),
{out}_n as (select *, max(case when f is not null then bin end) over (partition by kmer order by bin) as ab, min(case when f is not null then bin end) over (partition by kmer order by bin desc) as bb from {out}_f),
{out}_i as (select x.kmer, x.bin, x.lo, x.width, greatest(coalesce(x.f, a.f + (b.f - a.f) * (x.bin - x.ab) / (x.bb - x.ab)), 1e-7) as v from {out}_n x left join {out}_f a on a.kmer = x.kmer and a.bin = x.ab left join {out}_f b on b.kmer = x.kmer and b.bin = x.bb),
{out} as (select kmer, bin, lo, width, v / sum(v) over (partition by kmer) as p from {out}_i)"""


def _hists(sig):
    a, b = (h.select("kmer", F.col("v100").alias("value")) for h in halves(sig))
    ranges = km.kmer_ranges(a, b)
    return km.kmer_histogram(a, ranges, 10), km.kmer_histogram(b, ranges, 10)


@query("E8_kmer_histogram", "sig", sql=f"{HIST}, {_hist_sql('a', 'h')} select kmer, bin, round(lo, 6) as lo, round(width, 6) as width, round(p, 8) as p from h")
def _(sig):
    return _hists(sig)[0].select("kmer", "bin", F.round("lo", 6).alias("lo"), F.round("width", 6).alias("width"), F.round("p", 8).alias("p"))


@query(
    "E8_strict_histogram", "sig",
    sql=f"{HIST}, {_hist_sql('a', 'h')}, v as (select *, greatest(d, 1e-7) as v from h_g) select kmer, bin, round(lo, 6) as lo, round(width, 6) as width, round(v / sum(v) over (partition by kmer), 8) as p from v",
)
def _(sig):
    a, b = (h.select("kmer", F.col("v100").alias("value")) for h in halves(sig))
    h = km.kmer_histogram(a, km.kmer_ranges(a, b), 10, strict=True)
    return h.select("kmer", "bin", F.round("lo", 6).alias("lo"), F.round("width", 6).alias("width"), F.round("p", 8).alias("p"))


@query(
    "D7_bin_lookup", "sig",
    sql=f"""{HIST}, {_hist_sql('a', 'h')} select k3.read_id, k3.idx, round(coalesce(ln(p), -16.11809565095832), 6) as lp, p is null as out from (select * from k3 where kmer is not null) k3 left join sp using (kmer)
    left join h on h.kmer = k3.kmer and h.bin = floor((v100 - sp.lo) / sp.width)""",
)
def _(sig):
    x = km.bin_lookup(k3(sig).withColumn("value", F.col("v100")), _hists(sig)[0], bins=10)
    return x.select("read_id", "idx", F.round("lp", 6).alias("lp"), "out")


@query(
    "J16_loglik_ratio", "sig",
    sql=f"""{HIST}, {_hist_sql('a', 'h')}, {_hist_sql('b', 'g')}, x as (select k3.read_id, k3.idx, coalesce(ln(g.p), -16.11809565095832) - coalesce(ln(h.p), -16.11809565095832) as d from (select * from k3 where kmer is not null) k3 left join sp using (kmer)
    left join h on h.kmer = k3.kmer and h.bin = floor((v100 - sp.lo) / sp.width) left join g on g.kmer = k3.kmer and g.bin = floor((v100 - sp.lo) / sp.width)),
    s as (select read_id, avg(d) over (partition by read_id order by idx rows between 2 preceding and 1 following) as r from x) select read_id, round(avg(r), 6) as ratio from s group by read_id""",
)
def _(sig):
    ref, cmp = _hists(sig)
    x = km.loglik_ratio(k3(sig).withColumn("value", F.col("v100")), ref, cmp, "read_id", "idx", 4, bins=10)
    return x.groupBy("read_id").agg(F.round(F.avg("ratio"), 6).alias("ratio"))


def _round(i: int) -> str:
    """The table t of round i, from that of the round before."""
    return f"""j{i} as (select k3.*, t{i - 1}.mean as th, left(kmer, 1) != 'T' as u from k3 join t{i - 1} using (kmer)),
    m{i} as (select read_id, avg(v100) filter (u) as ma, avg(th) filter (u) as mb, stddev_pop(v100) filter (u) as sa, stddev_pop(th) filter (u) as sb from j{i} group by read_id),
    t{i} as (select kmer, count(*) as n, avg((v100 - ma) * ((sb + sa) / 2) / sa + mb) as mean from j{i} join m{i} using (read_id) where sa > 0 group by kmer)"""


@query("J10_refine_kmer_table", "sig", sql=f"{KM}, t0 as (from tab), {', '.join(map(_round, range(1, 7)))} select kmer, n, round(mean, 4) as mean from t6")
def _(sig):
    from strandloom.plans.kmer_workflow import refine_kmer_table

    table = refine_kmer_table(k3(sig), "read_id", "kmer", "v100", F.startswith("kmer", F.lit("T")), rounds=6)
    return table.withColumn("mean", F.round("mean", 4))
