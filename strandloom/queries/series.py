"""Queries of ordered series: F1-F13, F19-F25, F27, F28, K8."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import kmers as km
from strandloom.operators import reads as r
from strandloom.operators import series as s

from .registry import query

W = "partition by read_id order by idx"
K, I = "read_id", "idx"


def _frame(lo, hi):
    side = lambda n: "current row" if n == 0 else f"{-n} preceding" if n < 0 else f"{n} following"
    return f"({W} rows between {side(lo)} and {side(hi)})"


@query("F1_running_mean", "sig", sql=f"select read_id, idx, (sum(v100) over {_frame(0, 31)} + sum(v100) over {_frame(-31, 0)}) / 64 as m from sig")
def _(sig):
    return sig.select(K, I, s.running_mean("v100", 32, K, I).alias("m"))


@query("F2_rolling_mean_centered", "sig", sql=f"select read_id, idx, avg(v100) over {_frame(-4, 3)} as m from sig")
def _(sig):
    return sig.select(K, I, s.rolling_mean_centered("v100", 8, K, I).alias("m"))


@query(
    "F3_weighted_smooth", "sig",
    sql=f"""n as (select *, row_number() over (w) - 1 as l, count(*) over (partition by read_id) - row_number() over (w) as r,
      (lag(v100, 2) over (w) + 2 * lag(v100) over (w) + 4 * v100 + 2 * lead(v100) over (w) + lead(v100, 2) over (w)) / 10 as f, avg(v100) over {_frame(-1, 1)} as m1 from sig window w as ({W}))
    select read_id, idx, case when least(l, r) = 0 then v100 when least(l, r) = 1 then m1 else f end::double as m from n""",
)
def _(sig):
    return s.weighted_smooth(sig, "v100", [1, 2, 4, 2, 1], K, I, "m").select(K, I, "m")


@query("F4_runmean", "sig", sql=f"select read_id, idx, case when count(v100) over {_frame(-5, 4)} = 10 then avg(v100) over {_frame(-5, 4)} end as c, case when count(v100) over {_frame(0, 9)} = 10 then avg(v100) over {_frame(0, 9)} end as l, avg(v100) over {_frame(-5, 4)} as e from sig")
def _(sig):
    return sig.select(K, I, s.runmean("v100", 10, K, I).alias("c"), s.runmean("v100", 10, K, I, "left").alias("l"), s.runmean("v100", 10, K, I, complete=False).alias("e"))


@query(
    "F5_rolling_median_detrend", "sig",
    sql=f"d as (select *, v100 - quantile_cont(v100, 0.5) over {_frame(-10, 9)} as d from sig) select read_id, idx, round(d / stddev_pop(d) over (partition by read_id), 5) as z from d",
)
def _(sig):
    return s.rolling_median_detrend(sig, "v100", 20, K, I, "z").select(K, I, F.round("z", 5).alias("z"))


@query(
    "F6_rolling_std_of_mean", "sig",
    sql=f"d as (select *, case when count(v100) over {_frame(-9, 0)} = 10 then stddev_samp(v100) over {_frame(-9, 0)} end as d from sig) select read_id, idx, round(case when count(d) over {_frame(-19, 0)} = 20 then avg(d) over {_frame(-19, 0)} end, 5) as m from d",
)
def _(sig):
    return s.rolling_std_of_mean(sig, "v100", 10, 20, K, I, "m").select(K, I, F.round("m", 5).alias("m"))


@query("F7_diff", "sig", sql=f"select read_id, idx, lead(v100) over ({W}) - v100 as d from sig")
def _(sig):
    return sig.select(K, I, s.diff("v100", K, I).alias("d"))


@query("F8_prefix_sums", "sig", sql=f"select read_id, idx, (sum(v100) over ({W} rows between unbounded preceding and current row))::bigint as s, (sum(v100 * v100) over ({W} rows between unbounded preceding and current row))::bigint as q from sig")
def _(sig):
    a, b = s.prefix_sums("v100", K, I)
    return sig.select(K, I, a.alias("s"), b.alias("q"))


@query(
    "F9_tstat", "sig",
    sql=f"""m as (select *, count(*) over {_frame(-6, -1)} as nl, count(*) over {_frame(0, 5)} as nr, sum(v100) over {_frame(-6, -1)} / 6 as ml, sum(v100) over {_frame(0, 5)} / 6 as mr,
      sum(v100 * v100) over {_frame(-6, -1)} / 6 as ql, sum(v100 * v100) over {_frame(0, 5)} / 6 as qr from sig)
    select read_id, idx, round(case when nl = 6 and nr = 6 then abs(mr - ml) / sqrt((greatest(ql - ml * ml, 1e-100) + greatest(qr - mr * mr, 1e-100)) / 6) else 0 end, 6) as t from m""",
)
def _(sig):
    return s.tstat(sig, "v100", 6, K, I, "t").select(K, I, F.round("t", 6).alias("t"))


@query("F10_active_range", "sig", sql=f"d as (select *, lead(v100) over ({W}) - v100 as d from sig), e as (select read_id, min(case when abs(d) > 3000 then idx end) as a, max(case when abs(d) > 3000 then idx end) as b, max(idx) as n from d group by read_id) select read_id, greatest(a - 10, 0) as first, least(b + 10, n) as last from e where a is not null")
def _(sig):
    return s.active_range(sig.withColumn("d", s.diff("v100", K, I)), "d", 3000, K, I)


def _runs(cond):
    return f"g as (select *, idx - sum(case when {cond} then 1 else 0 end) over ({W}) as g from sig), r as (select read_id, min(idx) as a, max(idx) as b, count(*) as n, min(v100) as low from g where {cond} group by read_id, g.g)"


@query("F11_first_run", "sig", sql=f"{_runs('v100 <= 1200')} select read_id, min(a) as \"start\" from r where n >= 3 group by read_id")
def _(sig):
    return s.first_run(sig, F.col("v100") <= 1200, 3, K, I)


@query("F14_series_islands", "sig", sql=f"{_runs('v100 > 900')} select read_id, a as \"start\", b as \"end\", n as length, low from r")
def _(sig):
    return s.islands(sig, F.col("v100") > 900, K, I, "v100")


@query("F12_downsample", "sig", sql=f"m as (select read_id, idx, avg(v100) over {_frame(-2, 2)} as smooth from sig) select * from m where idx % 5 = 0")
def _(sig):
    return s.downsample(sig, "v100", 5, K, I).select(K, I, "smooth")


@query(
    "F13_longest_band_run", "sig",
    sql=f"""s as (select *, avg(v100) over {_frame(-4, 3)} as s, avg(v100) over {_frame(-2, 1)} as f from sig), ok as (select read_id from s group by read_id having count(*) filter (f > 3000) > 3),
    g as (select *, idx - sum(case when s > 1000 and s < 2600 then 1 else 0 end) over ({W}) as g from s),
    r as (select read_id, min(idx) as a, max(idx) as b, count(*) as n, max(s) as top from g where s > 1000 and s < 2600 group by read_id, g.g),
    t as (select *, sum(n) over (partition by read_id) - coalesce(sum(n) over (partition by read_id order by n desc, a rows between unbounded preceding and 1 preceding), 0) as rest from r where read_id in (from ok)),
    q as (select *, row_number() over (partition by read_id order by n desc, a) as k from t where top > 2300 and rest > 10)
    select read_id, a as "start", b as "end" from q where k = 1""",
)
def _(sig):
    return s.longest_band_run(sig, "v100", K, I, 1000, 2600, 2300, 8, 10, 3000, 4, 3)


@query("F19_kmers", "seqs", sql="select read_id, p::int as p, substr(seq, p::int, 6) as kmer from (select read_id, seq, unnest(range(1, length(seq) - 4)) as p from seqs where length(seq) >= 6)")
def _(seqs):
    return km.kmers(seqs, "seq", 6).select("read_id", "p", "kmer")


@query("F20_chunk", "sig", sql="c as (select read_id, idx, idx // 20 as block, count(*) over (partition by read_id, idx // 20) as n from sig) select read_id, idx, block from c where n >= 15")
def _(sig):
    return s.chunk(sig, 20, 15, K, I).select(K, I, "block")


@query("F21_tumbling_windows", "sig", sql="select read_id, idx // 16 as win, list(v100 order by idx) as values from sig group by all having count(*) = 16")
def _(sig):
    return s.tumbling_windows(sig, "v100", 16, K, I)


@query(
    "F22_halo_windows", "sig",
    sql="""a as (select read_id, list(v100::double order by idx) as v, count(*) as n from sig group by read_id),
    p as (select read_id, [0.0, 0.0, 0.0]::double[] || v || list_transform(range(0, 16), lambda x: 0.0::double) as p, unnest(range(0, ceil(n / 10)::bigint)) as win from a)
    select read_id, win::int as win, p[win * 10 + 1:win * 10 + 16] as v from p""",
)
def _(sig):
    a = sig.groupBy(K).agg(F.transform(F.sort_array(F.collect_list(F.struct(I, "v100"))), lambda x: x.v100).alias("v"))
    return s.halo_windows(a, "v", 16, 3).select(K, "win", "v")


OVERLAP = """n as (select *, max(idx) over (partition by read_id) + 1 as size from sig),
p as (select n.*, phase, floor((idx - phase * 4) / 12)::bigint as win from n, range(0, 3) t(phase)), o as (select * from p where win >= 0 and win < (size - 8) // 12)"""


@query("F23_overlapped_windows", "sig", sql=f"{OVERLAP} select read_id, idx, phase::int as phase, win from o")
def _(sig):
    return s.overlapped_windows(sig, 12, 3, K, I).select(K, I, "phase", "win")


@query(
    "F24_overlap_consensus", "sig",
    sql=f"{OVERLAP}, w as (select read_id, phase, win, sum(v100)::bigint as score from o group by all), e as (select read_id, unnest(range(win * 12 + phase * 4, win * 12 + phase * 4 + 12)) as idx, score from w) select read_id, idx, quantile_cont(score, 0.5) as score from e group by all",
)
def _(sig):
    w = s.overlapped_windows(sig, 12, 3, K, I).groupBy(K, "phase", "win").agg(F.sum("v100").alias("score"))
    return s.overlap_consensus(w, 12, 3, K, "score")


@query("F25_pairwise_neighbours", "sig", sql=f"n as (select read_id, idx, v100, lead(v100) over ({W}) as next_v100, lead(idx) over ({W}) as next_idx from sig) select * from n where next_idx is not null")
def _(sig):
    return s.with_successor(sig, ["v100", "idx"], K, I).select(K, I, "v100", "next_v100", "next_idx")


@query("F27_dedupe_first", "iv", sql="n as (select *, row_number() over (partition by chrom order by s, e, strand, rep) as k from iv) select chrom, s, e, strand, rep from n where k = 1")
def _(iv):
    return r.dedupe_first(iv, "chrom", ["s", "e", "strand", "rep"])


@query("F28_neighbour_triple", "sig", sql=f"n as (select read_id, idx, v100, lag(v100) over ({W}) as prev, lead(v100) over ({W}) as next from sig) select * from n where prev is not null and next is not null")
def _(sig):
    return s.neighbour_triple(sig, "v100", K, I).select(K, I, "v100", "prev", "next")


@query(
    "K8_events_from_peaks", "sig",
    sql=f"""g as (select *, sum(case when v100 > 2500 then 1 else 0 end) over ({W} rows between unbounded preceding and current row) as seg from sig),
    a as (select read_id, seg::bigint as seg, min(idx) as a, count(*) as n, sum(v100)::bigint as s, sum(v100 * v100)::bigint as q from g where seg > 0 group by all)
    select read_id, seg, a / 4000 as "start", n / 4000 as length, s / n as mean, round(sqrt(greatest((n * q - s * s) / (n * n), 0)), 6) as std from a""",
)
def _(sig):
    return s.segment_summary(sig, F.col("v100") > 2500, "v100", K, I, 4000).withColumn("std", F.round("std", 6))
