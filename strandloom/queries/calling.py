"""Queries of calling, segmentation and forks: K1-K7, K9-K14, F26."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strandloom.operators import calling as k
from strandloom.operators import kmers as km
from strandloom.operators import series as s
from strandloom.plans import forks as fk

from .fork_sql import fork_sql
from .joins import KM, k3
from .kmers import HALF, _hist_sql, _hists
from .kmers import HIST as HISTS
from .registry import query
from .series import OVERLAP, _frame

K, I = "read_id", "idx"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: The given signals have some dozens of positions: shorter smoothing, and places 100 bases apart.
SMALL = fk.Settings(min_std=0.1, smoothing=4, min_amplitude=0.2, min_jump=0.3, low_plateau=0.4, min_distance=100, score=0.5, jump_score=0.2)


def _small(sig):
    return sig.withColumns({"x": F.col("read_id") * 100000.0 + F.col("idx") * 100.0, "y": F.least(F.col("v100"), F.lit(10000)) / 10000})


@query(
    "K1_gated_signal", "sig",
    sql="""y as (select *, least(v100, 10000) as v from sig), ok as (select read_id from y group by read_id having stddev_pop(v / 10000) > 0.1),
    m as (select read_id, idx, sum(v) over (partition by read_id order by idx rows between current row and 3 following) + sum(v) over (partition by read_id order by idx rows between 3 preceding and current row) as m from y where read_id in (from ok)),
    e as (select read_id, min(m) as lo, max(m) as hi from m group by read_id having (max(m) - min(m)) / 80000 > 0.2)
    select read_id, idx, round((m - lo) / (hi - lo), 6) as yr from m join e using (read_id)""",
)
def _(sig):
    return fk.gated_signal(_small(sig), K, I, "x", "y", SMALL).select(K, I, F.round("yr", 6).alias("yr"))


# a level at a time: of each open stretch the farthest point, the first of equal ones, which opens two stretches if it is too far away
@query(
    "K1_polyline", "sig",
    sql="""recursive p as (select read_id, idx, idx::double * 100 as x, v100::double / 10000 as y from sig),
    seg as (select read_id, min(idx) as a, max(idx) as b from p group by read_id union all
      select read_id, unnest([a, far]), unnest([far, b]) from (select read_id, a, b, arg_max(idx, {'d': d, 'i': -idx}) as far, max(d) as d from (
        select s.read_id, s.a, s.b, p.idx, abs((q.x - o.x) * (p.y - o.y) - (q.y - o.y) * (p.x - o.x)) / sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)) as d
        from seg s join p o on o.read_id = s.read_id and o.idx = s.a join p q on q.read_id = s.read_id and q.idx = s.b join p on p.read_id = s.read_id and p.idx > s.a and p.idx < s.b) group by all) where d > 0.4)
    select distinct read_id, idx, round(y, 6) as y from p join (select read_id, a as idx from seg union select read_id, b from seg) using (read_id, idx)""",
)
def _(sig):
    at = sig.withColumns({"x": F.col(I) * 100.0, "y": F.col("v100") / 10000})
    return fk.polyline(at, K, I, "x", "y", 0.4).select(K, I, F.round("y", 6).alias("y"))


SPOT = ("mid", "s1", "e1", "s2", "e2")


def _part(kind):
    columns = {"tract": ["start", "end", "dir", "score", "jump_score"]}.get(kind, SPOT)

    def run(sig):
        found = fk.detect_forks(_small(sig), K, I, "x", "y", SMALL).filter(F.col("kind") == kind).select(K, "id", *columns)
        return found.withColumns({c: F.round(c, 6) for c in ("score", "jump_score") if c in columns})

    return run


FORKS = fork_sql("select read_id as r, idx, read_id * 100000::double + idx * 100::double as x, least(v100, 10000) / 10000 as y from sig", SMALL)
#: Tracts of a row's list l as rows; places of initiations and terminations are rows of the lists of these names.
TRACT_SQL = "(t.id - 1)::int as id, t.v.s as start, t.v.e as \"end\", t.v.d as dir, round(t.v.c, 6) as score, round(t.v.j, 6) as jump_score"
SPOT_SQL = "(t.id - 1)::int as id, " + ", ".join(f"t.v.{c} as {c}" for c in SPOT)


def _rows_sql(values: str) -> str:
    return f"(select r, unnest(list_transform({values}, lambda v, i: {{'v': v, 'id': i}})) as t from ends)"


query("K2_detect_tracts", "sig", sql=f"{FORKS} select r as read_id, {TRACT_SQL} from {_rows_sql('l')}")(_part("tract"))
query("K4_detect_inits", "sig", sql=f"{FORKS} select r as read_id, {SPOT_SQL} from {_rows_sql('inits')}")(_part("init"))
query("K5_detect_terms", "sig", sql=f"{FORKS} select r as read_id, {SPOT_SQL} from {_rows_sql('terms')}")(_part("term"))


@query(
    "F26_flatten_spikes", "sig",
    sql="""recursive w as (select read_id, idx, v100 / 10000 as y, lead(v100) over (partition by read_id order by idx) / 10000 as nx from sig),
    f as (select read_id, idx, y from w where idx = 0 union all
      select w.read_id, w.idx, case when abs(w.nx - f.y) < 0.3::double and greatest(abs(w.nx - w.y), abs(f.y - w.y)) > 0.6::double then (f.y + w.nx) / 2 else w.y end from f join w on w.read_id = f.read_id and w.idx = f.idx + 1)
    select read_id, idx, round(y, 6) as y from f""",
)
def _(sig):
    at = sig.withColumns({"x": F.col(I) * 100.0, "y": F.col("v100") / 10000})
    return fk.without_spikes(at, K, I, "x", "y", 250.0).withColumn("y", F.round("y", 6))


@query(
    "K3_resolve_overlaps", "sig",
    sql="""recursive t as (select read_id, list({'s': idx, 'e': idx + v100 % 12 + 1, 'c': v100 % 37 - 18} order by idx) as l from sig where idx % 5 = 0 group by read_id),
    f as (select read_id, l from t union all select read_id, list_concat(l[:out - 1], l[out + 1:])
      from (select *, case when abs(l[p.a].c) > abs(l[p.b].c) then p.b else p.a end as out
      from (select read_id, l, flatten(list_transform(range(1, len(l) + 1), lambda a: list_transform(list_filter(range(1, len(l) + 1), lambda b: b <> a and l[b].s <= l[a].s and l[a].s < l[b].e), lambda b: {'a': a, 'b': b})))[1] as p from f)
      where p is not null)),
    least as (select read_id, unnest(arg_min(l, len(l))) as k from f group by read_id)
    select read_id, k.s as start, k.e as "end", k.c as score from least""",
)
def _(sig):
    tracts = sig.filter("idx % 5 = 0").selectExpr(K, "idx as start", "idx + v100 % 12 + 1 as end", "v100 % 37 - 18 as score")
    return fk.without_overlaps(tracts, K)


# a read's track is a number: twice the read's, one more for ratios
TRACKS = fork_sql(
    """select read_id * 2 as r, idx, case strand when '-' then end_ - idx else start_ + idx end * 100::double as x, (call = 'B')::int::double as y from sig join reads using (read_id) where call in ('T', 'B')
    union all select read_id * 2 + 1, idx, case strand when '-' then end_ - idx else start_ + idx end * 100::double, least(v100, 10000) / 10000 from sig join reads using (read_id) where call in ('T', 'B')""", SMALL)  # fmt: skip
KEY_SQL = "r // 2 as read_id, case r % 2 when 0 then 'letters' else 'ratio' end as track"
NO_TRACT_SQL = ", ".join(f"null::{t} as {c}" for c, t in (("start", "double"), ("\"end\"", "double"), ("dir", "varchar"), ("score", "double"), ("jump_score", "double")))
NO_SPOT_SQL = ", ".join(f"null::double as {c}" for c in SPOT)


@query(
    "K14_detect_forks", "sig", "reads",
    sql=f"""{TRACKS} select {KEY_SQL}, 'tract' as kind, {TRACT_SQL}, {NO_SPOT_SQL} from {_rows_sql('l')}
    union all by name select {KEY_SQL}, 'init' as kind, {SPOT_SQL}, {NO_TRACT_SQL} from {_rows_sql('inits')}
    union all by name select {KEY_SQL}, 'term' as kind, {SPOT_SQL}, {NO_TRACT_SQL} from {_rows_sql('terms')}""",
)
def _(sig, reads):
    """Both tracks, letters and ratios, with places on the genome."""
    from strandloom.functions.columns import genome_pos, indicator

    at = sig.join(reads, K).withColumn("x", genome_pos("strand", "start_", "end_", "idx") * 100.0)
    letters = indicator("call").cast("double")
    ratio = F.when(F.col("call").isin("T", "B"), F.least(F.col("v100"), F.lit(10000)) / 10000)
    at = at.withColumns({"letters": letters, "ratio": ratio})
    found = fk.detect_tracks_of(at, K, I, "x", {name: (name, SMALL) for name in ("letters", "ratio")})
    return found.withColumns({c: F.round(c, 6) for c in ("score", "jump_score")})


def _expected(sig):
    """Steps with their first base and the levels of their k-mers in two sets of reads."""
    x = k3(sig)
    for name, part in (("t", 0), ("b", 1)):
        table = km.kmer_stats(x.filter(F.col(K) % 2 == part), "kmer", "v100").select("kmer", F.col("mean").alias(name))
        x = x.join(table, "kmer")
    return x.withColumn("base", F.substring("kmer", 1, 1))


#: The same as SQL: x.
EXPECTED = f"""{KM}, {HALF}, ta as (select kmer, sum(v100) / count(*) as t from a group by kmer), tb as (select kmer, sum(v100) / count(*) as b from b group by kmer),
    x as (select read_id, idx, v100, left(kmer, 1) as base, t, b from k3 join ta using (kmer) join tb using (kmer))"""


@query(
    "K6_call_tm", "sig",
    sql=f"""{KM}, {HALF}, ta as (select kmer, sum(v100) / count(*) as t from a group by kmer), tb as (select kmer, sum(v100) / count(*) as b from b group by kmer)
    select read_id, idx, case when left(kmer, 1) = 'T' then case when not abs(t - b) > 400 then 'X' when abs(v100 - b) < abs(v100 - t) then 'B' else 'T' end else left(kmer, 1) end as called from k3 join ta using (kmer) join tb using (kmer)""",
)
def _(sig):
    return k.call_tm(_expected(sig), "v100", "t", "b", "base", 400).select(K, I, "called")


@query(
    "K6_call_tm_near", "sig",
    sql=f"""{EXPECTED} select read_id, idx, case when base = 'T' then case when not (abs(t - b) > 50 and least(abs(v100 - t), abs(v100 - b)) < 1500) then 'X' when abs(v100 - b) < abs(v100 - t) then 'B' else 'T' end else base end as called from x""",
)
def _(sig):
    return k.call_tm(_expected(sig), "v100", "t", "b", "base", 50, near=1500).select(K, I, "called")


# numbers of the steps' sides: 10 stands for one that does not count; sums of neighbours say whether they agree
@query(
    "K6_call_tm_both", "sig",
    sql=f"""{EXPECTED}, s as (select *, abs(t - b) > 400 as s, (abs(v100 - b) < abs(v100 - t))::int as b1 from x),
    p as (select *, s or coalesce(lag(s) over w, false) as p from s window w as (partition by read_id order by idx)),
    n as (select *, case when p then b1 else 10 end as n from p), y as (select *, lag(n) over (partition by read_id order by idx) as before from n)
    select read_id, idx, case when base <> 'T' then base when not p or (before is not null and n + before = 1) then 'X' when n + coalesce(before, 0) in (2, 11) then 'B' else 'T' end as called from y""",
)
def _(sig):
    return k.call_tm(_expected(sig), "v100", "t", "b", "base", 400, both=(K, I)).select(K, I, "called")


def _tstat_sql(w: int) -> str:
    n, m, q = (f"{f} over {{}} / {w}" for f in ("count(*)", "sum(v100)", "sum(v100 * v100)"))
    left, right = _frame(-w, -1), _frame(0, w - 1)
    var = lambda win: f"greatest({q.format(win)} - ({m.format(win)}) * ({m.format(win)}), 1e-100)"
    t = f"abs({m.format(right)} - {m.format(left)}) / sqrt(({var(left)} + {var(right)}) / {w})"
    return f"case when {n.format(left)} = 1 and {n.format(right)} = 1 then {t} else 0::double end"


# one row a read and step; the state is each detector's place, value and certainty, and where the short one's silence ends
@query(
    "K7_detect_events", "sig",
    sql=f"""recursive m as (select read_id, idx, {_tstat_sql(4)} as u, {_tstat_sql(6)} as v from sig),
    f as (select distinct read_id, (-1)::bigint as i, null::bigint as aat, 'inf'::double as av, false as asure, null::bigint as bat, 'inf'::double as bv, false as bsure, 0::bigint as quiet, null::bigint as pa, null::bigint as pb from sig union all
      select read_id, i, case when pa is null then aat end, case when pa is null then av else u end, pa is null and asure, case when pb is null then bat end, case when pb is null then bv else v end, pb is null and bsure, quiet, pa, pb
      from (select *, case when rb and bsure and i - bat > 3 then bat end as pb
      from (select * replace (bsure or (rb and bv - v > 0.65::double and bv > 1) as bsure)
      from (select * replace (case when not heard then bat when rb then case when v > bv then i else bat end when v >= bv and v - bv > 0.65::double then i end as bat,
        case when not heard then bv when rb then greatest(bv, v) when v < bv or v - bv > 0.65::double then v else bv end as bv)
      from (select *, heard and bat is not null as rb, case when ra and asure and i - aat > 2 then aat end as pa
      from (select * replace (asure or (ra and av - u > 0.65::double and av > 1.4::double) as asure, case when loud then aat + 4 else quiet end as quiet, case when not loud then bat end as bat, case when loud then 'inf'::double else bv end as bv, bsure and not loud as bsure),
        i > case when loud then aat + 4 else quiet end as heard
      from (select *, ra and av > 1.4::double as loud
      from (select f.* exclude (i, aat, av, pa, pb), m.idx as i, u, v, aat is not null as ra, case when aat is not null then case when u > av then m.idx else aat end when u >= av and u - av > 0.65::double then m.idx end as aat,
        case when aat is not null then greatest(av, u) when u < av or u - av > 0.65::double then u else av end as av
      from f join m on m.read_id = f.read_id and m.idx = f.i + 1)))))))
    ) select read_id, pa as peak from f where pa is not null union all select read_id, pb from f where pb is not null""",
)
def _(sig):
    return k.detect_events(sig, "v100", K, I)


# least costs of all beginnings of a read, each with the begin of its last segment; then the way back from the end
@query(
    "K9_optimal_segments", "sig",
    sql="""recursive x as (select read_id, idx, v100 / 1000 as x from sig),
    f as (select distinct read_id, 0::bigint as n, [0::double] as s, [0::double] as q, [0::double] as c, [0::bigint] as b from sig union all
      select read_id, n, s, q, list_append(c, list_min(o)), list_append(b, greatest(0, n - 10) + list_position(o, list_min(o)) - 1)
      from (select *, list_transform(range(greatest(0, n - 10), n), lambda g: c[g + 1] + 3::double + (q[n + 1] - q[g + 1] - (s[n + 1] - s[g + 1]) * (s[n + 1] - s[g + 1]) / (n - g))) as o
      from (select f.read_id, n + 1 as n, list_append(s, s[n + 1] + x) as s, list_append(q, q[n + 1] + x * x) as q, c, b from f join x on x.read_id = f.read_id and x.idx = n))),
    w as (select read_id, n as till, b[n + 1] as origin, b from f where n = (select count(*) from sig where sig.read_id = f.read_id) union all select read_id, origin, b[origin + 1], b from w where origin > 0)
    select w.read_id, (dense_rank() over (partition by w.read_id order by origin) - 1)::int as seg, origin::int as start, (till - origin)::int as length, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std
    from w join x on x.read_id = w.read_id and idx >= origin and idx < till group by w.read_id, origin, till""",
)
def _(sig):
    found = k.optimal_segments(sig.withColumn("x", F.col("v100") / 1000), "x", K, I, gamma=3.0)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "K10_emit_mod_sites", "sig", "reads",
    sql=f"""{HISTS}, {_hist_sql('a', 'h')}, {_hist_sql('b', 'g')}, x as (select k3.read_id, k3.idx, left(k3.kmer, 1) = 'T' as m, coalesce(ln(h.p), -16.11809565095832) as lr, coalesce(ln(g.p), -16.11809565095832) as lc from (select * from k3 where kmer is not null) k3 left join sp using (kmer)
    left join h on h.kmer = k3.kmer and h.bin = floor((v100 - sp.lo) / sp.width) left join g on g.kmer = k3.kmer and g.bin = floor((v100 - sp.lo) / sp.width)),
    s as (select *, avg(lc - lr) over (partition by read_id order by idx rows between 2 preceding and 1 following) as r from x), ok as (select read_id from s group by read_id having count(*) >= 60 and avg(lr) filter (not m) >= -4)
    select read_id, chrom, strand, case strand when '-' then end_ - (idx + 1) else start_ + idx + 1 end as pos, round(r, 6) as log from s join reads using (read_id) where m and r > 0.3 and read_id in (from ok)""",
)
def _(sig, reads):
    from strandloom.plans.kmer_workflow import emit_mod_sites

    ref, cmp = _hists(sig)
    x = km.loglik_ratio(k3(sig).withColumn("value", F.col("v100")), ref, cmp, K, I, 4, bins=10)
    out = emit_mod_sites(x, reads, K, I, F.startswith("kmer", F.lit("T")), 3, -4.0, 0.3, 60)
    return out.withColumn("log", F.round("log", 6))


@query(
    "K11_score_windows", "sig",
    sql=f"""{OVERLAP}, w as (select read_id, phase, win, avg(v100 / 100) as m, stddev_pop(v100 / 100) as d from o group by all),
    sc as (select read_id, phase, win, 1 / (1 + exp(-(0.05::double * m - 0.01::double * d - 1))) as score from w),
    e as (select read_id, unnest(range(win * 12 + phase * 4, win * 12 + phase * 4 + 12)) as idx, score from sc) select read_id, idx, round(quantile_cont(score, 0.5), 6) as score from e group by read_id, idx""",
)
def _(sig):
    w = s.overlapped_windows(sig, 12, 3, K, I).groupBy(K, "phase", "win").agg(F.transform(F.sort_array(F.collect_list(F.struct(I, "v100"))), lambda x: x.v100 / 100).alias("v"))
    scores = k.score_windows(w, [K, "phase", "win"], "v", k.Logistic((0.05, -0.01, 0.0), -1.0))
    return s.overlap_consensus(scores, 12, 3, K, "score").withColumn("score", F.round("score", 6))


class TwoHeads:
    """A layer of two outputs over the values and the letters of a window, each position with a weight of its own."""

    def predict(self, x):
        place = 1.0 + np.arange(x.shape[1])
        a = (x[..., 0] * place).sum(axis=1) / 2000 - x[..., 1].sum(axis=1) / 8
        b = (x[..., 0] * x[..., 1] / place).sum(axis=1) / 100
        return [1 / (1 + np.exp(-a)), (b / (1 + b))[:, None]]


@query(
    "K11_two_outputs", "sig",
    sql=f"""{OVERLAP}, w as (select read_id, phase, win, sum(v100 / 100 * (idx - win * 12 - phase * 4 + 1)) / 2000 - sum((call in ('T', 'B'))::int) / 8 as a,
      sum(v100 / 100 * (call in ('T', 'B'))::int / (idx - win * 12 - phase * 4 + 1)) / 100 as b from o group by all),
    e as (select read_id, unnest(range(win * 12 + phase * 4, win * 12 + phase * 4 + 12)) as idx, 1 / (1 + exp(-a)) as p, b / (1 + b) as q from w)
    select read_id, idx, round(quantile_cont(p, 0.5), 6) as first, round(quantile_cont(q, 0.5), 6) as second from e group by read_id, idx""",
)
def _(sig):
    channels = F.array(F.col("v100") / 100, F.col("call").isin("T", "B").cast("double")).alias("c")
    w = s.overlapped_windows(sig, 12, 3, K, I).groupBy(K, "phase", "win").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(I), channels))), lambda x: x.c).alias("v"))
    scores = k.score_windows(w, [K, "phase", "win"], "v", TwoHeads(), ("first", "second"))
    return s.overlap_consensus(scores, 12, 3, K, "first", "second").withColumns({c: F.round(c, 6) for c in ("first", "second")})


@query("K12_relabel_reads", "seqs", sql="m as (select read_id, seq, read_id % 97 / 96 as p from seqs) select read_id, case when p >= 0.5 then replace(seq, 'TA', 'BA') else seq end as labelled from m where p between 0.1 and 0.9")
def _(seqs):
    return k.relabel_reads(seqs.withColumn("p", F.col(K) % 97 / 96), "seq", "p", 0.5, "B", (0.1, 0.9), "TA").select(K, "labelled")


@query("K12_relabel_positions", "sig", sql=f"{KM} select read_id, idx, case when left(kmer, 1) = 'T' and v100 > mean then 'B' else left(kmer, 1) end as labelled from k3 left join tab using (kmer) where kmer is not null")
def _(sig):
    x = k3(sig)
    table = km.kmer_stats(x, "kmer", "v100").select("kmer", "mean")
    x = x.join(table, "kmer", "left").withColumn("base", F.substring("kmer", 1, 1))
    return k.relabel_positions(x, "base", "v100", F.col("mean"), "B").select(K, I, "labelled")


@query(
    "K13_template_offset", "sig",
    sql="""t as (select read_id, idx - 17 as i, v100 + 1 as t from sig where idx between 17 and 26), n as (select read_id, count(*) as n from t group by read_id),
    o as (select t.read_id, s.idx - i as off, sum((t - v100) * (t - v100))::double / count(*) as gap, count(*) as c from t join sig s on s.read_id = t.read_id and s.idx >= i and s.idx - i <= 60 group by all)
    select read_id, arg_min(off, (gap, off)) as "offset", min(gap) as gap from o join n using (read_id) where c = n group by read_id having min(gap) <= 100""",
)
def _(sig):
    t = sig.filter("idx between 17 and 26").selectExpr(K, "idx - 17 idx", "v100 + 1 v100")
    return k.template_offset(t, sig, K, I, "v100", 60, 100)
