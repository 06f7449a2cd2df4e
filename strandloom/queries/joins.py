"""Queries of joins: D1-D8, D15-D18."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import columns as c
from strandloom.operators import joins as j
from strandloom.operators import kmers as km

from .registry import query

KM = "k3 as (select read_id, idx, v100, call || lead(call) over w || lead(call, 2) over w as kmer from sig window w as (partition by read_id order by idx)), tab as (select kmer, sum(v100) / count(*) as mean, count(*) as n from k3 where kmer is not null group by kmer)"


def k3(sig):
    return km.series_kmers(sig, "read_id", "idx", "call", 3)


@query("D1_pair_tracks", "sig", sql="select a.read_id, a.idx, a.call, b.v100 from sig a join sig b using (read_id, idx) where b.v100 % 3 != 0")
def _(sig):
    return j.pair_tracks(sig.select("read_id", "idx", "call"), sig.filter("v100 % 3 != 0").select("read_id", "idx", "v100"), ["read_id", "idx"])


@query(
    "D2_attach_sequence", "seqs", "reads",
    sql="""rec as (select case when read_id % 3 = 0 then 'a' || read_id end as key1, case when read_id % 3 = 1 then 'b' || read_id end as key2, seq from seqs)
    select r.read_id, coalesce(x.seq, y.seq) as seq, coalesce(x.seq, y.seq) is not null as seq_found from reads r left join rec x on x.key1 = 'a' || r.read_id left join rec y on y.key2 = 'b' || r.read_id""",
)
def _(seqs, reads):
    rec = seqs.selectExpr("case when read_id % 3 = 0 then concat('a', read_id) end key1", "case when read_id % 3 = 1 then concat('b', read_id) end key2", "seq")
    r = reads.selectExpr("read_id", "concat('a', read_id) k1", "concat('b', read_id) k2")
    return j.attach_sequence(r, rec, "k1", "k2").select("read_id", "seq", "seq_found")


@query("D3_route_reads", "sig", "reads", sql="select read_id, idx, read_id % 7 as shard from sig join reads using (read_id) where read_id % 5 != 0")
def _(sig, reads):
    index = reads.filter("read_id % 5 != 0").selectExpr("read_id", "read_id % 7 shard")
    return j.route_reads(sig.select("read_id", "idx"), index, "read_id")


@query("D4_merge_annotations", "reads", sql="select count(*) as n, count(*) filter (read_id % 3 = 0) as no_template, count(*) filter (read_id % 4 = 0) as no_alignment from reads")
def _(reads):
    t, a = reads.filter("read_id % 3 != 0").select("read_id"), reads.filter("read_id % 4 != 0").select("read_id")
    return j.annotation_gaps(j.merge_annotations(reads, t, a, "read_id"))


@query(
    "D5_join_percent", "reads", "events",
    sql="""p as (select 'x' || user_id as name, min(case when event_id % 4 != 0 then event_id % 100 end) as percent from events group by user_id) select read_id, percent from reads join p on 'x' || read_id = name where percent is not null""",
)
def _(reads, events):
    p = events.selectExpr("concat('read_x', user_id) readname", "case when event_id % 4 != 0 then event_id % 100 end percent")
    r = reads.selectExpr("read_id", "concat('x', read_id) name")
    return j.join_percent(r, p, "name", c.standard_name("readname"), "percent").select("read_id", "percent")


@query("D6_expected_signal", "sig", sql=f"{KM} select read_id, idx, kmer, mean as expected from k3 join tab using (kmer)")
def _(sig):
    k = k3(sig)
    table = km.kmer_stats(k, "kmer", "v100").select("kmer", F.col("mean").alias("expected"))
    return j.expected_signal(k, table, "kmer", "expected").select("read_id", "idx", "kmer", "expected")


@query(
    "D6_expected_pairs", "sig",
    sql=f"""{KM} select a.kmer || right(b.kmer, 1) as kmer, round(b.mean - a.mean, 6) as expected from tab a join tab b on substr(a.kmer, 2) = substr(b.kmer, 1, 2)""",
)
def _(sig):
    table = km.kmer_stats(k3(sig), "kmer", "v100")
    return km.expected_pairs(table, "kmer", "mean").select("kmer", F.round("expected", 6).alias("expected"))


@query("D8_calibrated_threshold", "sig", sql=f"{KM} select read_id, idx, v100 > mean as modified from k3 left join tab using (kmer) where kmer is not null")
def _(sig):
    k = k3(sig)
    table = km.kmer_stats(k, "kmer", "v100")
    return j.calibrated_threshold(k, table, "kmer", "v100", "mean").select("read_id", "idx", "modified")


@query("D15_agree_alignments", "pts", sql="select id, chrom, pos from pts p where exists (select 1 from pts q where q.id = p.id and q.id % 3 != 0 and abs(q.id % 7 * 1000) < 5000)")
def _(pts):
    other = pts.filter("id % 3 != 0").selectExpr("id", "chrom", "pos + id % 7 * 1000 pos")
    return j.agree_alignments(pts.select("id", "chrom", "pos"), other, "id", 5000)


@query(
    "D16_assign_to_segment", "sig",
    sql="seg as (select distinct read_id, idx // 9 as seg, idx // 9 * 9 as a, idx // 9 * 9 + 7 as b from sig) select s.read_id, idx as at, seg from sig s join seg on s.read_id = seg.read_id and a < idx and idx < b",
)
def _(sig):
    seg = sig.selectExpr("read_id", "idx div 9 seg", "idx div 9 * 9 a", "idx div 9 * 9 + 7 b").distinct()
    return j.assign_to_segment(sig.selectExpr("read_id", "idx at"), seg, "read_id")


@query(
    "D16_nearest_centre", "sig",
    sql="""c as (select read_id, idx as at from sig where v100 > 4000), d as (select s.read_id, s.idx as id, s.idx as at, c.at as centre, row_number() over (partition by s.read_id, s.idx order by abs(c.at - s.idx), c.at) as k from sig s left join c on c.read_id = s.read_id)
    select read_id, id, "at", centre::double as centre from d where k = 1""",
)
def _(sig):
    return j.nearest_centre(sig.selectExpr("read_id", "idx id", "idx at"), sig.filter("v100 > 4000").selectExpr("read_id", "idx at"), "read_id")


@query("D17_update_by_key", "reads", sql="select read_id, case when read_id % 4 = 0 then null when read_id % 4 = 1 then start_ * 2 else start_ end as start_ from reads")
def _(reads):
    new = reads.filter("read_id % 4 < 2").selectExpr("read_id", "case when read_id % 4 = 1 then start_ * 2 end start_")
    return j.update_by_key(reads.select("read_id", "start_"), new, "read_id", "start_")


@query("D18_match_signal_reads", "sig", "reads", sql="select read_id, count(*) as n from sig group by read_id")
def _(sig, reads):
    n = sig.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    return j.match_signal_reads(n, reads.selectExpr("read_id", "end_ - start_ + 1 m"), "read_id", "n", "m").select("read_id", "n")
