"""Queries of grouped summaries: E1-E4, E6, E7, E9-E13, E17, E18, E22-E24, K13."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import columns as c
from strandloom.operators import aggregates as a
from strandloom.operators import reads as r

from .joins import KM, k3
from .registry import query

N = "count(*)"


@query("E1_read_percent", "sig", sql="select read_id, count(*) filter (v100 % 7 != 0) as n, avg(case when v100 % 7 != 0 then v100 end) as mean from sig group by read_id")
def _(sig):
    return a.read_percent(sig.withColumn("p", F.when(F.col("v100") % 7 != 0, F.col("v100"))), "read_id", "p")


LETTERS = ", ".join(f"sum(length(seq) - length(replace(seq, '{b}', '')))::bigint as n_{b.lower()}" for b in "TAN")


@query("E2_base_counts", "seqs", sql=f"n as (select {LETTERS} from seqs) select *, (n_a + n_n) / n_t as mod_ratio from n")
def _(seqs):
    return a.base_counts(seqs, "seq", "TAN")


@query("E2_read_mod_share", "sig", sql="n as (select read_id, count(*) filter (call = 'B') as n_mod, count(*) filter (call = 'T') as n_base from sig group by read_id) select *, n_mod / nullif(n_mod + n_base, 0) as share from n")
def _(sig):
    return a.read_mod_share(sig, "read_id", "call")


REFLEN = "(regexp_extract(cigar, '([0-9]+)S', 1)::bigint + regexp_extract(cigar, '([0-9]+)M', 1)::bigint + regexp_extract(cigar, '([0-9]+)D', 1)::bigint - regexp_extract(cigar, '([0-9]+)I', 1)::bigint) * 100"


@query("E3_alignment_summary", "aln", sql=f"l as (select *, {REFLEN} as length from aln) select count(*) filter (flag in (0, 16, 2048, 2064)) as aligned, count(*) filter (flag = 4) as unaligned, count(*) filter (flag != 4 and length > 6000) as long, count(*) filter (flag != 4 and length < 200) as short from l")
def _(aln):
    return a.alignment_summary(aln.withColumn("length", c.cigar_ref_len("cigar") * 100))


@query("E3_alignment_types", "aln", sql="select case when flag in (0, 16) then 'primary' when flag = 4 then 'none' else 'supplementary' end as kind, case when flag in (0, 2048) then '+' when flag = 16 then '-' else '*' end as strand, count(*) as n from aln group by all")
def _(aln):
    return a.alignment_types(aln)


@query("E4_tract_count_histogram", "reads", "sig", sql="t as (select read_id, count(*) filter (v100 > 9000) as n from sig group by read_id) select n, count(*) as reads from t group by n")
def _(reads, sig):
    return a.tract_count_histogram(reads, sig.filter("v100 > 9000"), "read_id")


@query("E6_kmer_percentile", "sig", sql=f"{KM} select kmer, round(quantile_cont(v100, 0.9), 6) as percentile, count(*) as nsample from k3 where kmer is not null group by kmer")
def _(sig):
    return a.kmer_percentile(k3(sig), "kmer", "v100", 0.1).withColumn("percentile", F.round("percentile", 6))


@query("E7_histogram", "sig", sql="n as (select case when v100 = 5000 then 19 else v100 // 250 end::int as bin, count(*) as n from sig where v100 between 0 and 5000 group by all) select bin, n, n / (sum(n) over () * 250) as density from n")
def _(sig):
    return a.histogram(sig, "v100", 0, 5000, 20)


@query("E9_error_tally", "sig", sql="select case when v100 % 11 = 0 then 'no signal' when v100 % 13 = 0 then 'no reference' else 'processed' end as error, count(*) as n from sig group by all")
def _(sig):
    return a.error_tally(sig.withColumn("e", F.when(F.col("v100") % 11 == 0, "no signal").when(F.col("v100") % 13 == 0, "no reference")), "e")


@query("E10_threshold_reassign", "sig", sql="u as (select count(*) filter (v100 < 1500) / count(*) as u from sig) select read_id, idx, case when v100 > 1500 then least(0.2::double / (1 - u), 1) else 0 end as reassigned from sig, u")
def _(sig):
    return a.threshold_reassign(sig, "v100", 1500, 0.2).select("read_id", "idx", "reassigned")


@query(
    "E11_split_mixture", "sig",
    sql="""x as (select read_id, idx, case when v100 % 3 = 0 then v100 % 100 / 1000 + 0.3::double else v100 % 100 / 1000 + 0.7::double end as p, v100 % 10 / 60 as err from sig), g as (select * from x where err < 0.1::double),
    b as (select least(floor(p * 101), 100)::int as bin, count(*) as n from g group by all), e as (select i::int as bin, coalesce(n, 0) as n from range(0, 101) t(i) left join b on i = bin),
    k as (select arg_max(bin, n * 1000 - bin) as p, max(n) as top from e), l as (select max(bin) as low from e, k where bin < p and n < top / 4), t as (select case when low > 10.1 then low / 101 / 2 end as t from l),
    s as (select t, count(*) filter (p > t) / count(*) as share from g, t group by t)
    select read_id, idx, case when share >= 0.05::double and t is not null then case when p > t then least(0.4::double / share, 100) else 0 end end as assigned from x, s""",
)
def _(sig):
    v = F.col("v100") % 100 / 1000
    x = sig.withColumns({"p": F.when(F.col("v100") % 3 == 0, v + 0.3).otherwise(v + 0.7), "err": F.col("v100") % 10 / 60})
    return a.split_mixture(x, "p", "err", 0.4).select("read_id", "idx", "assigned")


@query("E12_content_ratio", "sig", sql="n as (select count(*) filter (call = 'B') as m, count(*) filter (call = 'T') as c from sig group by read_id) select least(floor(m / (m + c + 1) * 20), 19)::int as bin, count(*) as n from n group by all")
def _(sig):
    return a.content_ratio(sig, "read_id", "call", "B", "T")


@query("E13_sweep_summary", "sig", sql="select idx % 5 as param, count(*) as n, avg(v100) as v100, avg(idx) as idx from sig group by all")
def _(sig):
    return a.sweep_summary(sig.withColumn("param", F.col("idx") % 5), "param", ["v100", "idx"])


@query("E17_describe5", "feat", sql="select chrom, min(e - s) as min, quantile_cont(e - s, 0.25)::double as q1, quantile_cont(e - s, 0.5)::double as median, avg(e - s) as mean, quantile_cont(e - s, 0.75)::double as q3, max(e - s) as max from feat group by chrom")
def _(feat):
    return a.describe5(feat.withColumn("w", F.col("e") - F.col("s")), "w", ["chrom"])


@query("E17_value_table", "feat", sql="select e - s as w, count(*) as n from feat group by all")
def _(feat):
    return a.value_table(feat.withColumn("w", F.col("e") - F.col("s")), "w")


@query("E18_residual_std", "sig", sql="select read_id, round(sqrt((count(*) * sum((v100 - idx) * (v100 - idx)) - sum(v100 - idx) * sum(v100 - idx))::double) / count(*), 6) as std from sig group by read_id")
def _(sig):
    return a.residual_std(sig, "v100", "idx", ["read_id"]).withColumn("std", F.round("std", 6))


@query("E22_position_frequency_matrix", "seqs", sql="n as (select ((p - 1) % 30 + 1)::int as position, substr(seq, p::int, 1) as base, count(*) as n from (select seq, unnest(range(1, length(seq) // 30 * 30 + 1)) as p from seqs) group by all) select *, n / sum(n) over (partition by position) as share from n")
def _(seqs):
    pieces = F.regexp_extract_all("seq", F.lit("[A-Z]{30}"), F.lit(0))
    return a.position_frequency_matrix(seqs.select(F.explode(pieces).alias("seq")), "seq")


@query("E23_label_mean", "sig", sql="select call as sample, avg(v100) as target, sum(idx)::bigint as length from sig group by call")
def _(sig):
    return a.label_mean(sig.withColumnRenamed("call", "sample"), "sample", "v100", "idx")


@query("E24_window_mod_fraction", "sig", sql="select read_id, idx // 20 as win, avg(case when call = 'T' and v100 % 7 != 0 then (v100 > 2000)::int end) as b, avg(case when call = 'T' then (idx % 9 > 2)::int end) as e from sig group by all")
def _(sig):
    x = sig.withColumns({"pb": F.when(F.col("v100") % 7 != 0, F.col("v100") / 4000), "pe": F.when(F.col("idx") % 9 > 2, 0.9).otherwise(0.1)})
    return a.window_mod_fraction(x, "read_id", "idx", "call", {"b": "pb", "e": "pe"}, 20)


@query("H10_best_alignment", "aln", sql="l as (select aid, flag, cigar, md, length(cigar) as n from aln where flag in (0, 16)), q as (select *, row_number() over (partition by aid order by n desc, flag desc, cigar desc, md desc) as k from l) select aid, flag, cigar, md, n from q where k = 1")
def _(aln):
    return r.best_alignment(aln.withColumn("n", F.length("cigar").cast("long")), "aid", "flag", "n")
