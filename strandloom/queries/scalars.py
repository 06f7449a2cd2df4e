"""Queries of projections, filters and column functions: B1-B45 without B24 and B43, and A3, A8, A18, A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import columns as c
from strandloom.operators import reads as r

from .registry import query


@query("B1_filter_min_length", "seqs", sql="select read_id, length(seq) as n from seqs where length(seq) >= 250")
def _(seqs):
    return r.filter_min_length(seqs, "seq", 250).select("read_id", F.length("seq").cast("long").alias("n"))


NEST = "a as (select read_id, list(v100 order by idx) as mean from sig group by read_id)"


def _nested(sig):
    return sig.groupBy("read_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v100"))), lambda x: x.v100).alias("mean"))


@query("B2_filter_min_events", "sig", sql=f"{NEST} select read_id, len(mean)::bigint as n from a where len(mean) >= 66")
def _(sig):
    return r.filter_min_events(_nested(sig), "mean", 66).select("read_id", F.size("mean").cast("long").alias("n"))


@query("B2_dropped", "sig", sql=f"{NEST} select count(*) filter (len(mean) < 66) as dropped, count(*) as n from a")
def _(sig):
    return r.count_dropped(_nested(sig), "mean", 66)


@query("B3_tb_indicator", "sig", sql="select read_id, idx, case call when 'T' then 0 else 1 end as ind from sig where call in ('T', 'B')")
def _(sig):
    return r.tb_indicator(sig, "call").select("read_id", "idx", "ind")


@query("B4_t_sites", "sig", sql="select read_id, idx from sig where call in ('T', 'B', 'X')")
def _(sig):
    return r.t_sites(sig, "call").select("read_id", "idx")


@query("B5_genome_pos", "sig", "reads", sql="select s.read_id, idx, case strand when '-' then end_ - idx else start_ + idx end as pos from sig s join reads using (read_id)")
def _(sig, reads):
    return sig.join(reads, "read_id").select("read_id", "idx", c.genome_pos("strand", "start_", "end_", "idx").alias("pos"))


ROMAN = ", ".join(f"'{x}'" for x in c.ROMAN)


@query("B6_roman_chrom", "feat", sql=f"select fid, 'chr' || ([{ROMAN}])[substr(chrom, 4)::int] as chrom from feat")
def _(feat):
    return feat.select("fid", c.roman_chrom("chrom").alias("chrom"))


@query("B7_dir_to_strand", "pts", sql="select id, case when id % 3 = 0 then '+' when id % 3 = 1 then '-' end as strand from pts")
def _(pts):
    d = F.when(F.col("id") % 3 == 0, "L").when(F.col("id") % 3 == 1, "R").otherwise("?")
    return pts.select("id", c.direction_strand(d).alias("strand"))


@query("B8_replicate_label", "feat", sql="select fid, regexp_replace(split_part('BC' || fid || '_' || status, '_', 1), '[0-9]', '', 'g') as rep from feat")
def _(feat):
    return feat.select("fid", c.replicate_label(F.concat(F.lit("BC"), F.col("fid").cast("string"), F.lit("_"), "status")).alias("rep"))


@query("B9_standardize_name", "pts", sql="select id, case id % 2 when 0 then 'x' || id else 'y' || id end as name from pts")
def _(pts):
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("read_x"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("/y"), F.col("id").cast("string")))
    return pts.select("id", c.standard_name(name).alias("name"))


@query("B10_revcomp", "seqs", sql="select read_id, reverse(translate(seq, 'ACGTN', 'TGCA')) as rc from seqs")
def _(seqs):
    return seqs.select("read_id", c.revcomp("seq").alias("rc"))


@query(
    "B11_ref_slice", "seqs", "pts",
    sql="""p as (select id, id % 200 as read_id, 1 + pos % 50 as bp, case id % 3 when 0 then 0 when 1 then 16 else 2064 end as flag from pts), s as (select id, flag, upper(substr(seq, bp, 20)) as part from p join seqs using (read_id))
    select id, case when flag in (16, 2064) then reverse(translate(part, 'ACGTN', 'TGCA')) else part end as part from s""",
)
def _(seqs, pts):
    p = pts.selectExpr("id", "id % 200 as read_id", "cast(1 + pos % 50 as int) at", "case id % 3 when 0 then 0 when 1 then 16 else 2064 end flag")
    return p.join(seqs, "read_id").select("id", c.ref_slice("seq", "at", F.lit(20), "flag").alias("part"))


CIG = "regexp_extract(cigar, '([0-9]+){}', 1)::bigint"


@query("B12_cigar_ref_len", "aln", sql=f"select aid, {CIG.format('S')} + {CIG.format('M')} + {CIG.format('D')} - {CIG.format('I')} as n from aln")
def _(aln):
    return aln.select("aid", c.cigar_ref_len("cigar").alias("n"))


@query("B13_cigar_stats", "aln", sql=f"select aid, {CIG.format('I')} as n_ins, {CIG.format('D')} as n_del, {CIG.format('S')} as n_trim from aln")
def _(aln):
    return aln.select("aid", *[v.alias(k) for k, v in c.cigar_stats("cigar").items()])


MD = "select aid, len(regexp_extract_all(regexp_replace(md, '\\^[A-Z]+', '', 'g'), '[A-Z]'))::int as mismatches, {} from aln".format(
    ", ".join(f"len(regexp_extract_all(regexp_replace(md, '\\^[A-Z]+', '', 'g'), '{b}'))::int as mis_{b.lower()}" for b in "ACGT")
)


@query("B14_md_mismatches", "aln", sql=MD)
def _(aln):
    return aln.select("aid", *[v.alias(k) for k, v in c.md_mismatches("md").items()])


@query("B15_edit_tags", "aln", sql="select aid, flag::varchar as nm, md as md_value from aln")
def _(aln):
    tagged = aln.select("aid", F.concat(F.lit("NM:i:"), F.col("flag").cast("string")).alias("t1"), F.concat(F.lit("MD:Z:"), "md").alias("t2"))
    return tagged.select("aid", c.edit_tag("t1").alias("nm"), c.edit_tag("t2").alias("md_value"))


@query("B16_dac_to_current", "sig", sql="select read_id, idx, (v100 + 10) * 1200.0::double / 8192 as pa, ((v100 + 10) * 1200.0::double / 8192 - 3) / 16 as z from sig")
def _(sig):
    lit = F.lit
    return sig.select("read_id", "idx", c.dac_to_current("v100", lit(10), lit(1200.0), lit(8192)).alias("pa"), c.dac_to_current("v100", lit(10), lit(1200.0), lit(8192), lit(3), lit(16)).alias("z"))


@query("B17_clip_signal", "sig", sql="select read_id, idx, case when v100 < 200 or v100 > 3000 then 0 else v100 end as zeroed, least(greatest(v100, 200), 3000) as bounded from sig")
def _(sig):
    return sig.select("read_id", "idx", c.clip_signal("v100", 200, 3000).alias("zeroed"), c.clip_signal("v100", 200, 3000, True).alias("bounded"))


@query("B18_const_scale", "sig", sql="select read_id, idx, (v100 - 100) / 15 as a, (v100 - 100) / 50 as b, v100 / 100 - 0.66::double as c from sig")
def _(sig):
    return sig.select("read_id", "idx", *[c.const_scale("v100", k).alias(k) for k in "abc"])


@query("B19_logistic_calibrate", "sig", sql="select read_id, idx, round(1 / (1 + exp(-30 * (v100 / 10000 - 0.16::double))), 6) as p from sig")
def _(sig):
    return sig.select("read_id", "idx", F.round(c.logistic_calibrate(F.col("v100") / 10000), 6).alias("p"))


@query("B20_fill_base_nulls", "sig", sql="select read_id, idx, case when v100 % 7 = 0 then case when call = 'T' then 0 end else v100 end as v from sig")
def _(sig):
    return sig.select("read_id", "idx", c.fill_base_nulls(F.when(F.col("v100") % 7 != 0, F.col("v100")), "call", "T").alias("v"))


@query("B21_collapse_mods", "sig", sql="select read_id, idx, case when call = 'B' then 'T' else call end as base from sig")
def _(sig):
    return sig.select("read_id", "idx", c.collapse_mods("call").alias("base"))


@query("B22_filter_chrom", "iv", sql="select chrom, count(*) as n from iv where chrom in ('chr1', 'chr11') group by chrom")
def _(iv):
    return r.filter_values(iv, "chrom", ["chr1", "chr11"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("B22_filter_ids", "pts", "feat", sql="select id, chrom from pts where id in (select fid from feat)")
def _(pts, feat):
    return r.filter_ids(pts, "id", feat, "fid").select("id", "chrom")


@query("B22_filter_contains", "feat", "region", sql="select fid, status from feat where exists (select 1 from region where contains(status, substr(r_name, 1, 1)))")
def _(feat, region):
    return r.filter_contains(feat, "status", region.select(F.substring("r_name", 1, 1).alias("part")), "part").select("fid", "status")


@query("B23_fraction_slice", "reads", sql="f as (select *, (row_number() over (order by 'r' || read_id) - 1) / count(*) over () as f from reads) select read_id from f where f > 0.2 and f < 0.7")
def _(reads):
    return r.fraction_slice(reads.withColumn("name", F.concat(F.lit("r"), F.col("read_id").cast("string"))), "name", 0.2, 0.7).select("read_id")


@query("B25_status_fill", "feat", sql="select fid, case when fid % 3 = 0 then status else 'n' || fid end as name from feat")
def _(feat):
    name = F.when(F.col("fid") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("fid").cast("string")))
    return feat.select("fid", c.status_fill(name, "status").alias("name"))


@query("B25_status_subset", "feat", sql="select status, count(*) as n from feat where status in ('ECONOMY', 'STANDARD', 'PROMO') or status like 'S%' group by status")
def _(feat):
    return feat.filter(F.col("status").isin("ECONOMY", "STANDARD", "PROMO") | F.startswith("status", F.lit("S"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("B26_bucketize", "sig", sql="select read_id, idx, case when v100 % 20 <= 1 then 'spo' when v100 % 20 <= 4 then '2-4' when v100 % 20 <= 12 then '5-12' else '13+' end as k4, case when v100 % 20 <= 1 then 'spo' else 'clustered' end as k2 from sig")
def _(sig):
    n = F.col("v100") % 20
    return sig.select("read_id", "idx", c.size_class(n).alias("k4"), c.two_classes(n).alias("k2"))


@query("B27_minmax_invert", "sig", sql="m as (select min(v100) as lo, max(v100) as hi from sig) select read_id, idx, 1 - (v100 - lo) / (hi - lo) as score from sig, m")
def _(sig):
    return r.minmax_invert(sig, "v100", "score").select("read_id", "idx", "score")


@query("B28_first_available", "sig", sql="select read_id, idx, v100 as value from sig")
def _(sig):
    return sig.select("read_id", "idx", F.col(c.first_available(sig, ["percent_B", "v100", "idx"])).alias("value"))


@query("B29_set_constants", "reads", sql="select read_id, chrom, 0.5::double as percent_B, 'B' as mod from reads")
def _(reads):
    return c.set_constants(reads.select("read_id", "chrom"), {"chrom": "x", "percent_B": "0.5", "mod": "B"})


KMER5 = "k as (select read_id, p, substr(seq, p::int, 5) as kmer from (select read_id, seq, unnest(range(1, length(seq) - 3)) as p from seqs where length(seq) >= 5))"


@query("B30_motif_mask", "seqs", sql=f"{KMER5} select kmer, substr(kmer, 3, 1) = 'T' as middle, contains(substr(kmer, 2, 2), 'T') as either, contains(substr(kmer, 2, 3), 'T') as inside, count(*) as n from k group by all")
def _(seqs):
    from strandloom.operators.kmers import kmers

    k = kmers(seqs, "seq", 5)
    return k.groupBy("kmer", c.motif_mask("kmer", "middle", "T", 5).alias("middle"), c.motif_mask("kmer", "either", "T", 4).alias("either"), c.motif_mask("kmer", "inside", "T", 5).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query("B31_motif_positions", "seqs", sql="""q as (select read_id, unnest(list_transform(range(1, len(string_split(seq, 'TA'))), lambda i: list_sum(list_transform(list_slice(string_split(seq, 'TA'), 1, i), lambda x: length(x) + 2)) - 2)) as pos from seqs)
    select read_id, pos::int as pos from q""")  # fmt: skip
def _(seqs):
    # outer: else Spark makes all positions once more to see whether there is one
    return seqs.select("read_id", F.explode_outer(c.motif_positions("seq", "TA")).alias("pos")).filter("pos is not null")


@query("B32_kmer_index", "seqs", sql=f"{KMER5} select distinct kmer, list_sum(list_transform(range(1, 6), lambda i: (strpos('ATCG', substr(kmer, i::int, 1)) - 1) * 4 ** (5 - i)))::bigint as idx from k where not contains(kmer, 'N')")
def _(seqs):
    from strandloom.operators.kmers import kmers

    return kmers(seqs, "seq", 5).select("kmer").distinct().filter(~F.contains("kmer", F.lit("N"))).select("kmer", c.kmer_index("kmer").alias("idx"))


@query("B33_encode_channels", "sig", sql="select read_id, idx, [v100::double, (call = 'A')::int, (call = 'T')::int, (call = 'C')::int, 0.0] as plain, [v100 / 3, (call = 'A')::int, (call in ('T', 'B'))::int, (call = 'C')::int, 0.0] as collapsed from sig")
def _(sig):
    return sig.select("read_id", "idx", c.encode_channels("v100", "call").alias("plain"), c.encode_channels("v100", "call", 3.0, True).alias("collapsed"))


PROBS = "p as (select read_id, idx, [v100 % 11, v100 % 7, v100 % 5, v100 % 13, v100 % 9] as p from sig)"


def _probs(sig):
    return sig.select("read_id", "idx", F.array(*[F.col("v100") % k for k in (11, 7, 5, 13, 9)]).alias("p"))


@query(
    "B34_call_argmax", "sig",
    sql=f"""{PROBS}, b as (select *, 'ACGTB'[list_position(p, list_max(p))] as best from p)
    select read_id, idx, case when best in ('T', 'B') then case when p[5] / (p[4] + p[5]) >= 0.5 then 'B' else 'T' end else best end as call from b""",
)
def _(sig):
    return _probs(sig).select("read_id", "idx", c.call_argmax("p").alias("call"))


@query(
    "B35_call_multi_mod", "sig",
    sql="""m as (select *, v100 % 11 / 10 as pb, v100 % 7 / 6 as pe from sig)
    select read_id, idx, case when call = 'T' and greatest(pb, pe) >= 0.5 then case when pb >= pe then 'B' else 'E' end else call end as call from m""",
)
def _(sig):
    mods = {"B": F.col("v100") % 11 / 10, "E": F.col("v100") % 7 / 6}
    return sig.select("read_id", "idx", c.call_multi_mod("call", "T", mods).alias("call"))


@query("B36_drop_invalid", "sig", sql="select read_id, idx, v100::double / (v100 % 3) as x from sig where v100 % 3 != 0 and v100 % 5 != 0")
def _(sig):
    x = F.when(F.col("v100") % 3 != 0, F.col("v100").cast("double") / (F.col("v100") % 3)).when(F.col("v100") % 2 == 0, F.lit(float("nan")))
    df = sig.select("read_id", "idx", x.alias("x"), F.when(F.col("v100") % 5 != 0, 1).alias("w"))
    return r.drop_invalid(df, ["x", "w"]).select("read_id", "idx", "x")


@query("B37_trim_border", "sig", sql=f"{NEST} select read_id, mean[11:len(mean) - 10] as mean from a where len(mean) > 20")
def _(sig):
    return r.trim_border(_nested(sig), "mean", 10).select("read_id", "mean")


@query("B38_check_canonical", "seqs", sql="select read_id, regexp_matches(seq, '[^ACGTacgt]') as odd from seqs")
def _(seqs):
    return seqs.select("read_id", c.has_noncanonical("seq").alias("odd"))


@query("B39_decode_alphabet", "sig", sql=f"{NEST} select read_id, array_to_string(list_transform(mean, lambda x: 'ACGTB'[(x % 5)::int + 1]), '') as seq from a")
def _(sig):
    codes = F.transform("mean", lambda x: (x % 5).cast("int"))
    return _nested(sig).select("read_id", c.decode_alphabet(codes, "ACGTB").alias("seq"))


@query("B40_sample_weight", "sig", sql="select read_id, idx, case when v100 / 100000 <= 0.045::double then 1.0 else 0.1 end::double as w from sig")
def _(sig):
    return sig.select("read_id", "idx", c.sample_weight(F.col("v100") / 100000).alias("w"))


@query("B41_mod_encode_labels", "sig", sql="select read_id, idx, case when call = 'T' then case read_id % 2 when 0 then 'B' else 'E' end else call end as five, case when call in ('A', 'C') then call else 'T' end as four from sig")
def _(sig):
    letter = F.when(F.col("read_id") % 2 == 0, "B").otherwise("E")
    return sig.select("read_id", "idx", c.mod_encode("call", letter).alias("five"), c.mod_encode("call", letter, 4).alias("four"))


@query("B42_mixture_target", "sig", sql="select read_id, idx, case when v100 % 10 = 0 then [0.5, 0.5, 0.0, 0.0] else [0.2, 0.8, 0.0, least(v100 % 10 / 10 / 0.8::double, 1.0)] end::double[] as y from sig")
def _(sig):
    return sig.select("read_id", "idx", c.mixture_target(F.col("v100") % 10 / 10).alias("y"))


@query("B44_filter_quality", "sig", sql=f"{NEST} select read_id from a where read_id % 60 > 10 and len(mean) >= 60")
def _(sig):
    return r.filter_quality(_nested(sig).withColumn("q", F.col("read_id") % 60), "q", 10, F.size("mean"), 60).select("read_id")


@query(
    "B45_filter_length_agreement", "seqs",
    sql="l as (select read_id, length(seq) as n, length(seq) - read_id % 80 as ref, length(seq) - length(replace(seq, 'T', '')) as t, length(seq) - length(replace(seq, 'N', '')) as b from seqs) select read_id, b + t > 0 and b / nullif(b + t, 0) < 0.1 as low_share from l where n > 0 and abs(ref - n) <= 50 and abs(ref - n) / n <= 0.15",
)
def _(seqs):
    df = seqs.withColumns({"n": F.length("seq"), "ref": F.length("seq") - F.col("read_id") % 80})
    share = F.try_divide(F.regexp_count("seq", F.lit("N")), F.regexp_count("seq", F.lit("[NT]")))
    return r.filter_length_agreement(df, "n", "ref", 50, 0.15, share, 0.1).select("read_id", "low_share")


@query("A3_parse_header", "reads", sql="select 'r' || read_id as read, chrom, strand, start_ as \"start\", end_ as \"end\" from reads")
def _(reads):
    line = F.format_string(">/a/b/r%d {'mapped_chrom': '%s', 'mapped_strand': '%s', 'mapped_start': %d, 'mapped_end': %d}", "read_id", "chrom", "strand", "start_", "end_")
    return reads.select(line.alias("h")).select(*[v.alias(k) for k, v in c.parse_header("h").items()])


@query(
    "A8_write_forks", "pts",
    sql="""select chrom, pos as "start", pos + 900 as "end", case id % 3 when 0 then 'L' else 'R' end as direction, 'f.fa' as file, 'r' || id as read, '+' as strand, printf('%.2f', (id % 40) / 4) as "JumpScore", printf('%.2f', (id % 24) / 4) as "AsymScore"
    from pts where id % 3 != 2 and (id % 40) / 4 >= 1 and (id % 24) / 4 >= 2""",
)
def _(pts):
    from strandloom.sources.bed import fork_rows

    tracts = pts.selectExpr("chrom", "pos start", "pos + 900 end", "case id % 3 when 0 then 'L' when 1 then 'R' else '?' end dir", "'f.fa' file", "concat('r', id) read", "'+' strand", "id % 40 / 4 jump_score", "id % 24 / 4 score")
    return fork_rows(tracts, 1, 2)


@query("A8_write_events", "pts", sql="select chrom, pos as mid, pos - 500 as s1, pos - 100 as e1, pos + 100 as s2, pos + 500 as e2, 'f.fa' as file, 'r' || id as read, '-' as strand from pts")
def _(pts):
    from strandloom.sources.bed import event_rows

    return event_rows(pts.selectExpr("chrom", "pos + 0.4 mid", "pos - 500 s1", "pos - 100 e1", "pos + 100 s2", "pos + 500 e2", "'f.fa' file", "concat('r', id) read", "'-' strand"))


@query("A18_write_mod_sites", "sig", "reads", sql="select s.read_id as id, chrom as mapped_chrom, strand as mapped_strand, case strand when '-' then end_ - idx else start_ + idx end as pos, v100 / 100 as log from sig s join reads using (read_id) where call = 'T' and v100 > 2500")
def _(sig, reads):
    from strandloom.sources.reads import mod_site_rows

    sites = sig.filter("call = 'T' and v100 > 2500").join(reads, "read_id").withColumn("pos", c.genome_pos("strand", "start_", "end_", "idx"))
    return mod_site_rows(sites.withColumn("log", F.col("v100") / 100))


@query(
    "A19_alignment_stats", "aln",
    sql=f"select aid as name, case when flag in (0, 16) then 'primary' when flag in (2048, 2064) then 'supplementary' when flag = 4 then 'none' else 'other' end as type, flag, {CIG.format('M')} + {CIG.format('S')} + {CIG.format('D')} - {CIG.format('I')} as length, {CIG.format('I')} as n_ins, {CIG.format('D')} as n_del, {CIG.format('S')} as n_trim, " + MD.split("select aid, ")[1],
)
def _(aln):
    from strandloom.sources.reads import alignment_stats

    return alignment_stats(aln.withColumnRenamed("aid", "name"))

