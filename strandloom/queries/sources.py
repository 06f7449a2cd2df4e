"""Queries of sources and sinks: given tables written as text and read again (A1, A2, A4-A7, A9, A10, A12-A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.sources import bed, reads
from strandloom.sources.storage import new_path, stored

from .registry import query


def _text(df, label):
    """Writes lines as text files to shared storage and returns their folder."""
    path = new_path(df.sparkSession, label)
    reads.write_lines(df, path)
    return path


def _calls(seqs, rds):
    # both files are written from here; dealt anew, as reads may lie in few of the sequences' files. Ratios are never null, so no filter works them out once more
    met = stored(rds.join(seqs, "read_id").repartition("read_id"), "met")
    return met.selectExpr("concat('r', read_id) read", "chrom", "strand", "start_ start", "end_ end", "seq", "coalesce(transform(sequence(0, length(seq) - 1), i -> case when i % 5 != 0 then i % 100 / 100D end), array()) ratio")


@query(
    "A1_A2_calls", "seqs", "reads",
    sql="""select 'r' || read_id as read, chrom, strand, start_ as "start", end_ as "end", seq, list_transform(range(0, length(seq)), lambda i: case when i % 5 = 0 then null else i % 100 / 100 end) as ratio from reads join seqs using (read_id) where length(seq) > 0""",
)
def _(seqs, rds):
    calls = _calls(seqs.filter("length(seq) > 0"), rds)
    spark = calls.sparkSession
    a, b = _text(reads.call_lines(calls), "calls"), _text(reads.ratio_lines(calls), "ratios")
    one = reads._records(spark, a, "*").select(*[v.alias(k) for k, v in reads.c.parse_header("head").items()], F.trim("body").alias("seq"))
    two = reads._records(spark, b, "*").select(reads.c.parse_header("head")["read"].alias("read"), reads.ratio_values("body").alias("ratio"))
    return one.join(two, "read", "left")


@query("A4_read_percent", "reads", sql="select 'r' || read_id as readname, read_id % 50 / 100 as percent, read_id % 7 / 4 as error, 'B' as mod from reads")
def _(rds):
    lines = reads.percent_lines(rds.selectExpr("concat('r', read_id) read", "read_id % 50 * 1.0D percent", "read_id % 7 / 4 error", "'B' mod"))
    return reads.read_percent(rds.sparkSession, _text(lines, "percents"))


@query("A5_read_manifest", "feat", sql="select 'f' || fid as filename, fid / 4 as percent, fid % 3 as weight from feat")
def _(feat):
    path = new_path(feat.sparkSession, "manifest")
    feat.selectExpr("fid % 3 weight", "concat('f', fid) filename", "fid / 4 percent").write.csv(path, header=True)
    return reads.read_manifest(feat.sparkSession, path, {"percent": "double", "weight": "long"})


@query("A6_read_dataset", "region", sql="select r_name as key, ['a' || r_regionkey, 'b'] as f5, case when r_regionkey > 1 then r_regionkey / 2 end as percents from region")
def _(region):
    path = new_path(region.sparkSession, "sheet")
    lines = region.selectExpr("r_name key", "concat('[', '''a', r_regionkey, ''', ''b'']') f5", "case when r_regionkey > 1 then cast(r_regionkey / 2 as string) when r_regionkey = 1 then 'None' else 'False' end percents")
    lines.write.csv(path, sep=";", header=True)
    return reads.read_dataset(region.sparkSession, path, ["f5"], ["percents"])


@query("A7_bed", "feat", sql="select chrom, s, e, status as name, fid::double as score, '.' as strand from feat")
def _(feat):
    path = new_path(feat.sparkSession, "bed")
    bed.write_bed(feat.selectExpr("chrom", "s", "e", "status name", "fid score"), path)
    return bed.read_bed(feat.sparkSession, path)


ROMAN = ", ".join(f"'{x}'" for x in reads.c.ROMAN)


@query("A9_read_forks", "pts", sql=f"select 'chr' || ([{ROMAN}])[substr(chrom, 4)::int] as chrom, pos as \"start\", pos + 900 as \"end\", case when id % 2 = 0 then 'L' else 'R' end as direction, 'r' || id as read, case when id % 2 = 0 then '+' else '-' end as strand, 1.5::double as jump_score, 0.25::double as score from pts")
def _(pts):
    tracts = pts.selectExpr("chrom", "pos start", "pos + 900 end", "if(id % 2 = 0, 'L', 'R') dir", "'f.fa' file", "concat('r', id) read", "'+' strand", "1.5D jump_score", "0.25D score")
    path = new_path(pts.sparkSession, "forks")
    bed.write_rows(bed.fork_rows(tracts), path)
    return bed.read_forks(pts.sparkSession, path).drop("file", "source")


@query("A10_read_reads_bed", "iv", sql="select chrom, s, e, strand from iv")
def _(iv):
    path = new_path(iv.sparkSession, "reads-bed")
    bed.write_bed(iv.select("chrom", "s", "e", "strand"), path)
    return bed.read_reads_bed(iv.sparkSession, path, 16)


@query("A12_read_wig", "sig", sql="select 'chr' || (read_id % 16 + 1) || '_' || read_id as chrom, idx * 10 + 1 as pos, v100 / 4 as value from sig")
def _(sig):
    g = sig.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("idx", (F.col("v100") / 4).alias("v")))).alias("x"))
    head = F.format_string("fixedStep chrom=chr%d_%d start=1 step=10", F.col("read_id") % 16 + 1, "read_id")
    lines = g.select(F.concat_ws("\n", head, F.array_join(F.transform("x", lambda x: x.v.cast("string")), "\n")).alias("value"))
    return bed.read_wig(sig.sparkSession, _text(lines, "wig"))


@query("A13_read_fastq", "seqs", sql="select 'x' || read_id || '_7' as key1, 'x' || read_id as key2, seq, repeat('I', length(seq)) as qual from seqs where length(seq) > 0")
def _(seqs):
    lines = seqs.filter("length(seq) > 0").select(F.concat(F.lit("@x"), F.col("read_id").cast("string"), F.lit("_7_z more\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("value"))
    return reads.read_fastq(seqs.sparkSession, _text(lines, "fastq"))


@query("A14_read_sam", "aln", sql="select 'a' || aid as name, flag, 'chr1' as chrom, aid % 1000 as pos, 30 as mapq, cigar, 'ACGT' as seq, (flag % 7)::varchar as nm, md from aln")
def _(aln):
    row = F.concat_ws("\t", F.concat(F.lit("a"), F.col("aid").cast("string")), F.col("flag").cast("string"), F.lit("chr1"), (F.col("aid") % 1000).cast("string"), F.lit("30"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("*"), F.concat(F.lit("NM:i:"), (F.col("flag") % 7).cast("string")), F.concat(F.lit("MD:Z:"), "md"))
    head = aln.sparkSession.range(1).select(F.lit("@SQ\tSN:chr1\tLN:1000").alias("value"))
    return reads.read_sam(aln.sparkSession, _text(aln.select(row.alias("value")).unionByName(head), "sam"))


@query("A15_read_seq_summary", "reads", sql="select 'r' || read_id as read_id, 'f' || read_id % 5 as filename from reads")
def _(rds):
    path = new_path(rds.sparkSession, "summary")
    rds.selectExpr("concat('f', read_id % 5) filename_fast5", "concat('r', read_id) read_id", "1 duration").write.csv(path, sep="\t", header=True)
    return reads.read_seq_summary(rds.sparkSession, path)


@query("A16_write_partitioned_reads", "reads", sql="select read_id, (read_id % 5)::int as file_no from reads")
def _(rds):
    return reads.write_partitioned_reads(rds.selectExpr("*", "cast(read_id % 5 as int) file_no"), new_path(rds.sparkSession, "shards"), "file_no")


@query("A17_kmer_table", "sig", sql="k as (select call || lead(call) over w as kmer, v100 from sig window w as (partition by read_id order by idx)) select kmer, count(*) as n, avg(v100) as mean from k where kmer is not null group by kmer")
def _(sig):
    from strandloom.operators.kmers import series_kmers

    path = new_path(sig.sparkSession, "kmer-samples")
    reads.save_kmer_table(series_kmers(sig, "read_id", "idx", "call", 2).select("kmer", F.col("v100").alias("value")), path)
    return reads.load_kmer_table(sig.sparkSession, path)
