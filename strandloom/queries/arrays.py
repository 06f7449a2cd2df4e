"""Queries of array decoding: C1-C4."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import arrays as a

from .registry import query

TAGS = """g as (select read_id, seq, list_transform(range(0, read_id % 9 + 1), lambda i: (i * 7 + read_id) % 4) as mm, list_transform(range(0, read_id % 9 + 1), lambda i: (i * 31 + read_id * 3) % 256) as ml from seqs where length(seq) > 0)"""


def _tags(seqs):
    n = "sequence(0, cast(read_id % 9 as int))"
    return seqs.filter("length(seq) > 0").selectExpr("read_id", "seq", f"transform({n}, i -> cast((i * 7 + read_id) % 4 as int)) mm", f"transform({n}, i -> cast((i * 31 + read_id * 3) % 256 as int)) ml")


SITES = "s as (select read_id, p - 1 as pos, row_number() over (partition by read_id order by p) - 1 as nth from (select read_id, seq, unnest(range(1, length(seq) + 1)) as p from seqs) where substr(seq, p::int, 1) = 'T')"


@query(
    "C1_decode_mm_ml", "seqs",
    sql=f"""{TAGS}, {SITES}, k as (select read_id, unnest(ml) as ml, unnest(list_transform(range(1, len(mm) + 1), lambda i: list_sum(mm[:i]) + i - 1)) as nth from g)
    select k.read_id, pos::int as pos, ml / 255 as value from k join s on k.read_id = s.read_id and k.nth = s.nth""",
)
def _(seqs):
    return a.decode_mm_ml(_tags(seqs), ["read_id"], "seq", "mm", "ml", "T")


@query(
    "C2_decode_multi_mod", "seqs",
    sql=f"""{TAGS}, {SITES}, k as (select read_id, 'B' as mod, unnest(ml[:len(mm)]) as ml, unnest(list_transform(range(1, len(mm) + 1), lambda i: list_sum(mm[:i]) + i - 1)) as nth from g
      union all select read_id, 'E', unnest([(read_id * 5) % 256, 77]), unnest([1, 4]) from g)
    select k.read_id, mod, pos::int as pos, ml / 255 as value from k join s on k.read_id = s.read_id and k.nth = s.nth""",
)
def _(seqs):
    t = _tags(seqs).withColumns({
        "tag": F.concat(F.lit("T+B,"), F.array_join(F.col("mm").cast("array<string>"), ","), F.lit(";T+E,1,2;")),
        "probs": F.concat("ml", F.array((F.col("read_id") * 5 % 256).cast("int"), F.lit(77))),
    })
    return a.decode_multi_mod(t.select("read_id", "seq", "tag", "probs"), "read_id", "seq", "tag", "probs")


@query("C3_orient", "sig", "reads", sql="v as (select read_id, list(v100 order by idx) as v from sig group by read_id) select read_id, case strand when '-' then list_reverse(v) else v end as v from v join reads using (read_id)")
def _(sig, reads):
    v = sig.groupBy("read_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v100"))), lambda x: x.v100).alias("v"))
    return v.join(reads, "read_id").select("read_id", a.orient("v", "strand").alias("v"))


@query("C4_keep_modified", "sig", sql="select read_id, count(*) filter (v100 > 4000) as n from sig group by read_id having count(*) filter (v100 > 4000) >= 8")
def _(sig):
    return a.keep_modified(sig, "read_id", "v100", 4000, 8)
