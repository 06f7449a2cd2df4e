"""Views over the given tables that stand for forks, events, features, reads, signals and alignments.

Each is a table, a list of expressions in Spark's spelling, and DuckDB SQL for the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# executors need not have the package: functions travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHROM = "concat('chr', cast({} % 16 + 1 as {}))"
_MIXED = "(l_orderkey * 61 + l_partkey * 7 + l_linenumber) % 200000"
_STRAND = "case when l_linestatus = 'F' then '+' else '-' end strand"
_FLAG = "case cast(l_linenumber % 4 as int) when 0 then 0 when 1 then 16 when 2 then 4 else 2048 end flag"
_LETTERS = "'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTNN'"
_CALL = "case event_type when 'view' then 'T' when 'purchase' then 'B' when 'signup' then 'X' when 'click' then 'A' else 'C' end call"
_IDX = "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) idx"

#: name: (table, expressions); s is the spelling of the string type.
_VIEWS = {
    "iv": ("lineitem", lambda s: [_CHROM.format("l_suppkey", s) + " chrom", _MIXED + " + 1 s", _MIXED + " + cast(l_quantity as bigint) * 40 e", _STRAND, "l_returnflag rep"]),
    "pts": ("orders", lambda s: [_CHROM.format("o_custkey", s) + " chrom", "(o_orderkey * 7919 + o_custkey * 13) % 1500000 + 1 pos", "o_orderkey id", "case when o_orderstatus = 'O' then 'BC' else 'BD' end rep"]),
    "feat": ("part", lambda s: [_CHROM.format("p_partkey", s) + " chrom", "(p_partkey * 104729) % 1500000 + 1 s", "(p_partkey * 104729) % 1500000 + p_size * 10 e", "p_type status", "p_partkey fid"]),
    "chrom_sizes": ("part", lambda s: ["distinct " + _CHROM.format("p_partkey", s) + " chrom", "cast(1500500 as bigint) size"]),
    "sig": ("events", lambda s: ["user_id read_id", _IDX, "cast(round(value * 100) as bigint) v100", _CALL]),
    "aln": ("lineitem", lambda s: ["l_orderkey * 100 + l_partkey % 100 aid", _FLAG, f"concat(cast(l_linenumber as {s}), 'S', cast(cast(l_quantity as int) as {s}), 'M', cast(l_partkey % 5 + 1 as {s}), 'D', cast(l_suppkey % 3 + 1 as {s}), 'I') cigar", f"concat(cast(l_linenumber as {s}), 'A0^TG', cast(l_suppkey % 9 as {s}), 'C') md"]),
}

SQL = {name: f"select {', '.join(e('varchar'))} from {table}" for name, (table, e) in _VIEWS.items()}
SQL["reads"] = f"select user_id read_id, {_CHROM.format('user_id', 'varchar')} chrom, case when user_id % 2 = 0 then '+' else '-' end strand, user_id * 1000 start_, user_id * 1000 + count(*) - 1 end_ from events group by user_id"
SQL["seqs"] = f"select doc_id read_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), {_LETTERS}) seq from documents"


#: What SQL["seqs"] does to a byte of a text: letters turn into bases, all others go.
_BASES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"ACGTACGTACGTACGTACGTACGTNN" * 2)
_OTHERS = bytes(b for b in range(256) if not (b < 128 and chr(b).isalpha()))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        seqs = [None if t is None else t.translate(_BASES, _OTHERS) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary()).cast(pa.string())], ["read_id", "seq"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or else the table of that name."""

    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    if name == "reads":
        chrom = _CHROM.format("user_id", "string") + " chrom"
        grouped = read("events").groupBy("user_id").count()
        return grouped.selectExpr("user_id read_id", chrom, "case when user_id % 2 = 0 then '+' else '-' end strand", "user_id * 1000 start_", "user_id * 1000 + count - 1 end_")
    if name == "seqs":
        # one pass over bytes: translate() looks up each letter as a string, once more for each filter
        return read("documents").selectExpr("cast(doc_id as bigint) read_id", "text").mapInArrow(_sequences, "read_id long, seq string")
    if name not in _VIEWS:
        return read(name)
    table, expressions = _VIEWS[name]
    listed = expressions("string")
    if listed[0].startswith("distinct "):
        return read(table).selectExpr(listed[0].removeprefix("distinct "), *listed[1:]).distinct()
    return read(table).selectExpr(*listed)
