"""Removal of lines that many documents share.

Each line becomes a 96-bit hash of its key. The (hash, document, position) rows are range-partitioned on the hash and sorted
within a partition by hash, document and position; a pass along each sorted run counts a key's documents and sees its
first occurrence. The keys that have more lines than an even part are cut in slices of documents beforehand, so that one very
common line spreads over many partitions; the counts at the ends of its slices are added up. Only rows of dropped keys
travel on, and come back as bitmaps of one bit a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, null_safe

LINE_KEYS = ["h1", "h2"]
ROW_KEYS = ["doc_id", "text_hash"]
#: Least number of parts in which lines are thought to be dealt: see common_keys().
PARTS, SAMPLE = 1024, 64


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row (h1, h2, doc_id, text_hash, pos) for each line whose key has min_chars code points."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select(*ROW_KEYS, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select(*ROW_KEYS, "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), *ROW_KEYS, "pos")


def common_keys(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Keys (h1, h2, slices) with more lines of one in sample documents than an even part of them has, and in how many slices to deal them.

    There are as many parts as shuffle partitions, PARTS at least. So there are fewer such keys than parts, all others have
    no more lines than a task is to take anyway, but for chance, and a slice has about a quarter of that: five slices a part at most, together.
    """
    parts = max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = rows.filter(F.pmod(F.xxhash64(*ROW_KEYS), F.lit(sample)) == 0)
    counts = materialize(seen.groupBy(*LINE_KEYS).agg(F.count(F.lit(1)).alias("n")), "line-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * parts > total).select(*LINE_KEYS, F.ceil(F.col("n") * (4 * parts) / F.lit(total)).cast("int").alias("slices"))


def repeated_lines(rows: DataFrame, min_docs: int, sample: int = SAMPLE) -> DataFrame:
    """The rows of line_hashes() whose key min_docs documents or more have, with first, the key's first occurrence.

    first is a struct of doc_id, text_hash and pos, the smallest in this order; null if no row of the key has a doc_id. Rows
    that repeat a whole document count once.
    """
    common = F.broadcast(common_keys(rows, sample))  # fewer rows than parts
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(1), *ROW_KEYS), "slices").cast("int"), F.lit(-1))
    dealt = rows.join(common, LINE_KEYS, "left").withColumn("slice", part).drop("slices")
    keys = [*LINE_KEYS, "slice"]
    order = [F.col("doc_id").asc_nulls_last(), "text_hash", "pos"]
    runs = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys, *order)
    along = Window.partitionBy(*keys).orderBy(*order)
    here = F.struct(*ROW_KEYS, "pos")
    fresh = F.lag(F.struct(*ROW_KEYS)).over(along).eqNullSafe(F.struct(*ROW_KEYS))
    runs = runs.withColumns(
        {
            "fresh": F.when(fresh, 0).otherwise(1),
            "head": F.row_number().over(along) == 1,
            "first": F.first(here).over(along.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    runs = runs.withColumn("n_docs", F.sum("fresh").over(Window.partitionBy(*keys))).drop("fresh")
    runs = materialize(runs.filter((F.col("slice") >= 0) | (F.col("n_docs") >= min_docs)), "line-runs")
    # a common key's slices meet at their heads: five rows a part at most, over all keys
    known = F.when(F.col("first.doc_id").isNotNull(), F.col("first"))
    heads = runs.filter("slice >= 0 and head").groupBy(*LINE_KEYS)
    whole = heads.agg(F.sum("n_docs").alias("all_docs"), F.min(known).alias("all_first"))
    runs = runs.join(F.broadcast(whole), LINE_KEYS, "left")  # fewer rows than parts
    runs = runs.filter(F.coalesce("all_docs", "n_docs") >= min_docs)
    return runs.select(*LINE_KEYS, *ROW_KEYS, "pos", F.when(F.col("slice") >= 0, F.col("all_first")).otherwise(known).alias("first"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, sample: int = SAMPLE) -> DataFrame:
    """Bitmaps of kept lines: (doc_id, text_hash, words array<struct<word, bits>>).

    Bit i of word w stands for line 64 w + i and is set if the line stays, as are bits past the last line. Words that keep all
    their lines are left out, and so are documents that do. keep_first keeps a repeated key's first occurrence, by doc_id (then
    the text's hash) and position (null doc_ids never hold it); otherwise all its occurrences go.
    """
    rows = materialize(line_hashes(docs, min_chars), "line-hashes")
    gone = repeated_lines(rows, min_docs, sample)
    if keep_first:
        gone = gone.filter(~F.struct(*ROW_KEYS, "pos").eqNullSafe(F.col("first")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.repartition(*ROW_KEYS).groupBy(*ROW_KEYS, F.expr("cast(pos div 64 as int)").alias("word"))
    words = words.agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy(*ROW_KEYS).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def bitmap_text(bitmap: str):
    """A bitmap as text: word:bits for each of its words, bits in 16 hexadecimal digits, comma-joined; empty without any."""
    return F.expr(f"coalesce(array_join(transform({bitmap}, e -> concat(e.word, ':', lower(lpad(hex(e.bits), 16, '0')))), ','), '')")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, sample: int = SAMPLE) -> DataFrame:
    """docs with text rebuilt from its kept lines, and n_lines, n_dropped and keep_bitmap (see keep_bitmaps; null if all lines stay).

    Null or empty texts are one empty line and come back empty. Rows with equal doc_id and text count as one
    document and each come back. Other columns stay; ones with the names of added columns are replaced.
    """
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first, sample)
    bitmaps = bitmaps.withColumnsRenamed({"words": "keep_bitmap", "text_hash": "__text_hash"})
    base = docs.drop("n_lines", "n_dropped", "keep_bitmap").withColumn("text", F.coalesce("text", F.lit("")))
    joined = null_safe(base.withColumn("__text_hash", F.xxhash64("text")), bitmaps, ["doc_id", "__text_hash"], "left")
    # the words between two stored ones keep all lines: pad them, so that a line finds its word by index
    dense = F.expr(
        "flatten(zip_with(keep_bitmap, array_insert(slice(keep_bitmap, 1, size(keep_bitmap) - 1), 1,"
        " named_struct('word', -1, 'bits', 0L)), (e, p) -> concat(array_repeat(-1L, e.word - p.word - 1), array(e.bits))))"
    )
    lined = joined.withColumn("__lines", F.split("text", "\n", -1)).withColumn("__dense", dense)
    kept = F.expr(
        "array_join(filter(__lines, (x, i) -> (shiftright(coalesce(get(__dense, cast(i div 64 as int)), -1L), i % 64) & 1) = 1), '\n')"
    )
    return (
        lined.withColumn("text", F.when(F.col("keep_bitmap").isNull(), F.col("text")).otherwise(kept))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", F.expr("coalesce(aggregate(keep_bitmap, 0L, (a, e) -> a + 64 - bit_count(e.bits)), 0L)"))
        .drop("__lines", "__dense", "__text_hash")
    )
