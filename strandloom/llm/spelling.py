"""Groups of spelling variants: words that differ by one inserted, deleted or replaced code point.

Two such words have a common prefix and a common suffix that together reach the longer length less one. If that length less one is cut
into parts, the edit lies in one of them, so that both words have the parts before it as prefix and those after it as suffix: words meet in
blocks of equal prefix, suffix and longer length, and a pair counts in the block in which its common prefix ends.
In a block, words are tiles of padded matrices of code points, one aligned at the start and one at the end; pairs of tiles are compared
column by column. A task returns a row for each word that has near ones, with their number and the most frequent, never pairs.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, materialize, ship, whole_groups

ship(__name__, "strandloom.llm.common")

#: Code points of a part, and most parts of a word: words of a block agree but for one part, and one code point more in the last.
PART, PARTS = 2, 16
#: Words of a tile, and cells of a comparison of pairs of tiles.
TILE, CELLS = 64, 1 << 20
#: Words and bytes of a block that are dealt to one task.
DEALT, BYTES = 4096, 1 << 26
#: Different words that a task counts before it passes their counts on.
COUNTED = 1 << 18
BLOCK = ["longer", "part", "key", "tile_a", "tile_b"]


def _count_words(typo: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        # no run becomes longer
        long_enough = re.compile(f"[a-zÀ-ÿ]{{{max(least, 1)},}}")

        def passed_on() -> pa.RecordBatch:
            held = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return held

        for batch in batches:
            for i, text in zip(batch.column("doc_id"), pc.cast(batch.column("text"), pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{i.as_py() if i.is_valid else ''}:".encode())
                for word, n in Counter(long_enough.findall(text.as_py().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % typo:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield passed_on()
        yield passed_on()

    return run


def count_words(docs: DataFrame, typo: int = 199, least: int = 6, occurrences: int = 5) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text), of so many code points and occurrences at least.

    A word is a maximal run of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. If typo divides the crc32 h of "<doc_id>:<run>" in UTF-8, the run loses its code
    point h % length. Null texts have no words; of a null doc_id the name is empty; rows that repeat count each time.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_count_words(typo, least), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def cuts(length: int) -> list[tuple[int, int]]:
    """The parts of words whose longer length this is."""
    step = max(PART, -(-(length - 1) // PARTS))
    return [(a, min(a + step, length - 1)) for a in range(0, length - 1, step)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (longer, part, key, word, n) for each block of a word: those in which it is the longer word of a pair or as long, and those in which it is the shorter one."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        index, longer, part, key = [], [], [], []
        hash_of = xxhash.xxh64_intdigest
        for i, w in enumerate(words):
            for length in (len(w), len(w) + 1):
                for j, (a, b) in enumerate(cuts(length)):
                    index.append(i)
                    longer.append(length)
                    part.append(j)
                    # a hash only brings words together: that a pair shares prefix and suffix is seen again where it is compared
                    key.append(hash_of((w[:a] + w[len(w) - (length - 1 - b) :]).encode()))
        taken = batch.take(pa.array(index, pa.int64()))
        columns = [pa.array(longer, pa.int32()), pa.array(part, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), *taken.columns]
        yield pa.RecordBatch.from_arrays(columns, ["longer", "part", "key", *batch.schema.names])


def code_points(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of code points, padded with zeros after and before the words, and the words' lengths."""
    lengths = np.array([len(w) for w in words])
    left = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left[row, column] = flat
    right = np.zeros_like(left)
    right[row, column + width - lengths[row]] = flat
    small = np.uint8 if flat.size and flat.max() < 256 else np.uint32
    return left.astype(small), right.astype(small), lengths


def _common(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """For tiles a and b (pair, row, column): how many columns of the given order two rows agree in before they first differ."""
    alike = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    n = np.zeros(alike.shape, np.uint16 if len(columns) < 1 << 16 else np.int64)
    for c in columns:
        alike &= a[:, :, None, c] == b[:, None, :, c]
        n += alike
        if not alike.any():
            break
    return n


def single_edits(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, ends: tuple[int, int]) -> np.ndarray:
    """near[p, i, j]: whether rows a[p, i] and b[p, j], -1 for none, differ by one edit and their common prefix lies in [ends[0], ends[1]).

    Matrices are as wide as the longer length of the block; rows are as long or one shorter, and two of the shorter ones are not compared.
    """
    width = left.shape[1]
    prefix = _common(left[a], left[b], range(min(width, ends[1] + 1)))
    may = (lengths[a] == width)[:, :, None] | (lengths[b] == width)[:, None, :]
    may &= (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
    may &= (prefix >= ends[0]) & (prefix < ends[1]) & (prefix < width)
    chosen = np.nonzero(may.any(axis=(1, 2)))[0]
    near = np.zeros(may.shape, bool)
    if len(chosen):
        suffix = _common(right[a[chosen]], right[b[chosen]], range(width - 1, -1, -1))
        near[chosen] = may[chosen] & (prefix[chosen].astype(np.int64) + suffix >= width - 1)
    return near


def _tile_pairs(starts: np.ndarray, ends: np.ndarray, two: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of tiles of row numbers (-1: none) of groups [starts, ends), in batches of one size; whether the two are the same tile.

    two is where the second set of rows begins in a group of two sets, of which only pairs across are wanted; else equal to starts.
    """
    made: dict[int, list] = {}
    for s, e, m in zip(starts.tolist(), ends.tolist(), two.tolist(), strict=True):
        if m > s:
            pairs = itertools.product([(x, min(x + TILE, m)) for x in range(s, m, TILE)], [(x, min(x + TILE, e)) for x in range(m, e, TILE)])
        else:
            tiles = [(x, min(x + TILE, e)) for x in range(s, e, TILE)]
            pairs = itertools.combinations_with_replacement(tiles, 2)
        for x, y in pairs:
            size = 1 << (max(x[1] - x[0], y[1] - y[0]) - 1).bit_length()
            kind = 2 * size + (x == y)
            held = made.setdefault(kind, [])
            held.append((*x, *y))
            if len(held) * size * max(size, width // 8) >= CELLS:
                yield *_filled(made.pop(kind), size), x == y
    for kind, held in made.items():
        yield *_filled(held, kind // 2), kind % 2 == 1


def _filled(held: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.array(held)
    at = np.arange(size)
    a, b = (np.where(lo[:, None] + at < hi[:, None], lo[:, None] + at, -1) for lo, hi in ((bounds[:, 0], bounds[:, 1]), (bounds[:, 2], bounds[:, 3])))
    return a, b


def near_of_blocks(rows: pa.Table) -> pa.Table:
    """(word, n_near, near_n, near) of rows sorted by BLOCK and own tile, for words with near ones in whole blocks."""
    words = rows.column("word").to_pylist()
    order = pc.sort_indices(rows.select(["word", "n"]), [("n", "descending"), ("word", "ascending")]).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    found, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    longer, part, own, tile_a, tile_b = (rows.column(c).to_numpy() for c in ("longer", "part", "own", "tile_a", "tile_b"))
    starts = group_starts(rows, BLOCK)
    ends = np.append(starts[1:], len(words))
    cut = tile_a[starts] != tile_b[starts]
    second = np.add.reduceat((own == tile_a).astype(np.int64), starts)
    wanted = np.where(cut, (second > 0) & (second < ends - starts), ends - starts > 1)
    kind = np.stack([longer[starts], part[starts]], axis=1)
    for length, j in np.unique(kind[wanted], axis=0).tolist():
        those = wanted & (kind[:, 0] == length) & (kind[:, 1] == j)
        s, e, two = starts[those], ends[those], (starts + np.where(cut, second, 0))[those]
        # matrices of the rows of these blocks only
        index = np.concatenate([np.arange(x, y) for x, y in zip(s, e, strict=True)])
        shift = np.cumsum(e - s) - (e - s)
        left, right, lengths = code_points([words[i] for i in index], length)
        parts = cuts(length)
        span = (parts[j][0], length if j == len(parts) - 1 else parts[j][1])
        for a, b, same in _tile_pairs(shift, shift + (e - s), shift + (two - s), length):
            near = single_edits(left, right, lengths, a, b, span)
            for x, y, sees in ((a, b, near), *(() if same else ((b, a, near.transpose(0, 2, 1)),))):
                r = np.where(y >= 0, rank[index[y]], len(words))
                low = np.where(sees, r[:, None, :], len(words)).min(axis=2)
                np.add.at(found, index[x[x >= 0]], sees.sum(axis=2)[x >= 0])
                np.minimum.at(best, index[x[x >= 0]], low[x >= 0])
    seen = np.nonzero(found)[0]
    chosen = rows.select(["word"]).combine_chunks().take(pa.array(seen))
    other = rows.select(["n", "word"]).combine_chunks().take(pa.array(order[best[seen]]))
    columns = [chosen.column("word"), pa.array(found[seen]), other.column("n"), other.column("word")]
    return pa.Table.from_arrays(columns, ["word", "n_near", "near_n", "near"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, BLOCK):
        yield from near_of_blocks(rows).to_batches()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of words(word, n), different ones, that have near words: how many, and the one of largest n, then smallest in code-point order.

    Blocks of more than DEALT words are cut by a hash of the word, and each pair of their tiles is a group by itself.
    """
    blocks = materialize(words.select("word", "n").mapInArrow(_blocks, "longer int, part int, key long, word string, n long"), "spelling-blocks")
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / DEALT, F.sum(F.octet_length("word")) / BYTES)).cast("int")
    size = blocks.groupBy("longer", "part", "key").agg(F.count(F.lit(1)).alias("size"), tiles.alias("tiles")).filter("size > 1").drop("size")
    dealt = blocks.join(size, ["longer", "part", "key"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")}).select(*BLOCK, "own", "word", "n")
    dealt = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "own")
    found = dealt.mapInArrow(_near, "word string, n_near long, near_n long, near string")
    first = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("k")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("k.m")).alias("near_n"), "k.near")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form), neither null and no cycles: the last form that a word leads to. Steps double with each join."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = state.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        state = materialize(moved, "spelling-roots")
        if not state.filter("moved").limit(1).count():
            return state.drop("moved")
        state = state.drop("moved")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for each of words(word, n), different ones of two code points or more.

    n_near counts words that differ by one code point inserted, deleted or replaced. form is the most frequent of them, the smallest in code-point order of
    several, if its n is ratio times the word's or more, with ratio over 1; root is the last word that forms lead to. An empty table gives none.
    """
    words = materialize(words, "spelling-words")
    found = materialize(near_words(words), "spelling-near")
    df = words.join(found, "word", "left").withColumn("has", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False)))
    df = materialize(
        df.select("word", F.when(F.col("has"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("near_n")).alias("form_n")),
        "spelling-forms",
    )
    roots = follow_forms(df.filter("form is not null"))
    return df.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
