"""Vectors as codes: each part of a vector is named by the nearest entry of that part position's codebook.

A task takes some thousands of vectors at a time. Their different parts at a position, sorted by components, are the leaves of
a trie: parts that begin with equal components share a path, and the distances of a path to all entries are summed up
once, component by component. The trie is walked depth first, in runs of leaves of which all paths are extended at once.
Leaves take the nearest entry; for a round of training, sums of parts weighted by how often they occur go to the driver, which
needs a row for each entry only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_safe, ship

ship(__name__)

#: Components are held within this, so that squared distances of vectors of up to 512 components fit 64 bits.
MOST = 1 << 26
#: Vectors that make one trie, and leaves whose paths are extended at once.
VECTORS, LEAVES = 1 << 15, 1 << 12


def kept(column: str, parts: int) -> Column:
    """Whether a vector has components, in a number that parts divide, all finite and none null."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & (F.size(column) % parts == 0) & finite, F.lit(False))


def nearest(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the first of several) and its squared distance, for each of leaves: different rows, sorted."""
    best, distance = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    for start in range(0, len(leaves), LEAVES):
        run = leaves[start : start + LEAVES]
        # a row begins a path of d components where one of the first d differs from the row before
        begins = np.zeros(len(run), bool)
        begins[0] = True
        path, summed = np.zeros(len(run), np.int64), np.zeros((1, len(entries)), np.int64)
        for d in range(run.shape[1]):
            begins[1:] |= run[1:, d] != run[:-1, d]
            first = np.nonzero(begins)[0]
            summed = summed[path[first]] + (run[first, d, None] - entries[None, :, d]) ** 2
            path = np.cumsum(begins) - 1
        k = summed.argmin(axis=1)
        best[start : start + LEAVES] = k[path]
        distance[start : start + LEAVES] = summed[np.arange(len(k)), k][path]
    return best, distance


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows in the order of their components, the place of each row among them, and how often each occurs."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    begins = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(begins) - 1
    return ordered[begins], place, np.bincount(place)


def _integers(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks])
    held = np.clip(np.floor(flat.astype(np.float64) * 256), -MOST, MOST).astype(np.int64)
    return table, held.reshape(table.num_rows, -1)


def _in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Vectors as integers, up to VECTORS rows or a batch at a time."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= VECTORS:
            yield _integers(held)
            held, n = [], 0
    if held:
        yield _integers(held)


def _sums(books: np.ndarray):
    """Rows (part, entry, n, sums): of all parts of a task at a position that are nearest to an entry."""
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((n_parts, n_entries), np.int64), np.zeros(books.shape, np.int64)
        for _, vectors in _in_groups(batches):
            for p in range(n_parts):
                leaves, _, weight = distinct_parts(vectors[:, p * width : (p + 1) * width])
                entry, _ = nearest(leaves, books[p])
                np.add.at(n[p], entry, weight)
                np.add.at(sums[p], entry, leaves * weight[:, None])
        part, entry = np.nonzero(n)
        flat = pa.array(sums[part, entry].reshape(-1))
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
        columns = [pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.ListArray.from_arrays(offsets, flat)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    n_parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, vectors in _in_groups(batches):
            codes, error = np.empty((len(vectors), n_parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(n_parts):
                leaves, place, _ = distinct_parts(vectors[:, p * width : (p + 1) * width])
                entry, distance = nearest(leaves, books[p])
                codes[:, p] = entry[place]
                error += distance[place]
            named = table.drop_columns(["vector"]).append_column("code", pa.array([c.tobytes().hex() for c in codes], pa.string()))
            yield from named.append_column("error", pa.array(error)).to_batches()

    return run


def train_codebooks(vectors: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after rounds over vectors(vector), starting from first. A round brings one row for each entry to the driver."""
    books, width = first.copy(), first.shape[2]
    for _ in range(rounds):
        partial = vectors.select("vector").mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
        at = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *at).collect():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def vector_codes(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of each kept row of rows(vec_id, embedding, label), and the codebooks (part, entry, component).

    Components are floor(256 x), held within 2^26. Dropped are vectors that are null or empty, hold null or non-finite components, can't be cut
    into parts of equal size, or differ in size from that of the smallest vec_id kept. Codebooks start as the parts of the vectors of the smallest vec_ids
    (nulls last; equal ids by their components), fewer if there are fewer; entries is 256 at most. Rows that repeat count each time. label_error is the sum of
    error over rows of an equal label, nulls together. Other columns are not used. Without a vector that is kept, the codebooks have no entries and there are no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds a byte a part, so entries must lie between 1 and 256")
    spark = rows.sparkSession
    good = rows.filter(kept("embedding", parts)).select("vec_id", "label", F.col("embedding").alias("vector"))
    least = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    size = len(least[0]["vector"]) if least else 0
    good = good.filter(F.size("vector") == size)
    kinds = ", ".join(f"{c} {good.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    if not least:
        empty = spark.createDataFrame([], f"{kinds}, code string, error long, label_error long")
        return empty, np.zeros((parts, 0, 0), np.int64)
    start = good.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    first = np.array([r["vector"] for r in start], np.float64)
    first = np.clip(np.floor(first * 256), -MOST, MOST).astype(np.int64)
    books = train_codebooks(good, first.reshape(len(first), parts, -1).transpose(1, 0, 2), rounds)
    coded = materialize(good.mapInArrow(_codes(books), f"{kinds}, code string, error long"), "vector-codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return null_safe(coded, labels, ["label"], "inner"), books


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal and joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
