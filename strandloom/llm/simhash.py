"""Near duplicates by SimHash, compared in bit-sliced blocks.

Different fingerprints meet in blocks of those that agree in some of their bits, chosen so that any two within the
radius share a block; large blocks are cut in tiles, each pair of which is compared in a task of its own. A task
returns, for each fingerprint, the first one of the block that it reaches, so that a group of n near copies
makes fewer than n links a block. Links are joined to components over shared storage.

By similarity, the links of fingerprints are candidates, and different sets of shingles meet in blocks of equal bands of minimum hashes too. All these
and the share of minimum hashes that agree only find candidates; the sets themselves decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitslice
from .common import materialize, null_safe, ship
from .components import connected_components

ship(__name__, bitslice.__name__)

N_HASHES = 128
#: Sets of similarity 0.8 share no band in 5 of 100,000 cases, and agree in less than SLACK below 0.8 of their hashes in fewer.
BANDS, BAND_ROWS = 25, 5
SLACK = 0.15
#: Bytes of sets that a block of sets holds, in the mean, before it is cut.
TILE_BYTES = 64_000_000
#: Hashes of at most so many sets of a block are counted along lists of these sets.
FEW_SETS = 64
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, N_HASHES), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes | None, n_words: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's shingles, with A-Z in lower case; of the whole sequence if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    h = xxhash.xxh64_intdigest
    if len(words) < n_words:
        return np.array([h(joined, 42)], np.uint64)
    return np.array([h(joined[a : b - 1], 42) for a, b in zip(starts, starts[n_words:], strict=False)], np.uint64)


def simhash(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """The fingerprint: bits set in more than half of the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), chunk):
        part = hashes[k : k + chunk].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def minhashes(hashes: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    out = np.full(N_HASHES, bitslice.ONES)
    for k in range(0, len(hashes), chunk):
        part = hashes[k : k + chunk, None] * SEEDS[0] + SEEDS[1]
        np.minimum(out, (part >> np.uint64(7)).min(axis=0), out=out)
    return out


def _fingerprints(n_words: int, signed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column("text"), pa.binary())
            prints, nodes, signs, bands = [], [], [], []
            for t in texts:
                hashes = shingle_hashes(t.as_py(), n_words)
                prints.append(simhash(hashes))
                if signed:
                    hashes = np.unique(hashes)
                    low = minhashes(hashes)
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), 1))
                    signs.append((low & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    cut = low[: BANDS * BAND_ROWS].reshape(BANDS, -1)
                    bands.append([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(cut)])
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(prints, np.uint64).view(np.int64))]
            names = ["doc_id", "text_hash", "fingerprint"]
            if signed:
                flat = pa.array(np.array(bands, np.uint64).reshape(-1).view(np.int64))
                offsets = pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS)
                columns += [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(signs, pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
                names += ["node", "signature", "bands"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fingerprints(docs: DataFrame, n_words: int = 3, signed: bool = False) -> DataFrame:
    """(doc_id, text_hash, fingerprint[, node, signature, bands]) of each row; null texts are empty, empty ones have fingerprint zero.

    node is a hash of the set of the text's shingles.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, fingerprint long" + ", node long, signature binary, bands array<long>" * signed
    return rows.mapInArrow(_fingerprints(n_words, signed), schema)


def _block_masks(n: int, radius: int) -> list[int]:
    """Masks of bits, such that two fingerprints within radius agree on one of them: all choices of m - radius of m cuts of
    the 64 bits, with m as small as leaves blocks of some dozens of n evenly spread fingerprints."""
    m = radius + 1
    while m < radius + 5 and 64 * (m - radius) / m < max(1, n).bit_length() - 6:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    cuts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(cuts, m - radius)]


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, N_HASHES)


def _groups(rows: pa.Table) -> np.ndarray:
    """Where each group of rows of equal (block, key, tile_a, tile_b) begins."""
    key = np.stack([rows.column(i).to_numpy() for i in range(4)])
    return np.nonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))[0]


def _first_reached(radius: int, similarity: float | None):
    """Links (node, other) of each node and the first one of its group that it reaches: by fingerprints, or by signatures only."""

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node = rows.column("node").to_numpy()
        starts = _groups(rows)
        if similarity is None:
            f = rows.column("fingerprint").to_numpy().view(np.uint64)
            root = bitslice.roots(f, starts, radius, None)
        else:
            signs = _signatures(rows)

            def agree(a, b, step=1 << 14):
                parts = [(signs[a[k : k + step]] == signs[b[k : k + step]]).mean(axis=1) for k in range(0, len(a), step)]
                return np.concatenate(parts) >= similarity

            root = bitslice.roots(np.zeros(len(node), np.uint64), starts, 0, agree)
        moved = np.nonzero(root != np.arange(len(root)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["node", "other"])

    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets of hashes."""
    return len(np.intersect1d(a, b, assume_unique=True))


class _Overlaps:
    """Sizes of the intersections of each of some sets with others of them, exactly and without a step for each pair.

    Hashes that no other set holds count for nothing. Those of a few sets are counted along the lists of the sets that hold them; the others are
    bits of a row for each set, one for each hash, of which there are the fewer the more sets hold them.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        at, owner = at.astype(np.int32), np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        rare = (counts > 1) & (counts <= FEW_SETS)
        number = np.cumsum(rare) - 1
        held = rare[at]
        # sets of each rare hash, and rare hashes of each set
        self.tokens, owners = number[at[held]], owner[held]
        self.holders = owners[np.argsort(self.tokens, kind="stable")]
        self.begins = np.concatenate([[0], np.cumsum(counts[rare])])
        self.own = np.searchsorted(owners, np.arange(len(sets) + 1))
        self.n_rare = np.diff(self.own)
        often = counts > FEW_SETS
        number = np.cumsum(often) - 1
        self.bits = np.zeros((len(sets), -(-int(often.sum()) // 8)), np.uint8)
        self.n_often = np.zeros(len(sets), np.int64)
        for i, (a, b) in enumerate(itertools.pairwise([0, *np.cumsum(self.sizes).tolist()])):
            mine = at[a:b][often[at[a:b]]]
            row = np.zeros(int(often.sum()), bool)
            row[number[mine]] = True
            self.bits[i], self.n_often[i] = np.packbits(row), len(mine)

    def similar(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of others whose sets are similar to that of i."""
        total = self.sizes[i] + self.sizes[others]
        need = similarity * total - 1e-9 * (1 + similarity)
        most = np.minimum(self.n_rare[i] + self.n_often[i], self.n_rare[others] + self.n_often[others])
        near = (1 + similarity) * most >= need
        others, need = others[near], need[near]
        if not len(others):
            return others
        mine = self.tokens[self.own[i] : self.own[i + 1]]
        lists = [self.holders[self.begins[t] : self.begins[t + 1]] for t in mine.tolist()]
        common = np.bincount(np.concatenate(lists), minlength=len(self.sizes))[others] if lists else np.zeros(len(others), np.int64)
        near = (1 + similarity) * (common + np.minimum(self.n_often[i], self.n_often[others])) >= need
        others, need, common = others[near], need[near], common[near]
        step = max(1, (1 << 24) // max(1, self.bits.shape[1]))
        for k in range(0, len(others), step):
            common[k : k + step] += np.bitwise_count(self.bits[others[k : k + step]] & self.bits[i]).sum(axis=1, dtype=np.int64)
        # two empty sets are similar
        return others[(1 + similarity) * common >= need]


def _links_apart(similarity: float):
    """Links (node, other) that join the components of a group: pairs of different ones whose sets are similar, exactly, fewer than rows.

    Pairs whose signatures agree too little are passed over; all other pairs of parts that are still apart are compared, those of one set at a time.
    """

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, part = rows.column("node").to_numpy(), rows.column("part").to_numpy().copy()
        signs = _signatures(rows)
        held = rows.column("shingles")
        found = []
        for start, end in itertools.pairwise([*_groups(rows).tolist(), len(node)]):
            own = part[start:end]
            if not (own != own[0]).any():
                continue
            overlaps = _Overlaps([np.frombuffer(x.as_py(), np.uint64) for x in held.slice(start, end - start)])
            for i in range(end - start - 1):
                others = i + 1 + np.nonzero(own[i + 1 :] != own[i])[0]
                if len(others):
                    others = others[(signs[start + others] == signs[start + i]).mean(axis=1) >= similarity - SLACK]
                for j in overlaps.similar(i, others, similarity).tolist() if len(others) else ():
                    if own[j] != own[i]:
                        found.append((node[start + i], node[start + j]))
                        own[own == own[j]] = own[i]
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "other"])

    return links


def _by_group(links):
    """links() of rows (block, key, tile_a, tile_b, node, ...), sorted by the first four, a few whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(4)])
            changes = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
            before = [x.column(i)[-1].as_py() for x in held[-1:] for i in range(4)]
            if held and before != key[:, 0].tolist():
                yield from links(pa.Table.from_batches(held))
                held = []
            cut = int(changes[-1]) if len(changes) else 0
            if cut:
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def _deal(blocks: DataFrame, tile: int, carried: DataFrame | None = None) -> DataFrame:
    """Rows (block, key, tile_a, tile_b, ...) of blocks (block, key, node, ...), groups of these four together.

    A block of more than tile rows is cut by a hash of the nodes, and each pair of its tiles is a group by itself. carried (node, ...) is joined to the
    rows that are dealt; then blocks have a column size, the bytes that a node carries, and blocks of more than TILE_BYTES are cut too.
    """
    n = [F.count(F.lit(1)) / tile, *([F.sum("size") / TILE_BYTES] if carried is not None else [])]
    large = blocks.groupBy("block", "key").agg((F.greatest(*n) if n[1:] else n[0]).alias("n")).filter(F.col("n") > 1)
    large = materialize(large.withColumn("tiles", F.ceil(2 * F.col("n")).cast("int")).drop("n"), "large-blocks")
    rest = [c for c in blocks.columns if c not in ("block", "key", "size")]
    if large.isEmpty():
        dealt = blocks.select("block", "key", F.lit(0).alias("tile_a"), F.lit(0).alias("tile_b"), *rest)
    else:
        cut = blocks.join(large, ["block", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.hash("node"), F.col("tiles"))).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        # of three tiles or more, a tile need not meet itself again: every pair of tiles holds its own pairs
        cut = cut.filter("tiles = 1 or own != other")
        dealt = cut.select("block", "key", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), *rest)
    keys = ["block", "key", "tile_a", "tile_b"]
    if carried is not None:
        dealt = dealt.join(carried, "node").select(*keys, "node", *[c for c in rest if c != "node"], *[c for c in carried.columns if c != "node"])
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def block_links(blocks: DataFrame, radius: int, similarity: float | None, tile: int = 8192) -> DataFrame:
    """Links (node, other) between rows of a block (block, key, node, fingerprint or signature), fewer than rows."""
    return _deal(blocks, tile).mapInArrow(_by_group(_first_reached(radius, similarity)), "node long, other long")


def _bitmap(rows: DataFrame, n_bits: int = 1 << 26) -> np.ndarray:
    """Bits of the text hashes in rows, modulo n_bits: 8 MB, whatever the input."""
    bit = rows.select(F.pmod("text_hash", F.lit(n_bits)).alias("b"))
    parts = bit.groupBy(F.expr("b div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits"))
    out = np.zeros((n_bits // 32768, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _sets(n_words: int, bitmap: np.ndarray):
    """Sets of the shingles of texts whose bit is set: all that are sought, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("text_hash").to_numpy() & (8 * len(bitmap) - 1)
            batch = batch.filter(pa.array(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1))
            texts = pc.cast(batch.column("text"), pa.binary())
            sets = [np.unique(shingle_hashes(t.as_py(), n_words)).tobytes() for t in texts]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "shingles"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("shingles"), batch.column("others"), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
                common = _common(a, b)
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield batch.select(["node", "other"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, other) whose sets in sets(node, shingles) are similar by that much, exactly."""
    pairs = pairs.select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()
    held = pairs.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("others")), "other")
    return held.select("node", "other", "shingles", "others").mapInArrow(_similar(similarity), "node long, other long")


def _fingerprint_links(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links (node, other) of prints (node, fingerprint) that differ in radius bits or fewer: each row's to the first one of a block that it reaches."""
    masks = [F.lit(m - (1 << 64) if m >> 63 else m) for m in _block_masks(prints.count(), radius)]
    keys = F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(m) for m in masks]))
    return block_links(prints.select(keys.alias("block", "key"), "node", "fingerprint"), radius, None, tile)


def _similar_roots(docs: DataFrame, classes: DataFrame, prints: DataFrame, n_words: int, radius: int, similarity: float, tile: int) -> DataFrame:
    """(node, root) of classes (node, doc_id, text_hash, signature, bands) that are linked to a smaller one; prints are their (node, fingerprint).

    First each class is compared with the first one whose fingerprint links with its own, and with the first one of a block that it seems to reach, which
    joins most copies; then all pairs of a block that are candidates and still apart, in the tasks that hold the block's sets.
    """
    printed = _fingerprint_links(prints, radius, tile).filter("node != other").distinct()
    printed = materialize(printed, "fingerprint-links")
    keys = classes.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    blocks = materialize(keys.join(shared, "key"), "band-blocks")
    signed = blocks.join(classes.select("node", "signature"), "node").select(F.lit(0).alias("block"), "key", "node", "signature")
    sought = blocks.select("node").union(printed.select("node")).union(printed.select("other"))
    met = sought.distinct().join(classes.select("node", "doc_id", "text_hash"), "node")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = materialize(met, "met-classes")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = rows.mapInArrow(_sets(n_words, _bitmap(met)), f"doc_id {kind}, text_hash long, shingles binary")
    sets = null_safe(sets, met, ["doc_id", "text_hash"], "inner").select("node", "shingles").dropDuplicates(["node"])
    sets = materialize(sets, "shingle-sets")
    roots = connected_components(similar_pairs(printed.union(block_links(signed, 0, similarity, tile)), sets, similarity))
    roots = materialize(roots.select("node", F.col("root").alias("part")), "first-components")
    parts = blocks.join(roots, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a != b").select("key")
    size = sets.select("node", F.octet_length("shingles").alias("size"))
    apart = parts.join(mixed, "key").join(size, "node").select(F.lit(0).alias("block"), "key", "node", "part", "size")
    # sets meet in the blocks, and only links that join components leave them: pairs that are nearly similar are never rows
    dealt = _deal(materialize(apart, "blocks-apart"), tile, sets.join(classes.select("node", "signature"), "node"))
    links = materialize(dealt.mapInArrow(_by_group(_links_apart(similarity)), "node long, other long"), "links-apart")
    if links.isEmpty():
        return roots.withColumnRenamed("part", "root")
    own = roots.union(links.select("node", "other"))
    return connected_components(own)


def near_duplicates(
    docs: DataFrame, n_words: int = 3, radius: int = 3, similarity: float | None = None, tile: int = 8192
) -> DataFrame:
    """One row (doc_id, text_hash, fingerprint, root, component_id) for each row of docs: root names the component, component_id is its smallest doc_id.

    Without similarity, fingerprints link if they differ in radius bits or fewer, exactly. With it, these links are candidates only, next to those of minimum hashes, and documents
    link if the sets of their shingles are similar (Jaccard) by that much, exactly; pairs that neither finds, at most about
    1 in 10,000 at 0.8 and fewer above, are missed. Null texts are empty; documents without words have fingerprint zero, are equal to
    each other, and link like others. Rows that repeat a text share a component; null doc_ids count for none, so that a
    component of them alone has id null. Other columns of docs are not used.
    """
    signed = similarity is not None
    marked = fingerprints(docs, n_words, signed)
    marked = materialize(marked if signed else marked.withColumn("node", F.col("fingerprint")), "fingerprints")
    if signed:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")
        carried = [F.any_value(c).alias(c) for c in ("signature", "bands")]
        classes = marked.groupBy("node").agg(first, *carried).select("node", "k.doc_id", "k.text_hash", "signature", "bands")
        classes = materialize(classes.withColumn("first_id", F.col("doc_id")), "set-classes")
        prints = materialize(marked.select("node", "fingerprint").distinct(), "set-fingerprints")
        roots = _similar_roots(docs, classes, prints, n_words, radius, similarity, tile)
    else:
        classes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("fingerprint").alias("fingerprint"))
        classes = materialize(classes, "fingerprint-classes")
        roots = connected_components(_fingerprint_links(classes.select("node", "fingerprint"), radius, tile))
    placed = classes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.select("node", "root").join(smallest, "root")
    return marked.join(placed, "node").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, components: DataFrame) -> DataFrame:
    """docs without all but one row of each component: the one of the smallest doc_id, then the smallest hash of its text. All columns stay."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = components.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", F.col("k.text_hash").alias("__text_hash")).distinct()
    marked = docs.withColumn("__text_hash", F.xxhash64("text"))
    joined = null_safe(marked, kept, ["doc_id", "__text_hash"], "inner")
    return joined.dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
