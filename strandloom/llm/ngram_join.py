"""Documents whose sets of word n-grams are similar, exactly, by a join of prefix trees.

N-grams are ordered by the number of different sets that hold them, rarest first. Those that the very same sets hold (told by that number and
by a sum over the sets) count as one with a weight, so that a set is a short list of weights in that order. N-grams of one set
only come first and match nothing. Two sets of the wanted similarity share an n-gram among the first few of both, so sets are dealt by these, and
a set of which too few n-grams are shared at all is dealt nowhere.
In a group, the lists are stored in a trie whose paths are common beginnings. A set is searched by carrying its overlap down the paths:
sets that begin alike share it, and a subtree is left as soon as what remains of it and of the set can't reach the overlap that their sizes need.

N-grams travel as 64-bit hashes in packed arrays, once, to ranges of hashes in which they are counted. Those that hold a large share of a sample of
documents don't travel: they are counted where sets are gathered. The sample decides on the way only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_starts, materialize, ship, whole_groups
from .components import connected_components

ship(__name__, "strandloom.llm.common")

#: Documents sampled for frequent n-grams (the larger of a number and a share), and in how many of these an n-gram is frequent: so one that is not is in fewer
#: than 2,000,000 documents, whatever their number.
SAMPLE, SAMPLE_SHARE, FREQUENT = 4000, 1e-5, 20
#: N-grams that a task packs at a time, and of a range.
CHUNK, RANGE = 1 << 21, 1 << 21
#: Sets of a trie.
TILE = 1024
#: Odd multipliers of the words of an n-gram.
MULTIPLIERS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
GROUP = ["sig", "tile_a", "tile_b"]
ITEM = np.dtype([("order", "<i8"), ("weight", "<i4")])
ROUTE = [("sig", pa.int64()), ("at", pa.int32()), ("before", pa.int64())]


def gram_hashes(text: bytes | None, n_words: int) -> np.ndarray:
    """64-bit hashes of the text's n-grams of words, with A-Z in lower case; of the whole sequence if it has fewer words. n_words is 64 at most."""
    words = (text or b"").lower().split()
    n = min(n_words, len(words))
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = len(words) - n + 1
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out += each[k : k + count] * MULTIPLIERS[k]
    for shift, factor in ((33, MULTIPLIERS[-1]), (29, MULTIPLIERS[-2])):
        out ^= out >> np.uint64(shift)
        out *= factor
    return out ^ (out >> np.uint64(32))


def _sets(texts, n_words: int) -> Iterator[np.ndarray]:
    for t in pc.cast(texts, pa.binary()):
        yield np.unique(gram_hashes(t.as_py(), n_words))


def _places(frequent: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of grams are frequent, and where among the frequent ones."""
    if not len(frequent):
        return np.zeros(len(grams), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    known = frequent[at] == grams
    return known, at[known]


def _name(grams: np.ndarray) -> int:
    """A hash of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 1)).view(np.int64))


def _sampled(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in _sets(batch.column("text"), n_words):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return run


def frequent_grams(docs: DataFrame, n_words: int) -> np.ndarray:
    """The n-grams of FREQUENT documents of a sample or more, sorted."""
    share = max(SAMPLE / max(docs.count(), 1), SAMPLE_SHARE)
    steps = 1 << 40
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).filter(F.pmod("h", F.lit(steps)) < int(min(share, 1) * steps))
    counted = rows.select("text").mapInArrow(_sampled(n_words), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    held = [r["gram"] for r in counted.filter(F.col("n") >= FREQUENT).select("gram").toLocalIterator()]
    return np.sort(np.array(held, np.int64).view(np.uint64))


def _described(n_words: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, held = [], [], []
            for grams in _sets(batch.column("text"), n_words):
                size.append(len(grams))
                node.append(_name(grams))
                held.append(_places(frequent, grams)[1].astype(np.uint32).tobytes())
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "frequent"])

    return run


def _packed(n_words: int, frequent: np.ndarray, bits: int):
    """Rows (range, grams, owners, nodes) of the n-grams that are not frequent, cut by their first bits: owners are places in nodes."""

    def pack(grams: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(grams)
        order = np.argsort(flat)
        flat, owner = flat[order], np.repeat(np.arange(len(nodes)), [len(g) for g in grams])[order]
        edges = np.searchsorted(flat >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
        names = np.array(nodes, np.int64)
        out = []
        for r in np.nonzero(edges[1:] > edges[:-1])[0].tolist():
            own, place = np.unique(owner[edges[r] : edges[r + 1]], return_inverse=True)
            short = np.uint16 if len(own) <= 1 << 16 else np.uint32
            # steps between sorted hashes, byte by byte, so that the bytes that are mostly zero compress
            steps = np.diff(flat[edges[r] : edges[r + 1]], prepend=np.uint64(0))
            out.append((r, steps.view(np.uint8).reshape(-1, 8).T.tobytes(), place.astype(short).tobytes(), names[own].tobytes()))
        columns = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["range", "grams", "owners", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for grams in _sets(batch.column("text"), n_words):
                node = _name(grams)
                grams = grams[~_places(frequent, grams)[0]]
                if len(grams) and node not in held:
                    held[node] = grams
                    n += len(grams)
                if n >= CHUNK:
                    yield from pack(list(held.values()), list(held))
                    held, n = {}, 0
        if held:
            yield from pack(list(held.values()), list(held))

    return run


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    grams, nodes = [], []
    for g, o, names in zip(*(rows.column(c) for c in ("grams", "owners", "nodes")), strict=True):
        g, o = g.as_py(), o.as_py()
        grams.append(np.frombuffer(g, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1).cumsum(dtype=np.uint64))
        nodes.append(np.frombuffer(names.as_py(), np.int64)[np.frombuffer(o, np.uint16 if len(o) * 4 == len(g) else np.uint32)])
    return np.concatenate(grams), np.concatenate(nodes)


def shared_weights(grams: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, df, sig, weight): how many of the n-grams of a node are held by the same df sets, two or more, whose sum is sig. Pairs may repeat."""
    order = np.argsort(grams, kind="stable")
    grams, nodes = grams[order], nodes[order]
    edge = np.append(True, grams[1:] != grams[:-1])
    shared = ~(edge & np.append(edge[1:], True))
    grams, nodes = grams[shared], nodes[shared]
    order = np.lexsort((nodes, grams))
    grams, nodes = grams[order], nodes[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1]))[: len(grams)]
    grams, nodes = grams[new], nodes[new]
    first = np.nonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])[0]
    if not len(first):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    df = np.diff(np.append(first, len(grams)))
    sig = np.add.reduceat(nodes, first)
    df_of, sig_of = np.repeat(df, df), np.repeat(sig, df)
    keep = df_of > 1
    nodes, df_of, sig_of = nodes[keep], df_of[keep], sig_of[keep]
    order = np.lexsort((df_of, sig_of, nodes))
    nodes, df_of, sig_of = nodes[order], df_of[order], sig_of[order]
    begins = np.append(True, (nodes[1:] != nodes[:-1]) | (sig_of[1:] != sig_of[:-1]) | (df_of[1:] != df_of[:-1]))[: len(nodes)]
    at = np.nonzero(begins)[0]
    return nodes[at], df_of[at], sig_of[at], np.diff(np.append(at, len(nodes)))


WEIGHTS = "node long, df long, sig long, weight long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["range"], rows=1 << 30, size=8 * RANGE):
        columns = shared_weights(*_unpacked(rows))
        yield from pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["node", "df", "sig", "weight"]).to_batches(1 << 16)


def _frequent_sums(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, sig = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for node, held in zip(batch.column("node").to_pylist(), batch.column("frequent").to_pylist(), strict=True):
                at = np.frombuffer(held, np.uint32)
                df[at] += 1
                sig[at] += np.int64(node)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(sig[at])], ["gram", "df", "sig"])

    return run


def _frequent_weights(df: np.ndarray, sig: np.ndarray):
    """Rows of WEIGHTS of the frequent n-grams of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, held in zip(batch.column("node").to_pylist(), batch.column("frequent").to_pylist(), strict=True):
                at = np.frombuffer(held, np.uint32)
                at = at[df[at] > 1]
                pair, weight = np.unique(np.stack([df[at], sig[at]]), axis=1, return_counts=True)
                out.append((np.full(len(weight), node), *pair, weight))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "df", "sig", "weight"])

    return run


def _listed(percent: int):
    """Rows (node, n, items, routes) of sets as lists of ITEM, in order: by the magnitude of df, then by sig.

    A route (sig, at, before) is an item that may be the first one that the set shares with a similar set: its place in the list, and the n-grams before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, routes = [], []
            for n, held in zip(batch.column("n").to_pylist(), batch.column("items"), strict=True):
                df, sig, weight = (x.to_numpy() for x in held.values.flatten())
                size = np.minimum(4 * np.log2(df), 127).astype(np.int64)
                order, place = np.unique(size << 56 | sig & ((1 << 56) - 1), return_inverse=True)
                items = np.empty(len(order), ITEM)
                items["order"], items["weight"] = order, np.bincount(place.reshape(-1), weight)
                first = n - -(-percent * n // 100) + 1
                upto = np.cumsum(items["weight"], dtype=np.int64)
                before = n - upto[-1] + upto - items["weight"]
                packed.append(items.tobytes())
                routes.append([(int(order[i]), i, int(before[i])) for i in np.nonzero(before < first)[0].tolist()])
            columns = [batch.column("node"), batch.column("n"), pa.array(packed, pa.binary()), pa.array(routes, pa.list_(pa.struct(ROUTE)))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "items", "routes"])

    return run


class Trie:
    """Weighted sets in one order, with components of similar ones. A place holds, of all sets beneath it, the least and largest size, the most weight ahead, and their component if it is one."""

    __slots__ = ("below", "sets", "weight", "least", "most", "ahead", "only")

    def __init__(self, weight: int = 0):
        self.below: dict[int, Trie] = {}
        self.sets: list[tuple[int, int]] = []
        self.weight, self.least, self.most, self.ahead, self.only = weight, 1 << 62, 0, 0, None


def similar_links(sets: list[tuple[int, int, int, list[int], list[int]]], percent: int) -> list[tuple[int, int]]:
    """Links (node, other) that join the components of sets (node, part, size, ranks, weights): pairs of different parts whose Jaccard similarity
    is percent or more, exactly, fewer than sets. ranks ascend; size counts n-grams too that are not among them, which no two sets share."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    found, top = [], Trie()
    for node, part, size, ranks, weights in sorted(sets, key=lambda s: (s[3], s[0])):
        rest = [0]
        for w in reversed(weights):
            rest.append(rest[-1] + w)
        rest.reverse()
        own = root(part)
        stack = [(top, 0, 0)]
        while stack:
            at, i, overlap = stack.pop()
            if at.only is not None and root(at.only) == own:
                continue
            for other, n, other_part in at.sets:
                if 100 * overlap >= percent * (size + n - overlap) and root(other_part) != own:
                    found.append((node, other))
                    above[root(other_part)] = own
            for rank, below in at.below.items():
                # sizes too far apart, or too little left of either, for 100 * overlap >= percent * union
                if 100 * below.most < percent * size or percent * below.least > 100 * size:
                    continue
                j = bisect_left(ranks, rank, i)
                same = j < len(ranks) and ranks[j] == rank
                now = overlap + below.weight if same else overlap
                j += same
                if (100 + percent) * (now + min(rest[j], below.ahead)) >= percent * (size + below.least):
                    stack.append((below, j, now))
        at = top
        for k in range(len(ranks) + 1):
            at.least, at.most, at.ahead = min(at.least, size), max(at.most, size), max(at.ahead, rest[k])
            if at.only is None:
                at.only = own if not at.sets and not at.below else None
            elif root(at.only) != own:
                at.only = None
            if k < len(ranks):
                at = at.below.setdefault(ranks[k], Trie(weights[k]))
        at.sets.append((node, size, part))
    return found


def _links(percent: int):
    """Links (node, other) within groups of rows (sig, tile_a, tile_b, node, part, n, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, GROUP, rows=1 << 14):
            starts = [*group_starts(rows, GROUP).tolist(), rows.num_rows]
            node, part, n = (rows.column(c).to_pylist() for c in ("node", "part", "n"))
            items = [np.frombuffer(x, ITEM) for x in rows.column("items").to_pylist()]
            found = []
            for s, e in zip(starts, starts[1:], strict=False):
                if e - s < 2:
                    continue
                flat = np.concatenate(items[s:e])
                rank, weight, at, sets = flat["order"].tolist(), flat["weight"].tolist(), 0, []
                for i in range(s, e):
                    upto = at + len(items[i])
                    sets.append((node[i], part[i], n[i], rank[at:upto], weight[at:upto]))
                    at = upto
                found += similar_links(sets, percent)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "other"])

    return run


def weighted_sets(docs: DataFrame, classes: DataFrame, n_words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(node, n, items) of classes(node, n, frequent) of whose n-grams percent or more are in other sets too: items are their weights (df, sig, weight)."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(6, (total // RANGE).bit_length())
    packed = docs.select("text").mapInArrow(_packed(n_words, frequent, bits), "range long, grams binary, owners binary, nodes binary")
    weights = packed.repartition("range").sortWithinPartitions("range").mapInArrow(_shared, WEIGHTS)
    if len(frequent):
        held = classes.filter(F.octet_length("frequent") > 0).select("node", "frequent")
        df, sig = np.zeros(len(frequent), np.int64), np.zeros(len(frequent), np.int64)
        sums = held.mapInArrow(_frequent_sums(len(frequent)), "gram long, df long, sig long")
        for r in sums.groupBy("gram").agg(F.sum("df").alias("df"), F.expr("sum(cast(sig as decimal(38, 0)))").alias("sig")).toLocalIterator():
            df[r["gram"]], sig[r["gram"]] = r["df"], (int(r["sig"]) + (1 << 63)) % (1 << 64) - (1 << 63)
        weights = weights.union(held.mapInArrow(_frequent_weights(df, sig), WEIGHTS))
    items = weights.groupBy("node").agg(F.sum("weight").alias("shared"), F.collect_list(F.struct("df", "sig", "weight")).alias("items"))
    return items.join(classes.select("node", "n"), "node").filter(F.col("shared") * 100 >= F.col("n") * percent).select("node", "n", "items")


def _joined(lists: DataFrame, routes: DataFrame, percent: int, tile: int, last: bool) -> DataFrame:
    """Links (node, other) between sets of lists that meet in routes (sig, at, before, node, n, part), whose lists travel from place at on.

    Groups of more than tile sets are cut in tiles: each two tiles are a group by themselves in the last round, before that each tile with the smallest node of all.
    A set stays away where too little of it is left for the smallest set of the group.
    """
    groups = routes.groupBy("sig").agg(F.min("n").alias("least"))
    routes = routes.join(groups, "sig").filter(F.expr(f"{100 + percent} * (n - before) >= {percent} * (n + least)")).drop("least")
    tiles = F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")
    groups = routes.groupBy("sig").agg(tiles, F.min("node").alias("pivot"), F.min("part").alias("a"), F.max("part").alias("b")).filter("a != b").drop("a", "b")
    dealt = routes.join(groups, "sig").withColumn("own", F.pmod(F.hash("node"), F.col("tiles")))
    every = F.expr("sequence(0, tiles - 1)")
    if last:
        # of two tiles or more, every pair of tiles holds its own pairs
        dealt = dealt.withColumn("other", F.explode(every)).filter("tiles = 1 or own != other")
        dealt = dealt.withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")})
    else:
        dealt = dealt.withColumn("tile_a", F.explode(F.when(F.col("node") == F.col("pivot"), every).otherwise(F.array("own")))).withColumn("tile_b", F.col("tile_a"))
    tail = F.expr(f"substring(items, at * {ITEM.itemsize} + 1)").alias("items")
    dealt = dealt.select(*GROUP, "node", "part", "at").join(lists.select("node", "n", "items"), "node").select(*GROUP, "node", "part", "n", tail)
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return materialize(dealt.mapInArrow(_links(percent), "node long, other long"), "ngram-links")


def similar_roots(sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """(node, root) of the sets (node, n, items) that are linked to a smaller node.

    First each set meets others in the largest group of its routes alone, with its whole list, which joins most copies. Then all routes count, of the groups
    in which several components are left: two similar sets share nothing before their first common route, so lists travel from there on.
    """
    lists = sets.mapInArrow(_listed(percent), "node long, n long, items binary, routes array<struct<sig: long, at: int, before: long>>")
    lists = materialize(lists, "ngram-lists")
    routes = lists.select(F.inline("routes"), "node", "n")
    sizes = routes.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"))
    largest = routes.join(sizes, "sig").groupBy("node", "n").agg(F.max(F.struct("rows", "sig"))["sig"].alias("sig"))
    largest = largest.select("sig", F.lit(0).alias("at"), F.lit(0).cast("long").alias("before"), "node", "n", F.col("node").alias("part"))
    roots = materialize(connected_components(_joined(lists, largest, percent, tile, last=False)), "ngram-roots")
    routes = routes.join(roots, "node", "left").select("sig", "at", "before", "node", "n", F.coalesce("root", "node").alias("part"))
    more = _joined(lists, materialize(routes, "ngram-routes"), percent, tile, last=True)
    if more.isEmpty():
        return roots
    return connected_components(roots.union(more))


def ngram_components(docs: DataFrame, n_words: int = 5, percent: int = 80, tile: int = TILE) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    The set of a text are its different n-grams of words, with A-Z in lower case; of a text with fewer words, the whole sequence. Two documents link if 100 *
    intersection >= percent * union, exactly but for equal 64-bit hashes of different n-grams. component_id is the smallest doc_id that links lead to. Null
    and empty texts have no n-grams and link with nothing, so that their component is their own doc_id. Rows that repeat a text are alike and share a component;
    null doc_ids count for none. Other columns are not used.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    frequent = frequent_grams(docs, n_words)
    described = docs.mapInArrow(_described(n_words, frequent), f"doc_id {kind}, n_shingles long, node long, frequent binary")
    described = materialize(described, "ngram-sets")
    held = described.filter("n_shingles > 0").groupBy("node")
    classes = held.agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.max("frequent").alias("frequent"))
    classes = materialize(classes, "ngram-classes")
    roots = similar_roots(weighted_sets(docs, classes, n_words, percent, frequent), percent, tile)
    placed = classes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(smallest, "root").select("node", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return described.join(placed, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))
