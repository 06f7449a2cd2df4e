"""Benchmark decontamination: rare n-gram seeds of test items, then local alignment.

Seeds are pairs of words that stand next to each other or one apart. An alignment that reaches the least score lines up a known
number of an item's pairs with pairs of the text, whatever was inserted, left out or replaced. So a part of an item's pairs, the
most frequent ones, can be left out of the seeds, and a stated number of seeds must still be hit close together: no passage of the
least score is lost. A first pass counts in how many documents each pair stands; a second one looks the seeds up and
aligns the item with the words around hits by Smith-Waterman. Texts stay where they are read; only counts and
matches are shuffled. Items are dealt in blocks of bounded size, and both passes go over all documents for each block.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship

ship(__name__)

WORD = re.compile(r"[^\W_]+")
MATCH, MISS, GAP = 2, -1, -1
#: Stands between texts.
END = -1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Items:
    """Test items as word numbers; the code of a pair of words is one integer."""

    def __init__(self, items: list[tuple[object, str]], min_words: int, min_score: float):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if len(w) >= max(3, min_words)]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.base = len(self.number) + 1
        self.ids = [i for i, _ in split]
        self.items = [np.array([self.number[w] for w in ws], np.int64) for _, ws in split]
        self.min_score = min_score

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of neighbours and of words one apart whose words are in items, and the places of their first words."""
        codes, places = [], []
        for gap in (1, 2):
            a, b = numbers[:-gap], numbers[gap:]
            at = np.nonzero((a > 0) & (b > 0))[0]
            if gap == 2:
                at = at[numbers[at + 1] != END]  # not over the end of a text
            codes.append(a[at] * self.base + b[at])
            places.append(at)
        return np.concatenate(codes), np.concatenate(places)

    def slack(self, n: int) -> int:
        """How many operations an alignment of the least score with an item of n words can have at most."""
        return int(2 * n * (1 - self.min_score) + 1e-9)

    def least_pairs(self, n: int) -> int:
        """How many pairs of an item of n words an alignment of the least score s lines up with pairs of the text.

        Of M equal words, with E words inserted, left out or replaced, 2 M - E >= 2 s n. Between neighbours of the M words that are
        over one apart, in the item or in the text, lie two operations or more, so at most M - s n times; M - 1 less that is s n - 1.
        """
        return math.ceil(self.min_score * n - 1e-9) - 1

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts, each followed by END, and where each begins; zero are words of no item.

        Different pieces between spaces are taken apart once a batch, however often they stand.
        """
        pieces = pc.ascii_split_whitespace(texts.fill_null(""))
        encoded = pieces.flatten().dictionary_encode()
        get = self.number.get
        parts = [(get(p.lower(), 0),) if p.isalnum() else [get(w, 0) for w in WORD.findall(p.lower())] for p in encoded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        values = np.fromiter((n for p in parts for n in p), np.int64, int(sizes.sum()))
        firsts = np.cumsum(sizes) - sizes
        at = encoded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - n, n)
        numbers = values[np.repeat(firsts[at], n) + inside]
        text = np.repeat(np.arange(len(texts)), np.diff(pieces.offsets.to_numpy()))
        words_of = np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)
        begins = np.cumsum(words_of) - words_of + np.arange(len(texts))
        out = np.full(total + len(texts), END, np.int64)
        out[np.arange(total) + np.repeat(np.arange(len(texts)), words_of)] = numbers
        return out, begins


def _counts(items: Items):
    grams = np.unique(np.concatenate([items.pairs(x)[0] for x in items.items])) if items.items else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, begins = items.flat(batch.column("text"))
            code, at = items.pairs(numbers)
            known = np.minimum(np.searchsorted(grams, code), max(0, len(grams) - 1))
            held = grams[known] == code if len(grams) else np.zeros(len(code), bool)
            doc = np.searchsorted(begins, at[held], "right")
            once = np.unique(known[held] * (len(begins) + 1) + doc)
            number, n = np.unique(once // (len(begins) + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams[number], pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return run


@dataclass
class Seeds:
    """Sorted codes; for each of them its uses by items begin at first, up to the next one's."""

    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    #: Hits of each item's seeds that must stand close together.
    hits: np.ndarray


def choose_seeds(items: Items, docs_with: dict[int, int]) -> Seeds:
    """The rarest pairs of each item: all but half of as many as an alignment of the least score lines up. Ties go by place.

    So such an alignment hits at least the other half of these; where it lines up none for sure (of scores of 2 / n or less), all pairs are seeds.
    """
    uses, hits = [], []
    for k, item in enumerate(items.items):
        codes = items.pairs(item)[0].tolist()
        sure = items.least_pairs(len(item))
        left_out = max(0, sure // 2)
        order = sorted(range(len(codes)), key=lambda p: (docs_with.get(codes[p], 0), p))
        uses += [(codes[p], k) for p in order[: len(codes) - left_out]]
        hits.append(max(1, sure - left_out))
    table = np.array(sorted(set(uses)), np.int64).reshape(-1, 2)
    codes, first = np.unique(table[:, 0], return_index=True)
    return Seeds(codes, np.append(first, len(table)), table[:, 1], np.array(hits, np.int64))


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of the two, and where it ends in part (exclusive)."""
    row = np.zeros(len(part) + 1, np.int64)
    steps = np.arange(len(part) + 1) * -GAP
    best, end = 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(part == word, MATCH, MISS))
        row = np.maximum.accumulate(new + steps) - steps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def _windows(items: Items, seeds: Seeds, numbers: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, from, to): stretches of words around enough hits of an item's seeds close together, in order."""
    code, at = items.pairs(numbers)
    if not len(seeds.codes) or not len(code):
        return
    known = np.minimum(np.searchsorted(seeds.codes, code), len(seeds.codes) - 1)
    held = seeds.codes[known] == code
    known, at = known[held], at[held]
    n = seeds.first[known + 1] - seeds.first[known]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, at = seeds.item[np.repeat(seeds.first[known], n) + inside], np.repeat(at, n)
    doc = np.searchsorted(begins, at, "right") - 1
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    size = np.array([len(x) for x in items.items], np.int64)
    reach = size + np.array([items.slack(int(m)) for m in size], np.int64)  # words of text that an alignment covers at most
    last = np.arange(len(at)) + seeds.hits[item] - 1
    some = last < len(at)
    a, z = np.nonzero(some)[0], last[some]
    close = (doc[a] == doc[z]) & (item[a] == item[z]) & (at[z] - at[a] <= reach[item[a]])
    a, z = a[close], z[close]
    ends = np.append(begins[1:], len(numbers)) - 1
    low, high = np.maximum(begins[doc[a]], at[z] - reach[item[a]]), np.minimum(ends[doc[a]], at[a] + reach[item[a]] + 2)
    held_by = None
    for d, k, p, q in zip(doc[a].tolist(), item[a].tolist(), low.tolist(), high.tolist(), strict=True):
        if held_by and held_by[:2] == (d, k) and p <= held_by[3]:
            held_by = (d, k, min(p, held_by[2]), max(q, held_by[3]))
            continue
        if held_by:
            yield held_by
        held_by = (d, k, p, q)
    if held_by:
        yield held_by


def _matches(items: Items, seeds: Seeds, numbers: np.ndarray, begins: np.ndarray):
    """(document, item, score, first word, last word) of the texts in numbers; the best place of each item in a document."""
    for (doc, k), spans in itertools.groupby(_windows(items, seeds, numbers, begins), lambda x: x[:2]):
        item, best = items.items[k], (0, 0, 0)
        listed, need = item.tolist(), items.min_score * MATCH * len(item) - 1e-9
        for _, _, a, b in spans:
            held = set(numbers[a:b].tolist())
            if MATCH * sum(w in held for w in listed) < need:  # no alignment scores more
                continue
            score, end = align(item, numbers[a:b])
            if score > best[0]:
                best = (score, a, a + end)
        if best[0] >= max(need, 1):
            score, a, end = best
            _, back = align(item[::-1], numbers[a:end][::-1])
            yield doc, items.ids[k], score / (MATCH * len(item)), end - back - int(begins[doc]), end - 1 - int(begins[doc])


def _find(items: Items, seeds: Seeds, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "score", "first_word", "last_word"]
        for batch in batches:
            found = list(_matches(items, seeds, *items.flat(batch.column("text"))))
            columns = list(zip(*found, strict=True)) or [()] * 5
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            types = [kind, pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names)

    return run


def _keep(items: Items, seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = {x[0] for x in _matches(items, seeds, *items.flat(batch.column("text")))}
            yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, min_score: float, min_words: int, block_chars: int):
    """Items and seeds of each block of the benchmark; blocks hold block_chars characters in the mean."""
    size = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = size // block_chars + 1
    for b in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").distinct()
        items = Items(sorted(map(tuple, part.collect()), key=str), min_words, min_score)
        counted = docs.select("text").mapInArrow(_counts(items), "code long, n long")
        counts = counted.groupBy("code").agg(F.sum("n").alias("n"))
        # a row for each pair of words of the block's items at most
        yield items, choose_seeds(items, {r["code"]: r["n"] for r in counts.collect()})


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, min_words: int = 5, block_chars: int = 10_000_000
) -> DataFrame:
    """One row (doc_id, item_id, score, first_word, last_word) for each document and item that it holds.

    Words are runs of letters and digits, in lower case. score is that of the best local alignment (2 for equal
    words, -1 for others and for gaps) as a share of the item's with itself; all pairs of min_score or more are returned (of an item of n
    words, if min_score is over 1 / n), with the words of the document it covers, from 0. Items of fewer than min_words words (3 at
    least) and null items match nothing; null and empty texts hold nothing. Equal items with different ids each match; rows that
    repeat an item match once, rows that repeat a document each match. Ids may be of any type, and null. Other columns are not used.
    """
    rows = docs.select("doc_id", "text")
    kind, item = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, score double, first_word long, last_word long"
    blocks = _blocks(rows, benchmark, min_score, min_words, block_chars)
    parts = [rows.mapInArrow(_find(i, s, to_arrow_type(item)), schema) for i, s in blocks]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, min_words: int = 5, block_chars: int = 10_000_000
) -> DataFrame:
    """docs without the rows that benchmark_matches() returns pairs for; no row is shuffled. Rows of null or empty text stay, and so do all other columns."""
    out = docs
    for items, seeds in _blocks(docs, benchmark, min_score, min_words, block_chars):
        out = out.mapInArrow(_keep(items, seeds), docs.schema)
    return out
