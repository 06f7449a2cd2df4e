"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has features: its byte n-grams with marks of its ends (so that prefixes and suffixes count apart) and the
word itself (a lexicon). Weights of features and of transitions between the languages of neighbouring words are
learned from a bounded sample of labelled documents, spliced to code-switched sequences. Forward-backward gives
each word's distribution over languages; a document's language has the largest share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)

LOG_ROWS = 18
NGRAMS = 5
SEGMENT = 128
MIX = np.uint32(2654435761)


def clean(word: str) -> bytes:
    """The word in lower case without other characters than letters at its ends; empty if it has no letter."""
    first, last = 0, len(word)
    while first < last and not word[first].isalpha():
        first += 1
    while last > first and not word[last - 1].isalpha():
        last -= 1
    return word[first:last].lower().encode()


def _rows(h: np.ndarray, salt: int) -> np.ndarray:
    """Rows of the weight table; row zero is no feature."""
    rows = ((h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * MIX) >> np.uint32(32 - LOG_ROWS)
    return np.maximum(rows, np.uint32(1))


def features(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Rows of the weight table for words of at most width bytes: arrays [words, places], zero where there is none."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = b"".join((b"\x02" + w + b"\x03").ljust(width + 2, b"\0") for w in words)
    m = np.frombuffer(text, np.uint8).reshape(len(words), width + 2).astype(np.uint32)
    place = np.arange(width + 2)
    h = m.copy()
    for k in range(1, NGRAMS + 1):
        if k > 1:
            if h.shape[1] == 1:
                break
            h = h[:, :-1] * np.uint32(131) + m[:, k - 1 :]
        yield np.where(place[: h.shape[1]] + k <= n[:, None], _rows(h, k), np.uint32(0))
    whole = np.zeros(len(words), np.uint32)
    for p in range(width + 2):
        whole = np.where(p < n, whole * np.uint32(16777619) + m[:, p], whole)
    yield _rows(whole, 99)[:, None]


def by_width(words: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
    """Places of the words of similar length, and a bound of their length."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    bound = np.where(n <= 8, 8, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    for w in np.unique(bound):
        at = np.nonzero(bound == w)[0]
        step = max(1, (1 << 22) // int(w))
        for k in range(0, len(at), step):
            yield at[k : k + step], int(w)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # [rows, labels]
    transitions: np.ndarray  # [labels, labels], logs

    def scores(self, words: list[bytes], most: int = 1 << 16) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at, width in by_width(words):
            step = max(1, most // len(at))  # places at a time: many of few long words, one of many short ones
            for rows in features([words[i] for i in at], width):
                for j in range(0, rows.shape[1], step):
                    out[at] += self.weights[rows[:, j : j + step]].sum(axis=1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(potentials: np.ndarray, transitions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distribution of each word's label. potentials: [words, labels] of documents of the given sizes (1 at least), one after
    the other. Long documents are cut in segments: products of the segments' matrices carry the messages across, exactly."""
    k = potentials.shape[1]
    step = _unit(np.exp(transitions)).astype(np.float32)
    n_segments = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), n_segments)
    ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    start = np.repeat(np.cumsum(sizes) - sizes, n_segments) + ordinal * SEGMENT
    length = np.minimum(SEGMENT, sizes[doc] - ordinal * SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, left = start[order], length[order]
    active = [int((left > t).sum()) for t in range(int(left[0]))]
    before, after = np.full((len(doc), k), 1 / k, np.float32), np.full((len(doc), k), 1 / k, np.float32)
    if n_segments.max() > 1:
        product = np.broadcast_to(np.eye(k, dtype=np.float32), (len(doc), k, k)).copy()
        for t, a in enumerate(active):
            x = (product[:a].reshape(-1, k) @ step).reshape(a, k, k) * potentials[begin[:a] + t][:, None, :]
            product[:a] = x / x.sum(axis=(1, 2), keepdims=True)
        by_segment = np.empty_like(product)
        by_segment[order] = product
        first = np.cumsum(n_segments) - n_segments
        for j in range(1, int(n_segments.max())):
            s = first[n_segments > j] + j
            before[s] = _unit((before[s - 1][:, None, :] @ by_segment[s - 1])[:, 0])
        last = first + n_segments - 1
        for j in range(1, int(n_segments.max())):
            s = last[n_segments > j] - j
            after[s] = _unit((by_segment[s + 1] @ after[s + 1][:, :, None])[:, :, 0])
    out = np.empty_like(potentials)
    message = before[order]
    for t, a in enumerate(active):
        message[:a] = _unit((message[:a] @ step) * potentials[begin[:a] + t])
        out[begin[:a] + t] = message[:a]
    message = after[order]
    for t in reversed(range(len(active))):
        a = active[t]
        at = begin[:a] + t
        out[at] = _unit(out[at] * message[:a])
        message[:a] = _unit((message[:a] * potentials[at]) @ step.T)
    return out


def train(samples: list[tuple[str, list[str]]], epochs: int = 3, rate: float = 0.3, seed: int = 5, length: int = 40, batch: int = 48) -> Model:
    """Fits weights by gradients of the conditional likelihood, on sequences spliced of pieces of 8 to 24 words.

    Samples of less than length words are gone through again until they fill a sequence, in as many epochs; those without
    a word of letters teach nothing. Labels without such a word are not learned, so a model may have none.
    """
    rng = np.random.default_rng(seed)
    samples = [(x, words) for x, words in samples if any(map(clean, words))]
    labels = sorted({x for x, _ in samples})
    vocabulary: dict[bytes, int] = {}
    pieces: list[tuple[int, list[int]]] = []
    for label, words in samples:
        numbers = [vocabulary.setdefault(c, len(vocabulary)) for w in words if (c := clean(w))]
        a = 0
        while a < len(numbers):
            b = a + int(rng.integers(8, 25))
            pieces.append((labels.index(label), numbers[a:b]))
            a = b
    words = list(vocabulary)
    rows = np.zeros((len(words), 0), np.uint32)
    listed: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
    for at, width in by_width(words):
        found = np.concatenate(list(features([words[i] for i in at], width)), axis=1)
        for i, r in zip(at, found, strict=True):
            listed[i] = r[r > 0]
    most = max((len(r) for r in listed), default=0)
    rows = np.zeros((len(words), most), np.uint32)
    for i, r in enumerate(listed):
        rows[i, : len(r)] = r
    k = len(labels)
    weights, moves = np.zeros((1 << LOG_ROWS, k), np.float32), np.zeros((k, k), np.float32)
    squares, move_squares = np.full_like(weights, 1e-4), np.full_like(moves, 1e-4)
    for _ in range(epochs if k > 1 else 0):
        flat_words: list[int] = []
        flat_labels: list[int] = []
        for i in rng.permutation(len(pieces)):
            flat_words += pieces[i][1]
            flat_labels += [pieces[i][0]] * len(pieces[i][1])
        if len(flat_words) < length:
            again = -(-length // len(flat_words))
            flat_words, flat_labels = flat_words * again, flat_labels * again
        n = len(flat_words) // length
        x = np.array(flat_words[: n * length]).reshape(n, length)
        y = np.array(flat_labels[: n * length]).reshape(n, length)
        for b in range(0, n, batch):
            xs, ys = x[b : b + batch], y[b : b + batch]
            used = rows[xs.reshape(-1)]
            score = weights[used].sum(axis=1)
            potential = np.exp(score - score.max(axis=1, keepdims=True))
            p, pairs = _expectations(potential.reshape(*xs.shape, k), moves)
            gap = (np.eye(k, dtype=np.float32)[ys] - p).reshape(-1, k)
            index = used.reshape(-1)
            for j in range(k):
                g = np.bincount(index, weights=np.repeat(gap[:, j], used.shape[1]), minlength=1 << LOG_ROWS).astype(np.float32)
                g[0] = 0
                squares[:, j] += g * g
                weights[:, j] += rate * g / np.sqrt(squares[:, j]) * (g != 0)
            seen = np.zeros((k, k), np.float32)
            np.add.at(seen, (ys[:, :-1].reshape(-1), ys[:, 1:].reshape(-1)), 1)
            g = seen - pairs
            move_squares += g * g
            moves += rate * g / np.sqrt(move_squares)
    return Model(labels, weights, moves)


def _expectations(potential: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [sequences, words, labels] and the expected number of each transition."""
    s, n, k = potential.shape
    step = _unit(np.exp(moves))
    ahead, back = np.empty_like(potential), np.ones_like(potential)
    ahead[:, 0] = _unit((np.full((s, k), 1 / k, np.float32) @ step) * potential[:, 0])
    for t in range(1, n):
        ahead[:, t] = _unit((ahead[:, t - 1] @ step) * potential[:, t])
    for t in range(n - 2, -1, -1):
        back[:, t] = _unit((back[:, t + 1] * potential[:, t + 1]) @ step.T)
    joint = ahead[:, :-1, :, None] * step * (potential[:, 1:] * back[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return _unit(ahead * back), joint.sum(axis=(0, 1))


def label_words(model: Model, words: list[list[str]]) -> list[list[tuple[str, float]]]:
    """Label and probability of each word of each text; words without letters are left out."""
    out = []
    for text in words:
        kept = [c for w in text if (c := clean(w))]
        if not kept:
            out.append([])
            continue
        score = model.scores(kept)
        p = marginals(np.exp(score - score.max(axis=1, keepdims=True)), model.transitions, np.array([len(kept)]))
        out.append([(model.labels[i], float(r[i])) for r, i in zip(p, p.argmax(axis=1), strict=True)])
    return out


def _predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    k = len(model.labels)
    share = np.zeros((len(texts), k))
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    encoded = split.flatten().dictionary_encode()
    cleaned = [clean(w) for w in encoded.dictionary.to_pylist()]
    some = np.fromiter(map(bool, cleaned), bool, len(cleaned))
    score = np.zeros((len(cleaned), k), np.float32)
    if some.any() and k > 1:
        score[some] = model.scores([w for w in cleaned if w])
    score = np.exp(score - score.max(axis=1, keepdims=True)) if len(cleaned) else score
    number = encoded.indices.to_numpy()
    offsets = split.offsets.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kept = some[number] if len(number) else np.zeros(0, bool)
    doc, number = doc[kept], number[kept]
    if len(doc):
        sizes = np.bincount(doc, minlength=len(texts))
        p = marginals(score[number], model.transitions, sizes[sizes > 0])
        for j in range(k):
            share[:, j] = np.bincount(doc, weights=p[:, j], minlength=len(texts))
    total = share.sum(axis=1)
    best = share.argmax(axis=1)
    names = [model.labels[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
    return names, np.where(total > 0, share.max(axis=1) / np.maximum(total, 1e-12), 0.0)


def _run(shared, chunk_bytes: int = 8_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            texts = batch.column("text")
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = [0, *np.nonzero(np.diff(size // chunk_bytes))[0] + 1, batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                names, score = _predict(model, part.column("text"))
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score"])

    return run


def training_sample(labelled: DataFrame, per_lang: int = 400, n_words: int = 60, max_langs: int = 64) -> list[tuple[str, list[str]]]:
    """About per_lang documents of each of the max_langs most frequent languages, chosen by a hash of id and text, and of each n_words words in a row."""
    known = labelled.filter("lang is not null and text is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    counts = {r["lang"]: r["count"] for r in counts.collect()}
    if not counts:
        return []
    h = F.xxhash64("doc_id", "text")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))])
    chosen = known.filter(F.pmod(h, F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)  # null, so false, for other languages
    words = F.split(F.trim("text"), r"\s+")
    first = F.pmod(F.shiftright(h, 20), F.greatest(F.lit(1), F.size("w") - n_words + 1)).cast("int") + 1
    rows = chosen.withColumn("w", words).select("lang", F.slice("w", first, F.lit(n_words)).alias("w"), h.alias("h"))
    return [(r["lang"], r["w"]) for r in sorted(rows.collect(), key=lambda r: (r["h"], r["lang"]))]


def identify(docs: DataFrame, labelled: DataFrame, per_lang: int = 400, n_words: int = 60, max_langs: int = 64) -> DataFrame:
    """docs with lang_pred and score: the language of most words of a text and its expected share of them.

    The model learns from labelled(doc_id, text, lang): n_words words of about per_lang documents of each of the max_langs most
    frequent languages, which bounds what the driver holds. Predictions depend on text alone. Texts that are null or have no
    letter (a character of Unicode's classes L; number signs are none) are und, with score 0; so are all without labelled rows that have
    one. With rows of one language only, all others are of it, with score 1; few rows are learned from over and over.
    Ties go to the first language in order. Time grows with the length of a text and of a word. Rows that repeat each come back
    the same. Other columns of docs stay; ones with the names of added columns are replaced.
    """
    model = train(training_sample(labelled, per_lang, n_words, max_langs))
    base = docs.drop("lang_pred", "score")
    if not model.labels:
        return base.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.transitions))  # 2^LOG_ROWS rows of a weight for each language
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(_run(shared), schema)
