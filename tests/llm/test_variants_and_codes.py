"""Spelling variants, the join of n-gram sets and vector codes against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import ngram_join, registry, spelling, vector_codes
from strandloom.llm.ngram_join import ngram_components
from strandloom.llm.spelling import count_words, variants

from . import brute
from .conftest import ROWS

# spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if counts[x] >= ratio * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def held(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("dealt", [4096, 8])
def test_variants_of_crowded_blocks(spark, monkeypatch, dealt):
    """Words over few letters, so that most have many near ones, ties are usual and blocks are cut in tiles."""
    monkeypatch.setattr(spelling, "DEALT", dealt)
    draw = random.Random(3)
    counts = {"".join(draw.choice("abé\U0001f600") for _ in range(draw.randint(2, 6))): draw.choice([1, 1, 2, 5, 7, 40, 250]) for _ in range(700)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert held(variants(rows)) == plain_variants(counts)


def test_chains_of_forms_and_long_words(spark):
    counts = {"colour" + "s" * i: 5**i for i in range(9)} | {"x" * 3000: 1, "x" * 2999: 9, "x" * 1500 + "y" + "x" * 1499: 3, "y" + "x" * 2998 + "y": 2}
    out = held(variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == plain_variants(counts) and out["colour"][1] == "colourssssssss" and out["x" * 3000][0] == "x" * 2999


@pytest.mark.parametrize("words,width", [(["abcdef", "abcdeg", "abcdeh", "bcdef"], 6), (["aaaa", "aaa"], 4), (["aaaa", "baaa", "aaab", "aab"], 4)])
def test_tiles_see_each_edit_once(words, width):
    left, right, lengths = spelling.code_points(words, width)
    rows = np.array([[i if i < len(words) else -1 for i in range(4)]])
    parts = [(a, width if b == width - 1 else b) for a, b in spelling.cuts(width)]
    near = sum(spelling.single_edits(left, right, lengths, rows, rows.copy(), p).astype(int) for p in parts)[0]
    n = len(words)
    assert near[:n, :n].tolist() == [[int(one_edit(a, b) and max(len(a), len(b)) == width) for b in words] for a in words] and not near[n:].any()


def plain_counts(rows, typo=199, least=6, occurrences=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


@pytest.mark.parametrize("typo", [199, 3])
def test_words_are_counted(odd, docs, typo):
    for df, rows in ((odd, [(r[0], r[1]) for r in ROWS]), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        got = {r["word"]: r["n"] for r in count_words(df, typo).collect()}
        assert got == plain_counts(rows, typo)


def test_no_words(none):
    out = variants(count_words(none))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not out.count()


# n-grams


def plain_sets(rows, n=5):
    out = []
    for _, text in rows:
        w = [brute.lower(x) for x in brute.words(text)]
        out.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def plain_components(rows, percent=80, n=5):
    sets = plain_sets(rows, n)
    label = list(range(len(rows)))
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            label = [label[i] if x == label[j] else x for x in label]
    smallest = {}
    for (i, _), c in zip(rows, label):
        smallest[c] = min(filter(lambda x: x is not None, (smallest.get(c), i)), default=None)
    return [(i, len(s), smallest[c] if s else i) for (i, _), s, c in zip(rows, sets, label)]


def same(df, rows, percent=80):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)
    assert got == sorted(plain_components(rows, percent), key=str)


def edited(draw, n_texts, n_words, edits):
    """Chains and groups of edited copies, so that links lie on both sides of the bound, with a passage that all share."""
    shared = [f"s{i}" for i in range(30)]
    out = []
    while len(out) < n_texts:
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(*n_words))]
        for _ in range(draw.randint(1, 9)):
            out.append(" ".join(words + shared * draw.randint(0, 1)))
            words = list(words)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("tile,frequent", [(1024, 20), (4, 5)])
@pytest.mark.parametrize("percent", [80, 60])
def test_components_of_edited_copies(spark, monkeypatch, tile, frequent, percent):
    """With few sets a tile, and with n-grams that are frequent in the sample and so don't travel."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = edited(random.Random(percent + tile), 250, (5, 120), 5)
    same(ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, tile=tile), rows, percent)


def test_large_groups_of_near_copies(spark):
    """Texts of one group of which each lacks or adds some words, over many tiles, and the same texts twice."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(w for w in base if draw.random() > 0.004)) for i in range(150)] + [(1000 + i, " ".join(base[:60]) + f" x{i % 3}") for i in range(40)]
    same(ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=16), rows)


def test_ngram_sets_of_odd_rows(odd, none):
    same(ngram_components(odd), [(r[0], r[1]) for r in ROWS])
    assert ngram_components(none).columns == ["doc_id", "n_shingles", "component_id"] and not ngram_components(none).count()


def test_trie_links_equal_all_pairs():
    draw = random.Random(1)
    for percent in (50, 80, 100):
        for _ in range(60):
            weights = [draw.randint(1, 6) for _ in range(14)]
            sets = []
            for i in range(12):
                ranks = sorted(draw.sample(range(14), draw.randint(6, 14)))
                own = draw.randint(0, 3)
                sets.append((i, i, own + sum(weights[r] for r in ranks), ranks, [weights[r] for r in ranks]))
            label = list(range(12))
            want, got = label, list(label)
            for a, b in itertools.combinations(sets, 2):
                both = sum(weights[r] for r in set(a[3]) & set(b[3]))
                if 100 * both >= percent * (a[2] + b[2] - both):
                    want = [want[a[0]] if x == want[b[0]] else x for x in want]
            links = ngram_join.similar_links(sets, percent)
            for a, b in links:
                got = [got[a] if x == got[b] else x for x in got]
            assert len(links) < 12 and len(set(zip(want, got))) == len(set(want)) == len(set(got))


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64), label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0]))
    width = len(good[0][1]) // parts
    cut = np.array([g[1].reshape(parts, width) for g in good])
    books = cut[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        best, _ = assign()
        for p, k in itertools.product(range(parts), range(books.shape[1])):
            if (best[:, p] == k).any():
                chosen = cut[best[:, p] == k, p]
                books[p, k] = chosen.sum(axis=0) // len(chosen)
    best, d = assign()
    error = d.sum(axis=1)
    total = Counter()
    for (_, _, label), e in zip(good, error):
        total[label] += int(e)
    sha = hashlib.sha256(",".join(str(x) for x in books.reshape(-1)).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in b), int(e), total[label], sha) for (i, _, label), b, e in zip(good, best, error)), key=str)


def coded(df, **options):
    out, books = vector_codes.vector_codes(df, **options)
    sha = vector_codes.codebooks_sha256(books)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], sha) for r in out.collect()), key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({n: F.lit("x") for n in ("vector", "code", "error", "part", "n")})


def odd_vectors(n=300, width=32):
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(0, 0.02, width)], None if i % 7 == 0 else int(i) % 3) for i in draw.permutation(n)]
    rows += [rows[2], (9000, None, 1), (9001, [], 1), (9002, [None] * width, 2), (9003, [float("nan")] * width, 2), (9004, [float("inf")] * width, None)]
    return rows + [(9005, [0.0] * width, 0), (9006, [1e6] * width, 0), (None, [0.5] * width, 5)]


@pytest.mark.parametrize("leaves", [1 << 12, 3])
@pytest.mark.parametrize("options", [{}, {"parts": 4, "entries": 5, "rounds": 3}, {"parts": 32}, {"parts": 1, "entries": 256}])
def test_codes_equal_plain_ones(spark, monkeypatch, leaves, options):
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    rows = [(i, [min(x, 2.0**18) if x is not None and np.isfinite(x) else x for x in v] if v else v, label) for i, v, label in odd_vectors()]
    assert coded(vectors(spark, odd_vectors()), **options) == plain_codes(rows, **options)


def test_few_vectors_and_none(spark):
    rows = odd_vectors(3)
    rows = [(i, [min(x, 2.0**18) if x is not None and np.isfinite(x) else x for x in v] if v else v, label) for i, v, label in rows]
    assert coded(vectors(spark, rows)) == plain_codes(rows)
    for empty in (vectors(spark, [r for r in rows if r[0] and 9000 <= r[0] < 9005]), vectors(spark, rows).limit(0)):
        out, books = vector_codes.vector_codes(empty)
        assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and not out.count() and not books.size
    mixed = vectors(spark, [(1, [0.5] * 32, 1), (2, [0.5] * 16, 1), (3, [0.5] * 33, 1)])
    assert [r[0] for r in coded(mixed)] == [1]


def test_paths_are_shared():
    draw = np.random.default_rng(4)
    parts = draw.integers(-3, 3, (5000, 4))
    leaves, place, n = vector_codes.distinct_parts(parts)
    assert (leaves[place] == parts).all() and n.sum() == 5000 and [tuple(x) for x in leaves.tolist()] == sorted(set(map(tuple, parts.tolist())))
    entries = draw.integers(-3, 3, (9, 4))
    best, distance = vector_codes.nearest(leaves, entries)
    d = ((leaves[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_spelling", "op12_ngram_join", "op13_vector_codes"])
def test_queries_use_no_cartesian_product(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
