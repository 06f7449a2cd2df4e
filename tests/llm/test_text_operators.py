"""The text operators against brute force, on the given documents and on odd rows."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import line_dedup as line_dedup_module
from strandloom.llm import registry, spans
from strandloom.llm.licenses import TEMPLATES, containment_join, license_scan
from strandloom.llm.line_dedup import keep_bitmaps, line_dedup, line_hashes, repeated_lines
from strandloom.llm.quality import METRICS, base_counts, fences, measured, quality_rules, quantile_sketches, sketch_quantiles
from strandloom.llm.secrets import secret_scan, spans_text

from . import brute
from .conftest import ROWS

DATA = "/root/testdata/sf0.001"


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.fixture(params=["docs", "odd"])
def table(request):
    return request.getfixturevalue(request.param)


def texts(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_quality_counts(table):
    out = quality_rules(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((i, *brute.quality(t)) for i, t in texts(table)), key=key)


def test_quality_keeps_what_is_like_its_group(spark):
    plain = [(i, " ".join(f"w{j * 7 % 60}x" for j in range(60 + i % 9)), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{j * 7 % 60}x###" for j in range(60)), "en", "a") for i in range(9)]
    df = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules(df).collect()}
    assert all(kept[i] == (i < 1000) for i in kept)


def test_each_rule_fires(spark):
    """In a group alike in each metric, a document that is odd in one breaks that rule; a small group follows its language."""
    def words(i, n=100):
        return [f"w{(j * 7 + i) % 997}xy" for j in range(n)]

    plain = [(i, " ".join(words(i)), "en", "a" if i % 50 else "small") for i in range(400)]
    repeated = words(1)[:13]
    odd = {
        1000: " ".join(words(3)) + "#" * 60, 1001: "\n".join(f"lin{x}e" for x in np.random.default_rng(1).integers(0, 40, 100)), 1002: " ".join([*words(5, 69), *repeated, *repeated]),
        1003: " ".join(w * 3 for w in words(6)), 1004: " ".join(w[1:3] for w in words(7)),
    }
    rows = [*plain, *[(i + 10 * (s == "small"), t, "en", s) for i, t in odd.items() for s in ("a", "small")]]
    out = {r.doc_id: r.broken for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    want = {1000: "high_symbol_share", 1001: "high_dup_line_share", 1002: "high_repeat_share", 1003: "high_word_length", 1004: "low_word_length"}
    for i, rule in want.items():
        assert rule in out[i] and rule in out[i + 10], (i, out[i], out[i + 10])
    assert not any(out[i] for i in range(400))


HIGH = [f"high_{m}" for m in METRICS]


def test_groups_of_other_spread_get_other_cutoffs(spark):
    """Two large groups alike but for how much their documents differ: all four rules' cutoffs follow, and so do verdicts of the same text."""
    rng = np.random.default_rng(4)

    def text(wide):
        n = int(rng.integers(40, 400)) if wide else 200
        words = [f"w{x:04d}" * (1 + wide * int(rng.integers(3))) for x in rng.integers(0, 9999, n)]
        words += words[:12] * int(wide and rng.integers(2)) + ["#" * int(wide * rng.integers(30))]
        lines = [" ".join(words[a : a + 10]) for a in range(0, len(words), 10)]
        return "\n".join(lines + lines[:1] * int(wide * rng.integers(3)))

    rows = [(i, text(i % 2), "en", "wide" if i % 2 else "narrow") for i in range(3000)]
    odd = " ".join([f"w{x:04d}" * 2 for x in range(300)] + ["#" * 60])
    rows += [(9000, odd, "en", "wide"), (9001, odd, "en", "narrow")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cut = {r.source: r for r in fences(measured(base_counts(df).filter("n_words > 0"))).collect()}
    assert all(cut["wide"][c] > 1.1 * cut["narrow"][c] for c in HIGH) and abs(cut["wide"].low_word_length / cut["narrow"].low_word_length - 1) > 0.1
    out = {r.doc_id: r.broken for r in quality_rules(df).filter("doc_id >= 9000").collect()}
    assert out == {9000: [], 9001: ["high_symbol_share", "high_word_length"]}


def test_sketches_decide_not_their_error(docs):
    """On the given documents every group's fences lie beyond its quartiles by more than the sketches' error."""
    rows = measured(base_counts(docs).filter("n_words >= 20")).persist()
    far, near = ({(r.lang, r.source): r for r in fences(rows, reach=x).collect()} for x in (4.0, 0.0))
    assert len(far) > 20 and all(far[g][c] > 1.05 * near[g][c] for g in far for c in HIGH)


def test_a_case_in_a_short_document_is_no_evidence(spark):
    long = [(i, " ".join(f"w{x}" for x in range(i, i + 500 + i)), "en", "a") for i in range(300)]
    short = [(1000, " ".join(f"w{x}" for x in range(20)) + "#", "en", "a"), (1001, " ".join(f"w{x}#" for x in range(20)), "en", "a")]
    out = {r.doc_id: r.broken for r in quality_rules(spark.createDataFrame(long + short, "doc_id long, text string, lang string, source string")).collect()}
    assert out[1000] == [] and "high_symbol_share" in out[1001]


def test_sketches_merge_and_are_close(spark):
    values = np.random.default_rng(3).lognormal(size=4000)
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(values)], "m double, g string")
    parts = quantile_sketches(df, ["m"], ["g"]).groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    whole = quantile_sketches(df, ["m"], [])
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    q = sketch_quantiles(whole, [], {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    for got, p in ((q.a, 0.1), (q.b, 0.5), (q.c, 0.9)):
        assert got == pytest.approx(np.quantile(values, p, method="inverted_cdf"), rel=0.011)


def test_line_dedup(table):
    out = line_dedup(table, min_docs=2).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    rows = texts(table)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute.line_dedup(rows, 2), key=key)


def test_line_dedup_keeps_first_and_its_bitmaps(spark):
    rows = [(3, "b\na"), (1, "x\na\nA "), (2, "a\ny" + "\nz" * 130 + "\na")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup(df, min_docs=2, keep_first=True).collect()}
    assert out == {1: "x\na", 2: "y" + "\nz" * 130, 3: "b"}
    bits = {r.doc_id: [(w.word, w.bits) for w in r.words] for r in keep_bitmaps(df, 2, keep_first=True).collect()}
    assert bits == {1: [(0, ~4)], 2: [(0, ~1), (2, ~(1 << (132 - 128)))], 3: [(0, ~2)]}


@pytest.fixture
def written(monkeypatch):
    """What line dedup writes on its way: label: (plan, table)."""
    out, materialize = {}, line_dedup_module.materialize

    def keep(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out[label] = (plan, materialize(df, label))
        return out[label][1]

    monkeypatch.setattr(line_dedup_module, "materialize", keep)
    return out


@pytest.mark.parametrize("sample", [1, 64])
def test_keys_over_the_edges_of_partitions(spark, written, sample):
    """One line in every document and one in a third of them, rare ones, and repeats within documents: partitions cut the runs of common keys."""
    rows = [(i, f"Top\n{'third' if i % 3 == 0 else f'own {i}'}\nTOP \npair {i // 2}\nten {i // 10}\nx{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = line_dedup(df, sample=sample).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = written["line-runs"][1].select("h1", F.input_file_name()).distinct().collect()
    assert max(Counter(r.h1 for r in files).values()) > 1
    assert sorted(map(tuple, out.collect())) == sorted(brute.line_dedup(rows))
    kept = {r.doc_id: r.text for r in line_dedup(df, keep_first=True, sample=sample).collect()}
    assert kept[0] == "Top\nthird\npair 0\nten 0\nx0" and kept[1] == "own 1\npair 0\nx1" and kept[10] == "own 10\npair 5\nten 1\nx10"


def test_slices_follow_parts(spark, monkeypatch):
    """A key of 1 line in 1,500 is common once there are more parts than that, and slices follow a key's size; all keys are few."""
    rows = spark.range(3000).select(
        F.expr("if(id % 1500 = 0, -1, if(id % 3 = 0, -2, id))").alias("h1"), F.lit(0).alias("h2"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("text_hash"), F.lit(0).alias("pos")
    )

    def slices(parts):
        monkeypatch.setattr(line_dedup_module, "PARTS", parts)
        return {r.h1: r.slices for r in line_dedup_module.common_keys(rows, 1).collect()}

    few, many = slices(1024), slices(2048)
    assert set(few) == {-2} and set(many) == {-1, -2} and many[-1] == 6 and abs(many[-2] - 4 * 2048 / 3) < 9 and abs(few[-2] - 4 * 1024 / 3) < 9
    out = [repeated_lines(rows, 2, 1).groupBy("h1").count().collect() for _ in (1, monkeypatch.setattr(line_dedup_module, "PARTS", 1024))]
    assert all({r.h1: r["count"] for r in x} == {-1: 2, -2: 998} for x in out)


def test_runs_are_counted_where_they_are_sorted(docs, written):
    """Between the sorted runs and the windows over them lies no other exchange and no aggregate."""
    keep_bitmaps(docs)
    plan = written["line-runs"][0]
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Window" in plan and "Aggregate" not in plan


def test_secrets(table):
    out = secret_scan(table)
    kinds = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))") for k in ("assign", "access", "hex")]
    got = out.select("doc_id", *kinds, F.sha2(spans_text("base"), 256)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute.secrets(t)[:4]) for i, t in texts(table)), key=key)


def test_markov_spans_equal_brute_force(spark, docs):
    rng = np.random.default_rng(6)
    letters = list(brute.ALPHABET)
    made = ["".join(rng.choice(letters, int(n))) for n in rng.integers(10, 60, 400)]
    rows = [(50_000 + i, f"token={t} x" if i % 2 else f"see {t}, or {t}: {made[i - 1]}") for i, t in enumerate(made)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "markov"] for r in secret_scan(df).collect()}
    listed = texts(df)
    want = dict(zip([i for i, _ in listed], brute.random_tokens([t for _, t in listed]), strict=True))
    assert out == want and sum(map(len, want.values())) > 100


@pytest.mark.parametrize("token", ["aB3/" * 250_000, "x" * 1_000_000, ("q7" * 12 + " ") * 40_000, "token " * 170_000, "ab=" * 330_000])
def test_secrets_of_very_long_texts(spark, token):
    rows = [(0, "data:image/png;base64," + token), (1, 'token = "Zz9+abcdefg0"'), *[(2 + i, "some recurring words, identifiers_of_code") for i in range(4)]]
    start = time.monotonic()
    out = {r.doc_id: r.found for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 6 and [s.kind for s in out[1]] == ["assign"]
    assert time.monotonic() - start < 60


def test_markov_models_tell_random_tokens_from_words(spark, docs):
    rng = np.random.default_rng(8)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    mixed = ["".join(rng.choice(alphabet, 40)) for _ in range(200)]
    known = [(10_000 + i, f"token = \"{m}\" words") for i, m in enumerate(mixed[:150])] + [(20_000 + i, f"see {h} words") for i, h in enumerate(hexes)]
    hidden = [(30_000 + i, f"before {m} after") for i, m in enumerate(mixed[150:])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(known + hidden, "doc_id long, text string"))
    out = {r.doc_id: [s for s in r.found if s.kind == "markov"] for r in secret_scan(df).collect()}
    assert sum(len(out[30_000 + i]) == 1 and (out[30_000 + i][0].start, out[30_000 + i][0].end) == (7, 47) for i in range(50)) >= 48
    assert sum(bool(v) for k, v in out.items() if k < 10_000) == 0


def test_random_tokens_of_letters_only(spark, docs):
    rng = np.random.default_rng(9)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    known = [(10_000 + i, f"token = \"{''.join(rng.choice([*letters, *'0123456789'], 40))}\" words") for i in range(150)]
    hidden = [(30_000 + i, f"before {''.join(rng.choice(letters, 32))} after") for i in range(50)]
    # names of the words of the documents themselves
    names = sorted({w for r in docs.collect() for w in (r.text or "").split() if w.isascii() and w.isalpha() and 4 <= len(w) <= 9})
    camel = [(40_000 + i, f"call {''.join(str(w).capitalize() for w in rng.choice(names, 4))} here") for i in range(50)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(known + hidden + camel, "doc_id long, text string"))
    out = {r.doc_id: [s for s in r.found if s.kind == "markov"] for r in secret_scan(df).collect()}
    found, wrong = (sum(bool(out[k + i]) for i in range(50)) for k in (30_000, 40_000))
    assert found >= 45, (found, wrong)
    assert wrong <= 5, (found, wrong)
    assert sum(bool(v) for k, v in out.items() if k < 10_000) == 0


def test_matches_with_many_blocks(spark):
    text = "ab " * 2000 + "é" + "ab" * 50
    df = spans.with_matches(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t", "a(b)", "m", masked="k")
    rows = [r.asDict(True) for r in df.collect()]
    want = [i for i in range(len(text)) if text.startswith("ab", i)]
    assert [x["start"] for x in rows[0]["m"]] == want and all(x["end"] - x["start"] == 2 for x in rows[0]["m"])
    assert rows[0]["k"] == text.replace("ab", "  ")
    assert rows[1]["k"] == "" and not rows[1]["m"]


def test_licenses(table):
    out = license_scan(table)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), round(r.score, 9)) for r in out.collect()]
    want = []
    for i, t in texts(table):
        base, met = brute.licenses(t), brute.containment(t, TEMPLATES, 0.8)
        labels = ",".join(sorted(set(met) | set(filter(None, base[4].split(",")))))
        want.append((i, *base, labels, round(1.0 if base[1] else max(met.values(), default=0.0), 9)))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_wrapped_and_edited_notices(spark):
    rows, want = [], {}
    for k, (t, label) in enumerate(TEMPLATES.items()):
        w = t.split()
        # in two or more lines, each of less than 0.8 of the words, after some words
        lines = [w[i : i + max(1, len(w) // 2)] for i in range(0, len(w), max(1, len(w) // 2))]
        rows.append((k, "\n".join([*(f"x{i} y" for i in range(k * 7)), *(" # " + " ".join(x) for x in lines), "z"])))
        want[k] = label
        # with a word inserted after every second word, in a long line
        edited = [x for i, v in enumerate(w) for x in ((v, f"new{i}") if i % 2 else (v,))]
        rows.append((100 + k, " ".join([*(f"x{i}" for i in range(k * 7 + 5)), *edited, *["z"] * 40])))
        want[100 + k] = label
    out = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] in out[i] for i in want), {i: out[i] for i in want if want[i] not in out[i]}


def test_templates_of_a_table(spark):
    long = " ".join(f"clause{i}" for i in range(150))
    table = spark.createDataFrame([(f"Clause Zero, it's: {long}!", "long"), ("Any\nother notice", "short"), (None, "none"), ("--", "empty")], "text string, label string")
    words = f"clause zero it s {long}".split()
    rows = [(1, "a b " * 50 + "\n".join(words) + " c d" * 50), (2, " ".join(words[:100])), (3, "ANY other-notice"), (4, None)]
    out = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=table).collect()}
    assert out == {1: ["long"], 2: [], 3: ["short"], 4: []}


@pytest.mark.parametrize("piece", ["the license ", "x", "licensed\n", "cc by "])
def test_licenses_of_very_long_texts(spark, piece):
    start = time.monotonic()
    df = spark.createDataFrame([(1, piece * (1_000_000 // len(piece)))], "doc_id long, text string")
    assert license_scan(df).count() == 1 and time.monotonic() - start < 60


def test_containment_join_is_exact(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(14)]
    templates = {" ".join(rng.choice(vocabulary, n, replace=False)): f"t{k}" for k, n in enumerate((3, 4, 5, 7, 9))}
    used = sorted({w for t in templates for w in t.split()})
    blocks = [(i, [str(w) for w in rng.choice(used, rng.integers(2, 10), replace=False)]) for i in range(400)]
    out = containment_join(spark.createDataFrame(blocks, "id long, words array<string>"), templates, 0.7)
    want = {(i, label) for i, b in blocks for t, label in templates.items() if len(set(t.split()) & set(b)) >= 0.7 * len(t.split()) - 1e-9}
    got = [(r.id, r.label) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("run", [quality_rules, line_dedup, secret_scan, license_scan])
def test_empty_tables(none, run):
    assert run(none).count() == 0


def test_rows_are_neither_lost_nor_made(odd):
    ids = Counter(r[0] for r in ROWS)
    for run in (quality_rules, line_dedup, secret_scan, license_scan):
        assert Counter(r.doc_id for r in run(odd).select("doc_id").collect()) == ids


def test_line_dedup_keeps_other_columns(odd):
    out = line_dedup(odd)
    assert set(odd.columns) == set(out.columns) and dict(out.dtypes)["n_lines"] == "bigint"
    assert {r.text_hash for r in out.select("text_hash").collect()} == {"x"}


def test_queries_return_digests(spark):
    row = next(r for r in registry.QUERIES["op3_line_dedup"](spark, DATA).collect() if r.n_dropped == 0)
    text = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
