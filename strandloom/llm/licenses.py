"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block meets a template if it holds a given share of the template's different words. Words are ordered by how rare
they are in the corpus. A block that holds o words of a template must have one of the template's first |T| - o + 1
words among its own first |B| - o + 1: only pairs that share such a word, and whose places leave room for o
common words, are compared.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, null_safe

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Phrases and labels of the base rule.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences that mark a license, in the words of WORDS, and their labels.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}
#: Least words of a window. Windows over a whole text start a quarter of their words apart: any three quarters of them in a row lie in one.
BLOCK = 64
#: Templates are a short list, which plans hold as literals; the prefixes of more than so many words are not broadcast.
MOST_TEMPLATES, MOST_PREFIXES = 1000, 200_000


def _sql_array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def _needed(words: list[str], share: float) -> int:
    return math.ceil(share * len(words) - 1e-9)


def block_words(templates: dict[str, str]) -> int:
    """Words of a window: BLOCK, or twice the longest template's if that is more, in fours."""
    return max(BLOCK, -(-max(len(t.split()) for t in templates) // 2) * 4)


def text_blocks(docs: DataFrame, templates: dict[str, str], share: float) -> DataFrame:
    """docs (doc_id, text) with n_words, n_base, first_word, last_word, base_labels and blocks (struct<words>).

    A block is a line; one of more than block_words() words gives windows of as many that overlap by half. Such windows over the words
    of the whole text, which overlap by three quarters, are blocks too, so that a notice may run over several lines: what
    spans three quarters of a window or less is never cut. blocks keeps, of blocks that could meet a template, the
    different words that stand in any template.
    """
    block = block_words(templates)
    step = block // 4
    vocabulary = sorted({w for t in templates for w in t.split()})
    least = min(_needed(sorted(set(t.split())), share) for t in templates)
    text = ascii_lower(F.coalesce("text", F.lit("")))
    df = docs.withColumn("__lines", F.transform(F.split(text, "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(WORDS), F.lit(0))))
    df = df.withColumn("__words", F.flatten("__lines"))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("__text", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        pieces = F.when(F.contains("__text", F.lit(f" {phrase} ")), F.split("__text", f" {phrase}(?= )", -1))
        df = df.withColumn("__p", pieces).withColumns(
            {
                f"__n_{label}": F.when(F.col("__p").isNull(), 0).otherwise(F.size("__p") - 1),
                f"__first_{label}": F.regexp_count(F.get("__p", F.lit(0)), F.lit(" ")),
                # the last piece ends with a space more than it has words
                f"__last_{label}": F.col("n_words") - (F.regexp_count(F.element_at("__p", -1), F.lit(" ")) - 1) - len(phrase.split()),
            }
        )
        counts.append(F.col(f"__n_{label}"))
        firsts.append(F.col(f"__first_{label}"))
        lasts.append(F.col(f"__last_{label}"))
        labels.append(F.when(F.col(f"__n_{label}") > 0, F.lit(label)))
    df = df.withColumns(
        {
            "n_base": sum(counts[1:], counts[0]).cast("long"),
            "first_word": F.least(*firsts).cast("long"),
            "last_word": F.greatest(*lasts).cast("long"),
            "base_labels": F.array_compact(F.array(*labels)),
            "__any": F.expr(f"array_intersect(__words, {_sql_array(vocabulary)})"),
        }
    )
    # a text that lacks too many words of every template has no block that meets one
    enough = [f"size(array_intersect(__any, {_sql_array(ws)})) >= {_needed(ws, share)}" for ws in (sorted(set(t.split())) for t in templates)]
    df = df.withColumn("__enough", F.expr(" or ".join(enough)))
    windows = f"transform(sequence(1, greatest(1, size(__words) - {block - step}), {step}), i -> slice(__words, i, {block}))"
    lines = (
        f"flatten(transform(__lines, x -> if(size(x) <= {block}, array(x),"
        f" transform(sequence(1, size(x) - {block // 2}, {block // 2}), i -> slice(x, i, {block})))))"
    )
    df = df.withColumn("__blocks", F.expr(f"if(__enough, concat({lines}, {windows}), array())"))
    held = f"transform(__blocks, x -> array_intersect(x, {_sql_array(vocabulary)}))"
    df = df.withColumn("blocks", F.expr(f"array_distinct(filter({held}, x -> size(x) >= {least}))"))
    return df.drop("text", *[c for c in df.columns if c.startswith("__")])


def containment_join(blocks: DataFrame, templates: dict[str, str], share: float) -> DataFrame:
    """Pairs (block keys..., label, score) of blocks(..., words) and templates that meet, exactly: score is the share held.

    words must be different words of the templates. The templates, and so all that is made of them, are a parameter.
    """
    spark: SparkSession = blocks.sparkSession
    keys = [c for c in blocks.columns if c != "words"]
    sets = [(label, sorted(set(t.split()))) for t, label in templates.items()]
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counted.collect()}  # a row for each word of the templates at most
    order = sorted({w for _, words in sets for w in words}, key=lambda w: (seen.get(w, 0), w))
    at = {w: i for i, w in enumerate(order)}
    prefixes = []
    for i, (_, words) in enumerate(sets):
        ranked, need = sorted(words, key=at.__getitem__), _needed(words, share)
        prefixes += [(w, i, k, len(words), need) for k, w in enumerate(ranked[: len(words) - need + 1])]
    least = min(p[4] for p in prefixes)
    index = spark.createDataFrame(prefixes, "word string, template int, t_at int, t_size int, need int")
    # sorted by rank in the global order: the number comes first in the struct
    rank = "transform(words, w -> named_struct('r', array_position(%s, w), 'w', w))" % _sql_array(order)
    ranked = blocks.withColumn("__ranked", F.expr(f"sort_array({rank})"))
    ranked = ranked.withColumn("__prefix", F.expr(f"slice(__ranked, 1, size(__ranked) - {least} + 1)"))
    probes = ranked.select(*keys, "words", F.posexplode("__prefix").alias("b_at", "__x")).withColumn("word", F.col("__x.w")).drop("__x")
    size = F.size("words")
    index = F.broadcast(index) if len(prefixes) <= MOST_PREFIXES else index
    met = probes.join(index, "word").filter(
        (size >= F.col("need"))
        & (F.col("b_at") <= size - F.col("need"))
        & (1 + F.least(F.col("t_size") - F.col("t_at"), size - F.col("b_at")) - 1 >= F.col("need"))
    )
    members = "array(" + ", ".join(_sql_array(words) for _, words in sets) + ")"
    common = F.expr(f"size(array_intersect(words, get({members}, template)))")
    met = met.withColumn("__common", common).filter(F.col("__common") >= F.col("need"))
    met = met.dropDuplicates([*keys, "words", "template"])  # a pair meets at each word that it shares
    label = F.expr(f"get({_sql_array(label for label, _ in sets)}, template)")
    return met.select(*keys, label.alias("label"), (F.col("__common") / F.col("t_size")).alias("score"))


def template_table(templates: DataFrame) -> dict[str, str]:
    """Templates of a table (text, label) in the words of WORDS; a list of more than MOST_TEMPLATES is refused, and empty or null ones are left out."""
    listed = templates.select("text", "label").distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(listed) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    split = sorted((" ".join(re.findall(WORDS, r["text"].translate(LOWER))), r["label"]) for r in listed if r["text"] and r["label"])
    return {t: label for t, label in split if t}


def license_scan(docs: DataFrame, share: float = 0.8, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score.

    n_base counts the places of PHRASES, first_word and last_word are the smallest and largest start among them,
    in words from 0 (null without any). labels adds those of templates of which a block holds the share of words or
    more. score is 1 with a phrase, else the largest share held by such a block, else 0. Null and empty texts have no words. Rows that repeat
    a document share what is found. Other columns of docs are not used. templates: texts, in lower-case words, and their labels, or a table (text, label).
    """
    templates = template_table(templates) if isinstance(templates, DataFrame) else templates or TEMPLATES
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    scanned = materialize(text_blocks(rows, templates, share), "license-blocks")
    blocks = scanned.select("doc_id", "text_hash", F.explode("blocks").alias("words"))
    met = containment_join(blocks, templates, share)
    best = met.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("__met"), F.max("score").alias("__score"))
    out = null_safe(scanned.drop("blocks"), best, ["doc_id", "text_hash"], "left")
    merged = F.array_distinct(F.concat("base_labels", F.coalesce("__met", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__score", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.sort_array("base_labels").alias("base_labels"), F.sort_array(merged).alias("labels"), score.alias("score"),
    )
