"""Licence scans: fixed phrases, and an exact set-similarity join of text blocks with licence templates.

DataFrame and SQL functions only. A block is a line of a text, or a window of as many words as a template has that runs
over line ends, as notices are often wrapped; blocks and templates are sets of words. A template is found in a block that
holds at least ``containment`` of its words. The join of lines is exact: words stand in global order of
document frequency, rarest first (words of no template can't be shared and are left out); a template that needs ``need``
of its n words must share one of its first n - need + 1 with any block that holds it (prefix filter), blocks of fewer
than ``need`` such words are out (length filter), and so are pairs whose places in both orders leave too few words
(positional filter). What passes is counted. Windows are counted from each word of the template on, in texts of more than
one line that hold enough of the template's words at all; that is exact too, as a window may as well begin at such a word.

One scan cuts all texts into words and keeps, per document, its counts and its blocks' template words; everything else
reads that narrow table, which has the places of template words for those texts alone that may hold a window. Templates are a fixed table, so their sides of joins are small whatever the corpus.

Null text is empty: no words, no labels, score 0. Rows with one doc_id, repeated rows too, are kept apart; a text of any length is
one row of the scan; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence notices by label; a label may have several.
TEMPLATES = [
    ("notice-apache-2.0", "licensed under the apache license version 2.0"),
    ("notice-apache-2.0", "you may obtain a copy of the license at www apache org licenses license 2.0 unless required by applicable law or agreed to in writing"),
    ("notice-mit", "released under the mit license"),
    ("notice-mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("notice-gpl", "this work is licensed under the gnu general public license version 3"),
    ("notice-gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("notice-cc-by", "licensed under cc by nc 4.0"),
    ("notice-cc-by", "this work is licensed under a creative commons attribution international license"),
    ("notice-bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("notice-isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("notice-mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("notice-reserved", "copyright holder all rights reserved no part may be reproduced without permission"),
]


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(words))


def template_sets(spark, templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """Labels, word sets and numbers of words, by the same word rule as the texts'."""
    rows = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(templates)], "k int, label string, text string")
    cut = rows.select("k", "label",
        F.regexp_extract_all(common.ascii_lower(F.col("text")), F.lit(common.WORD), F.lit(0)).alias("words")).orderBy("k")
    return [(r["label"], list(dict.fromkeys(r["words"])), len(r["words"])) for r in cut.collect()]


def scan(docs: DataFrame, sets: list[tuple[str, list[str], int]], vocabulary: set[str], containment: float,
    phrases: dict[str, str]) -> DataFrame:
    """rid, doc_id, n_words, places (start, label of each phrase), seen (template words of the text), blocks (of lines),
    hits (place, line and word of each template word; null unless the text may hold a template over several lines)."""
    least = min(_need(len(words), containment) for _, words, _ in sets)
    text = common.ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.split(text, "\n").alias("lines"))
    cut = lines.select("rid", "doc_id", F.expr(f"transform(lines, l -> regexp_extract_all(l, r'{common.WORD}', 0))").alias("by_line"))
    flat = cut.withColumn("w", F.flatten("by_line"))
    own = f"filter(l, x -> x IN ({_quoted(vocabulary)}))"
    flat = flat.withColumn("blocks", F.expr(f"transform(by_line, l -> array_distinct({own}))"))
    flat = flat.withColumn("seen", F.expr("array_distinct(flatten(blocks))"))
    possible = " OR ".join(f"size(array_intersect(seen, array({_quoted(words)}))) >= {_need(len(words), containment)}" for _, words,
        _ in sets)
    lined = "flatten(transform(by_line, (l, n) -> transform(l, x -> named_struct('line', n, 'word', x))))"
    placed = f"filter(transform({lined}, (x, n) -> named_struct('at', n, 'line', x.line, 'word', x.word)), x -> x.word IN ({_quoted(vocabulary)}))"
    flat = flat.withColumn("hits", F.expr(f"CASE WHEN size(by_line) > 1 AND ({possible}) THEN {placed} END"))
    places = []
    for phrase, label in phrases.items():
        words = phrase.split(" ")
        here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        possible = " AND ".join(f"array_contains(seen, '{x}')" for x in words)
        places.append(
            f"transform(CASE WHEN size(w) >= {len(words)} AND {possible} THEN filter(sequence(0, size(w) - {len(words)}), i -> {here}) ELSE array() END, i -> named_struct('at', i, 'label', '{label}'))")
    return flat.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"concat({', '.join(places)})").alias("places"),
        "seen",
        F.expr(f"filter(transform(blocks, (b, i) -> named_struct('line', i, 'words', b)), x -> size(x.words) >= {least})").alias("blocks"),
        "hits")


def containment_join(scanned: DataFrame, sets: list[tuple[str, list[str], int]], vocabulary: set[str], containment: float) -> DataFrame:
    """rid, line, label, containment of every block and template at or over the threshold."""
    spark = scanned.sparkSession
    # as many counts as the template table has words
    df = {r["x"]: r["n"] for r in scanned.select(F.explode("seen").alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order, 1)}
    index, first = [], set()
    for t, (label, words, _) in enumerate(sets):
        ranks = sorted(rank[w] for w in words)
        need = _need(len(words), containment)
        for p, r in enumerate(ranks[: len(ranks) - need + 1]):
            index.append((r, t, label, p, len(ranks), need, ranks))
            first.add(order[r - 1])
    prefixes = spark.createDataFrame(index, "rank int, t int, label string, tp int, tn int, need int, ranks array<int>")
    blocks = scanned.select("rid", F.explode(F.expr(f"filter(blocks, b -> exists(b.words, x -> x IN ({_quoted(first)})))")).alias("b"))
    ordered = blocks.select("rid", F.col("b.line").alias("line"),
        F.expr(
            f"array_sort(transform(b.words, x -> cast(array_position(array({', '.join(_quoted([w]) for w in order)}), x) as int)))").alias(
            "own"))
    probes = ordered.select("rid", "line", "own", F.posexplode("own").alias("bp", "rank"))
    pairs = probes.join(F.broadcast(prefixes), "rank").where("size(own) >= need AND 1 + least(tn - tp, size(own) - bp) - 1 >= need - tp")
    # the first shared word decides, so each pair is counted once
    once = pairs.where("rank = array_min(array_intersect(own, ranks))").withColumn("shared", F.size(F.array_intersect("own", "ranks")))
    return once.where("shared >= need").select("rid", "line", "label", (F.col("shared") / F.col("tn")).alias("containment"))


def wrapped(scanned: DataFrame, sets: list[tuple[str, list[str], int]], containment: float) -> DataFrame:
    """rid, line (the first), label, containment of windows that run over line ends and are at or over the threshold."""
    rows = [(label, words, _need(len(words), containment), length) for label, words, length in sets]
    templates = scanned.sparkSession.createDataFrame(rows, "label string, words array<string>, need int, length int")
    pairs = scanned.where("hits IS NOT NULL").join(F.broadcast(templates), F.expr("size(array_intersect(seen, words)) >= need"))
    own = pairs.select("rid", "label", "words", "need", "length", F.expr("filter(hits, h -> array_contains(words, h.word))").alias("own"))
    window = "array(filter(slice(own, j + 1, length), g -> g.at < h.at + length))"
    counted = f"transform({window}, x -> named_struct('line', h.line, 'last', array_max(transform(x, g -> g.line)), 'shared', size(array_distinct(transform(x, g -> g.word)))))[0]"
    windows = own.withColumn("x", F.expr(f"transform(own, (h, j) -> CASE WHEN get(own, j + need - 1).at < h.at + length THEN {counted} END)"))
    found = windows.select("rid", "label", "words", F.explode(F.expr("filter(x, x -> x.last > x.line AND x.shared >= need)")).alias("x"))
    return found.groupBy("rid", F.col("x.line").alias("line"), "label").agg(F.max(F.col("x.shared") / F.size("words")).alias("containment"))


def _need(n: int, containment: float) -> int:
    return max(1, math.ceil(containment * n - 1e-9))  # 0.56 of 25 words are 14, though the product is more by rounding


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
    containment: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and found (line, label, containment).

    score: 1 where a phrase stands, else the largest containment found, else 0."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    sets = [x for x in template_sets(docs.sparkSession, templates) if x[1]]
    vocabulary = {w for _, words, _ in sets for w in words} | {w for p in phrases for w in p.split(" ")}
    scanned = common.saved(scan(docs, sets, vocabulary, containment, phrases), "scan")
    found = containment_join(scanned, sets, vocabulary, containment).unionByName(wrapped(scanned, sets, containment))
    by_doc = found.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("containment").alias("most"),
        F.collect_list(F.struct("line", "label", "containment")).alias("found"))
    out = scanned.select("rid", "doc_id", "n_words", "places").join(by_doc, "rid", "left")
    base = F.expr("array_distinct(transform(places, p -> p.label))")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.expr("array_min(transform(places, p -> p.at))").cast("long").alias("first_word"),
        F.expr("array_max(transform(places, p -> p.at))").cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"), "found",
    )
