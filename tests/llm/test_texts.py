"""Decontamination, licence scan, line dedup and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import decontamination, jaccard_join, license_scan, line_dedup
from kgloom.llm.shingles import shingle_sets

from .helpers import LOWER, docs, prose, result, words

BLANK = re.compile(r"[\x20\x09-\x0D]+")


# decontamination


def contaminated(rows, bench, size=10):
    windows: dict[tuple, set] = {}
    for item, text in bench:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).update({str(item)} if item is not None else set())
    out = {}
    for d, text in rows:
        w, hit, items = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= own
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize(("broadcast", "bitmap"), [(50_000, 50_000), (0, 50_000), (0, 0)])
def test_decontamination(spark, broadcast, bitmap):
    rng = random.Random(4)
    bench = [(i, prose(rng, rng.choice([10, 11, 30, 45]))) for i in range(12)] + [(20, "one two three"), (21, "Solo"), (22, ""), (23, None), (None, prose(rng, 20)), (24, "a b a b a b a b a b a b"), (25, prose(rng, 7)), (25, prose(rng, 12))]
    rows = []
    for d in range(60):
        t = prose(rng, rng.choice([0, 4, 30, 200]))
        if d % 3 == 0:
            w = (bench[rng.randrange(len(bench))][1] or "").split()
            a = rng.randrange(max(1, len(w)))
            t = f"{t} {' '.join(w[a : a + rng.choice([5, 9, 10, 30])]).upper()} {t}"
        rows.append((d, t))
    rows += [(100, None), (101, "solo one TWO, three! a b a b a b a b a b a b a b"), (102, (bench[3][1] + " ") * 40)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = result(decontamination.contamination(docs(spark, rows), table, broadcast, bitmap))
    assert {k: tuple(v[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for k, v in got.items()} == contaminated(rows, bench)


def test_decontamination_of_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(14)
    bench = [(1, prose(rng, 30)), (2, prose(rng, 12))]
    rows = [(5, bench[0][1]), (5, "clean words only"), (5, bench[0][1]), (None, bench[1][1]), (6, "w " * 60_000 + bench[1][1])]
    table = docs(spark, rows).withColumnRenamed("source", "n_hit").withColumnRenamed("lang", "rid").withColumnRenamed("n_chars", "words")
    own = spark.createDataFrame(bench, "item_id long, text string").withColumn("win", F.lit("x"))
    n, m = len(words(bench[0][1])), len(words(bench[1][1]))
    for most in (50_000, 0):
        got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.contamination(table, own, bitmap_windows=most).collect())
        assert got == sorted([(5, n, n, True), (5, n, n, True), (5, 3, 0, False), (0, m, m, True), (6, 60_000 + m, m, True)])


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = result(decontamination.contamination(docs(spark, [(1, "a b"), (2, None)]), empty))
    assert [(v["n_words"], v["n_hit"], v["contaminated"]) for _, v in sorted(got.items())] == [(2, 0, False), (0, 0, False)]
    assert decontamination.contamination(docs(spark, []), empty, bitmap_windows=-1).count() == 0
    assert decontamination.contamination(docs(spark, []), spark.createDataFrame([(1, "x y")], "item_id long, text string")).count() == 0


# licences


def test_license_scan(spark):
    rng = random.Random(5)
    notices = [t for _, t in license_scan.TEMPLATES]
    rows = []
    for d in range(60):
        t = prose(rng, rng.choice([0, 20, 100]))
        if d % 2:
            w = rng.choice([*notices, "licensed under CC-BY 4.0", "All Rights\nReserved", "all rights reserved all rights reserved"]).split(" ")
            cut = [x for x in w if rng.random() < 0.9]
            rng.shuffle(cut) if d % 3 else None
            t += "\n" + " ".join(cut).title() + "\n" + t
        rows.append((d, t))
    rows.append((99, None))
    got = result(license_scan.scan_licenses(docs(spark, rows)))
    sets = [(k, set(words(t))) for k, t in license_scan.TEMPLATES]
    for d, t in rows:
        w, places, own, most = words(t), [], set(), 0.0
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split(" ")
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        for line in (t or "").translate(LOWER).split("\n"):
            for label, s in sets:
                share = len(s & set(words(line))) / len(s)
                if share >= 0.8 - 1e-9:
                    own.add(label)
                    most = max(most, share)
        base = {x for _, x in places}
        want = (len(w), len(places), min([i for i, _ in places], default=None), max([i for i, _ in places], default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else most)
        assert tuple(got[d][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == want, t
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize("width", [20, 45, 75])
def test_license_scan_of_wrapped_notices(spark, width):
    rng = random.Random(width)
    rows = [(d, prose(rng, 30) + "\n" + "\n".join(" * " + x for x in textwrap.wrap(t, width)).upper() + "\n" + prose(rng, 30)) for d, (_, t) in enumerate(license_scan.TEMPLATES)]
    mit = license_scan.TEMPLATES[3][1].split(" ")
    rows += [(100, "\n".join(mit[:19])), (101, "\n".join(" ".join([w] + ["w1"] * 3) for w in mit)), (102, ("it was the software and w2 of w3\n" * 3000) + "\n".join(mit))]
    got = result(license_scan.scan_licenses(docs(spark, rows)))
    for d, t in rows:
        w, labels, most = words(t), set(), 0.0
        for label, template in license_scan.TEMPLATES:
            s, n = set(words(template)), len(words(template))
            blocks = [set(words(x)) for x in t.split("\n")] + [set(w[i : i + n]) for i in range(len(w))]
            share = max(len(s & b) for b in blocks) / len(s)
            if share >= 0.8 - 1e-9:
                labels.add(label)
                most = max(most, share)
        assert labels == {x for x in got[d]["labels"].split(",") if x.startswith("notice-")}, t
        assert got[d]["score"] == (1.0 if got[d]["n_base"] else most)
    assert all(label in got[d]["labels"] for d, (label, _) in enumerate(license_scan.TEMPLATES)) and "notice-mit" in got[102]["labels"]


def test_license_scan_of_repeated_long_and_clashing_rows(spark):
    mit = license_scan.TEMPLATES[3][1]
    rows = [(1, mit), (1, mit), (1, "none"), (None, "cc by"), (2, "word " * 100_000 + "\n" + mit), (3, mit + "\n" + "x" * 500_000)]
    table = docs(spark, rows).withColumnRenamed("source", "score").withColumnRenamed("lang", "rid").withColumnRenamed("n_chars", "labels")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in license_scan.scan_licenses(table).collect())
    n = len(mit.split())
    assert got == [(0, 2, "cc-by"), (1, 1, ""), (1, n, "notice-mit"), (1, n, "notice-mit"), (2, 100_000 + n, "notice-mit"), (3, n + 1, "notice-mit")]


def test_a_share_of_words_is_exact():
    assert [license_scan._need(n, c) for n, c in ((25, 0.56), (25, 0.8), (24, 0.8), (10, 0.7), (1, 0.1))] == [14, 20, 20, 7, 1]


# lines


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0, "shard_keys": 5, "salt_rows": 20}])
def test_line_dedup(spark, how):
    rng = random.Random(6)
    pool = [prose(rng, rng.choice([1, 2, 3, 8])).replace("\n", " ") for _ in range(40)] + ["", "   ", "äöüäöüäöüä", "ÄÖÜäöüäöüä", "short", "\x0bpadded line here\t"]
    rows = [(d, "\n".join(rng.choice(["", " ", "\t"]) + (lambda x: x.upper() if rng.random() < 0.3 else x)(rng.choice(pool)) for _ in range(rng.randrange(6)))) for d in range(80)] + [(100, None), (101, "x" * 50 + "\n" + "x" * 50), (102, "x" * 50)]
    rows += [(None, pool[0] * 3), (103, pool[0] * 3), (104, "same doc line\nsame doc line"), (104, "same doc line")]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held: dict[str, set] = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None:
                held.setdefault(key(line), set()).add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or d == min(held[key(x)])]
        want.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    table = docs(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(table, **how).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(docs(spark, []), **how).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    h1[:500], h2[1500:2000] = h1[500:1000], h2[2000:2500]  # keys that share a half with another
    slots = line_dedup.PerfectHash.build(h1, h2).slots(h1, h2)
    assert sorted(slots.tolist()) == list(range(5000))
    twice = line_dedup.PerfectHash.build(np.repeat(h1, 2), np.repeat(h2, 2))
    assert sorted(twice.slots(h1, h2).tolist()) == list(range(5000))


def test_line_dedup_of_very_long_texts(spark):
    line = "a line that stands in both of them"
    rows = [(1, line), (2, "\n".join([line, *(f"own line number {i}" for i in range(20_000)), line.upper()])), (2, "x" * 2_000_000), (3, "x" * 2_000_000)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], len(r["text"])) for r in line_dedup.dedup_lines(docs(spark, rows)).collect())
    assert [(d, n, k) for d, n, k, _ in got] == [(1, 1, 0), (2, 1, 0), (2, 20_002, 2), (3, 1, 1)] and got[3][3] == 0


# near duplicates


def shingles(text):
    w = [x for x in BLANK.split((text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    top = {d: d for d in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "rounds"), [(1, 3), (2, 0), (3, 1)])
def test_near_duplicates(spark, monkeypatch, seed, rounds):
    if seed > 1:  # small fragments, and blocks of few classes, so that keys have several
        monkeypatch.setattr(jaccard_join, "FRAGMENT", 300)
        monkeypatch.setattr(jaccard_join, "BLOCK", 4)
        monkeypatch.setattr(jaccard_join, "LOCAL_LINKS", 0)
    rng = random.Random(seed)
    shared = prose(rng, 60)
    texts = [prose(rng, rng.choice([0, 1, 3, 5, 8, 60, 150])) for _ in range(60)]
    texts += family(rng, prose(rng, 150), 40, 4) + family(rng, prose(rng, 60), 25, 3) + family(rng, prose(rng, 12), 15, 1)
    texts += [f"{prose(rng, rng.choice([10, 30, 80]))} {shared} {prose(rng, 20)}" for _ in range(30)]
    texts += [t.upper().replace(" ", "\t ") for t in texts[60:70]] + ["a b c", "A b  c", None, "", " \n "]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    got = result(jaccard_join.near_duplicates(docs(spark, rows).repartition(3), star_rounds=rounds))
    assert {d: (v["n_shingles"], v["component_id"]) for d, v in got.items()} == groups(rows)


def test_near_duplicates_of_long_texts_and_clashing_columns(spark):
    long = " ".join(f"v{i % 9973}" for i in range(60_000))
    rows = [(-(2**63), long), (4, long + " end"), (5, "x" * 300_000), (6, "y" * 300_000), (None, long), (7, None)]
    table = docs(spark, rows).withColumnRenamed("source", "cls").withColumnRenamed("lang", "component_id").withColumnRenamed("n_chars", "n")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in jaccard_join.near_duplicates(table).collect()))
    assert got == [(False, -(2**63), -(2**63)), (False, 4, -(2**63)), (False, 5, 5), (False, 6, 6), (False, 7, 7), (True, 0, None)]


def test_near_duplicates_of_few(spark):
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0
    one = result(jaccard_join.near_duplicates(docs(spark, [(7, "only one text of some words")])))
    assert (one[7]["n_shingles"], one[7]["component_id"]) == (2, 7)
    same = jaccard_join.near_duplicates(docs(spark, [(3, "x y"), (2, "X  y"), (None, "x y"), (2, "X  y")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in same), key=str) == [(2, 2), (2, 2), (3, 2), (None, None)]


def test_chains_are_one_group(spark):
    base = [f"t{i}" for i in range(80)]
    rows = [(k, " ".join([*base[: 80 - 6 * k], *(f"n{i}" for i in range(6 * k))])) for k in range(12)]
    got = result(jaccard_join.near_duplicates(docs(spark, rows)))
    assert {d: v["component_id"] for d, v in got.items()} == {d: r for d, (_, r) in groups(rows).items()}


def test_shingles_equal_sets_of_tuples():
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 6, 50)] + ["a\x0bb\x0cc d e f", "É a b c d"]
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts], 5, chunk=64), strict=True):
        assert len(s) == len(shingles(t)) and (np.diff(s.astype(object)) > 0).all()


@pytest.mark.parametrize("length", [16, 17, 128, 1024, 2048])
def test_words_of_like_letters_are_apart(spark, length):
    a = "a"
    while len(a) < length:
        a += a.translate(str.maketrans("ab", "ba"))
    a, b = a[:length], a[:length].translate(str.maketrans("ab", "ba"))
    texts = [x.encode() for x in (a, b, f"{a} {b}", f"{b} {a}", " ".join([a] * 6), " ".join([b] * 6), a.upper(), a + "\0")]
    sets = [s.tolist() for s in shingle_sets(texts, 5)]
    assert sets[0] == sets[6] and len({tuple(s) for s in sets}) == 7
    rows = [(1, a), (2, b), (3, a.upper()), (4, " ".join([a] * 6)), (5, " ".join([b] * 6))]
    got = result(jaccard_join.near_duplicates(docs(spark, rows)))
    assert {d: v["component_id"] for d, v in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
