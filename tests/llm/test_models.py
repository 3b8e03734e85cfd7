"""Languages, toxicity, nearest neighbours and sharding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given
from hypothesis import strategies as st

from kgloom.llm import language_id, sharding, toxicity, vptree

from .helpers import docs, prose, result

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sche", "ung", "ver", "ich"], "cc": ["eau", "tion", "que", "oui"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize()


def test_languages(spark):
    rng = random.Random(1)
    rows = [(d, speech(rng, lang, rng.choice([15, 60, 1500])), None if d % 10 == 0 else lang, "s", 1) for d, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    truth = {r[0]: r[2] for r in rows}
    rows += [(1000, None, "aa", "s", 0), (1001, "123 !!", "bb", "s", 0), (None, "tokami", "aa", "s", 0), (1002, "", None, "s", 0)]
    out = language_id.identify_language(docs(spark, rows).withColumnRenamed("source", "score")).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    for d in (1000, 1001, 1002):
        assert got[d]["lang_pred"] == "und" and got[d]["rejected"] and got[d]["score"] == 0.0
    known = [d for d, lang in truth.items() if lang]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d]["score"] <= 1 for d in known)
    held = [d for d in known if got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.98 * len(held)


def test_letters_by_their_category(spark):
    rows = [(1, "abc def", "aa", "s", 1), (2, "½ ²", None, "s", 1), (3, "Ⅷ", None, "s", 1), (4, "12_3", None, "s", 1), (5, "ʰ", None, "s", 1), (7, "日本", None, "s", 1)]
    got = result(language_id.identify_language(docs(spark, rows)).select("doc_id", "lang_pred", "score"))
    assert {d: v["lang_pred"] for d, v in got.items()} == {1: "aa", 2: "und", 3: "und", 4: "und", 5: "aa", 7: "aa"}
    assert got[2]["score"] == 0.0


def test_copies_do_not_push_a_language_out(spark):
    rng = random.Random(4)
    rows = [(d, speech(rng, "aa", 30), "aa", "s", 1) for d in range(400)] + [(d, "Ver schich ung ich verung.", "bb", "s", 1) for d in range(400, 6000)]
    long = next(d for d in range(9100, 9200) if zlib.crc32(str(d).encode()) % 4 != 2)
    rows += [(9000, speech(rng, "bb", 40), None, "s", 1), (9000, speech(rng, "aa", 40), None, "s", 1), (long, "tion oui " * 20_000, "cc", "s", 1), (9002, "tion oui tion oui oui tion " * 3, None, "s", 1)]
    out = language_id.identify_language(docs(spark, rows).repartition(3)).collect()
    assert {r["lang_pred"] for r in out if 400 <= r["doc_id"] < 6000} == {"bb"}
    assert sorted(r["lang_pred"] for r in out if r["doc_id"] == 9000) == ["aa", "bb"]
    assert [r["lang_pred"] for r in out if r["doc_id"] == 9002] == ["cc"]


def test_equal_languages_are_tied_by_name(spark):
    same = [(d, "tomi kato ruka mito", lang, "s", 1) for d, lang in ((1, "zz"), (3, "mm"), (4, "zz"), (5, "mm"))]
    known = [r for r in same if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = language_id.identify_language(docs(spark, [*known, (100, "kato mito", None, "s", 1)]))
    r = [x for x in got.collect() if x["doc_id"] == 100][0]
    assert r["lang_pred"] == min(x[2] for x in known) and r["rejected"] == (len({x[2] for x in known}) > 1)


def test_more_languages_and_copies(spark):
    rng = random.Random(8)
    own = {f"l{n:02d}": ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)] for n in range(70)}
    rows = [(100 * n + d, " ".join(rng.choices(w, k=40)), lang, "s", 1) for n, (lang, w) in enumerate(own.items()) for d in range(6)]
    got = result(language_id.identify_language(docs(spark, rows)).select("doc_id", "lang_pred"))
    assert sum(got[d]["lang_pred"] == lang for d, _, lang, _, _ in rows) >= 0.98 * len(rows)
    copies = [(d, f"copy {d % 2}", "aa", "s", 1) for d in range(4000)] + [(d, f"text {d}", "aa", "s", 1) for d in range(4000, 4100)]
    found = language_id.sample_rows(docs(spark, copies), 4, 2, 20, 100)
    assert len(found) == len(set(found)) == 20


def test_languages_without_labels(spark):
    assert {r["lang_pred"] for r in language_id.identify_language(docs(spark, [(1, "abc", None, "s", 3)])).collect()} == {"und"}
    assert language_id.identify_language(docs(spark, [])).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["grrbad", "vilest", "scumly", "wretched"]
    rows, labels = [], []
    for d in range(600):
        t, y = speech(rng, "aa", rng.choice([30, 200])), int(d % 5 == 0)
        if y:
            w = t.split()
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad).capitalize())
            t = " ".join(w)
        rows.append((d, t))
        labels.append((d, 1, y))
    rows += [(1000, None), (1001, ""), (1002, "!!! 12"), (None, "x")]
    labels += [(None, 1, 1), (1001, 1, None), (5, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs(spark, rows), table).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r for r in out}
    held = [d for d in range(600) if got[d]["held_out"]]
    assert {d for d in range(600) if zlib.crc32(str(d).encode()) % 5 == 0} == set(held)
    hits = [(got[d]["predicted"], int(d % 5 == 0)) for d in held]
    assert sum(p == y for p, y in hits) >= 0.97 * len(hits)
    assert all(got[d]["predicted"] == 0 and 0 <= got[d]["score"] < 0.5 for d in (1000, 1001, 1002))


def test_toxicity_of_a_long_tail():
    rng = random.Random(7)
    bad = [f"{a}{b}rk" for a in ("gr", "vl", "sk", "wr", "bl", "zn", "kn", "dr", "thr", "pf") for b in ("ao", "eu", "iu", "oe", "ua", "yo", "ie", "ou", "ay", "uy")]

    def text(toxic):
        w = speech(rng, "aa", 60).split()
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    model = toxicity.train([text(True) for _ in range(1600)], [text(False) for _ in range(1600)])
    scorer = model.scorer()
    assert sum(scorer.score(text(True)) >= 0.5 for _ in range(200)) >= 180
    assert sum(scorer.score(text(False)) >= 0.5 for _ in range(200)) <= 10


def test_toxicity_as_in_plain_python(spark):
    """Every row's score is that of a plain scorer over whole texts, also of repeated, empty and very long ones."""
    rng = random.Random(12)
    rows, labels = [], []
    for d in range(160):
        bad = d % 3 == 0
        t = speech(rng, "bb", 25) + (" grrbad vilest scumly" if bad else "")
        rows.append((d, t))
        labels.append((d, 0, int(bad)))
    rows += [(500, "x " * 100_000 + "grrbad vilest scumly"), (501, ""), (502, None), (3, rows[3][1]), (3, "another of this id"), (None, rows[6][1])]
    labels += [(3, 1, 1), (3, 0, 0), (700, 0, 1), (None, 0, 1), (501, 0, 0), (502, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = docs(spark, rows).withColumnRenamed("source", "predicted").withColumnRenamed("lang", "toxic")
    own = toxicity.sample_rows(frame, table, 5, 0, 2000, 20_000)
    assert len(own[0]) + len(own[1]) == len({t for d, t in rows if t and d is not None and d < 160 and zlib.crc32(str(d).encode()) % 5} - {max(t for d, t in rows if d == 3)})
    model = toxicity.train(*own)
    assert len(model.toxic) >= 8 and len(model.ordinary) >= 8

    def distance(text):
        words = toxicity.WORDS.findall((text or "").lower())
        one, two = (zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (model.toxic, model.ordinary))
        windows = [b"".join(xxhash.xxh64_digest("^" + w[:4]) + xxhash.xxh64_digest(w) for w in words[i : i + 24]) for i in range(0, len(words), 24)]
        return max([0, *(len(two.compress(w)) - len(one.compress(w)) for w in windows)])

    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"] >= 0.5, r["predicted"]) for r in toxicity.score_toxicity(frame, table).collect())
    want = sorted((-1 if d is None else d, distance(t) > model.threshold, int(distance(t) > model.threshold)) for d, t in rows)
    assert got == want
    assert toxicity.score_toxicity(docs(spark, []), table).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.score_toxicity(docs(spark, [(1, "a b")]), none).collect()] == [0]


def neighbours(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            near = sorted((-float(x @ y), i) for i, y in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("factor", [1.0, 0.6])
def test_nearest(spark, factor):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)] + [(i, [0.5] * 8) for i in range(900, 1000)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("nan")] * 8), (2080, [1.0] * 3), (None, [1.0] * 8), (2100, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = {k: v for k, v in neighbours([(i, np.array(v, np.float32).tolist() if v and None not in v else v) for i, v in rows], 20, 20).items()}
    got: dict = {}
    for r in sorted(vptree.nearest(df, factor=factor, sample=256, shard_rows=64, query_rows=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(exact)
    if factor == 1.0:
        for q, want in exact.items():
            assert np.allclose([s for _, s in want], [s for _, s in got[q]], rtol=0, atol=1e-9)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want}) for q, want in exact.items())
    assert found >= (0.99 if factor == 1.0 else 0.9) * sum(map(len, exact.values()))


@pytest.mark.parametrize("kind", ["one long", "mixed norms", "low dimension"])
def test_nearest_as_registered(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24))
    if kind == "low dimension":
        x = rng.normal(size=(6000, 4)) @ rng.normal(size=(4, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long":
        x[7] *= 3
    if kind == "mixed norms":
        x *= rng.lognormal(size=(6000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vptree.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ip = x[::20] @ x.T
    ip[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = np.argsort(-ip, axis=1)[:, :20]
    assert all(got[20 * n] == set(w) for n, w in enumerate(want.tolist()))


@pytest.mark.parametrize("kind", ["one long", "mixed norms", "low dimension"])
def test_a_calibrated_factor_keeps_the_recall(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 4)) @ rng.normal(size=(4, 24)) + 0.05 * rng.normal(size=(5000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long":
        x[7] *= 3
    if kind == "mixed norms":
        x *= rng.lognormal(0, 0.3, size=(5000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    factor, told = vptree.calibrate(df, 0.9)
    assert told >= 0.95 and factor < 1
    got: dict = {}
    for r in vptree.nearest(df, factor=factor, shard_rows=512).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ip = x[::20] @ x.T
    ip[np.arange(250), np.arange(0, 5000, 20)] = -np.inf
    want = np.argsort(-ip, axis=1)[:, :20]
    assert sum(len(got[20 * n] & set(w)) for n, w in enumerate(want.tolist())) >= 0.9 * want.size
    assert vptree.calibrate(df.limit(0)) == (1.0, 1.0)


def test_copies_are_ordered_by_id(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 33))
    rows = [(i, base[i % 40].tolist(), "x") for i in rng.permutation(3000).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    got: dict = {}
    for r in sorted(vptree.nearest(df, sample=512, shard_rows=300).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ip = base @ base.T
    for q in range(0, 3000, 20):
        near = sorted(range(40), key=lambda j: -ip[q % 40, j])
        want = [i for j in near[:2] for i in range(j, 3000, 40) if i != q][:20]
        assert [i for i, _ in got[q]] == want and got[q][0][1] == got[q][19][1]


def test_rows_of_one_id_give_one_list(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])]
    got = [tuple(r)[:3] for r in vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got[0] == (0, 1, 2) and got[1] == (0, 2, 1) and len({r for _, r, _ in got}) == len(got)


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[:3] for r in vptree.nearest(few).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert vptree.nearest(few.limit(0)).count() == 0


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(d, prose(rng, rng.choice([0, 5, 50, 400]))) for d in range(3000)] + [(d, "copy of one text " * 30) for d in range(3000, 3400)] + [(5000, None), (5001, "é")]
    out = result(sharding.assign_shards(docs(spark, rows).withColumnRenamed("source", "shard"), slot_rows=100))
    assert len(out) == len(rows)
    size = {d: len((t or "").encode()) + 1 for d, t in rows}
    shards = [[r for r in out.values() if r["shard"] == s] for s in range(8)]
    total = [sum(size[r["doc_id"]] for r in s) for s in shards]
    assert max(total) <= 1.02 * min(total)
    for s in shards:
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    assert all(r["size"] == size[d] and r["law"] == "bytes" and r["grown_shard"] is None for d, r in out.items())
    assert len({out[d]["shard"] for d in range(3000, 3400)}) == 1
    texts = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32((texts[d] or "").encode()) for d, r in out.items())


def test_sharding_splits_a_group_larger_than_a_shard(spark):
    rng = random.Random(5)
    rows = [(d, "the same " * 40) for d in range(700)] + [(d, prose(rng, 80)) for d in range(700, 1400)]
    total: dict = {}
    for r in sharding.assign_shards(docs(spark, rows)).collect():
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert len(total) == 8 and max(total.values()) <= 1.1 * min(total.values())
    assert sharding.assign_shards(docs(spark, [])).count() == 0
    assert sharding.assign_shards(docs(spark, [(1, "a"), (1, "a"), (2, None)])).count() == 3


def plain_tree(rows, shards, names):
    """The same k-d tree by sorting: shard by text."""

    def code(name):
        return -1 if name is None else int.from_bytes(name.encode()[:7].ljust(7, b"\0"), "big")

    groups: dict = {}
    for d, t, lang, source in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
        g = groups.setdefault(t or "", {"w": 0, "bytes": len((t or "").encode()) + 1, "first_id": d, "source": code(source), "lang": code(lang), "text": t or ""})
        g["w"] += g["bytes"]
    dims = [*names, "bytes", "first_id"]
    span = {d: max(1, max(g[d] for g in groups.values()) - min(g[d] for g in groups.values())) for d in dims}
    out = {}

    def cut(node, width, base):
        if width == 1:
            out.update({g["text"]: base for g in node})
            return
        dim = max(dims, key=lambda d: ((max(g[d] for g in node) - min(g[d] for g in node)) / span[d], -dims.index(d)))
        ordered = sorted(node, key=lambda g: (g[dim], g["first_id"]))
        want, run, k = sum(g["w"] for g in node) / 2, 0, 0
        while run + ordered[k]["w"] < want:
            run += ordered[k]["w"]
            k += 1
        k += run + ordered[k]["w"] / 2 < want
        cut(ordered[:k], width // 2, base)
        cut(ordered[k:], width // 2, base + width // 2)

    cut(list(groups.values()), shards, 0)
    return out


def test_sharding_is_the_tree_of_its_metadata(spark):
    rng = random.Random(9)
    rows = [(d, prose(rng, rng.randrange(5, 60)), rng.choice(["aa", "bb", "bb", None]), rng.choice(["hot", "hot", "hot", "src1", "src2", "a longer name", "a longer name too", "é"])) for d in range(400)]
    rows += [(d, rows[d % 7][1], "aa", "src1") for d in range(400, 430)]
    table = docs(spark, [(*r, 1) for r in rows])
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(table, heavy=1.0, tolerance=0.0, bins=16).collect()}
    want = plain_tree(rows, 8, ("source", "lang"))
    assert got == {d: want[t or ""] for d, t, _, _ in rows}


@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(0, 2000), st.integers(0, 2000), st.integers(0, 3000))
def test_halves_are_balanced_where_they_can_be(weights, left, right, light):
    side = sharding.halve([float(w) for w in weights], left, right, light, 1.0)
    a, b = (sum(w for w, s in zip(weights, side, strict=True) if s == x) for x in (True, False))
    gap = abs(left + a - right - b)
    prefix = min(abs(left + sum(weights[:k]) - right - sum(weights[k:])) for k in range(len(weights) + 1))
    assert gap <= prefix and (gap <= light + 1 or gap <= max([abs(left - right), *weights]))


def test_sharding_of_a_small_corpus_of_unlike_sizes(spark):
    rng = random.Random(11)
    rows = [(d, prose(rng, int(3 * 1.06 ** rng.randrange(100)) + 1), rng.choice(["aa", "bb"]), f"src{rng.randrange(5)}", 1) for d in range(300)]
    rows += [(400, "w " * 4000, "aa", "src1", 1), (400, "w " * 4000, "aa", "src1", 1), (None, "no id", None, None, 1)]
    total: dict = {}
    out = sharding.assign_shards(docs(spark, rows)).collect()
    for r in out:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert len(out) == len(rows) and len(total) == 8 and max(total.values()) <= 1.03 * min(total.values()), total


def test_sharding_with_very_long_texts_and_ties(spark):
    rows = [(1, "x" * 3_000_000), (2, "y" * 3_000_000)] + [(d, f"{d % 3}" * 1000 + f"{d:05d}") for d in range(3, 3000)] + [(7, "0" * 1000), (7, "0" * 1000)]
    out = sharding.assign_shards(docs(spark, rows)).collect()
    total: dict = {}
    for r in out:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert len(out) == len(rows) and {r["shard"] for r in out if r["doc_id"] == 1} != {r["shard"] for r in out if r["doc_id"] == 2}
    light = [v for s, v in total.items() if s not in {r["shard"] for r in out if r["doc_id"] in (1, 2)}]
    assert max(light) <= 1.03 * min(light), total  # a text larger than a shard fills one alone, and the rest share what is left


@pytest.mark.parametrize("ids", ["own", "none"])
def test_sharding_of_texts_of_one_size(spark, ids):
    rows = [(d if ids == "own" else None, f"{d:06d} " + "x" * 193) for d in range(3800)] + [(d if ids == "own" else None, f"{d:06d}"[: 1 + d % 6] + "y" * (d % 9)) for d in range(3800, 4000)]
    total: dict = {}
    for r in sharding.assign_shards(docs(spark, rows)).collect():
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert len(total) == 8 and max(total.values()) <= 1.02 * min(total.values()), total
