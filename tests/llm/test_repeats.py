"""Suffix arrays, removal of repeats, funnels and divergence against brute force."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgloom.llm import divergence, funnels, repeats
from kgloom.llm.suffix_array import Suffixes

from ..helpers import shuffled_rows
from .helpers import docs, prose, result

MINUTE = 60_000_000


def plain_order(strings: list[bytes]) -> list[int]:
    n, at, out = len(strings), 0, []
    for i, s in enumerate(strings):
        out += [([b + n for b in s[o:]] + [n - 1 - i], at + o) for o in range(len(s))]
        at += len(s) + 1
    return [p for _, p in sorted(out)]


def shared(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffixes_and_common_prefixes():
    rng = random.Random(3)
    cases = [[b"a"], [b"aaaa", b"aaa", b"aaaa"], [b"banana", b"ananas"], [bytes(range(256))], [b"\0\0", b"\xff\0\xff"], [b"abab" * 30]]
    for _ in range(300):
        size, letters = rng.choice([3, 12, 50]), rng.choice([1, 2, 4, 256])
        cases.append([bytes(rng.randrange(letters) for _ in range(rng.randrange(1, size))) for _ in range(rng.randrange(1, 14))])
        cases[-1] += cases[-1][:rng.randrange(3)]
    for strings in cases:
        s, order = Suffixes(strings), plain_order(strings)
        assert s.sa.tolist() == order
        common, suffix = s.common(), lambda p, s=s: s.text[p:p + s.rest[p]]
        assert [common[q] for q in order[1:]] == [shared(suffix(p), suffix(q)) for p, q in zip(order, order[1:], strict=False)]


def plain_removal(rows: list[tuple], width: int = 50) -> list[tuple]:
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    least: dict[bytes, int] = {}
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - width + 1):
                least[t[i:i + width]] = min(d, least.get(t[i:i + width], d))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - width + 1):
                if least[t[i:i + width]] < d:
                    gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def texts_with_repeats() -> list[tuple]:
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (4, 9, 12, 30, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 40)) for _ in range(4)]
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(9):])
        rows.append((i * 3, rng.choice([" ", "ä", ""]).join(parts)))
    rows += [(400 + i, rows[i % 5][1]) for i in range(20)]
    rows += [(900, None), (901, ""), (902, "x" * 49), (903, "x" * 50), (904, "x" * 51), (905, "x" * 5000), (1, "y" * 400), (2, "y" * 120 + "z" + "y" * 60)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (-7, "ß" * 60), (8, "ß" * 60 + "é" * 70)]
    rows += [(2000, prose(rng, 20000) + rows[3][1] + prose(rng, 3000)), (2001, rows[3][1][10:] + "tail")]
    return rows


@pytest.mark.parametrize("hot", [50_000, 2])
def test_removal_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 5000)
    rows = texts_with_repeats()
    found = repeats.remove_repeats(docs(spark, rows), shard_bytes=4000, hot=hot)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "n_removed", "n_spans", "kept"]
    own = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
    assert own == Counter(plain_removal(rows))


def test_pieces_left_out_share_no_window():
    """Only pieces that share no window with another are left out of a shard, and most of those that share none are."""
    rng = random.Random(12)
    some = [t.encode() for _, t in texts_with_repeats() if t]
    some += [b"".join(prose(rng, 6).encode() + b" one anchor in common " for _ in range(5)) for _ in range(30)] + [b"y" * 90 + b"z" + b"y" * 70]
    for width, gram in ((50, 16), (50, 50), (24, 9), (33, 8)):
        of, h, first, count = repeats.pieces(some, width, gram)
        cut = sorted({(int(k), some[i][a:a + n + width - 1]) for i, k, a, n in zip(of, h, first, count, strict=True)})
        own = repeats.related([p for _, p in cut], np.array([k for k, _ in cut]), width, gram)
        windows = [{p[i:i + width] for i in range(len(p) - width + 1)} for _, p in cut]
        number = Counter(w for s in windows for w in s)
        shares = np.array([any(number[w] > 1 for w in s) for s in windows])
        assert not (shares & ~own).any() and shares.any()
        assert (~own).sum() > 0.5 * (~shares).sum()


def test_pieces_are_dealt_once(spark):
    rows = docs(spark, texts_with_repeats()).repartition(2).localCheckpoint()
    texts = [(r.text or "").encode() for r in rows.collect() if r.doc_id is not None]
    number = len(repeats.pieces(texts, 50, 16)[0])
    found = []
    sent = shuffled_rows(spark, lambda: found.extend(repeats.remove_repeats(rows).collect()))
    own = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    assert own == Counter(plain_removal(texts_with_repeats()))
    print("pieces", number, "sent", sent)
    assert sent < 1.8 * number, (sent, number)


def test_removal_of_nothing_and_other_columns(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    rows = docs(spark, [(1, "k" * 80), (2, "k" * 80)]).selectExpr("doc_id", "text", "1 AS h", "2 AS row", "3 AS low", "4 AS kept")
    found = result(repeats.remove_repeats(rows))
    assert bytes(found[2]["kept"]) == b"" and found[2]["n_removed"] == 80 and found[1]["n_removed"] == 0 and found[2]["row"] == 2


def plain_funnels(rows: list[tuple], plans=funnels.FUNNELS, within: int = 5 * MINUTE) -> dict:
    by: dict = defaultdict(lambda: defaultdict(set))
    for c, k, t in rows:
        if None not in (c, k, t):
            by[c][k].add(t)
    out = {}
    for name, (steps, excluded) in plans.items():
        for client, kinds in by.items():
            reached = defaultdict(list)
            for start in kinds[steps[0]]:
                reached[1].append(0)
                at = start
                for i, kind in enumerate(steps[1:], 2):
                    later = [t for t in kinds[kind] if t > at]
                    if not later or min(later) - start > within or any(at < t <= min(later) for x in excluded for t in kinds[x]):
                        break
                    reached[i].append(min(later) - at)
                    at = min(later)
            if reached:
                t = {i: sorted(reached[i])[math.ceil(25 * len(reached[i]) / 100) - 1] if reached[i] else None for i in (2, 3, 4)}
                out[name, client] = (*(len(reached[i]) for i in (1, 2, 3, 4)), max(i for i in reached if reached[i]), t[2], t[3], t[4])
    depths = Counter((f, v[4]) for (f, _), v in out.items())
    return {k: (*v, depths[k[0], v[4]]) for k, v in out.items()}


def clicks(spark, rows, kind: str = "timestamp_ntz"):
    epoch = datetime.datetime(1970, 1, 1)
    full = [(c, k, None if t is None else epoch + datetime.timedelta(microseconds=t), 7, "x") for c, k, t in rows]
    return spark.createDataFrame(full, f"client_id long, kind string, arrived_at {kind}, t int, bucket string")


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_funnels_equal_brute_force(spark, kind):
    rng = random.Random(2)
    rows = []
    for _ in range(4000):
        client = rng.choice([7] * 6 + [1, 2, 3, None])
        at = rng.choice([rng.randrange(3 * 60 * MINUTE), rng.randrange(200) * MINUTE // 2, rng.randrange(-60, 60) * 30_000_001])
        rows.append((client, rng.choice(["view", "view", "click", "click", "purchase", "signup", "error", "other", None]), rng.choice([at, at, at, None])))
    rows += rows[:300]
    own = {(r[0], r[1]): tuple(r)[2:] for r in funnels.count_funnels(clicks(spark, rows, kind), piece_rows=100).collect()}
    assert own == plain_funnels(rows)


def test_funnels_at_the_limits(spark):
    rows = [(1, "view", 0), (1, "click", 1), (1, "view", 2), (1, "purchase", 5 * MINUTE), (2, "view", 0), (2, "click", 5 * MINUTE + 1), (3, "view", 5),
        (3, "click", 5), (4, "view", 0), (4, "click", 9), (4, "error", 9), (5, "view", 0), (5, "error", 0), (5, "click", 9), (6, "other", 1)]
    own = {(r[0], r[1]): tuple(r)[2:] for r in funnels.count_funnels(clicks(spark, rows), piece_rows=1).collect()}
    assert own == plain_funnels(rows) and own["A", 1][:5] == (2, 1, 1, 1, 4) and own["A", 2][4] == 1 and ("A", 6) not in own
    assert funnels.count_funnels(clicks(spark, [])).count() == 0


def test_exact_ranks():
    rng = np.random.default_rng(1)
    for _ in range(200):
        v = np.unique(rng.integers(0, 500, 40))
        n = rng.integers(1, 6, len(v))
        order = rng.permutation(len(v))
        k = int(rng.integers(1, n.sum() + 1))
        want = np.sort(np.repeat(v, n))[k - 1]
        assert funnels.kth(v[order], n[order], k) == want
        big = n.astype(np.int64) * funnels.SPREAD
        assert funnels.kth(v[order], big[order], (k - 1) * funnels.SPREAD + 1) == want


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    rows = [(t or "", lang or "", source or "") for _, t, lang, source, _ in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        terms = TERM.findall(t.translate(LOWER))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in [*own.items(), (None, whole)]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(f(p[s][t], p[None][t]), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("shard_terms", [100_000, 7])
def test_divergence_equals_brute_force(spark, shard_terms):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "ÄRGER", "naïve", "日本", "x", "don't", "a1b", "O", "zz"] + [f"w{c}" for c in "abcdefghijklmnop"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"]), 0)
        for i in range(120)]
    rows += [(1, None, "en", "empty", 0), (1, "!!", "fr", "s", 0), (2, "une fois", "fr", "t", 0), (3, "une", "fr", "s", 0), (4, "word " * 3000, "en", "a", 0)] + rows[:9]
    found = divergence.audit(docs(spark, rows), shard_terms=shard_terms, top=6)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    own = [tuple(r) for r in found.collect()]
    assert len(own) == len(set(own)) and set(own) == plain_audit(rows, top=6)


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    own = [tuple(r) for r in divergence.audit(docs(spark, [(1, "one", "en", "a", 0), (2, "two", "en", "b", 0)]).selectExpr("*", "1 AS term", "2 AS n")).collect()]
    assert sorted(own) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_kept_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == result(repeats.remove_repeats(docs(spark, [(1, "")])).selectExpr("doc_id", "sha2(kept, 256) AS s"))[1]["s"]
