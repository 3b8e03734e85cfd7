"""Token ids against the library; wavelet matrices against plain lists; packing and its laws."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kgloom.llm import packing, wavelet
from kgloom.llm.encoding import Encoder

from .helpers import docs, prose

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "a  b\n\n c\t d  ", "x\n", "\n\nfoo", "don't 'tis we'll '", "é ÉA ½ 12 3a4 ²", "naïve\xa0 ok\xa0\xa0x", "日本 ok", "<|endoftext|> hi", "a\x00b", "\r\n \r\n z ", "!!! ??  ...", " lead", "tail ", "ÿßµªº", "a\xadb", "İstanbul", "x" * 500]
ENCODERS = {n: Encoder(public_tokenizers.path(n)) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_encoder_knows_its_rule(name):
    assert ENCODERS[name].rule


def check(name, texts):
    e = ENCODERS[name]
    ids, n = e.encode(texts)
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(name):
    check(name, ODD)
    for t in ODD:
        check(name, [t])
    check(name, [])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.characters(max_codepoint=0x17F) | st.sampled_from(" \n\t'.-aZ9é"), max_size=40), max_size=5))
def test_any_text(name, texts):
    check(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_as_in_the_library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["a <|endoftext|> b", "plain", "<|startoftext|><|endoftext|>", "a<|EndOfText|>b", "<|endoftext", "é 日本<|endoftext|>", *ODD]
    ids, n = Encoder(public_tokenizers.path(name)).encode(texts)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", NAMES)
def test_words_of_one_hash_keep_their_own_ids(name):
    tok, texts = Tokenizer.from_file(public_tokenizers.path(name)), []
    for n in (16, 17, 128, 256, 512, 1024, 2048):
        a = "a"
        while len(a) < n:
            a += a.translate(str.maketrans("ab", "ba"))
        b = a[:n].translate(str.maketrans("ab", "ba"))
        texts += [a[:n], b, f"{a[:n]} {b}", f"so {b} it {a[:n]}"]
    for order in (texts, texts[::-1]):
        ids, k = Encoder(public_tokenizers.path(name)).encode(order)
        want = [tok.encode(t, add_special_tokens=False).ids for t in order]
        assert k.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_full_table_starts_anew():
    e = Encoder(public_tokenizers.path(NAMES[1]))
    e.KEPT = 10
    rng = random.Random(1)
    for _ in range(5):
        t = [prose(rng, 50)]
        assert e.encode(t)[0].tolist() == e.tok.encode(t[0], add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 49407), max_size=700))
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    m = wavelet.WaveletMatrix(wavelet.to_blob(a))
    assert m.ids().tolist() == ids
    for i in range(0, len(ids), 37):
        assert m.access(i) == ids[i]
    for s in [*ids[:5], 299, 70000]:
        assert m.count(s) == ids.count(s)
        assert m.rank(s, len(ids) // 2) == ids[: len(ids) // 2].count(s)
        assert [m.select(s, k) for k in range(min(4, m.count(s)))] == [i for i, x in enumerate(ids) if x == s][:4]
    with pytest.raises(IndexError):
        m.select(70001, 0)


@pytest.mark.parametrize("n", [65_535, 65_536, 65_537, 300_000])
def test_wavelet_matrix_of_several_frames(n):
    ids = np.random.default_rng(n).zipf(1.4, n).astype(np.uint64).clip(0, 49_407).astype(np.uint32)
    blob = wavelet.to_blob(ids)
    assert (wavelet.WaveletMatrix(blob).ids() == ids).all()
    m = wavelet.WaveletMatrix(blob)
    assert m.inflated == 0 and m.access(n - 1) == ids[-1] and m.inflated <= 2 * m.planes
    for i in (0, 1, 65_534, n // 2, n - 2):
        assert m.access(i) == ids[i]
    for symbol in (1, 2, int(ids[-1]), 49_407, 40_001):
        where = np.flatnonzero(ids == symbol)
        assert m.count(symbol) == len(where) and m.rank(symbol, n // 3) == (where < n // 3).sum()
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert m.select(symbol, k) == where[k]
    assert len(m.open) <= m.kept


def test_shards_with_null_and_smallest_ids(spark, tmp_path):
    rows = [(-(2**63), "smallest"), (None, "b"), (None, "a a"), (0, "zero"), (0, "zero"), (7, None)]
    table = docs(spark, rows).withColumnRenamed("source", "start").withColumnRenamed("lang", "n_tokens")
    wavelet.write_token_shards(table, public_tokenizers.path(NAMES[0]), str(tmp_path / "s"), shard_tokens=4)
    got = wavelet.read_documents(spark.read.parquet(str(tmp_path / "s"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(2**63), 0, 0, 7]
    assert [r["n_tokens"] for r in got][:2] == [3, 2] and got[-1]["n_tokens"] == 1


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, prose(rng, rng.choice([0, 3, 200]))) for d in rng.sample(range(1000), 60)] + [(2000, None), (2001, ""), (5, "long " * 5000)]
    path = str(tmp_path / "shards")
    wavelet.write_token_shards(docs(spark, rows), public_tokenizers.path(NAMES[0]), path, shard_tokens=1000)
    got = wavelet.read_documents(spark.read.parquet(path)).orderBy("start").collect()
    start = 0
    for r, (d, text) in zip(got, sorted(rows), strict=True):
        ids = [*ENCODERS[NAMES[0]].tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert spark.read.parquet(path).count() > 3


def test_tokens_are_found_in_their_shards(spark, tmp_path):
    rng = random.Random(7)
    rows = [(d, prose(rng, 50)) for d in range(40)]
    wavelet.write_token_shards(docs(spark, rows).repartition(3), public_tokenizers.path(NAMES[0]), str(tmp_path / "s"), shard_tokens=700)
    shards = spark.read.parquet(str(tmp_path / "s"))
    ids = {(r["part"], r["seq"]): wavelet.WaveletMatrix(r["blob"]).ids().tolist() for r in shards.collect()}
    for token in (1, 0, ids[min(ids)][3]):
        got = {(r["part"], r["seq"]): (r["count"], r["places"]) for r in wavelet.find_token(shards, token).collect()}
        assert got == {k: (v.count(token), [i for i, x in enumerate(v) if x == token]) for k, v in ids.items()}
    assert all(len(r["places"]) <= 2 for r in wavelet.find_token(shards, 1, most=2).collect())


def test_shards_of_an_empty_table(spark, tmp_path):
    wavelet.write_token_shards(docs(spark, []), public_tokenizers.path(NAMES[0]), str(tmp_path / "e"))
    assert wavelet.read_documents(spark.read.schema(wavelet.SHARD_SCHEMA).parquet(str(tmp_path / "e"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_takes_the_tightest_window(lengths):
    window, offset, fill = packing.best_fit(lengths, 64)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(64 - n)
    assert sorted(fill) == sorted(64 - r for r in rooms)
    for w in range(len(fill)):
        at = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if window[i] == w)
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and fill[w] == sum(n for _, n in at) <= 64


def test_packing_leaves_little_room(spark):
    rng = random.Random(5)
    rows = [(d, prose(rng, rng.choice([3, 40, 300, 900]))) for d in range(400)]
    out = packing.pack(docs(spark, rows).repartition(1), public_tokenizers.path(NAMES[1])).collect()
    fill = {r["sequence_id"]: (r["sequence_tokens"], r["padded_to"]) for r in out}
    assert sum(u for u, _ in fill.values()) >= 0.97 * sum(p for _, p in fill.values())
    few = packing.pack(docs(spark, [(d, "") for d in range(1000)]).repartition(1), public_tokenizers.path(NAMES[1]), batch_pieces=100).collect()
    assert len(few) == 1000 and len({r["sequence_id"] for r in few}) == 10 and all(r["sequence_tokens"] == 100 for r in few)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(d, prose(rng, rng.choice([1, 40, 300]))) for d in range(80)] + [(100, None), (101, "word " * 6000), (101, "word " * 6000)]
    out = packing.pack(docs(spark, rows).withColumnRenamed("source", "start").repartition(2), public_tokenizers.path(NAMES[1]), batch_tokens=20_000).collect()
    enc = ENCODERS[NAMES[1]].tok
    for d, text in rows:
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"])
        times = 2 if d == 101 else 1
        assert sum(r["length"] for r in own) == times * len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for s in {r["sequence_id"] for r in out}:
        own = sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"])
        total = sum(r["length"] for r in own)
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))] and total <= 2048
        assert {r["padded_to"] for r in own} == {total if total & (total - 1) == 0 else 2048}
    assert packing.pack(docs(spark, []), public_tokenizers.path(NAMES[1])).count() == 0
