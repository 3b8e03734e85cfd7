"""The pipeline's stages one by one against brute force over a small corpus."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import DOC, LOWER
from .test_models import speech
from .test_texts import contaminated, groups


def corpus(rng):
    bench = [(i, speech(rng, "aa", 25)) for i in range(5)]
    rows = []
    for d in range(120):
        lang = "aa" if d % 3 else "bb"
        lines = [speech(rng, lang, rng.choice([8, 20, 40])) for _ in range(3)]
        if d % 4 == 0:
            lines.append("A line that repeats in many documents.")
        if d % 10 == 0:
            lines.append(bench[d % 5][1])
        rows.append((d, "\n".join(lines), lang, "s", 0))
    for d in range(120, 150):  # near copies: one word less, and no shared line
        rows.append((d, "\n".join(" ".join(x.split()[1:]) for x in rows[d - 119][1].split("\n")[:3]), rows[d - 119][2], "s", 0))
    rows += [(200, None, "aa", "s", 0), (201, "12 34", "aa", "s", 0), (202, rows[7][1], rows[7][2], "s", 0)]
    return rows, bench


def test_stages(spark, tmp_path):
    rows, bench = corpus(random.Random(1))
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]

    def kept(name):
        nonlocal docs
        out = stage[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int")]
        return [r.asDict() for r in docs.collect()]

    first = kept("language_id")
    assert {r["doc_id"] for r in first} == {r[0] for r in rows} - {200, 201}
    truth = {r[0]: r[2] for r in rows}
    assert sum(r["lang"] == truth[r["doc_id"]] for r in first) >= 0.95 * len(first)

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held: dict = {}
    for r in first:
        for x in r["text"].split("\n"):
            held.setdefault(key(x), set()).add(r["doc_id"])
    want = {}
    for r in first:
        text = "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 10 or len(held[key(x)]) < 2 or r["doc_id"] == min(held[key(x)]))
        if text.strip():
            want[r["doc_id"]] = text
    second = {r["doc_id"]: r["text"] for r in kept("line_dedup")}
    assert second == want and 202 not in second

    found = groups(list(second.items()))
    third = {r["doc_id"]: r["text"] for r in kept("jaccard_join")}
    assert set(third) == {d for d, (_, root) in found.items() if root == d} and len(third) < len(second)

    dirty = contaminated(list(third.items()), bench)
    fourth = {r["doc_id"]: r["text"] for r in kept("decontamination")}
    assert set(fourth) == {d for d, x in dirty.items() if not x[4]} and len(fourth) < len(third)

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = kept("packing")
    for d, text in fourth.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == d)
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(n for _, n, _ in own) == len(ids)
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for s, n, c in own)
    assert {p["doc_id"] for p in pieces} == set(fourth)


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_of_one_id_are_apart(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(corpus_pipeline, "FEW", few)
    rng = random.Random(3)
    a, b, c, item = (speech(rng, "aa", 40) for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, a), (5, a), (7, b), (7, a + " too"), (3, c + " " + item), (3, c), (None, item), (None, b)]
    docs = spark.createDataFrame([(d, t, "aa", "s", 0) for d, t in rows], DOC).repartition(3)
    near = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id IS NULL OR doc_id <> 3"), str(tmp_path))
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in near.collect()) == sorted([(5, a), (7, b), (0, item), (0, b)])
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in clean.collect()) == sorted([(5, a), (5, a), (7, b), (7, a + " too"), (3, c), (0, b)])


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(6)
    rows = [(d, speech(rng, "aa", 30), "aa", "s", 0) for d in range(30)]
    wide = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS row", "'x' AS key", "'y' AS lang_pred", "2 AS n_lines", "'z' AS cls", "0 AS start", "3 AS contaminated")
    wide.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == set(range(30))
