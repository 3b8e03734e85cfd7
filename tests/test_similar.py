"""Similarity joins, pointer jumping and substring joins against brute force."""

from __future__ import annotations

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.operators import graph, layout, order, pointers, similar, substring


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(rng: random.Random) -> list[str | None]:
    base = ["".join(rng.choice("abcö ") for _ in range(rng.randrange(0, 14))) for _ in range(40)]
    out = list(base)
    for _ in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s) + 1)
            s[at:at + rng.randrange(2)] = rng.choice(["", "a", "ö", "bc"])
        out.append("".join(s))
    return [*out, None, "", "a", "b"]


@pytest.mark.parametrize("per_cent", [100, 85, 60, 35])
def test_similar_pairs_equal_all_pairs(spark, per_cent):
    rows = names(random.Random(per_cent))
    found = similar.similar_pairs(spark.createDataFrame([(x, 1) for x in rows], "text string, length int"), per_cent)
    own = {(r.a, r.b): r.distance for r in found.collect()}
    some = sorted({x for x in rows if x is not None})
    want = {(a, b): d for i, a in enumerate(some) for b in some[i + 1:] if (d := distance(a, b)) * 100 <= max(len(a), len(b)) * (100 - per_cent)}
    assert {tuple(sorted(k)): v for k, v in own.items()} == want and found.count() == len(want)


def test_no_cross_join_makes_candidates(spark):
    rows = spark.createDataFrame([("alpha",), ("alpho",)], "text string")
    plan = similar.similar_pairs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_and_clusters(spark):
    rows = [("1", "service-auth", "eu", "S"), ("2", "service-auth", "eu", "S"), ("3", "service-autx", "eu", "S"), ("4", "service-auth", "us", "S"),
        ("5", "service-autxy", "eu", "S"), ("6", "other", "eu", "S"), ("7", None, "eu", "S")]
    entities = spark.createDataFrame(rows, "id string, name string, namespace string, type string")
    made = similar.candidates(entities, 85)
    pairs = {(r.id, r.candidate) for r in made.collect()}
    assert pairs == {("2", "1"), ("1", "3"), ("3", "1"), ("3", "5"), ("5", "3")}
    merges = {(r.source_id, r.target_id) for r in similar.clusters(made, 0.9).collect()}
    assert merges == {("2", "1"), ("3", "1"), ("5", "1")}
    best = {r.id: (r.candidate, r.decision) for r in similar.best_matches(entities, 85).collect()}
    assert best["2"] == ("1", "CERTAIN_MERGE") and best["3"][1] == "CONFLICT"


def plain_ends(links: dict[str, str]) -> dict[str, str]:
    out = {}
    for source in links:
        seen, at = [], source
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        out[source] = min(seen[seen.index(at):]) if at in seen else at
    return {k: v for k, v in out.items() if k != v}


def test_chain_ends_and_components(spark):
    rng = random.Random(5)
    chain = {f"n{i}": f"n{i + 1}" for i in range(100, 150)} | {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "x": "y"}
    wild = {f"m{i}": f"m{j}" for i in range(200) if (j := rng.randrange(260)) != i}
    for links in (chain, wild, {}):
        found = pointers.chain_ends(spark.createDataFrame(list(links.items()), "source string, target string"))
        assert {r.source: r.target for r in found.collect()} == plain_ends(links)
    pairs = [(f"p{rng.randrange(300)}", f"p{rng.randrange(300)}") for _ in range(170)] + [("q1", "q1"), ("z", "y"), ("y", "x")] + [
        (f"l{i:03}", f"l{i + 1:03}") for i in range(120)]
    group: dict[str, str] = {}
    for a, b in pairs:
        group.setdefault(a, a), group.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(group[a], group[b])
            moved |= (group[a], group[b]) != (low, low)
            group[a] = group[b] = low
    found = pointers.components(spark.createDataFrame(pairs, "a string, b string"))
    assert {r.node: r.component for r in found.collect()} == group and found.count() == len(group)


def test_holding_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab\nö%") for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "", "abc"]
    patterns = ["".join(rng.choice("ab\nö%") for _ in range(rng.randrange(0, 6))) for _ in range(40)] + [None, "", "a", "ab", "zzzz"]
    found = substring.holding(spark.createDataFrame([(x, 1) for x in texts], "text string, t int"), spark.createDataFrame([(x,) for x in patterns], "pattern string"))
    own = [tuple(r) for r in found.collect()]
    assert len(own) == len(set(own))
    assert set(own) == {(t, p) for t in texts for p in patterns if t is not None and p is not None and p in t}
    both = {tuple(r) for r in substring.touching(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in patterns], "text string")).collect()}
    assert both == {(t, p) for t in texts for p in patterns if t is not None and p is not None and (p in t or t in p)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_written_index(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(["Alpha", "beta", "GAMMA", "Ölf", "x", "50%"]) for _ in range(rng.randrange(6)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "id long, body string")
    substring.write_index(docs, "body", str(tmp_path / "index"))
    for text in ("ALPHA b", "ma", "x", "ölf", "50% al", "nowhere", "", "a g"):
        own = {r.id for r in substring.search_index(docs, "body", str(tmp_path / "index"), text).collect()}
        assert own == {i for i, b in rows if b is not None and text.lower() in b.lower()}
    plan = substring.search_index(docs, "body", str(tmp_path / "index"), "gamma")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "NestedLoop" not in plan


def test_index_of_blocks(spark, tmp_path, monkeypatch):
    """Texts over the ends of blocks, bytes that are no characters alone, ids of another type, repeated ids, no texts at all."""
    monkeypatch.setattr(substring, "BLOCK", 7)
    block = substring._posted(3)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(["a", "b", "c", "a"]), "text": pa.array(["äöü abc", "", "b\0c", "abcabc"])})
    own = {(g, i) for found in block([batch.slice(0, 2), batch.slice(2)]) for g, ids in zip(*(found.column(k).to_pylist() for k in (0, 1)), strict=True) for i in ids}
    want = {(t.encode()[k:k + 3], i) for i, t in zip("abca", batch.column("text").to_pylist(), strict=True) for k in range(len(t.encode()))}
    assert own == {(substring._code(g, 3), i) for g, i in want}
    rows = [("a", "äöü abc"), ("b", None), ("c", "b\0c"), ("a", "abcabc"), ("d", ""), ("e", "x\U0001f600y")]
    docs = spark.createDataFrame(rows, "id string, body string")
    substring.write_index(docs, "body", str(tmp_path / "some"))
    for text in ("Ö", "öü", "abc", "\0", "b\0", "\U0001f600", "x", "c", "bca"):
        found = sorted((r.id, r.body) for r in substring.search_index(docs, "body", str(tmp_path / "some"), text).collect())
        assert found == sorted((i, b) for i, b in rows if b is not None and text.lower() in b)
    substring.write_index(docs.limit(0), "body", str(tmp_path / "none"))
    assert [substring.search_index(docs.limit(0), "body", str(tmp_path / "none"), t).count() for t in ("abc", "a", "")] == [0, 0, 0]


def test_lines_in_ranges(spark):
    rng = random.Random(4)
    ranges = [(rng.choice("fg"), a, a + rng.choice([0, 0, 1, 5, 63, 64, 900])) for a in (rng.randrange(0, 1000) for _ in range(150))] + [("f", 9, 3)]
    places = [(rng.choice("fgh"), rng.choice([None, *range(0, 1100, 7)])) for _ in range(120)]
    found = substring.at_lines(spark.createDataFrame(places, "file string, line int"), spark.createDataFrame(ranges, "file string, start_line int, end_line int"), ["file"])
    own = sorted((r.file, r.line is None, r.line or 0, r.start_line, r.end_line) for r in found.collect())
    assert own == sorted((f, n is None, n or 0, a, b) for f, n in places for g, a, b in ranges if f == g and (n is None or a <= n <= b))


def test_asof_over_parts(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(60)])) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "a", "c", None]), rng.choice([None, *range(0, 60, 3)]), i, f"x{i}") for i in range(150)]
    found = order.asof(spark.createDataFrame(left, "n int, k string, t int"), spark.createDataFrame(right, "k string, t int, tie int, extra string"), "k", "t", ["tie"])
    own = {r.n: r.found.extra if r.found else None for r in found.collect()}
    want = {}
    for n, k, t in left:
        some = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        want[n] = max(some, key=lambda r: (r[1], r[2]))[3] if some else None
    assert own == want and found.count() == len(left)


@pytest.mark.parametrize("per_cent", [20, 50, 100])
def test_coupling_above(spark, per_cent):
    rng = random.Random(per_cent)
    rows = [(c, f"f{f}") for c in range(40) for f in rng.sample(range(25), rng.randrange(1, 6))] + [(99, "f0"), (99, "alone"), (98, "alone"), (98, "two"), (99, "two")]
    commits = spark.createDataFrame(rows, "commit_id int, id string")
    want = {(r.left_id, r.right_id): r.together for r in graph.change_coupling(commits).collect()}
    size = {i: len({c for c, x in rows if x == i}) for _, i in rows}
    want = {(a, b): k for (a, b), k in want.items() if 100 * k >= per_cent * (size[a] + size[b] - k)}
    assert {(r.left_id, r.right_id): r.together for r in graph.coupled_above(commits, per_cent).collect()} == want


def test_layout_reads_a_part(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, f"e{rng.randrange(40)}", f"t{i // 7}", None if i % 50 == 0 else start + datetime.timedelta(hours=rng.randrange(240))) for i in range(600)]
    log = spark.createDataFrame(rows, "n int, e string, t string, at timestamp")
    for half in (log.where("n < 300"), log.where("n >= 300")):
        layout.append(half, str(tmp_path), "e", "at", "t")
    low, high = start + datetime.timedelta(days=2), start + datetime.timedelta(days=4)
    found = layout.read(spark, str(tmp_path), "e", "at", ["e1", "e2"], F.lit(low), F.lit(high))
    assert {r.n for r in found.collect()} == {n for n, e, _, t in rows if e in ("e1", "e2") and t is not None and low <= t <= high}
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "bucket" in filters and "day" in filters
    whole = spark.read.parquet(f"{tmp_path}/rows")
    folders = lambda df: df.select(F.regexp_extract(F.col("_metadata.file_path"), "rows/(.*)/[^/]*$", 1).alias("f")).distinct().count()
    assert folders(whole.where(F.col("bucket") == layout._bucket(F.lit("e1")))) <= folders(whole) / 4
    assert {r.n for r in layout.read(spark, str(tmp_path), "e", "at", ["e3"]).collect()} == {n for n, e, _, _ in rows if e == "e3"}
    assert layout.read(spark, str(tmp_path), "e", "at", []).count() == 0 and layout.read(spark, str(tmp_path), "e", "at").count() == 600
    one = layout.read_second(spark, str(tmp_path), "t", "t7")
    assert {r.n for r in one.collect()} == set(range(49, 56)) and layout.read_second(spark, str(tmp_path), "t", "none").count() == 0
