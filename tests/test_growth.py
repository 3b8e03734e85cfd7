"""Work grows with the input: rows that queries send through shuffles, with the whole results."""

from __future__ import annotations

import collections
import functools
import random

from pyspark.sql import functions as F

from kgloom import session
from kgloom.operators import graph, pipeline, records, similar, substring
from kgloom.plans import derived

from .helpers import shuffled_rows


def test_couplings_of_many_small_commits_are_counted_not_looked_up(spark):
    rng = random.Random(5)
    members = [sorted(rng.sample(range(60), 6)) for _ in range(300)]
    commits = spark.createDataFrame([(c, f"f{x}") for c, m in enumerate(members) for x in m], "commit_id long, id string")
    found = {}
    sent = shuffled_rows(spark, lambda: found.update({(r.left_id, r.right_id): (r.together, r.coupling) for r in graph.coupled_above(commits,
        9).collect()}))
    every = {(r.left_id, r.right_id): (r.together, r.coupling) for r in graph.change_coupling(commits).collect()}
    own = collections.Counter(f"f{x}" for m in members for x in m)
    assert found and found == {k: v for k, v in every.items() if 100 * v[0] >= 9 * (own[k[0]] + own[k[1]] - v[0])}
    assert sent < 40_000, sent


def test_reach_stays_in_its_part_of_the_graph(spark):
    """60 graphs of 40 nodes, numbered across; each node has steps to 20 others of its graph."""
    rng = random.Random(3)
    name = lambda g, i: f"n{i * 60 + g}"
    steps = [(name(g, i), name(g, j)) for g in range(60) for i in range(40) for j in rng.sample(range(40), 20)]
    edges = spark.createDataFrame([(a, b, "CALLS", 1.0, True) for a, b in steps], "from_id string, to_id string, type string, confidence double, is_active boolean")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(2401)], "id string")
    found = {}
    sent = shuffled_rows(spark, lambda: found.update({r.id: r.reached for r in graph.reach_counts(edges, nodes, 3, "in").collect()}))
    assert found == {f"n{k}": 39 if k < 2400 else 0 for k in range(2401)}
    assert sent < 150_000, sent


def test_ingestion_makes_what_is_asked_for_and_moves_edges_once(spark):
    origin = {"source_type": F.lit("git"), "source_id": F.lit("s"), "observed_at": F.expr("TIMESTAMP '2024-01-01'"), "ingestion_run_id": F.lit("r")}
    entities = spark.range(20).select(F.format_string("e%d", "id").alias("id"), F.when(F.col("id") == 19, "NOPE").otherwise("SERVICE").alias("type"), F.lit(
        "").alias("sub_type"), F.format_string("name-%d", "id").alias("name"), F.lit("").alias("raw_name"), F.lit("n").alias("namespace"), F.lit("{}").alias(
        "properties"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_partial"), F.col("id").alias("ordinal")).withColumns(origin)
    edges = spark.range(2000).select(F.format_string("x%d", "id").alias("id"), F.lit("CALLS").alias("type"), F.format_string("e%d", F.col("id") % 20).alias(
        "from_id"), F.format_string("e%d", F.floor(F.col("id") / 20) % 20).alias("to_id"), F.lit("{}").alias("properties"), F.lit(0.5).alias("confidence"), F.lit(
        False).alias("is_inferred"), F.col("id").alias("ordinal")).withColumns(origin)
    registry = spark.createDataFrame([], "canonical_id string, type string, name string, namespace string, aliases array<string>")
    none = spark.createDataFrame([], "id string, type string, sub_type string, name string, namespace string, confidence double, properties string")
    no_edges = spark.createDataFrame([], "id string, type string, from_id string, to_id string, confidence double, properties string")
    out = {}

    def rejects():
        out["all"] = pipeline.ingest(entities, edges, registry, none, no_edges)
        out["rejected"] = out["all"].rejected.collect()

    assert shuffled_rows(spark, rejects) == 0 and len(out["rejected"]) == 101
    sent = shuffled_rows(spark, lambda: out.update(edges=out["all"].relationships.collect()))
    assert {(r.from_id, r.to_id) for r in out["edges"]} == {(f"e{a}", f"e{b}") for a in range(19) for b in range(19) if a != b}
    assert {r.corroboration_count for r in out["edges"]} == {5} and sent < 4_000, sent


def test_names_that_share_a_segment_alone_are_not_moved(spark):
    rng = random.Random(8)
    names = sorted({"commons" + "".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(300)} | {"commonsaaaaaaaaaa", "commonsaaaaaaaaab"})
    found = []
    sent = shuffled_rows(spark, lambda: found.extend(similar.similar_pairs(spark.createDataFrame([(x,) for x in names], "text string"), 85).collect()))
    assert ("commonsaaaaaaaaaa", "commonsaaaaaaaaab", 1) in {tuple(r) for r in found} and sent < 20_000, sent


def test_calls_are_made_in_parts_that_counts_keep_small(spark, monkeypatch):
    monkeypatch.setattr(derived, "dealt", functools.partial(session.dealt, part_rows=500))
    parts = [r["count"] for r in derived._calls(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 8 and max(parts) < 1_500, parts


def _random_edges(spark, nodes: int, each: int, groups: int = 1, confidence: float = 0.9):
    rng = random.Random(4)
    rows = [(f"g{g}n{a}", f"g{g}n{b}", "IMPORTS", confidence, True) for g in range(groups) for a in range(nodes) for b in rng.sample(range(nodes), each)]
    return spark.createDataFrame(rows, "from_id string, to_id string, type string, confidence double, is_active boolean")


def test_walks_from_few_nodes_leave_the_edges_in_place(spark):
    edges, found = _random_edges(spark, 40, 10, groups=20), {}
    start = spark.createDataFrame([("g3n1",)], "origin string")

    def act():
        found["near"] = graph.neighborhood(edges, "g3n1", 2, "in")[0].collect()
        found["hit"] = graph.blast_radius(edges, start, 2).collect()

    assert shuffled_rows(spark, act) < 2_000
    ways = collections.defaultdict(set)
    for r in edges.collect():
        ways[r.to_id].add(r.from_id)
    one, two = ways["g3n1"], set().union(*(ways[x] for x in ways["g3n1"]))
    assert {r.node: r.depth for r in found["near"]} == {x: 1 if x in one else 2 for x in (one | two) - {"g3n1"}}
    assert {r.node for r in found["hit"]} == (one | two) - {"g3n1"}


def test_couplings_over_tables_move_lists_not_pairs(spark):
    rows = [(f"s{(97 * t + 13 * i) % 1500}", f"t{t}", "READS_FROM" if i < 25 else "WRITES_TO") for t in range(60) for i in range(50)]
    accesses, found = spark.createDataFrame(rows, "from_id string, to_id string, type string"), {}
    sent = shuffled_rows(spark, lambda: found.update({(r.from_id, r.to_id): (r.shared, r.shared_table) for r in records.infer_shared_resources(
        accesses).collect()}))
    want = collections.defaultdict(set)
    for a, t, kind in rows:
        if kind == "READS_FROM":
            for b, u, other in rows:
                if u == t and other == "WRITES_TO" and a != b:
                    want[a, b].add(t)
    assert found == {k: (len(v), min(v)) for k, v in want.items()}
    assert sent < 15_000, sent


def test_cycles_deal_pairs_once(spark):
    edges, found = _random_edges(spark, 40, 10, groups=20), {}
    sent = shuffled_rows(spark, lambda: found.update({r.node: r.component for r in graph.strongly_connected(edges).collect()}))
    assert found == {f"g{g}n{a}": f"g{g}n0" for g in range(20) for a in range(40)}
    assert sent < 35_000, sent


def test_steps_that_no_chain_can_keep_are_not_joined(spark):
    edges, found = _random_edges(spark, 40, 20, confidence=0.6), []
    sent = shuffled_rows(spark, lambda: found.extend(graph.transitive_dependencies(edges).collect()))
    assert found == [] and sent < 1_500, sent


def test_pairs_of_commits_are_counted_in_parts_that_counts_keep_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "dealt", functools.partial(session.dealt, part_rows=500))
    commits = spark.range(3000).select(F.expr("id div 6").alias("commit_id"), F.concat(F.lit("f"), F.expr("id * 7 % 500")).alias("id"))
    plan = graph.change_coupling(commits)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [left_id" in plan and ", 15" in plan, plan


def test_patterns_meet_texts_by_keys_near_their_own_length(spark):
    rng = random.Random(6)
    syllables = ["ber", "ley", "nim", "kot", "ans", "tor", "vic", "mar"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts, patterns = sorted({word(6) + "@x.org" for _ in range(600)}), sorted({word(4) for _ in range(600)} | {"", "b", "er", "ley"})
    found = []
    sent = shuffled_rows(spark, lambda: found.extend(substring.holding(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(
        x,) for x in patterns], "pattern string")).collect()))
    assert sorted((r.text, r.pattern) for r in found) == sorted((t, p) for t in texts for p in patterns if p in t)
    assert sent < 25_000, sent


def test_index_moves_grams_of_blocks_and_not_of_texts(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(800)]
    docs, found = session.cut(spark.createDataFrame(rows, "id long, body string")), set()

    def act():
        substring.write_index(docs, "body", str(tmp_path / "index"))
        for text in (words[0][:4], words[1][:2]):
            found.update((text, r.id) for r in substring.search_index(docs, "body", str(tmp_path / "index"), text).collect())

    sent = shuffled_rows(spark, act)
    assert found == {(t, i) for t in (words[0][:4], words[1][:2]) for i, b in rows if t in b}
    assert sent < 20_000, sent


def test_reach_makes_whole_rows_where_everything_is_reached(spark):
    """3,000 nodes with 5 random steps each, so that in the end nearly all reach nearly all: what a task makes is not merged once more."""
    rng, n = random.Random(9), 3000
    steps = [(a, b) for a in range(n) for b in rng.sample(range(n), 5)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "CALLS", 1.0, True) for a, b in steps], "from_id string, to_id string, type string, confidence double, is_active boolean")
    nodes, ways, found = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id")), collections.defaultdict(list), {}
    for a, b in steps:
        ways[a].append(b)
    sets = [1 << a for a in range(n)]
    for _ in range(5):
        sets = [functools.reduce(int.__or__, (sets[b] for b in ways[a]), sets[a]) for a in range(n)]
    sent = shuffled_rows(spark, lambda: found.update({r.id: r.reached for r in graph.reach_counts(edges, nodes, 5, "out").collect()}))
    assert found == {f"n{a}": s.bit_count() - 1 for a, s in enumerate(sets)}
    assert sent < 300_000, sent


def test_reach_is_whole_where_parts_are_small(spark):
    edges, nodes = _random_edges(spark, 60, 3, groups=12), spark.range(721).select(F.concat(F.lit("g"), F.expr("id div 60"), F.lit("n"), F.expr("id % 60")).alias("id"))
    one, small = (sorted(map(tuple, graph.reach_counts(edges, nodes, 3, "in", *parts).collect())) for parts in ((), (100,)))
    assert one == small and dict(one)["g12n0"] == 0 and max(n for _, n in one) > 20


def test_couplings_above_move_lists_not_pairs(spark):
    rng = random.Random(7)
    rows = [(c, f"f{x}") for c in range(150) for x in rng.sample(range(400), 40)] + [(1000 + c, f"t{x}") for c in range(30) for x in (c % 3, 3 + c % 3)]
    commits, found = spark.createDataFrame([*rows, *rows[:50], (None, "f1"), (3, None)], "commit_id long, id string"), {}
    sent = shuffled_rows(spark, lambda: found.update({(r.left_id, r.right_id): (r.together, r.coupling) for r in graph.coupled_above(commits,
        20).collect()}))
    own = collections.defaultdict(set)
    for c, x in [*rows, (None, "f1")]:
        own[x].add(c)
    both = {(a, b): len(own[a] & own[b] - {None}) for a in own for b in own if a < b}
    want = {k: n for k, n in both.items() if 100 * n >= 20 * (len(own[k[0]]) + len(own[k[1]]) - n)}
    assert {k: n for k, (n, _) in found.items()} == want and ("t0", "t3") in want and any(k[0][0] == "f" for k in want)
    assert sent < 30_000, sent


def test_a_number_of_many_lists_is_counted_by_steps_and_slots(spark, monkeypatch):
    from kgloom.operators import pairs

    rng = random.Random(2)
    rows = [(0 if i % 2 else rng.randrange(50), rng.sample(range(300), 20), f"k{rng.randrange(90):02}") for i in range(800)]
    lists = spark.createDataFrame([(a, b % 4, [b], 2, k) for a, others, k in rows for b in others], "a int, slot int, others array<int>, least int, label string")
    want = collections.defaultdict(list)
    for a, others, k in rows:
        for b in others:
            if a != b:
                want[a, b].append(k)
    got = {(r.a, r.b): (r.n, r.label) for r in pairs.counted(lists, 16_000, labelled=True).collect()}
    assert got == {x: (len(v), min(v)) for x, v in want.items() if len(v) > 1}
    monkeypatch.setattr(pairs, "STEP", 100)
    batch = lists.groupBy("a", "least", "label").agg(F.flatten(F.collect_list("others")).alias("others")).select("a", "least", "others", "label").toArrow()
    steps = list(pairs._counts(True)(iter(batch.to_batches())))
    assert len(steps) > 20 and {(r["a"], r["b"]): (r["n"], r["label"]) for s in steps for r in s.to_pylist()} == got


def _batch(spark, services: int, tables: int, unknown: int):
    """Services, of which the last are of an unknown type, each reading and writing every table; properties of the first in another form."""
    origin = {"source_type": F.lit("git"), "source_id": F.lit("s"), "observed_at": F.expr("TIMESTAMP '2024-01-01'"), "ingestion_run_id": F.lit("r")}
    own = spark.range(services).select(F.format_string("s%02d", "id").alias("id"), F.when(F.col("id") < services - unknown, "SERVICE").otherwise("NOPE").alias("type"))
    both = own.unionByName(spark.range(tables).select(F.format_string("t%02d", "id").alias("id"), F.lit("DATABASE_TABLE").alias("type")))
    entities = both.select("id", "type", F.lit("").alias("sub_type"), F.concat(F.lit("name-"), "id").alias("name"), F.lit("").alias("raw_name"), F.lit("n").alias(
        "namespace"), F.lit("{}").alias("properties"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_partial"), F.xxhash64("id").alias("ordinal")).withColumns(origin)
    edges = own.select(F.col("id").alias("from_id")).crossJoin(spark.range(tables).select(F.format_string("t%02d", "id").alias("to_id"))).select("*", F.explode(F.array(F.lit(
        "READS_FROM"), F.lit("WRITES_TO"))).alias("type")).select(F.concat_ws(">", "from_id", "type", "to_id").alias("id"), "type", "from_id", "to_id", F.lit("{}").alias(
        "properties"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_inferred"), F.xxhash64("from_id", "to_id", "type").alias("ordinal")).withColumns(origin)
    registry = spark.createDataFrame([], "canonical_id string, type string, name string, namespace string, aliases array<string>")
    none = spark.createDataFrame([], "id string, type string, sub_type string, name string, namespace string, confidence double, properties string")
    no_edges = spark.createDataFrame([], "id string, type string, from_id string, to_id string, confidence double, properties string")
    return session.cut(entities), session.cut(edges), registry, none, no_edges


def test_ingestion_leaves_unknown_ends_out_before_it_makes_couplings(spark):
    batch, found = _batch(spark, 60, 12, 40), []
    sent = shuffled_rows(spark, lambda: found.extend(pipeline.ingest(*batch).mutations.collect()))
    known = [f"s{i:02}" for i in range(20)]
    assert sum(r.kind == "relationship" for r in found) == 20 * 12 * 2 + 20 * 19
    entities = sorted(r.id for r in found if r.kind == "entity")
    assert entities == known + [f"t{i:02}" for i in range(12)]
    assert [r.id for r in sorted(found, key=lambda r: r.ordinal)] == entities + sorted(r.id for r in found if r.kind == "relationship")
    assert sent < 5_000, sent


def test_an_edge_stored_in_another_form_is_not_changed(spark):
    entities, edges, registry, none, no_edges = _batch(spark, 6, 2, 0)
    first = pipeline.ingest(entities, edges, registry, none, no_edges)
    k = F.xxhash64("id") % 5
    spaced = F.when(k == 0, F.regexp_replace("properties", '":', '" : ')).when(k == 1, F.regexp_replace("properties", "shared_resource", "x")).when((k == 2) & (F.col(
        "properties") == "{}"), F.lit(None)).otherwise(F.col("properties"))
    stored = session.cut(first.relationships)
    again = pipeline.ingest(entities, edges, first.registry, first.entities, stored.withColumn("properties", spaced)).mutations
    want = {r.id for r in stored.where((k == 1) & F.col("properties").contains("shared_resource")).collect()}
    assert {(r.kind, r.id, r.op) for r in again.collect()} == {("relationship", i, "UPDATE") for i in want} and want
