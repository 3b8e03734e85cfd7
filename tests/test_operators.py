"""Hand-made cases of the graph, record and store operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.operators import graph, records, store
from kgloom.plans import question, render

EDGE = "from_id string, to_id string, type string, confidence double, is_active boolean"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, c, True) for a, b, k, c in rows], EDGE)


def origin(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "origin string")


def test_normalized_names(spark):
    cases = {"PaymentService": "payment-service", "auth_module": "auth-module", "A B__c": "a-b-c", "-x-": "x", "ast_go.go": "ast-go.go"}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", fn.normalize_name(F.col("n")).alias("m")).collect()
    assert {r["n"]: r["m"] for r in rows} == cases


def test_ids_are_stable_and_depend_on_namespace(spark):
    a, b, c = spark.range(1).select(*[fn.observed_entity_id(F.lit("git"), F.lit("r"), F.lit("SERVICE"), F.lit("x"), F.lit(ns)).alias(k) for k, ns in (("a", "n"), ("b", "n"), ("c", "m"))]).first()
    assert a == b != c and a.startswith("ent_") and len(a) == 36


def test_blast_radius(spark):
    e = edges(spark, ("b", "a", "IMPORTS", 1.0), ("c", "b", "DEPENDS_ON", 0.9), ("d", "c", "CALLS", 0.2), ("a", "c", "IMPORTS", 1.0))
    got = {r["node"]: (r["probability"], r["depth"]) for r in graph.blast_radius(e, origin(spark, "a")).collect()}
    assert got == {"b": (0.95, 1), "c": (0.4275, 2)}


def test_cycles(spark):
    e = edges(spark, ("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 1.0), ("c", "a", "CALLS", 1.0), ("d", "e", "CALLS", 1.0), ("x", "x", "CALLS", 1.0))
    assert sorted(map(tuple, graph.strongly_connected(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]
    dag = edges(spark, ("a", "b", "CALLS", 1.0), ("a", "c", "CALLS", 1.0), ("b", "c", "CALLS", 1.0), ("c", "d", "CALLS", 1.0))
    assert graph.strongly_connected(dag).collect() == []


def test_cycles_equal_mutual_reachability(spark):
    import random

    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(24)}
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {y for x in reach[n] for y in reach[x]}
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}
    got = dict(map(tuple, graph.strongly_connected(edges(spark, *((a, b, "CALLS", 1.0) for a, b in pairs))).collect()))
    assert got == want


@pytest.mark.parametrize("words", [8, 1])
def test_reach_counts(spark, monkeypatch, words):
    import random

    monkeypatch.setattr(graph, "REACH_WORDS", words)
    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(200):03}", f"n{rng.randrange(200):03}") for _ in range(400)}
    nodes = [f"n{i:03}" for i in range(190)]  # some ends are no nodes, and don't count
    got = dict(map(tuple, graph.reach_counts(edges(spark, *((a, b, "CALLS", 1.0) for a, b in pairs)), spark.createDataFrame([(n,) for n in nodes], "id string"), 3, "out").collect()))
    for n in nodes:
        seen = front = {n}
        for _ in range(3):
            front = {b for a, b in pairs if a in front} - seen
            seen = seen | front
        assert got[n] == len((seen - {n}) & set(nodes))


def test_relevance_backs_off_and_leaves_the_origin_out(spark):
    e = edges(spark, ("o", "hub", "EXPOSES", 1.0), *(("hub", f"x{i:03}", "EXPOSES", 0.9) for i in range(250)))
    nodes, kept, depth = graph.relevance(e, "o", 2)
    assert depth == 1 and [r["node"] for r in nodes.collect()] == ["hub"] and kept.count() == 1
    nodes, kept, depth = graph.relevance(e, "o", 2, back_off=False)
    assert depth == 2 and nodes.count() == 200 and kept.count() == 200


def test_neighborhood_clamps_depth_and_leaves_outer_ring_edges(spark):
    e = edges(spark, *((f"n{i}", f"n{i + 1}", "CALLS", 1.0) for i in range(9)))
    nodes, found = graph.neighborhood(e, "n0", 9, "out")
    assert sorted(map(tuple, nodes.collect())) == [(f"n{i}", i) for i in range(1, 6)]
    assert found.count() == 5


def test_supernodes_need_four_entities(spark):
    e = edges(spark, *(("hub", "a", "CALLS", 1.0) for _ in range(9)))
    few = spark.createDataFrame([("hub",), ("a",), ("b",)], "id string")
    assert graph.supernodes(e, few, 0.1).collect() == []


def test_criticality_and_velocity_thresholds(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 2, 3, 5, 7, 8)], "n int").select(records.criticality(F.col("n")).alias("c"), records.criticality_score(F.col("n")).alias("s")).collect()
    assert [r["c"] for r in rows] == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL"] and rows[-1]["s"] == 1.0
    rows = spark.createDataFrame([(n,) for n in (1, 2, 10, 11, None)], "n int").select(records.velocity(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["STABLE", "ACTIVE", "ACTIVE", "HOT", "STABLE"]


def test_relationships_merge(spark):
    rows = [("a", "b", "CALLS", 0.88, "{}", "ast", 1, True), ("a", "b", "CALLS", 0.95, "{}", "runtime", 2, False)]
    got = records.merge_relationships(spark.createDataFrame(rows, "from_id string, to_id string, type string, confidence double, properties string, source_type string, ordinal int, is_inferred boolean")).first()
    assert (got["confidence"], got["sources"], got["corroboration_count"], got["is_inferred"]) == (0.95, ["ast", "runtime"], 2, False)


def test_entities_merge(spark):
    rows = [("e", "SERVICE", "one", "n", 0.9, 1, {"a": "1", "b": "1"}), ("e", "SERVICE", "two", "n", 0.9, 2, {"b": "2"}), ("e", "SERVICE", "three", "n", 0.5, 3, {"c": "3"})]
    got = records.merge_entities(spark.createDataFrame(rows, "id string, type string, canonical_name string, namespace string, confidence double, ordinal int, properties map<string,string>")).first()
    assert got["canonical_name"] == "one" and got["properties"] == {"a": "1", "b": "2", "c": "3"}


def test_shared_tables_couple_reader_to_writer(spark):
    rows = spark.createDataFrame([("A", "t", "WRITES_TO"), ("B", "t", "READS_FROM"), ("A", "t", "READS_FROM")], "from_id string, to_id string, type string")
    got = records.infer_shared_resources(rows).collect()
    assert [(r["from_id"], r["to_id"], r["confidence"], r["shared"]) for r in got] == [("B", "A", 0.85, 1)]


def test_upsert_versions_conflicts_and_no_change(spark):
    old = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2), ("c", 1.0, 3)], "id string, v double, version int")
    new = spark.createDataFrame([("a", 2.0, 0), ("b", 1.0, 0), ("c", 5.0, 99), ("d", 1.0, 0)], "id string, v double, expected int")
    got = {r["id"]: (r["v"], r["version"], r["operation"]) for r in store.upsert(old, new, "id", ["v"]).collect()}
    assert got == {"a": (2.0, 2, "UPDATED"), "b": (1.0, 2, "NO_CHANGE"), "c": (1.0, 3, "CONFLICT"), "d": (1.0, 1, "CREATED")}
    again = store.upsert(store.upsert(old, new, "id", ["v"]).drop("operation"), new.drop("expected"), "id", ["v"]).where("id <> 'c'")
    assert {r["operation"] for r in again.collect()} == {"NO_CHANGE"}


@pytest.mark.parametrize(("change", "field"), [({"type": "NOPE"}, "type"), ({"canonical_name": " "}, "canonical_name"), ({"canonical_name": "é" * 129}, "canonical_name"), ({"namespace": ""}, "namespace"), ({"confidence": -0.1}, "confidence"), ({"confidence": 1.5}, "confidence"), ({"valid_from": None}, "valid_from"), ({}, None)])
def test_stored_entity_rules(spark, change, field):
    row = {"type": "SERVICE", "canonical_name": "x", "namespace": "n", "confidence": 0.5, "valid_from": "2024-01-01", "valid_to": None, "properties": "{}"} | change
    df = spark.createDataFrame([tuple(row.values())], "type string, canonical_name string, namespace string, confidence double, valid_from string, valid_to string, properties string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    assert records.stored_entity_errors(df).first()["error_field"] == field


def test_questions(spark):
    cases = {
        "Are there any circular dependencies?": "GOVERNANCE", "What is the blast radius of auth?": "IMPACT", "what changed since yesterday": "TEMPORAL", "Which service is slowest?": "RUNTIME",
        "What depends on payment?": "STRUCTURAL", "audit the impact of auth": "GOVERNANCE",
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", question.archetype(F.col("q")).alias("a")).collect()
    assert {r["q"]: r["a"] for r in rows} == cases


def test_planner_and_engine(spark):
    ents = spark.createDataFrame([("a", "SERVICE", "auth", "n", 0.9, True), ("b", "SERVICE", "bill", "n", 0.8, True), ("c", "SERVICE", "cart", "n", 0.8, True)], "id string, type string, canonical_name string, namespace string, confidence double, is_active boolean")
    e = edges(spark, ("b", "a", "IMPORTS", 1.0), ("c", "b", "RUNTIME_CALLS", 1.0))
    log = spark.createDataFrame([("ENTITY_CREATED",)], "mutation_type string").withColumn("occurred_at", F.current_timestamp())
    engine = question.Engine(ents, e, spark.createDataFrame([], "from_id string, to_id string, type string"), log)
    assert engine.plan("what breaks if `auth` fails").depth == 5
    assert [tuple(r) for r in engine.ask("what breaks if `auth` fails").collect()] == [("a", "b", 0.95, 1), ("a", "c", 0.76, 2)]
    assert [tuple(r) for r in engine.ask("who calls `auth`").collect()] == [("b", 0.7), ("c", 0.63)]
    with pytest.raises(ValueError, match="entity needed"):
        engine.plan("who calls it")
    with pytest.raises(ValueError, match="namespace needed"):
        engine.plan("any smell?")
    c = engine.context("a")
    assert "### Used by\nbill = b, IMPORTS 1.00" in c.text and "### Nearby\ncart = c, SERVICE in n, 0.63" in c.text and c.citations == ["a", "b", "c"]
    assert engine.context("a", limit=40).text.endswith("(cut)") and "b -->|IMPORTS| a" in render.mermaid(e)
    told = engine.answer("who calls `auth`")
    assert told["text"] == c.text and told["citations"] == c.citations and told["diagram"] is None
    full = ents.where("id = 'a'").withColumns({"sub_type": F.lit("BFF"), "properties": F.lit('{"tier": 1, "owner": "x"}')})
    text = render.context(full, e, spark.createDataFrame([], "node string, score double"), "a").text
    assert "SERVICE/BFF, ACTIVE, namespace n" in text and 'owner: "x"\ntier: 1' in text and "unknown = b, IMPORTS 1.00" in text
    engine.llm = lambda system, text: "see\n```mermaid\ngraph LR\n```\nend"
    assert engine.answer("who calls `auth`")["diagram"] == "graph LR"
    engine.update(edges=e.where("type = 'IMPORTS'"))
    assert engine.context("a").citations == ["a", "b"]
    with pytest.raises(LookupError):
        engine.context("nobody")


def test_locations(spark):
    ents = spark.createDataFrame([("fn-1", "f", "pkg/service/service.go", 42, None)], "id string, name string, file string, start_line int, end_line int")
    got = graph.resolve_locations(spark.createDataFrame([("service/service.go", 42), ("other.go", 1)], "path string, line int"), ents).collect()
    assert [tuple(r) for r in got] == [("service/service.go", 42, "fn-1")]
    loose = graph.resolve_locations(spark.createDataFrame([("service.go.orig", None), ("vice/service.go", 42)], "path string, line int"), ents.withColumn("file", F.lit("service.go"))).collect()
    assert sorted((r["path"], r["entity_id"]) for r in loose) == [("service.go.orig", "fn-1"), ("vice/service.go", "fn-1")]


def test_governance_as_configured(spark):
    smells = spark.createDataFrame([("circular_dependency", "CRITICAL", "a"), ("shared_database_coupling", "HIGH", "t"), ("supernode", "MEDIUM", "h")], "smell string, severity string, subject string")
    entities = spark.createDataFrame([("s1", "SERVICE", "{}"), ("s2", "SERVICE", '{"primary_owner": {"team_name": "x"}}'), ("s3", "SERVICE", '{"owner": "y"}'), ("t", "TEAM", "{}")], "id string, type string, properties string")
    rules = spark.createDataFrame([("RULE-01", "no-circular-dependencies", "FAIL"), ("RULE-02", "require-service-owners", "WARN"), ("RULE-03", "shared-database-table", "off")], "id string, name string, severity string")
    got = {r["subject"]: tuple(r) for r in graph.governance(smells, graph.ownerless(entities), rules).collect()}
    assert got == {"a": ("RULE-01", "no-circular-dependencies", "a", "FAIL", "FAIL"), "t": ("RULE-03", "shared-database-table", "t", "off", "SILENT"), "h": ("UNKNOWN", "", "h", "MEDIUM", "SILENT"), "s1": ("RULE-02", "require-service-owners", "s1", "WARN", "WARN")}
    bare = {r["subject"]: (r["severity"], r["outcome"]) for r in graph.governance(smells, graph.ownerless(entities), rules.limit(0)).collect()}
    assert bare == {"a": ("CRITICAL", "SILENT"), "t": ("HIGH", "SILENT"), "h": ("MEDIUM", "SILENT"), "s1": ("HIGH", "SILENT")}


def test_reports(spark):
    entities = spark.createDataFrame([("a", "SERVICE", "auth", "n", True, "src/a.go"), ("b", "SERVICE", "bill", "n", True, "src/b.go"), ("t", "DATABASE_TABLE", "users", "n", True, "x.sql")], "id string, type string, canonical_name string, namespace string, is_active boolean, file string")
    entities = entities.withColumns({"name": F.col("canonical_name"), "start_line": F.lit(1), "end_line": F.lit(9)})
    e = edges(spark, ("b", "a", "IMPORTS", 1.0), ("a", "b", "CALLS", 1.0))
    accesses = spark.createDataFrame([("a", "t", "READS_FROM"), ("b", "t", "WRITES_TO")], "from_id string, to_id string, type string")
    text = render.blueprint(entities, e, accesses, "n")
    assert "2 services, 1 tables, 3 entities." in text and "| t | a | b |" in text and "- t" in text
    tree = render.tree_text(entities, e, 3)
    assert tree.split("\n")[0] == "[auth] (SERVICE)" and "(CALLS) → [bill] (SERVICE)" in tree and "[CYCLE]" in tree
    smells = spark.createDataFrame([("circular_dependency", "CRITICAL", "auth"), ("supernode", "MEDIUM", "zzz")], "smell string, severity string, subject string")
    comment = render.change_comment(spark.createDataFrame([("a.go",), ("none.go",)], "path string"), entities, e, smells)
    assert "| `a.go` | `auth` (SERVICE) | `bill` (SERVICE) | Low |" in comment and "circular_dependency" in comment and "zzz" not in comment


def test_replay_as_of(spark):
    log = spark.createDataFrame([(1, "ENTITY_CREATED", "e1", 1.0, "2024-01-01"), (2, "ENTITY_UPDATED", "e1", 0.8, "2024-01-03"), (3, "ENTITY_CREATED", "e2", 1.0, "2024-01-03"), (4, "ENTITY_SOFT_DELETED", "e2", 1.0, "2024-01-04")], "entry_id long, mutation_type string, entity_id string, state double, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    then = {r["entity_id"]: (r["state"], r["is_active"]) for r in store.replay(log, until=F.lit("2024-01-02").cast("timestamp")).collect()}
    now = {r["entity_id"]: (r["state"], r["is_active"]) for r in store.replay(log).collect()}
    assert then == {"e1": (1.0, True)} and now == {"e1": (0.8, True), "e2": (1.0, False)}
