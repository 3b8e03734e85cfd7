"""Batches, the log, snapshots and identities, by hand-made cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.operators import paths, pipeline, rules, snapshot, write
from kgloom.operators.order import numbered


ENTITIES = "id string, type string, sub_type string, canonical_name string, namespace string, confidence double, is_active boolean, lifecycle_stage string, valid_from timestamp, valid_to timestamp, version int, properties string"
EDGES = "id string, type string, from_id string, to_id string, confidence double, is_active boolean, valid_from timestamp, valid_to timestamp, version int, properties string"
MUTATIONS = (
    "idx long, kind string, target_id string, expected int, entity struct<id:string,type:string,sub_type:string,canonical_name:string,namespace:string,confidence:double,lifecycle_stage:string,valid_from:timestamp,properties:string>, "
    "relationship struct<id:string,type:string,from_id:string,to_id:string,confidence:double,valid_from:timestamp,properties:string>"
)


def put(spark, *rows):
    import datetime

    since = datetime.datetime(2024, 1, 1)

    def full(i, kind, *rest):
        entity = edge = target = expected = None
        if kind == "UPSERT_ENTITY":
            name, confidence, *more = rest
            expected = more[0] if more else None
            entity = (name, "SERVICE", "", name, "n", confidence, None, since, more[1] if len(more) > 1 else '{"a": 1}')
        elif kind == "UPSERT_RELATIONSHIP":
            a, b, confidence = rest
            edge = (f"{a}{b}", "CALLS", a, b, confidence, since, "{}")
        else:
            target = rest[0]
        return (i, kind, target, expected, entity, edge)

    return spark.createDataFrame([full(i, *r) for i, r in enumerate(rows)], MUTATIONS)


class Store:
    def __init__(self, spark):
        self.spark = spark
        self.entities, self.edges, self.log = (spark.createDataFrame([], s) for s in (ENTITIES, EDGES, write.LOG))

    def apply(self, *rows):
        a = write.apply_batch(self.entities, self.edges, self.log, put(self.spark, *rows), "t", F.expr("TIMESTAMP '2024-01-02 00:00:00'"))
        self.entities, self.edges, self.log = (x.cache() for x in (a.entities, a.relationships, a.log))
        return a.status.first()["status"], [(r["idx"], r["operation"], r["version"], r["error"]) for r in a.results.orderBy("idx").collect()]


def test_upsert_repeats_conflicts_and_deletes(spark):
    s = Store(spark)
    assert s.apply(("UPSERT_ENTITY", "a", 0.9)) == ("SUCCESS", [(0, "CREATED", 1, None)])
    assert s.apply(("UPSERT_ENTITY", "a", 0.9, None, '{ "a" : 1.0 }')) == ("SUCCESS", [(0, "NO_CHANGE", 1, None)])
    assert s.log.count() == 1
    assert s.apply(("UPSERT_ENTITY", "a", 0.95)) == ("SUCCESS", [(0, "UPDATED", 2, None)])
    assert s.apply(("UPSERT_ENTITY", "a", 0.99, 99)) == ("FAILED", [(0, "FAILED", 3, "version conflict")])
    assert s.apply(("SOFT_DELETE_ENTITY", "a")) == ("SUCCESS", [(0, "DELETED", 3, None)])
    gone = s.entities.first()
    assert not gone["is_active"] and gone["lifecycle_stage"] == "DELETED" and gone["valid_to"] is not None
    assert s.apply(("SOFT_DELETE_ENTITY", "a")) == ("SUCCESS", [(0, "NO_CHANGE", 3, None)])
    assert s.apply(("SOFT_DELETE_ENTITY", "zz")) == ("FAILED", [(0, "FAILED", 0, "not found")])
    assert s.apply(("UPSERT_ENTITY", "a", 0.95)) == ("SUCCESS", [(0, "UPDATED", 4, None)])
    assert [r["mutation_type"] for r in s.log.orderBy("entry_id").collect()] == ["ENTITY_CREATED", "ENTITY_UPDATED", "ENTITY_SOFT_DELETED", "ENTITY_UPDATED"]
    assert [r["entry_id"] for r in s.log.orderBy("entry_id").collect()] == [1, 2, 3, 4]


def test_edges_need_their_ends_in_order(spark):
    s = Store(spark)
    assert s.apply(("UPSERT_RELATIONSHIP", "a", "b", 0.5)) == ("FAILED", [(0, "FAILED", 1, "unknown entity")])
    status, got = s.apply(("UPSERT_ENTITY", "a", 0.9), ("UPSERT_RELATIONSHIP", "a", "b", 0.5), ("UPSERT_ENTITY", "b", 0.9))
    assert status == "FAILED" and [g[1] for g in got] == ["CREATED", "FAILED"] and s.entities.count() == 0 and s.log.count() == 0
    status, got = s.apply(("UPSERT_ENTITY", "a", 0.9), ("UPSERT_ENTITY", "b", 0.9), ("UPSERT_RELATIONSHIP", "a", "b", 0.5), ("UPSERT_RELATIONSHIP", "a", "b", 0.7), ("DELETE_RELATIONSHIP", "ab"))
    assert status == "SUCCESS" and [(g[1], g[2]) for g in got] == [("CREATED", 1), ("CREATED", 1), ("CREATED", 1), ("UPDATED", 2), ("DELETED", 3)]
    edge = s.edges.first()
    assert (edge["confidence"], edge["is_active"], edge["version"]) == (0.7, False, 3)
    assert s.apply(("NONSENSE", "x"))[0] == "FAILED"


def test_snapshots(spark, tmp_path):
    times = ["2024-01-01", "2024-01-03", "2024-01-05", "2024-01-06"]
    rows = [(1, "ENTITY_CREATED", "e1", None, '{"type":"SERVICE","c":1.0}'), (2, "RELATIONSHIP_CREATED", None, "r1", "{}"), (3, "ENTITY_UPDATED", "e1", None, '{"type":"SERVICE","c":0.8}'), (4, "ENTITY_CREATED", "e2", None, "{}")]
    log = spark.createDataFrame([(*r, t) for r, t in zip(rows, times, strict=True)], "entry_id long, mutation_type string, entity_id string, relationship_id string, after_state string, t string").select("*", F.to_timestamp("t").alias("occurred_at"), F.lit(None).cast("string").alias("before_state"))
    at = lambda d: F.to_timestamp(F.lit(d))
    m = snapshot.create(log, str(tmp_path), "s1", at("2024-01-04")).cache()
    r = m.first()
    assert (r["last_entry_id"], r["node_count"], r["edge_count"], r["active_services"]) == (2, 1, 1, 1)
    state = lambda d: {x["id"]: x["state"] for x in snapshot.restore(m, str(tmp_path), log, at(d)).collect()}
    assert state("2024-01-04")["e1"].endswith('1.0}') and set(state("2024-01-04")) == {"e1", "r1"}
    assert state("2024-01-09")["e1"].endswith('0.8}') and set(state("2024-01-09")) == {"e1", "r1", "e2"}
    assert set(state("2024-01-02")) == {"e1"}  # before the snapshot: from the log alone
    with pytest.raises(ValueError, match="s1"):
        snapshot.restore(m.withColumn("checksum", F.lit("x")), str(tmp_path), log, at("2024-01-04"))


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = [(r["k"], r["n"]) for r in numbered(df, "n", "k").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(1000)) and [k for k, _ in got] == sorted(k for k, _ in got)


def test_json_forms(spark):
    cases = [('{"b": 1.0, "a": [1, {"y": 2, "x": null}]}', '{"a":[1,{"x":null,"y":2.00}],"b":1}', True), ("{}", None, True), ('{"a": 1}', '{"a": 2}', False), ('{"a": 1}', '{"a": 1, "b": null}', False), ("not json", "not json", True)]
    rows = spark.createDataFrame(cases, "x string, y string, same boolean")
    assert all(r["e"] == r["same"] for r in rows.select("same", fn.json_canonical(F.col("x")).eqNullSafe(fn.json_canonical(F.col("y"))).alias("e")).collect())


def test_layers_trees_and_folders(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "a", "X"), ("c", "d", "X")], "from_id string, to_id string, type string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {tuple(r) for r in paths.layers(e, nodes).collect()} == {("d", 0), ("c", 1)}
    got = {("".join(r["path"]), r["cycle"]) for r in paths.trees(e, nodes.where("id = 'a'"), 5).collect()}
    assert got == {("a", False), ("ab", False), ("aba", True)}
    files = spark.createDataFrame([("f1", "src/a b/x.py", "p"), ("f2", "top.py", "p")], "id string, path string, project_id string")
    assert {tuple(r) for r in paths.directories(files).collect()} == {("p", "dir_src", "src"), ("dir_src", "dir_src_a_b", "a b"), ("dir_src_a_b", "f1", None), ("p", "f2", None)}


def test_the_whole_pipeline(spark):
    base = dict(sub_type="", raw_name="", namespace="acme", source_type="git", source_id="s", observed_at="2024-01-01", is_partial=False, ingestion_run_id="r")
    ents = [
        Row(id="1", type="SERVICE", name="PaymentService", properties='{"exposed_to_internet": true, "has_tests": true, "has_documentation": true, "has_resource_limits": true}', confidence=0.9, ordinal=1, **base),
        Row(id="2", type="MODULE", name="auth_module", properties="{}", confidence=0.85, ordinal=2, **base), Row(id="3", type="NOPE", name="x", properties="{}", confidence=0.5, ordinal=3, **base),
        Row(id="4", type="SERVICE", name="payment-service", properties='{"has_tests": false}', confidence=0.5, ordinal=4, **base),
    ]
    entities = spark.createDataFrame(ents).withColumn("observed_at", F.to_timestamp("observed_at"))
    rels = spark.createDataFrame([Row(id="r1", type="IMPORTS", from_id="1", to_id="2", properties="{}", confidence=0.95, is_inferred=False, ordinal=1, **{k: base[k] for k in ("source_type", "source_id", "observed_at", "ingestion_run_id")}),
                                  Row(id="r2", type="CALLS", from_id="4", to_id="nowhere", properties="{}", confidence=0.5, is_inferred=False, ordinal=2, **{k: base[k] for k in ("source_type", "source_id", "observed_at", "ingestion_run_id")})]).withColumn("observed_at", F.to_timestamp("observed_at"))
    registry = spark.createDataFrame([], "canonical_id string, type string, name string, namespace string, aliases array<string>")
    none = spark.createDataFrame([], "id string, type string, sub_type string, name string, namespace string, confidence double, properties string")
    no_edges = spark.createDataFrame([], "id string, type string, from_id string, to_id string, confidence double, properties string")
    out = pipeline.ingest(entities, rels, registry, none, no_edges)
    got = {r["name"]: r for r in out.entities.collect()}
    assert set(got) == {"payment-service", "auth-module"} and got["payment-service"]["sub_type"] == "BFF" and got["payment-service"]["id"] == "1"
    # a later has_tests is false; documentation and limits are left
    assert got["payment-service"]["maturity"] == "NASCENT" and json.loads(got["payment-service"]["properties"])["maturity_score"] == 0.4
    assert {(r["type"], r["from_id"], r["to_id"], r["confidence"]) for r in out.relationships.collect()} == {("IMPORTS", "1", "2", 0.95), ("DEPENDS_ON", "1", "2", 0.855)}
    assert [(r["kind"], r["id"]) for r in out.rejected.collect()] == [("entity", "3")]
    assert [r["kind"] for r in pipeline.ordered(out.mutations).collect()] == ["entity"] * 2 + ["relationship"] * 2
    known = {r["canonical_id"]: r["aliases"] for r in out.registry.collect()}
    assert known == {"1": ["PaymentService", "payment-service"], "2": ["auth_module"]}
    again = pipeline.ingest(entities.withColumn("ingestion_run_id", F.lit("r2")), rels, out.registry, out.entities, out.relationships)
    assert again.mutations.count() == 0


def test_match_bands(spark):
    rows = spark.createDataFrame([(0.95,), (0.80,), (0.60,), (0.59,)], "s double").select(rules.match_decision(F.col("s")).alias("d")).collect()
    assert [r["d"] for r in rows] == ["CERTAIN_MERGE", "LIKELY_MERGE", "UNCERTAIN", "NO_MATCH"]
