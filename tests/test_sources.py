"""Scans of small source trees, record files, and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kgloom.sources import code, tables
from kgloom.streaming import ingest


def put(root, **files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def names(df):
    return {r["name"] for r in df.collect()}


def test_python(spark, tmp_path):
    root = put(tmp_path, **{"app/main.py": "from app.lib import x\nimport app.helper as h\n\ndef run_app():\n    pass\n\nclass AppController:\n    def inner(self): pass\n", "app/lib.py": "x = 1\n", "app/helper.py": "", "vendor/skip.py": "def no(): pass\n"})
    entities, edges = code.scan_python(spark, root)
    assert names(entities) == {"app.main", "app.lib", "app.helper", "app.main.run_app", "app.main.AppController"}
    assert {(r["from_name"], r["to_name"]) for r in edges.where("type = 'IMPORTS'").collect()} == {("app.main", "app.lib"), ("app.main", "app.helper")}
    assert {r["confidence"] for r in entities.collect()} == {0.95} and {r["confidence"] for r in edges.collect()} == {0.99}


def test_typescript(spark, tmp_path):
    root = put(tmp_path, **{"src/index.ts": "import { helper } from './utils/helper';\nexport function runMain() {}\n", "src/utils/helper.ts": "export const helper = (a: number) => a;\n", "src/x.test.ts": "function no() {}\n"})
    entities, edges = code.scan_typescript(spark, root)
    assert names(entities) == {"src/index", "src/utils/helper", "src/index.runMain", "src/utils/helper.helper"}
    assert sorted((r["type"], r["from_name"], r["to_name"], r["confidence"]) for r in edges.collect()) == [
        ("DEPENDS_ON", "src/index.runMain", "src/index", 0.99), ("DEPENDS_ON", "src/utils/helper.helper", "src/utils/helper", 0.99), ("IMPORTS", "src/index", "src/utils/helper", 0.99)]
    assert {r["confidence"] for r in entities.collect()} == {0.95}


def test_go(spark, tmp_path):
    root = put(tmp_path, **{"go.mod": "module example.com/m\n", "main.go": 'package main\nimport (\n\t"fmt"\n\t"example.com/m/lib"\n)\nfunc main() { lib.Do() }\n', "lib/lib.go": "package lib\nfunc (t *T) Do() {}\n", "lib/lib_test.go": "package lib\nfunc TestX() {}\n"})
    entities, edges = code.scan_go(spark, root)
    assert names(entities) == {"example.com/m", "example.com/m/lib", "example.com/m.main", "example.com/m/lib.Do"}
    assert {(r["from_name"], r["to_name"]) for r in edges.where("type = 'IMPORTS'").collect()} == {("example.com/m", "example.com/m/lib")}
    assert {r["confidence"] for r in entities.collect()} == {0.95} and {r["confidence"] for r in edges.collect()} == {0.99}


def test_openapi(spark, tmp_path):
    spec = json.dumps({"openapi": "3.0.0", "paths": {"/v1/users": {"get": {"x": 1}, "post": {}}}})
    yaml = "openapi: 3.0.0\npaths:\n  /v1/checkout:\n    post:\n      summary: pay\n    get:\n      summary: see\ncomponents:\n  get: {}\n"
    root = put(tmp_path, **{"openapi.json": spec, "api.openapi.yaml": yaml, "other.json": spec})
    assert names(code.scan_openapi(spark, root)) == {"GET /v1/users", "POST /v1/users", "POST /v1/checkout", "GET /v1/checkout"}


def test_records_round_trip(spark, tmp_path):
    ents, rels = spark.createDataFrame([("a", 0.5)], "id string, confidence double"), spark.createDataFrame([("r", "a")], "id string, from_id string")
    tables.write_records(ents, rels, str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_records(spark, str(tmp_path / "out"), "entity", "id string, confidence double").collect()] == [("a", 0.5)]


def test_clean_path(spark):
    got = spark.createDataFrame([("a/./b/../c",), ("../x",)], "p string").select(code.clean_path(F.col("p")).alias("c")).collect()
    assert [r["c"] for r in got] == ["a/c", "../x"]


def entity(i, kind="SERVICE", confidence=0.9, at="2024-01-01T00:00:00Z"):
    return json.dumps({"id": i, "type": kind, "name": "n", "namespace": "x", "source_type": "git", "source_id": "s", "observed_at": at, "properties": "{}", "confidence": confidence, "ingestion_run_id": "r"})


def test_stream_splits_good_and_dead(spark, tmp_path):
    put(tmp_path, **{"in/1.json": entity("a") + "\n" + entity("b", "NOPE") + "\n"})
    stream = ingest.read_json(spark, str(tmp_path / "in"), ingest.OBSERVED_ENTITY)
    ingest.ingest(stream, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"]
    assert [r["error_field"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["type"]


def test_running_store(spark, tmp_path):
    for text in (entity("a") + "\n" + entity("b"), entity("a", confidence=0.5) + "\n" + entity("c")):
        put(tmp_path, **{f"in/{len(list(tmp_path.glob('in/*')))}.json": text + "\n"})
        stream = ingest.read_json(spark, str(tmp_path / "in"), ingest.OBSERVED_ENTITY)
        ingest.running_store(stream, str(tmp_path / "t"), str(tmp_path / "ck"), "id", ["confidence"]).awaitTermination(120)
    got = {r["id"]: (r["confidence"], r["version"]) for r in spark.read.parquet(str(tmp_path / "t/1")).collect()}
    assert got == {"a": (0.5, 2), "b": (0.9, 1), "c": (0.9, 1)}


def test_span_windows_and_dedup(spark, tmp_path):
    span = lambda i, ts, parent=None, s="web": json.dumps({"trace_id": "t", "span_id": i, "parent_span_id": parent, "service_name": s, "ts": ts, "value": 1.0})
    put(tmp_path, **{"in/1.json": "\n".join([span("1", "2024-01-01T00:01:00Z"), span("2", "2024-01-01T00:04:00Z", "1", "db"), span("2", "2024-01-01T00:04:00Z", "1", "db")])})
    spans = ingest.read_json(spark, str(tmp_path / "in"), ingest.SPAN)
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    run(ingest.span_windows(spans), "w", "complete")
    assert {(r["service_name"], r["calls"]) for r in spark.table("w").collect()} == {("web", 1), ("db", 2)}
    run(ingest.distinct_events(spans, "span_id"), "u", "append")
    assert spark.table("u").count() == 2
    run(ingest.live_calls(spans), "c", "append")
    assert {(r["caller"], r["callee"]) for r in spark.table("c").collect()} == {("web", "db")}


def test_file_records_and_changes(spark, tmp_path):
    rows = [("api/main.go", 1), ("api/v1/a.go", 1), ("README.md", 2)]
    changes = spark.createDataFrame(rows, "path string, seq long")
    projects = spark.createDataFrame([("api", "api"), ("api/v1", "api/v1")], "project string, name string")
    entities, edges = tables.file_modules(changes, projects, "src", "ns", "run", "sha", "place")
    assert {(r["sub_type"], r["name"], r["confidence"]) for r in entities.collect()} == {("project", "api", 0.99), ("project", "api/v1", 0.99), ("file", "api/main.go", 0.95), ("file", "api/v1/a.go", 0.95), ("file", "README.md", 0.95)}
    ids = {r["name"]: r["id"] for r in entities.collect()}
    assert {(r["from_id"], r["to_id"]) for r in edges.collect()} == {(ids["api/main.go"], ids["api"]), (ids["api/v1/a.go"], ids["api/v1"])}
    marks, seen = tables.Checkpoints(spark, str(tmp_path / ".marks")), []

    def broken(new):
        raise RuntimeError("away")

    with pytest.raises(RuntimeError):
        tables.deliver_changes(changes, "src", marks, broken)
    assert marks.get("src") == (None, 0)
    take = lambda new: seen.append(sorted(r["path"] for r in new.collect()))
    more = changes.unionByName(spark.createDataFrame([("api/new.go", 3)], "path string, seq long"))
    assert [tables.deliver_changes(c, "src", marks, take) for c in (changes, changes, more)] == [2, 2, 3]
    assert seen == [["README.md", "api/main.go", "api/v1/a.go"], ["api/new.go"]] and marks.get("src") == ("3", 2)
    assert tables.deliver_changes(changes.limit(0), "other", marks, take) is None


def test_configurations(spark, tmp_path):
    text = "version: 1\nnamespace: shop # the shop\ngovernance:\n  rules:\n    - id: RULE-01\n      name: no-circular-dependencies\n      severity: FAIL\n      scope: \"all\"\n    - {}\n".replace("    - {}\n", "    -\n      id: RULE-02\n      name: x\n")
    rules = [tuple(r) for r in tables.governance_rules(spark, text).collect()]
    assert rules == [("RULE-01", "no-circular-dependencies", "FAIL", "all"), ("RULE-02", "x", None, None)]
    assert [tuple(r) for r in tables.governance_rules(spark, json.dumps({"governance": {"rules": [{"id": "a", "name": "b", "severity": "WARN"}]}})).collect()] == [("a", "b", "WARN", None)]
    root = put(tmp_path, **{"arch.yaml": text, "deep/er/x": ""})
    assert tables.find_upward("arch.yaml", f"{root}/deep/er") == f"{root}/arch.yaml" and tables.find_upward("no-such-file.yaml", root) is None
    assert tables.ingest_config(None, "/r")["git"][0]["repo_path"] == "/r" and tables.ingest_config('{"git": [{"repo_path": "a"}]}')["ast_go"] == []


def test_checkpoints(spark, tmp_path):
    marks = tables.Checkpoints(spark, str(tmp_path))
    assert marks.get("a") == (None, 0)
    assert marks.put("a", "sha1") == 1 and marks.put("a", "sha2") == 2 and marks.put("b", "x") == 1
    assert marks.get("a") == ("sha2", 2)


def test_failed_delivery_goes_to_the_dead_letters(spark, tmp_path):
    put(tmp_path, **{"in/1.json": entity("a") + "\n" + entity("b", "NOPE") + "\n"})

    def broken(batch, number):
        raise RuntimeError("store is away")

    stream = ingest.read_json(spark, str(tmp_path / "in"), ingest.OBSERVED_ENTITY)
    ingest.ingest(stream, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "ck"), deliver=broken).awaitTermination(120)
    assert {(r["id"], r["error_field"]) for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {("b", "type"), ("a", "delivery: store is away")}
