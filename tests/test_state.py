"""Keyed state: batches one by one against plain folding."""

from __future__ import annotations

import datetime

from kgloom.streaming import state


def at(minute: int) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_newest_rows_by_batches(spark, tmp_path):
    schema = "key string, ts timestamp, value double"
    batches = [[("a", at(5), 1.0), ("b", at(1), 2.0), ("a", at(3), 9.0)], [("a", at(4), 7.0), ("b", at(2), 3.0), ("c", None, 1.0)], [("b", at(2), 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.newest_rows(stream, str(tmp_path / "out"), str(tmp_path / "mark"), "key", "ts").awaitTermination(120)
        changed = spark.read.parquet(str(tmp_path / "out")).where(f"batch = {i}").count()
        assert changed == (2, 1, 0)[i]  # a batch writes what it changes
    assert {tuple(r) for r in state.current(spark, str(tmp_path / "out"), "key").collect()} == {("a", at(5), 1.0), ("b", at(2), 3.0)}


def test_silent_keys_expire(spark, tmp_path):
    schema = "canonical_id string, type string, aliases array<string>, seen timestamp"
    batches = [[("x", "TEAM", ["one"], at(0)), ("y", "TEAM", None, at(1))], [("y", "SERVICE", ["b", "a"], at(50))], [("y", "OLD", ["c"], at(90))], [("z", "TEAM", [], at(95))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.identities(stream, str(tmp_path / "out"), str(tmp_path / "mark"), keep_ms=30 * 60_000).awaitTermination(120)
    found = {r["canonical_id"]: r for r in state.current(spark, str(tmp_path / "out"), "canonical_id").collect()}
    assert set(found) == {"y", "z"} and found["y"]["last_seen"] == at(90)
    gone = spark.read.parquet(str(tmp_path / "out")).where("op = 'EXPIRED'").collect()
    assert "x" in {r["canonical_id"] for r in gone}


def test_adaptive_sampling(spark, tmp_path):
    schema = "trace_id long, span_id long, service_name string, name string, value double"
    rows = [(i, i, "busy" if i % 50 else "calm", "error" if i % 97 == 0 else "ok", float(i % 100)) for i in range(4000)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.adaptive_sample(stream, str(tmp_path / "out"), str(tmp_path / "mark"), 98.0, 400).awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out")).collect()
    urgent = {r[0] for r in rows if r[3] == "error" or r[4] > 98.0}
    assert {r["trace_id"] for r in kept if r["weight"] == 1.0 and r["trace_id"] in urgent} == urgent
    first, second = ([r for r in kept if r["batch"] == b] for b in (0, 1))
    assert len(first) == 2000 and len(second) < 700
    total = sum(r["weight"] for r in second if r["service_name"] == "busy")
    n = sum(1 for r in rows[1::2] if r[2] == "busy")
    assert abs(total - n) < 0.2 * n
