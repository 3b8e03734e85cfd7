"""Keyed state in streams: each key's state lives in the state store, so a batch costs what it brings, not what is stored.

What changes is written under the batch's number, so that a batch that runs again replaces what it wrote; ``current`` reads the last
change of each key. A key that stays silent for longer than ``keep`` in the stream's own time expires: a timer clears its
state and writes that it is gone. All need the store that keeps state on disk, which is set for these queries alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kgloom.session import ship

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
UPSERT, EXPIRED = "UPSERT", "EXPIRED"


class _Kept(StatefulProcessor):
    """A value of each key with a timer; subclasses say how rows change it."""

    def __init__(self, columns: list[str], schema: str, keep: int | None):
        self.columns, self.schema, self.keep = columns, schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", self.schema)

    def merged(self, old: tuple | None, rows: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def times(self, rows: pd.DataFrame) -> pd.Series:
        raise NotImplementedError

    def _row(self, key: tuple, value: tuple, op: str) -> pd.DataFrame:
        return pd.DataFrame([(*key, *value, op)], columns=[*self.columns, "op"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.state.get()  # None where there is none; asking first would be another call for each key
        old = None if old is None else tuple(old)
        new, last = old, None
        for some in rows:  # a key's rows come in parts and are never held together
            new = self.merged(new, some)
            last = max(x for x in (last, self.times(some).max()) if x is not None)
        if new != old:
            self.state.update(new)
            yield self._row(key, new, UPSERT)
        if self.keep is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(max(int(last.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            value = tuple(self.state.get())
            self.state.clear()
            yield self._row(key, value, EXPIRED)

    def close(self) -> None:
        pass


class _Newest(_Kept):
    """The newest row by its own time; of equal times the largest by the other columns."""

    def merged(self, old, rows):
        names = self.columns[1:]
        if len(rows) > 1:
            rows = rows[rows[names[0]] == rows[names[0]].max()]
        best = max((tuple(r) for r in rows[names].itertuples(index=False)), key=lambda r: tuple((x is not None, x) for x in r))
        best = tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in best)
        return best if old is None or best > old else old

    def times(self, rows):
        return rows[self.columns[1]]


class _Identity(_Kept):
    """The first sighting, the last one with its type, and all aliases (a sorted text, by line)."""

    def merged(self, old, rows):
        rows = rows.sort_values("seen", kind="stable")
        known = set(old[3].split("\n")) if old and old[3] else set()
        known |= {a for some in rows["aliases"] if some is not None for a in some if a}
        first, last = rows["seen"].iloc[0].to_pydatetime(), rows["seen"].iloc[-1].to_pydatetime()
        kind = rows["type"].iloc[-1] if old is None or last >= old[2] else old[0]
        return (kind, min(first, old[1]) if old else first, max(last, old[2]) if old else last, "\n".join(sorted(known)))

    def times(self, rows):
        return rows["seen"]


def _start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = changes.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return changes.writeStream.foreachBatch(commit).outputMode("update").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _transformed(stream: DataFrame, key: str, worker: _Kept, out: str, at: str, late: str) -> DataFrame:
    ship(stream.sparkSession)
    timed = worker.keep is not None
    rows = stream.withWatermark(at, late) if timed else stream
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=worker, outputStructType=out, outputMode="Update",
        timeMode="EventTime" if timed else "None")


def newest_rows(stream: DataFrame, path: str, checkpoint: str, key: str, at: str, keep_ms: int | None = None,
    late: str = "0 seconds") -> StreamingQuery:
    """The newest row of each key by its own time, whatever the order of arrival: a late row never overrides a newer one. Rows without
    a time are left out. keep_ms: how long a silent key stays."""
    rest = [f for f in stream.schema if f.name not in (key, at)]
    kind = stream.schema[key].dataType.simpleString()
    value = ", ".join([f"`{at}` timestamp", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)])
    worker = _Newest([key, at, *(f.name for f in rest)], value, keep_ms)
    rows = stream.where(F.col(at).isNotNull()).select(key, at, *(f.name for f in rest))
    return _start(_transformed(rows, key, worker, f"`{key}` {kind}, {value}, op string", at, late), path, checkpoint)


def identities(stream: DataFrame, path: str, checkpoint: str, keep_ms: int | None = None, late: str = "0 seconds") -> StreamingQuery:
    """Identities (canonical_id, type, aliases, seen) as they grow: first_seen, last_seen, the last type and all aliases of each."""
    value = "type string, first_seen timestamp, last_seen timestamp, aliases string"
    worker = _Identity(["canonical_id", "type", "first_seen", "last_seen", "aliases"], value, keep_ms)
    rows = stream.where("seen IS NOT NULL").select("canonical_id", "type", "aliases", "seen")
    return _start(_transformed(rows, "canonical_id", worker, f"canonical_id string, {value}, op string", "seen", late), path, checkpoint)


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last change of each key that is not expired."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in (key, "batch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("batch", (F.col("op") == UPSERT).cast("int"))).alias("v")).select(
        key, "v.*").where(F.col("op") != EXPIRED).drop("op")


class _Sampler(StatefulProcessor):
    """A service's running rate, and which of its rows stay."""

    def __init__(self, target: int, columns: list[str]):
        self.target, self.columns = target, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "seen long, rate double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, rate = tuple(self.state.get()) if self.state.exists() else (0, 1.0)
        for some in rows:
            kept = some[some["urgent"] | (some["draw"] < rate)]
            yield kept.assign(weight=(1.0 / rate) if rate else 0.0, rate=rate).assign(weight=lambda x: x["weight"].where(~x["urgent"], 1.0))[[
                *self.columns, "rate", "weight"]]
            seen += int((~some["urgent"]).sum())
        self.state.update((seen, min(1.0, self.target / seen) if seen else 1.0))

    def close(self) -> None:
        pass


def adaptive_sample(spans: DataFrame, path: str, checkpoint: str, slow: float, target: int) -> StreamingQuery:
    """Spans (trace_id, span_id, service_name, name, value) that stay, with the rate they were drawn at and the weight each stands for. All
    failed or slow ones stay; of a service's others, a share that falls with how many it has sent in earlier batches, about
    ``target`` of them a batch. A trace is drawn by its hash, so it stays or goes whole at one rate, and a rerun draws the same."""
    columns = ["trace_id", "span_id", "service_name", "name", "value"]
    draw = F.pmod(F.xxhash64(F.col("trace_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    urgent = F.coalesce(F.col("name") == "error", F.lit(False)) | F.coalesce(F.col("value") > slow, F.lit(False))
    rows = spans.where("service_name IS NOT NULL").select(*columns, draw.alias("draw"), urgent.alias("urgent"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.select(*columns).schema)
    ship(spans.sparkSession)
    made = rows.groupBy("service_name").transformWithStateInPandas(statefulProcessor=_Sampler(target, columns),
        outputStructType=f"{out}, rate double, weight double", outputMode="Update", timeMode="None")
    return _start(made, path, checkpoint)
