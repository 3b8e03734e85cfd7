"""Incremental ingestion: files of JSON lines arrive, good records change the store, bad ones go to a dead-letter table.

Each micro-batch is written under its own number, so that a batch that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kgloom.operators import records, store
from kgloom.session import remove

OBSERVED_ENTITY = "id string, type string, sub_type string, name string, raw_name string, namespace string, source_type string, source_id string, observed_at timestamp, properties string, confidence double, ingestion_run_id string"
KEPT_VERSIONS = 3
SPAN = "trace_id string, span_id string, parent_span_id string, service_name string, name string, ts timestamp, value double"


def read_json(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, good_path: str, dead_path: str, checkpoint: str,
    check: Callable[[DataFrame], DataFrame] = records.observed_entity_errors, once: bool = True,
    deliver: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Splits each batch by the check's error_field and writes both parts, partitioned by the batch's number. Good rows are then
    delivered, if asked for; where that fails the batch is a dead letter as a whole. once: what has arrived, and then an end;
    else it runs on."""

    def commit(batch: DataFrame, number: int) -> None:
        checked = check(batch).withColumn("batch", F.lit(number)).persist()
        checked.where("error_field IS NULL").drop("error_field", "batch").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        checked.where("error_field IS NOT NULL").drop("batch").write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        checked.unpersist()
        if deliver is not None:
            good = batch.sparkSession.read.schema(batch.schema).parquet(f"{good_path}/batch={number}")
            try:
                deliver(good, number)
            except Exception as e:  # the batch isn't lost: all of it goes to the dead letters, with the reason
                good.withColumn("error_field", F.lit(f"delivery: {e}"[:200])).write.mode("append").parquet(f"{dead_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_store(stream: DataFrame, path: str, checkpoint: str, key: str, compared: list[str]) -> StreamingQuery:
    """Upserts each batch into a versioned table: version n of the table lies in path/n and is made from n - 1.

    The latest row of a key within a batch wins; a replayed batch rewrites its own version from the same base."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = T.StructType([f for f in batch.schema if f.name in (key, *compared)]).add("version", T.IntegerType())
        old = spark.read.schema(schema).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], schema)
        new = records.latest_per_key(batch, [key], [F.desc("observed_at"), *map(F.desc, compared)]).select(key, *compared)
        store.upsert(old, new, key, compared).drop("operation").write.mode("overwrite").parquet(f"{path}/{number}")
        if number >= KEPT_VERSIONS:  # the one before stays for a batch that runs again
            remove(spark, f"{path}/{number - KEPT_VERSIONS}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def span_windows(spans: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls, mean and largest value for each service in tumbling windows; later rows than the watermark are left out."""
    out = spans.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "service_name").agg(F.count("*").alias("calls"),
        F.avg("value").alias("mean"), F.max("value").alias("largest"))
    return out.select("service_name", F.col("w.start").alias("window_start"), "calls", "mean", "largest")


def distinct_events(events: DataFrame, key: str, keep: str = "24 hours") -> DataFrame:
    """Each key once while its first occurrence is younger than the watermark."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([key])


def live_calls(spans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Caller, callee and time as parents and children arrive: a stream-stream join bounded by the watermark."""
    parent = spans.select(F.col("span_id").alias("p"), F.col("service_name").alias("caller"), F.col("ts").alias("parent_ts")).withWatermark(
        "parent_ts", late)
    child = spans.where("parent_span_id IS NOT NULL").select("parent_span_id", F.col("service_name").alias("callee"), "ts").withWatermark(
        "ts", late)
    near = F.expr("p = parent_span_id AND caller <> callee AND ts BETWEEN parent_ts AND parent_ts + INTERVAL 10 MINUTES")
    return parent.join(child, near).select("caller", "callee", "ts")


def sample_spans(spans: DataFrame, slow: float, target: float, counts: DataFrame) -> DataFrame:
    """Spans that stay, and the weight each stands for: all failed or slow ones (value over slow), and of a service's others about
    ``target`` (counts: service_name, n), drawn by a hash of the trace, so a trace stays whole and a rerun draws the same."""
    keep = (F.col("name") == "error") | (F.col("value") > slow)
    rate = F.least(F.lit(1.0), target / F.col("n"))
    out = spans.join(F.broadcast(counts), "service_name", "left").withColumn("rate", F.when(keep, 1.0).otherwise(F.coalesce(rate, F.lit(1.0))))
    drawn = F.conv(F.substring(F.md5(F.col("trace_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") < F.col("rate") * (
        1 << 24)
    return out.where(drawn).withColumn("weight", 1.0 / F.col("rate")).drop("n", "rate")
