"""Signals from outside: telemetry, deployments, incidents and infrastructure, from files or topics of JSON, as records of the graph.

All functions take rows with one JSON text (column ``value``), so they serve files (``spark.read.text``), streams of files and topics
(``topic``) alike. Texts that don't parse give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import functions as fn

# The telemetry protocol's own names.
OTLP = (
    "resourceSpans array<struct<resource struct<attributes array<struct<key string, value struct<stringValue string>>>>, "
    "scopeSpans array<struct<spans array<struct<traceId string, spanId string, parentSpanId string, name string, "
    "startTimeUnixNano string, endTimeUnixNano string, status struct<code int>>>>>>>"
)
DEPLOYMENT = "id string, service string, environment string, version string, status string, finished_at timestamp"
INCIDENT = "id string, title string, severity string, services array<string>, opened_at timestamp, resolved_at timestamp"
RESOURCE = "address string, type string, name string, depends_on array<string>"


def topic(spark: SparkSession, servers: str, name: str, rows_per_batch: int = 100_000) -> DataFrame:
    """The texts of a Kafka topic as a stream; needs Spark's Kafka package on the cluster."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name)
    return stream.option("maxOffsetsPerTrigger", rows_per_batch).load().select(F.col("value").cast("string").alias("value"))


def otlp_spans(texts: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_span_id, service_name, name, ts, value (milliseconds), is_error of exported traces."""
    found = texts.select(F.from_json("value", OTLP).alias("x")).select(F.explode("x.resourceSpans").alias("r"))
    own = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    service = F.coalesce(F.try_element_at(own, F.lit(1))["value"]["stringValue"], F.lit(""))
    one = found.select(service.alias("service_name"), F.explode("r.scopeSpans").alias("s")).select("service_name", F.explode("s.spans").alias("s"))
    start, end = F.col("s.startTimeUnixNano").cast("decimal(20,0)"), F.col("s.endTimeUnixNano").cast("decimal(20,0)")
    return one.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif("s.parentSpanId", F.lit("")).alias("parent_span_id"),
        "service_name", F.col("s.name").alias("name"), F.timestamp_micros((start / 1000).cast("long")).alias("ts"),
        ((end - start) / 1_000_000).cast("double").alias("value"), (F.coalesce("s.status.code", F.lit(0)) == 2).alias("is_error"),
    )


def _id(kind: str, name: Column, namespace: Column) -> Column:
    return fn.stored_entity_id(F.lit(kind), name, namespace)


def deployments(texts: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """A DEPLOYMENT_EVENT for each finished deployment, and a DEPLOYED_IN edge from its service."""
    ns = F.lit(namespace)
    rows = texts.select(F.from_json("value", DEPLOYMENT).alias("r")).select("r.*").where("id IS NOT NULL AND finished_at IS NOT NULL")
    props = F.to_json(F.struct("environment", "version", "status"))
    entities = rows.select(_id("DEPLOYMENT_EVENT", F.col("id"), ns).alias("id"), F.lit("DEPLOYMENT_EVENT").alias("type"), F.col("id").alias("name"), ns.alias("namespace"), F.col("finished_at").alias("observed_at"), props.alias("properties"))
    service = fn.normalize_name(F.col("service"))
    edges = rows.where("service IS NOT NULL").select(F.lit("DEPLOYED_IN").alias("type"), _id("SERVICE", service, ns).alias("from_id"), _id("DEPLOYMENT_EVENT", F.col("id"), ns).alias("to_id"))
    return entities, edges.distinct()


def incidents(texts: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """An INCIDENT for each, and FAILURE_CORRELATED_WITH edges from its first service (by name) to the others."""
    ns = F.lit(namespace)
    rows = texts.select(F.from_json("value", INCIDENT).alias("r")).select("r.*").where("id IS NOT NULL")
    minutes = (F.unix_timestamp("resolved_at") - F.unix_timestamp("opened_at")) / 60
    props = F.to_json(F.struct("severity", minutes.alias("minutes")))
    entities = rows.select(_id("INCIDENT", F.col("id"), ns).alias("id"), F.lit("INCIDENT").alias("type"), F.col("title").alias("name"), ns.alias("namespace"), F.col("opened_at").alias("observed_at"), props.alias("properties"))
    named = F.array_sort(F.array_distinct(F.transform(F.coalesce("services", F.array().cast("array<string>")), fn.normalize_name)))
    pairs = rows.select(named.alias("s")).where("size(s) > 1").select(F.element_at("s", 1).alias("a"), F.explode(F.expr("slice(s, 2, size(s) - 1)")).alias("b"))
    edges = pairs.select(F.lit("FAILURE_CORRELATED_WITH").alias("type"), _id("SERVICE", F.col("a"), ns).alias("from_id"), _id("SERVICE", F.col("b"), ns).alias("to_id"))
    return entities, edges.distinct()


def resources(texts: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """An INFRASTRUCTURE_RESOURCE for each address, and DEPENDS_ON edges to known ones."""
    ns = F.lit(namespace)
    rows = texts.select(F.from_json("value", RESOURCE).alias("r")).select("r.*").where("address IS NOT NULL")
    kind = "INFRASTRUCTURE_RESOURCE"
    entities = rows.select(_id(kind, F.col("address"), ns).alias("id"), F.lit(kind).alias("type"), F.col("address").alias("name"), ns.alias("namespace"), F.to_json(F.struct(F.col("type").alias("resource_type"))).alias("properties")).dropDuplicates(["id"])
    wanted = rows.select("address", F.explode("depends_on").alias("target")).join(rows.select(F.col("address").alias("target")).distinct(), "target")
    edges = wanted.select(F.lit("DEPENDS_ON").alias("type"), _id(kind, F.col("address"), ns).alias("from_id"), _id(kind, F.col("target"), ns).alias("to_id"))
    return entities, edges.distinct()
