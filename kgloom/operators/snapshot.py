"""Snapshots of the graph's state, and its state at any time from the nearest one and the log after it.

Log: entry_id, mutation_type, entity_id, relationship_id, after_state (JSON), occurred_at. A state row: what (entity or
relationship), id, entry_id, is_active, state. The state at a time is the last of each id: a snapshot stands for all entries
up to its own last one, so replay never applies an entry twice, however far back the snapshot lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import asof

# Kinds that carry a state, and those that end a row's life.
ENTITY_KINDS = ["ENTITY_CREATED", "ENTITY_UPDATED", "ENTITY_SOFT_DELETED", "ENTITY_RESTORED"]
EDGE_KINDS = ["RELATIONSHIP_CREATED", "RELATIONSHIP_UPDATED", "RELATIONSHIP_DELETED"]
ENDED = ["ENTITY_SOFT_DELETED", "RELATIONSHIP_DELETED"]
MANIFEST = "snapshot_id string, snapshot_at timestamp, last_entry_id long, node_count long, edge_count long, active_services long, checksum string"


def states(log: DataFrame, until: Column | None = None) -> DataFrame:
    """Each id's last state up to a time (inclusive): one pass with a combining first step."""
    rows = log.where(F.col("mutation_type").isin(ENTITY_KINDS + EDGE_KINDS))
    if until is not None:
        rows = rows.where(F.col("occurred_at") <= until)
    entity = F.col("mutation_type").isin(ENTITY_KINDS)
    rows = rows.select(F.when(entity, "entity").otherwise("relationship").alias("what"),
        F.when(entity, F.col("entity_id")).otherwise(F.col("relationship_id")).alias("id"), "entry_id",
        (~F.col("mutation_type").isin(ENDED)).alias("is_active"), F.col("after_state").alias("state"))
    return last_states(rows)


def last_states(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("what", "id").agg(F.max_by(F.struct("is_active", "state"), "entry_id").alias("x"), F.max("entry_id").alias("entry_id"))
    return out.select("what", "id", "entry_id", "x.is_active", "x.state")


def checksum(rows: DataFrame) -> DataFrame:
    """One row: a digest of all state rows, whatever their order: how many, and the sum and the exclusive or of their hashes."""
    h = F.xxhash64("what", "id", "entry_id", "is_active", "state")
    total = F.sum(h.cast("decimal(38,0)"))
    parts = F.concat_ws("|", F.count("*").cast("string"), F.coalesce(total.cast("string"), F.lit("0")),
        F.coalesce(F.bit_xor(h).cast("string"), F.lit("0")))
    return rows.agg(F.sha2(parts, 256).alias("checksum"))


def statistics(rows: DataFrame) -> DataFrame:
    """node_count, edge_count, active_services, last_entry_id of a state."""
    node = F.col("what") == "entity"
    service = node & F.col("is_active") & (F.get_json_object("state", "$.type") == "SERVICE")
    return rows.agg(F.count_if(node).alias("node_count"), F.count_if(~node).alias("edge_count"), F.count_if(service).alias("active_services"),
        F.coalesce(F.max("entry_id"), F.lit(0)).alias("last_entry_id"))


def create(log: DataFrame, path: str, snapshot_id: str, at: Column) -> DataFrame:
    """Writes the state as of ``at`` under path and returns its manifest row, which the caller appends to the others."""
    spark, where = log.sparkSession, f"{path.rstrip('/')}/{snapshot_id}"
    states(log, at).write.parquet(where)  # an existing snapshot of this id is an error
    rows = spark.read.parquet(where)
    last = log.where(F.col("occurred_at") <= at).agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("last_entry_id"))
    out = statistics(rows).drop("last_entry_id").join(F.broadcast(last)).join(F.broadcast(checksum(rows)))
    return out.select(F.lit(snapshot_id).alias("snapshot_id"), at.cast("timestamp").alias("snapshot_at"), "last_entry_id", "node_count",
        "edge_count", "active_services", "checksum")


def nearest(manifests: DataFrame, times: DataFrame) -> DataFrame:
    """times (namespace, at) with the last snapshot (namespace, snapshot_id, snapshot_at) not after each: an as-of join by ranges."""
    found = asof(times.select("namespace", "at"), manifests.select("namespace", F.col("snapshot_at").alias("at"), "snapshot_id"), "namespace", "at",
        ["snapshot_id"])
    return found.select("namespace", "at", F.col("found.snapshot_id").alias("snapshot_id"), F.col("found.at").alias("snapshot_at"))


def restore(manifests: DataFrame, path: str, log: DataFrame, at: Column, verify: bool = True) -> DataFrame:
    """The state as of a time: the nearest snapshot's rows, and the log's entries after it up to then."""
    found = manifests.where(F.col("snapshot_at") <= at).orderBy(F.desc("snapshot_at"), F.desc("snapshot_id")).limit(1).collect()
    if not found:
        return states(log, at)
    base = log.sparkSession.read.parquet(f"{path.rstrip('/')}/{found[0]['snapshot_id']}")
    if verify and checksum(base).first()["checksum"] != found[0]["checksum"]:
        raise ValueError(f"snapshot {found[0]['snapshot_id']}: its rows are not those of its manifest")
    later = states(log.where(F.col("entry_id") > found[0]["last_entry_id"]), at)
    return last_states(base.select(*later.columns).unionByName(later))


def in_namespace(log: DataFrame, namespace: str, edges: DataFrame | None = None) -> DataFrame:
    """Entries whose state, after or before, lies in the namespace. Edges' states name none, so theirs stay only with edges
    (relationship_id, namespace) to look them up in."""
    own = (F.get_json_object("after_state", "$.namespace") == namespace) | (F.get_json_object("before_state", "$.namespace") == namespace)
    hit = log.where(F.coalesce(own, F.lit(False)))
    if edges is None:
        return hit
    rest = log.where(~F.coalesce(own, F.lit(False)) & F.col("relationship_id").isNotNull())
    return hit.unionByName(
        rest.join(edges.where(F.col("namespace") == namespace).select("relationship_id").distinct(), "relationship_id", "left_semi").select(
            *log.columns))


def between_commits(log: DataFrame, commits: DataFrame, base: str, head: str) -> DataFrame:
    """Entries from the base commit's time to the head's, either included; commits: ref, committed_at. An unknown ref gives none."""
    ends = commits.agg(F.max(F.when(F.col("ref") == base, F.col("committed_at"))).alias("__from"),
        F.max(F.when(F.col("ref") == head, F.col("committed_at"))).alias("__to"))
    return log.join(F.broadcast(ends)).where("occurred_at BETWEEN __from AND __to").select(*log.columns)


def chain(log: DataFrame) -> DataFrame:
    """entity_id, entry_id, before_state, after_state, consistent: whether each entry starts where the entity's last ended."""
    w = Window.partitionBy("entity_id").orderBy("entry_id")
    before = F.lag("after_state").over(w)
    return log.select("entity_id", "entry_id", before.alias("before_state"), "after_state",
        F.col("before_state").eqNullSafe(before).alias("consistent"))
