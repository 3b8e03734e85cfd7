"""The write path: batches of mutations applied all or nothing, the log they leave, and the other upserts.

Tables: entities (id, type, sub_type, canonical_name, namespace, confidence, is_active, lifecycle_stage, valid_from, valid_to, version,
properties) and relationships (id, type, from_id, to_id, confidence, is_active, valid_from, valid_to, version, properties);
properties are JSON. A batch's effects on one id follow one another, so they are read off windows over the id's mutations;
no id depends on another but for the ends of a new edge, which must be stored or come earlier in the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.session import cut

from . import pointers, records
from .order import numbered

ENTITY = ["type", "sub_type", "canonical_name", "namespace", "confidence", "lifecycle_stage", "valid_from", "properties"]
EDGE = ["type", "from_id", "to_id", "confidence", "valid_from", "properties"]
#: What makes an upsert more than a repetition.
ENTITY_COMPARED = ["type", "sub_type", "canonical_name", "namespace", "confidence", "lifecycle_stage", "properties"]
EDGE_COMPARED = ["type", "from_id", "to_id", "confidence", "properties"]
# The log's kinds.
LOGGED = {
    ("entity", "CREATED"): "ENTITY_CREATED", ("entity", "UPDATED"): "ENTITY_UPDATED", ("entity", "DELETED"): "ENTITY_SOFT_DELETED", ("entity", "RESTORED"): "ENTITY_RESTORED",
    ("relationship", "CREATED"): "RELATIONSHIP_CREATED", ("relationship", "UPDATED"): "RELATIONSHIP_UPDATED", ("relationship", "DELETED"): "RELATIONSHIP_DELETED",
}
LOG = "entry_id long, transaction_id string, mutation_type string, entity_id string, relationship_id string, before_state string, after_state string, occurred_at timestamp"


@dataclass
class Applied:
    """status: one row (status, failed_at, error). results: idx, kind, id, operation, version, error, up to the first failure.
    The tables and the log are as before where the batch failed."""

    status: DataFrame
    results: DataFrame
    entities: DataFrame
    relationships: DataFrame
    log: DataFrame


def _payload(columns: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in columns])


def _same(a: Column, b: Column, compared: list[str]) -> Column:
    out = F.lit(True)
    for c in compared:
        x, y = a[c], b[c]
        out = out & (fn.json_canonical(x).eqNullSafe(fn.json_canonical(y)) if c == "properties" else x.eqNullSafe(y))
    return out


def _stepped(mutations: DataFrame, current: DataFrame, what: str, payload: list[str], compared: list[str], error: Column) -> DataFrame:
    """idx, kind, id, operation, version, error, and the row's state before and after (old, new: payload, version, active)."""
    # current states are matched by id; a mutation's place among its id's is its idx
    cur = current.select("id", _payload(payload).alias("cur"), F.col("version").alias("cur_version"), F.col("is_active").alias("cur_active"),
        F.col("valid_to").alias("cur_valid_to"))
    m = mutations.join(cur, "id", "left")
    before = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    up = F.col("kind").startswith("UPSERT")
    stated = F.last(F.when(up, F.col("new")), ignorenulls=True).over(before)
    m = m.withColumns({"prev": F.coalesce(stated, "cur"), "prev_up": F.lag(up).over(Window.partitionBy("id").orderBy("idx"))})
    m = m.withColumn("prev_active", F.coalesce("prev_up", "cur_active", F.lit(False)))
    known = F.col("prev").isNotNull()
    same = F.coalesce(_same(F.col("new"), F.col("prev"), compared), F.lit(False))
    op = F.when(up, F.when(~known, "CREATED").when(F.col("prev_active") & same, "NO_CHANGE").otherwise("UPDATED")).otherwise(
        F.when(~known, "MISSING").when(F.col("prev_active"), "DELETED").otherwise("NO_CHANGE"))
    m = m.withColumn("operation", op)
    changed = F.col("operation").isin("CREATED", "UPDATED", "DELETED").cast("int")
    m = m.withColumn("old_version", F.coalesce("cur_version", F.lit(0)) + F.coalesce(F.sum(changed).over(before), F.lit(0)))
    clash = up & known & (F.coalesce("expected", F.lit(0)) != 0) & (F.col("expected") != F.col("old_version"))
    problem = F.coalesce(error, F.when(F.col("operation") == "MISSING", "not found"), F.when(clash, "version conflict"))
    state = F.when(up, F.col("new")).otherwise(F.col("prev"))
    return m.select(
        "idx", "kind", "id", F.lit(what).alias("what"), "operation", (F.col("old_version") + changed).cast("int").alias("version"), problem.alias("error"), "old_version",
        F.when(known, F.col("prev")).alias("old"), "prev_active", state.alias("state"), (up | (F.col("operation") == "MISSING")).alias("active"),
    )


def _json(state: Column, payload: list[str], version: Column, active: Column, valid_to: Column) -> Column:
    return F.when(state.isNotNull(),
        F.to_json(
            F.struct(*[state[c].alias(c) for c in payload], version.cast("int").alias("version"), active.alias("is_active"),
                valid_to.alias("valid_to"))))


def apply_batch(entities: DataFrame, relationships: DataFrame, log: DataFrame, mutations: DataFrame, transaction_id: str,
    at: Column) -> Applied:
    """Applies the mutations in the order of idx, or none of them where one fails.

    mutations: idx, kind (UPSERT_ENTITY, UPSERT_RELATIONSHIP, SOFT_DELETE_ENTITY, DELETE_RELATIONSHIP), target_id, expected (a version that
    must be the current one, or null), and for upserts entity (``ENTITY`` and id) or relationship (``EDGE`` and id). A
    missing id is made from type, name and namespace or from type and ends; a missing stage is ACTIVE. Upserts are active."""
    m = mutations.withColumn("kind", F.upper("kind"))
    e = m.where(F.col("kind").isin("UPSERT_ENTITY", "SOFT_DELETE_ENTITY")).select("idx", "kind", "expected", "target_id", "entity.*")
    e = e.withColumn("lifecycle_stage", F.coalesce(F.nullif("lifecycle_stage", F.lit("")), F.lit("ACTIVE")))
    own = F.coalesce(F.nullif("id", F.lit("")), fn.stored_entity_id(F.col("type"), F.col("canonical_name"), F.col("namespace")))
    e = e.withColumn("id", F.when(F.col("kind") == "UPSERT_ENTITY", own).otherwise(F.col("target_id")))
    e = records.stored_entity_errors(e.withColumn("valid_to", F.lit(None).cast("timestamp"))).withColumn("new", _payload(ENTITY))
    bad = F.when(F.col("kind") == "UPSERT_ENTITY", F.col("error_field"))
    steps = _stepped(e, entities, "entity", ENTITY, ENTITY_COMPARED, bad)

    r = m.where(F.col("kind").isin("UPSERT_RELATIONSHIP", "DELETE_RELATIONSHIP")).select("idx", "kind", "expected", "target_id",
        "relationship.*")
    own = F.coalesce(F.nullif("id", F.lit("")), fn.stored_relationship_id(F.col("type"), F.col("from_id"), F.col("to_id")))
    r = r.withColumn("id", F.when(F.col("kind") == "UPSERT_RELATIONSHIP", own).otherwise(F.col("target_id")))
    made = e.where("kind = 'UPSERT_ENTITY'").groupBy("id").agg(F.min("idx").alias("since"))
    known = entities.select("id", F.lit(-1).cast("long").alias("since")).unionByName(
        made.select("id", F.col("since").cast("long").alias("since"))).groupBy("id").agg(F.min("since").alias("since"))
    r = r.join(known.toDF("from_id", "from_since"), "from_id", "left").join(known.toDF("to_id", "to_since"), "to_id", "left")
    lost = ~(F.coalesce(F.col("from_since") < F.col("idx"), F.lit(False)) & F.coalesce(F.col("to_since") < F.col("idx"), F.lit(False)))
    r = records.stored_relationship_errors(r.withColumn("valid_to", F.lit(None).cast("timestamp"))).withColumn("new", _payload(EDGE))
    bad = F.when(F.col("kind") == "UPSERT_RELATIONSHIP", F.coalesce("error_field", F.when(lost, "unknown entity")))
    edge_steps = _stepped(r, relationships, "relationship", EDGE, EDGE_COMPARED, bad)

    odd = m.where(
        ~F.coalesce(F.col("kind").isin("UPSERT_ENTITY", "SOFT_DELETE_ENTITY", "UPSERT_RELATIONSHIP", "DELETE_RELATIONSHIP"), F.lit(False)))
    short = ["idx", "kind", "id", "operation", "version", "error"]
    odd = odd.select("idx", "kind", F.col("target_id").alias("id"), F.lit("FAILED").alias("operation"), F.lit(0).alias("version"),
        F.lit("unknown kind").alias("error"))
    steps, edge_steps = cut(steps), cut(edge_steps)
    every = steps.select(*short).unionByName(edge_steps.select(*short)).unionByName(odd)
    failed = cut(every.where("error IS NOT NULL").agg(F.min("idx").alias("failed_at"), F.min_by("error", "idx").alias("error")))
    status = failed.select(F.when(F.col("failed_at").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), "failed_at", "error")
    results = every.join(F.broadcast(failed.select("failed_at"))).where("failed_at IS NULL OR idx <= failed_at").drop("failed_at")
    results = results.withColumn("operation", F.when(F.col("error").isNotNull(), "FAILED").otherwise(F.col("operation")))
    if failed.where("failed_at IS NOT NULL").count():
        return Applied(status, results, entities, relationships, log)
    return Applied(
        status, results, _after(entities, steps, ENTITY, at, "lifecycle_stage"), _after(relationships, edge_steps, EDGE, at, None),
        append_log(log, _entries(steps, ENTITY, transaction_id, at).unionByName(_entries(edge_steps, EDGE, transaction_id, at)), "idx"),
    )


def _after(table: DataFrame, steps: DataFrame, payload: list[str], at: Column, stage: str | None) -> DataFrame:
    """The table with each changed id's last state."""
    changed = steps.where(F.col("operation").isin("CREATED", "UPDATED", "DELETED"))
    last = changed.groupBy("id").agg(F.max_by(F.struct("state", "version", "active"), "idx").alias("n"))
    kept = table.join(last.select("id"), "id", "left_anti").select(*table.columns)
    live = F.col("n.active")
    fields = [
        F.col(f"n.state.{c}").alias(c) if c != stage else F.when(live, F.col(f"n.state.{c}")).otherwise("DELETED").alias(c) for c in payload]
    new = last.select("id", *fields, live.alias("is_active"), F.when(~live, at).alias("valid_to"), F.col("n.version").alias("version"))
    return kept.unionByName(new.select(*table.columns))


def _entries(steps: DataFrame, payload: list[str], transaction_id: str, at: Column) -> DataFrame:
    kind = F.coalesce(*[F.when((F.col("what") == w) & (F.col("operation") == op), name) for (w, op), name in LOGGED.items()])
    none = F.lit(None).cast("timestamp")
    rows = steps.where(F.col("operation").isin("CREATED", "UPDATED", "DELETED"))
    entity = F.col("what") == "entity"
    before = _json(F.col("old"), payload, F.col("old_version"), F.col("prev_active"), none)
    after = _json(F.col("state"), payload, F.col("version"), F.col("active"), F.when(~F.col("active"), at))
    return rows.select(
        "idx", F.lit(transaction_id).alias("transaction_id"), kind.alias("mutation_type"), F.when(entity, F.col("id")).alias("entity_id"), F.when(~entity, F.col("id")).alias("relationship_id"),
        before.alias("before_state"), after.alias("after_state"), at.alias("occurred_at"),
    )


def append_log(log: DataFrame, entries: DataFrame, *order: str) -> DataFrame:
    """The log and the new entries, numbered on from its last in the given order."""
    last = log.agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("__last"))
    new = numbered(entries, "__n", *order).join(F.broadcast(last)).withColumn("entry_id", F.col("__last") + F.col("__n") + 1)
    return log.unionByName(new.select(*log.columns))


def upsert_metrics(points: DataFrame, new: DataFrame, key: str, at: str, now: Column, order: str) -> DataFrame:
    """The points with the new ones put in or over those of the same key and time; the last of new ones by ``order`` wins, a missing
    time is now."""
    fresh = new.withColumn(at, F.coalesce(at, now))
    values = [c for c in points.columns if c not in (key, at)]
    last = fresh.groupBy(key, at).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, at, "v.*")
    return points.join(last.select(key, at), [key, at], "left_anti").select(*points.columns).unionByName(last.select(*points.columns))


def upsert_registry(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Identities by canonical_id: all columns of the new row but first_seen, which never moves on, and aliases that are not known yet
    behind the known."""
    n = new.select("canonical_id", F.struct(*[c for c in registry.columns if c != "canonical_id"]).alias("n"))
    both = registry.select("canonical_id", F.struct(*[c for c in registry.columns if c != "canonical_id"]).alias("o")).join(n,
        "canonical_id", "full_outer")

    def pick(c: str) -> Column:
        if c == "first_seen":
            return F.least("o.first_seen", "n.first_seen")  # a late row may tell of an earlier time
        if c == "aliases":
            return fn.append_absent(F.coalesce("o.aliases", F.array().cast(registry.schema[c].dataType)),
                F.coalesce("n.aliases", F.array().cast(registry.schema[c].dataType)))
        return F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select("canonical_id", *[pick(c).alias(c) for c in registry.columns if c != "canonical_id"])


def merge_entities(entities: DataFrame, relationships: DataFrame, merges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Each source_id becomes one with its target_id (merges): its edges go to the target, parallel ones collapse to the most
    confident, edges between the two vanish; the source is deleted softly. Chains of merges are followed to their end by pointer
    jumping; merges in a circle end at their smallest member, which stays."""
    direct = merges.select("source_id", "target_id").where("source_id <> target_id").groupBy(F.col("source_id").alias("source")).agg(
        F.min("target_id").alias("target"))
    pairs = cut(pointers.chain_ends(direct).toDF("source_id", "target_id"))
    gone = entities.join(pairs.select(F.col("source_id").alias("id"), F.lit(True).alias("__gone")), "id", "left").withColumn("__gone",
        F.coalesce("__gone", F.lit(False)) & F.col("is_active"))
    out = gone.withColumns(
        {"valid_to": F.when(F.col("__gone"), at).otherwise(F.col("valid_to")),
            "version": (F.col("version") + F.col("__gone").cast("int")).cast("int"),
            "is_active": F.col("is_active") & ~F.col("__gone")}).drop("__gone")
    moved = records.remap_endpoints(relationships, pairs.toDF("old_id", "new_id")).where("from_id <> to_id")
    rest = [c for c in relationships.columns if c not in ("from_id", "to_id", "type")]
    best = moved.groupBy("from_id", "to_id", "type").agg(F.max_by(F.struct(*rest), F.struct("is_active", "confidence", "id")).alias("b"))
    return out.select(*entities.columns), best.select("from_id", "to_id", "type", "b.*").select(*relationships.columns)


def split_entity(entities: DataFrame, relationships: DataFrame, entity_id: str, names: tuple[str, str], second: DataFrame,
    at: Column) -> tuple[DataFrame, DataFrame]:
    """The entity becomes two of the given names; the edges named in second (id) go to the second, all others to the first."""
    ids = [fn.stored_entity_id(F.col("type"), F.lit(n), F.col("namespace")) for n in names]
    old = entities.where(F.col("id") == entity_id)
    parts = [old.withColumns({"new": i, "canonical_name": F.lit(n), "version": F.lit(1), "valid_from": at}) for n,
        i in zip(names, ids, strict=True)]
    made = parts[0].unionByName(parts[1]).withColumn("id", F.col("new")).drop("new")
    closed = entities.withColumns(
        {"valid_to": F.when((F.col("id") == entity_id) & F.col("is_active"), at).otherwise(F.col("valid_to")),
            "version": (F.col("version") + ((F.col("id") == entity_id) & F.col("is_active")).cast("int")).cast("int"),
            "is_active": F.col("is_active") & (F.col("id") != entity_id)})
    names_ = old.select(ids[0].alias("one"), ids[1].alias("two"))
    marked = relationships.join(second.select("id", F.lit(True).alias("__second")), "id", "left").join(F.broadcast(names_))
    to = F.when(F.coalesce("__second", F.lit(False)), F.col("two")).otherwise(F.col("one"))
    edges = marked.withColumns(
        {"from_id": F.when(F.col("from_id") == entity_id, to).otherwise(F.col("from_id")),
            "to_id": F.when(F.col("to_id") == entity_id, to).otherwise(F.col("to_id"))})
    return closed.unionByName(made.select(*entities.columns)), edges.select(*relationships.columns)


def restore_entities(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """Softly deleted rows named in ids (id) are active again, with an open interval and the next version."""
    marked = entities.join(ids.select("id", F.lit(True).alias("__back")).distinct(), "id", "left")
    hit = F.coalesce("__back", F.lit(False)) & ~F.col("is_active")
    op = F.when(hit, "RESTORED").when(F.col("__back"), "NO_CHANGE").otherwise("KEPT")
    return marked.withColumns(
        {"operation": op, "valid_to": F.when(~hit, F.col("valid_to")), "version": (F.col("version") + hit.cast("int")).cast("int"),
            "is_active": F.col("is_active") | hit}).drop("__back")


def update_strength(relationships: DataFrame, strengths: DataFrame) -> DataFrame:
    """The confidence of the edges named in strengths (id, strength; the last by ``at``), without other checks; inactive edges and
    strengths outside 0..1 stay out."""
    last = strengths.where(F.col("strength").between(0, 1)).groupBy("id").agg(F.max_by("strength", "at").alias("__s"))
    out = relationships.join(last, "id", "left")
    hit = F.col("__s").isNotNull() & F.col("is_active")
    return out.withColumns(
        {"confidence": F.when(hit, F.col("__s")).otherwise(F.col("confidence")),
            "version": (F.col("version") + hit.cast("int")).cast("int")}).drop("__s")


def apply_late(current: DataFrame, observed: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key by its own time: a late observation never overrides a newer one."""
    values = [c for c in current.columns if c != key]
    every = current.unionByName(observed.select(*current.columns))
    return every.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, *[c for c in values if c != at])).alias("v")).select(key, "v.*")
