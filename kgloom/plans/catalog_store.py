"""Registered queries of the write path, snapshots, the log, metrics, files and streams, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.operators import pipeline, records, rules, snapshot, store, write
from kgloom.session import PART_ROWS, cut, own_path
from kgloom.sources import signals, tables
from kgloom.streaming import ingest, state

from . import derived
from .registry import query

AT = "TIMESTAMP '2024-01-15 00:00:00'"
START = "TIMESTAMP '2024-01-01 00:00:00'"


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Services and their tables' edges as stored tables, all of version 1."""
    s = derived.services(spark, d)
    none, since = F.lit(None).cast("timestamp"), F.expr(START)
    stage = F.when(F.col("is_active"), "ACTIVE").otherwise("DELETED")
    entities = s.select("id", "type", "sub_type", "canonical_name", "namespace", "confidence", "is_active", stage.alias("lifecycle_stage"),
        since.alias("valid_from"), none.alias("valid_to"), F.lit(1).alias("version"), F.to_json(F.struct("owner")).alias("properties"))
    a = derived.accesses(spark, d)
    edge_id = fn.stored_relationship_id(F.col("type"), F.col("from_id"), F.col("to_id"))
    edges = a.select(edge_id.alias("id"), "type", "from_id", "to_id", F.lit(0.9).alias("confidence"), F.lit(True).alias("is_active"),
        since.alias("valid_from"), none.alias("valid_to"), F.lit(1).alias("version"), F.lit("{}").alias("properties"))
    return entities, edges


_ENTITY = "struct<id:string,type:string,sub_type:string,canonical_name:string,namespace:string,confidence:double,lifecycle_stage:string,valid_from:timestamp,properties:string>"
_EDGE = "struct<id:string,type:string,from_id:string,to_id:string,confidence:double,valid_from:timestamp,properties:string>"


def _mutations(spark, d, broken: bool = False) -> DataFrame:
    """A batch over whole tables: every service is changed, repeated or deleted; every customer becomes a team that owns a service, is told of
    twice, and at times gone again."""
    entities, _ = _stored(spark, d)
    c = derived.table(spark, d, "customer")
    n = derived.table(spark, d, "supplier").agg(F.count("*").alias("n"))
    none_e, none_r, since = F.lit(None).cast(_ENTITY), F.lit(None).cast(_EDGE), F.expr(START)
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")

    def row(df, idx, kind, target, entity, edge, expected=None):
        return df.select(idx.cast("long").alias("idx"), kind.alias("kind"), target.alias("target_id"),
            (expected if expected is not None else F.lit(None)).cast("int").alias("expected"), entity.alias("entity"),
            edge.alias("relationship"))

    new = F.struct("id", "type", "sub_type", "canonical_name", "namespace",
        F.when(k % 3 == 0, F.col("confidence") / 2).otherwise(F.col("confidence")).alias("confidence"),
        F.lit(None).cast("string").alias("lifecycle_stage"), "valid_from",
        F.regexp_replace("properties", ":", " : ").alias("properties")).cast(_ENTITY)
    first = row(entities, k, F.when(k % 3 == 2, "SOFT_DELETE_ENTITY").otherwise("UPSERT_ENTITY"), F.col("id"), new, none_r,
        F.when(k % 3 == 0, 1))
    key = F.col("c_custkey")
    team = F.struct(F.concat(F.lit("cust-"), key).alias("id"), F.lit("TEAM").alias("type"), F.lit("").alias("sub_type"),
        F.col("c_name").alias("canonical_name"), F.lit("people").alias("namespace"), F.lit(1.0).alias("confidence"),
        F.lit("ACTIVE").alias("lifecycle_stage"), since.alias("valid_from"), F.lit("{}").alias("properties")).cast(_ENTITY)
    second = row(c, key + 1_000_000_000, F.lit("UPSERT_ENTITY"), F.lit(None).cast("string"), team, none_r)
    owns = c.join(F.broadcast(n)).withColumn("service", F.concat(F.lit("svc-"), key % F.col("n")))
    if broken:
        owns = owns.withColumn("service", F.when(key == 1, "svc-nowhere").otherwise(F.col("service")))
    edge = F.struct(F.concat(F.lit("own-"), key).alias("id"), F.lit("OWNS").alias("type"), F.concat(F.lit("cust-"), key).alias("from_id"),
        F.col("service").alias("to_id"), F.lit(0.9).alias("confidence"), since.alias("valid_from"), F.lit("{}").alias("properties")).cast(
        _EDGE)
    third = row(owns, key + 2_000_000_000, F.lit("UPSERT_RELATIONSHIP"), F.lit(None).cast("string"), none_e, edge)
    fourth = row(owns, key + 3_000_000_000, F.when(F.col("c_acctbal") < 0, "DELETE_RELATIONSHIP").otherwise("UPSERT_RELATIONSHIP"),
        F.concat(F.lit("own-"), key), none_e, edge)
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def _apply(spark, d, broken: bool = False) -> write.Applied:
    entities, edges = _stored(spark, d)
    log = spark.createDataFrame([], write.LOG)
    return write.apply_batch(entities, edges, log, _mutations(spark, d, broken), "txn-1", F.expr(AT))


_RESULTS = """, n AS (SELECT count(*) AS n FROM supplier), m AS (
SELECT s_suppkey::BIGINT AS idx, 'svc-' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN CASE WHEN s_acctbal >= 0 THEN 'DELETED' ELSE 'NO_CHANGE' END WHEN s_suppkey % 3 = 0 OR s_acctbal < 0 THEN 'UPDATED' ELSE 'NO_CHANGE' END AS operation,
  (CASE WHEN s_suppkey % 3 = 2 THEN CASE WHEN s_acctbal >= 0 THEN 2 ELSE 1 END WHEN s_suppkey % 3 = 0 OR s_acctbal < 0 THEN 2 ELSE 1 END)::INTEGER AS version FROM supplier
UNION ALL SELECT c_custkey + 1000000000, 'cust-' || c_custkey, 'CREATED', 1 FROM customer
UNION ALL SELECT c_custkey + 2000000000, 'own-' || c_custkey, 'CREATED', 1 FROM customer
UNION ALL SELECT c_custkey + 3000000000, 'own-' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'DELETED' ELSE 'NO_CHANGE' END, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END FROM customer)"""


@query(_RESULTS + " SELECT idx, id, operation, version FROM m")
def batch_apply(spark, d):
    return _apply(spark, d).results.select("idx", "id", "operation", "version")


@query("SELECT 'FAILED' AS status, 2000000001::BIGINT AS failed_at, 'unknown entity' AS error, (SELECT count(*) FROM supplier) + (SELECT "
    "count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey <= 1) AS shown, (SELECT count(*) FROM supplier) AS entities")
def batch_fails_whole(spark, d):
    a = _apply(spark, d, broken=True)
    shown, kept = a.results.agg(F.count("*").alias("shown")), a.entities.agg(F.count("*").alias("entities"))
    return a.status.join(F.broadcast(shown)).join(F.broadcast(kept))


@query("""SELECT id, type, CASE WHEN id LIKE 'svc-%' AND regexp_extract(id, '[0-9]+$')::BIGINT % 3 = 2 THEN false ELSE true END AS is_active,
CASE WHEN regexp_extract(id, '[0-9]+$')::BIGINT % 3 = 2 AND id LIKE 'svc-%' THEN 'DELETED' ELSE 'ACTIVE' END AS lifecycle_stage FROM (SELECT id, type FROM services UNION ALL SELECT 'cust-' || c_custkey, 'TEAM' FROM customer)""")
def batch_entities(spark, d):
    return _apply(spark, d).entities.select("id", "type", "is_active", "lifecycle_stage")


@query("""SELECT 'own-' || c_custkey AS id, 'svc-' || (c_custkey % (SELECT count(*) FROM supplier)) AS to_id, c_acctbal >= 0 AS is_active, (CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END)::INTEGER AS version FROM customer
UNION ALL SELECT 'rel_' || left(sha256(type || '|' || from_id || '|' || to_id), 24), to_id, true, 1 FROM accesses""")
def relationship_upsert(spark, d):
    return _apply(spark, d).relationships.select("id", "to_id", "is_active", "version")


@query(_RESULTS + """ SELECT row_number() OVER (ORDER BY idx) AS entry_id, CASE WHEN id LIKE 'own-%' THEN CASE operation WHEN 'CREATED' THEN 'RELATIONSHIP_CREATED' ELSE 'RELATIONSHIP_DELETED' END
WHEN operation = 'CREATED' THEN 'ENTITY_CREATED' WHEN operation = 'UPDATED' THEN 'ENTITY_UPDATED' ELSE 'ENTITY_SOFT_DELETED' END AS mutation_type, CASE WHEN id NOT LIKE 'own-%' THEN id END AS entity_id, CASE WHEN id LIKE 'own-%' THEN id END AS relationship_id,
operation <> 'CREATED' AS had_before FROM m WHERE operation <> 'NO_CHANGE'""")
def log_append(spark, d):
    out = _apply(spark, d).log
    return out.select("entry_id", "mutation_type", "entity_id", "relationship_id", F.col("before_state").isNotNull().alias("had_before"))


@query(_RESULTS + ", s AS (SELECT id, CASE WHEN operation IN ('DELETED') THEN false ELSE true END AS is_active, row_number() OVER "
    "(PARTITION BY id ORDER BY idx DESC) AS r FROM m WHERE operation <> 'NO_CHANGE') SELECT CASE WHEN id LIKE 'own-%' THEN 'relationship' "
    "ELSE 'entity' END AS what, id, is_active FROM s WHERE r = 1")
def replay_batch_log(spark, d):
    return snapshot.states(_apply(spark, d).log).select("what", "id", "is_active")


@query("SELECT id, type, is_active FROM services WHERE owner = 'team-3' OR id = 'svc-1'")
def rows_by_id(spark, d):
    s = derived.services(spark, d)
    return tables.rows_by_id(s, s.where("owner = 'team-3' OR id = 'svc-1'").select("id")).select("id", "type", "is_active")


@query("""SELECT 'user-' || user_id AS entity_id, ts AS at, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def metrics_upsert(spark, d):
    m = derived.metrics(spark, d)
    old = m.where("event_id % 2 = 0").groupBy("entity_id", "at").agg(F.max_by("value", "event_id").alias("value"),
        F.max("event_id").alias("event_id"))
    new = m.select("entity_id", "at", "value", "event_id")
    return write.upsert_metrics(old, new, "entity_id", "at", F.expr(AT), "event_id").select("entity_id", "at", "value")


@query("""SELECT 'user-' || user_id AS canonical_id, min(ts) AS first_seen, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS aliases, max(ts) AS last_seen FROM events GROUP BY 1""")
def registry_upsert(spark, d):
    e = derived.table(spark, d, "events").withColumn("canonical_id", F.concat(F.lit("user-"), "user_id"))
    group = lambda df: df.groupBy("canonical_id").agg(F.array_sort(F.collect_set("event_type")).alias("aliases"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    cutoff = F.expr(AT)
    out = write.upsert_registry(group(e.where(F.col("ts") < cutoff)), group(e.where(F.col("ts") >= cutoff)))
    return out.select("canonical_id", "first_seen", F.array_join(F.array_sort("aliases"), ",").alias("aliases"), "last_seen")


_MERGED = """, pairs AS (SELECT 'svc-' || (2 * s_suppkey + 1) AS source, 'svc-' || (2 * s_suppkey) AS target FROM supplier WHERE 2 * s_suppkey + 1 < (SELECT count(*) FROM supplier)),
moved AS (SELECT coalesce(p.target, a.from_id) AS from_id, a.to_id, a.type FROM accesses a LEFT JOIN pairs p ON a.from_id = p.source)"""


def _merge(spark, d):
    entities, edges = _stored(spark, d)
    s = derived.table(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    pairs = s.join(F.broadcast(n)).where("2 * s_suppkey + 1 < n").select(
        F.concat(F.lit("svc-"), 2 * F.col("s_suppkey") + 1).alias("source_id"),
        F.concat(F.lit("svc-"), 2 * F.col("s_suppkey")).alias("target_id"))
    return write.merge_entities(entities, edges, pairs, F.expr(AT))


@query(_MERGED + " SELECT DISTINCT from_id, to_id, type FROM moved")
def merge_entities_edges(spark, d):
    return _merge(spark, d)[1].select("from_id", "to_id", "type")


@query(_MERGED + " SELECT id, is_active AND id NOT IN (SELECT source FROM pairs) AS is_active, (CASE WHEN is_active AND id IN (SELECT "
    "source FROM pairs) THEN 2 ELSE 1 END)::INTEGER AS version FROM services")
def merge_entities_nodes(spark, d):
    return _merge(spark, d)[0].select("id", "is_active", "version")


@query("""SELECT CASE WHEN from_id = 'svc-1' THEN 'ent_' || left(sha256('SERVICE|' || CASE WHEN a.type = 'WRITES_TO' THEN 'two' ELSE 'one' END || '|' || namespace), 24) ELSE from_id END AS from_id, to_id, a.type FROM accesses a JOIN services s ON s.id = a.from_id""")
def split_entity(spark, d):
    entities, edges = _stored(spark, d)
    second = edges.where("type = 'WRITES_TO' AND from_id = 'svc-1'").select("id")
    return write.split_entity(entities, edges, "svc-1", ("one", "two"), second, F.expr(AT))[1].select("from_id", "to_id", "type")


@query("SELECT id, is_active OR owner = 'team-3' AS is_active, CASE WHEN owner = 'team-3' AND NOT is_active THEN 'RESTORED' WHEN owner = "
    "'team-3' THEN 'NO_CHANGE' ELSE 'KEPT' END AS operation, (CASE WHEN owner = 'team-3' AND NOT is_active THEN 2 ELSE 1 END)::INTEGER AS "
    "version FROM services")
def restore_entities(spark, d):
    entities, _ = _stored(spark, d)
    ids = derived.services(spark, d).where("owner = 'team-3'").select("id")
    return write.restore_entities(entities, ids).select("id", "is_active", "operation", "version")


@query("""SELECT from_id, to_id, type, coalesce(s, 0.9::DOUBLE) AS confidence, (CASE WHEN s IS NULL THEN 1 ELSE 2 END)::INTEGER AS version FROM accesses LEFT JOIN (SELECT 'svc-' || l_suppkey AS f, 'tbl-' || l_partkey AS t, arg_max(l_discount, {a: l_shipdate, k: l_orderkey, n: l_linenumber, d: l_discount}) AS s FROM lineitem GROUP BY 1, 2) ON f = from_id AND t = to_id AND type = 'READS_FROM'""")
def strength_update(spark, d):
    _, edges = _stored(spark, d)
    li = derived.table(spark, d, "lineitem")
    from_id, to_id = F.concat(F.lit("svc-"), "l_suppkey"), F.concat(F.lit("tbl-"), "l_partkey")
    strengths = li.select(fn.stored_relationship_id(F.lit("READS_FROM"), from_id, to_id).alias("id"), F.col("l_discount").alias("strength"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_discount").alias("at"))
    return write.update_strength(edges, strengths).select("from_id", "to_id", "type", "confidence", "version")


@query("SELECT user_id, max(ts) AS ts, arg_max(value, {t: ts, e: event_id, v: value}) AS value FROM events GROUP BY 1")
def late_observations(spark, d):
    e = derived.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    newest = e.where("event_id % 2 = 0").groupBy("user_id").agg(
        F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")
    return write.apply_late(newest, e, "user_id", "ts").select("user_id", "ts", "value")


# snapshots and the log


def _full_log(spark, d) -> DataFrame:
    """The derived log with JSON states: entities have a type and a namespace, relationships a type alone."""
    e = derived.table(spark, d, "events")
    edge = F.col("event_type") == "purchase"
    kind = F.when(F.col("event_type") == "signup", "ENTITY_CREATED").when(F.col("event_type") == "error", "ENTITY_SOFT_DELETED").when(edge,
        "RELATIONSHIP_CREATED").otherwise("ENTITY_UPDATED")
    user = F.concat(F.lit("user-"), "user_id")
    state = F.when(edge,
        F.to_json(F.struct(F.when(F.col("value") > 50, "RUNTIME_CALLS").otherwise("CALLS").alias("type"), "value"))).otherwise(
        F.to_json(F.struct(F.lit("SERVICE").alias("type"), F.concat(F.lit("ns-"), F.length(user)).alias("namespace"), "value")))
    return e.select(
        F.col("event_id").alias("entry_id"), F.concat(F.lit("txn-"), F.floor(F.col("event_id") / 10)).alias("transaction_id"), kind.alias("mutation_type"), F.when(~edge, user).alias("entity_id"),
        F.when(edge, F.concat(F.lit("rel-"), "user_id")).alias("relationship_id"), F.lit(None).cast("string").alias("before_state"), state.alias("after_state"), F.col("ts").alias("occurred_at"),
    )


_LAST = """, l AS (SELECT event_id AS entry_id, CASE WHEN event_type = 'purchase' THEN 'relationship' ELSE 'entity' END AS what, CASE WHEN event_type = 'purchase' THEN 'rel-' || user_id ELSE 'user-' || user_id END AS id, event_type <> 'error' AS is_active, value, ts FROM events)"""


def _snapshots(spark, d):
    """Two snapshots in a folder of their own, with their manifests."""
    log, path = cut(_full_log(spark, d)), own_path(spark, "snapshots")
    early, late = F.expr("TIMESTAMP '2024-01-08 00:00:00'"), F.expr("TIMESTAMP '2024-01-12 00:00:00'")
    return log, path, cut(snapshot.create(log, path, "snap_1", early).unionByName(snapshot.create(log, path, "snap_2", late)))


@query(
    _LAST + f" SELECT what, id, arg_max(is_active, entry_id) AS is_active, max(entry_id) AS entry_id, arg_max(value, entry_id) AS value FROM l WHERE ts <= {AT} GROUP BY 1, 2")
def snapshot_restore(spark, d):
    log, path, manifests = _snapshots(spark, d)
    out = snapshot.restore(manifests, path, log, F.expr(AT))
    return out.select("what", "id", "is_active", "entry_id", F.get_json_object("state", "$.value").cast("double").alias("value"))


_MANIFEST = """ SELECT '{n}' AS snapshot_id, TIMESTAMP '{t}' AS snapshot_at, (SELECT max(entry_id) FROM l WHERE ts <= TIMESTAMP '{t}') AS last_entry_id, count_if(what = 'entity') AS node_count, count_if(what = 'relationship') AS edge_count, count_if(what = 'entity' AND active) AS active_services
FROM (SELECT what, id, arg_max(is_active, entry_id) AS active FROM l WHERE ts <= TIMESTAMP '{t}' GROUP BY 1, 2)"""


@query(_LAST + _MANIFEST.format(n="snap_1", t="2024-01-08 00:00:00") + " UNION ALL " + _MANIFEST.format(n="snap_2", t="2024-01-12 00:00:00"))
def snapshot_manifests(spark, d):
    return _snapshots(spark, d)[2].drop("checksum")


@query("""SELECT DISTINCT event_type AS namespace, ts AS at, (SELECT arg_max(s_name, (s_t, s_name)) FROM (SELECT 'day-' || strftime(t, '%d') AS s_name, t AS s_t FROM (SELECT unnest(range(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-28', INTERVAL 5 DAY)) AS t)) WHERE s_t <= ts) AS snapshot_id FROM events""")
def snapshot_nearest(spark, d):
    e = derived.table(spark, d, "events").select(F.col("event_type").alias("namespace"), F.col("ts").alias("at")).distinct()
    days = spark.range(1).select(
        F.explode(F.sequence(F.expr("TIMESTAMP '2024-01-03'"), F.expr("TIMESTAMP '2024-01-27'"), F.expr("INTERVAL 5 DAY"))).alias(
            "snapshot_at"))
    m = e.select("namespace").distinct().join(F.broadcast(days)).select("namespace",
        F.concat(F.lit("day-"), F.date_format("snapshot_at", "dd")).alias("snapshot_id"), "snapshot_at")
    return snapshot.nearest(m, e).select("namespace", "at", "snapshot_id")


@query("SELECT event_id AS entry_id FROM events WHERE length('user-' || user_id) = 7")
def log_in_namespace(spark, d):
    log = _full_log(spark, d)
    edges = derived.table(spark, d, "events").select(F.concat(F.lit("rel-"), "user_id").alias("relationship_id"),
        F.concat(F.lit("ns-"), F.length(F.concat(F.lit("user-"), "user_id"))).alias("namespace")).distinct()
    return snapshot.in_namespace(log, "ns-7", edges).select("entry_id")


@query("SELECT event_id AS entry_id FROM events WHERE event_type <> 'purchase' AND length('user-' || user_id) = 7")
def log_in_namespace_as_stored(spark, d):
    return snapshot.in_namespace(_full_log(spark, d), "ns-7").select("entry_id")


@query("""SELECT count_if(event_type = 'signup') AS entities_created, count_if(event_type IN ('view', 'click')) AS entities_updated, count_if(event_type = 'error') AS entities_deleted, count_if(event_type = 'purchase') AS relationships_created, 0::BIGINT AS relationships_updated, 0::BIGINT AS relationships_deleted, count(*) AS total
FROM events WHERE ts BETWEEN (SELECT ts FROM events WHERE event_id = 100) AND (SELECT max(ts) FROM events)""")
def commit_window_diff(spark, d):
    e = derived.table(spark, d, "events")
    last = e.agg(F.max("ts").alias("committed_at")).select(F.lit("head").alias("ref"), "committed_at")
    commits = e.where("event_id = 100").select(F.lit("base").alias("ref"), F.col("ts").alias("committed_at")).unionByName(last)
    return store.evolution(snapshot.between_commits(_full_log(spark, d), commits, "base", "head"))


@query("SELECT event_id AS entry_id, 'rel-' || user_id AS relationship_id, 'HIGH' AS severity FROM events WHERE event_type = 'purchase' "
    "AND value > 50")
def drift_alerts(spark, d):
    return rules.drift_alerts(_full_log(spark, d))


@query("""SELECT entity_id, entry_id, lag(state) OVER w AS before_state, state AS after_state, (entry_id % 2 = 0 AND lag(state) OVER w IS NOT NULL) OR lag(state) OVER w IS NULL AS consistent FROM change_log WINDOW w AS (PARTITION BY entity_id ORDER BY entry_id)""")
def log_chain(spark, d):
    from pyspark.sql import Window

    log = derived.change_log(spark, d).select("entity_id", "entry_id", F.col("state").alias("after_state"))
    before = F.lag("after_state").over(Window.partitionBy("entity_id").orderBy("entry_id"))
    told = log.withColumn("before_state", F.when(F.col("entry_id") % 2 == 0, before))
    return snapshot.chain(told)


@query("SELECT entry_id FROM change_log WHERE transaction_id = 'txn-7' UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase' "
    "AND user_id = 7")
def log_by_transaction(spark, d):
    log = _full_log(spark, d)
    return store.read_log(log, transaction_id="txn-7").select("entry_id").unionByName(
        store.read_log(log, relationship_id="rel-7").select("entry_id"))


# metrics, spans


@query("SELECT 'user-' || user_id AS entity_id, ts AS at, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP "
    "'2024-01-15 00:00:00'")
def metrics_last_day(spark, d):
    return store.metrics_range(derived.metrics(spark, d), now=F.expr(AT)).select("entity_id", "at", "value")


@query("SELECT s.id, m.at, m.value FROM services s LEFT JOIN (SELECT user_id, max(ts) AS at, arg_max(value, {t: ts, e: event_id}) AS value "
    "FROM events GROUP BY 1) m ON s.id = 'svc-' || user_id")
def entity_with_metrics(spark, d):
    m = derived.metrics(spark, d).withColumn("entity_id", F.regexp_replace("entity_id", "user", "svc"))
    return store.with_latest_metrics(derived.services(spark, d), m).select("id", "metrics_summary.at", "metrics_summary.value")


@query("SELECT 'user-' || user_id AS entity_id, date_trunc('day', ts)::TIMESTAMP AS at, count(*) AS points, round(sum(value), 4) AS total, "
    "max(value) AS largest, min(value) AS smallest FROM events GROUP BY 1, 2")
def metrics_rollup(spark, d):
    return store.rollup(store.rollup(derived.metrics(spark, d), "hour"), "day").withColumn("total", F.round("total", 4).cast(
        "double"))


@query("""SELECT 'user-' || user_id AS entity_id, date_trunc('month', ts)::TIMESTAMP AS at, q AS share, count(*) AS points,
CASE WHEN q = 0.5 THEN quantile_disc(value, 0.5) ELSE quantile_disc(value, 0.99) END AS exact, true AS within FROM events, (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) s(q) GROUP BY 1, 2, 3""")
def metrics_quantiles(spark, d):
    """Sketches rolled up from minutes to months, held against all points."""
    m = derived.metrics(spark, d)
    rolled = m
    for unit in ("minute", "hour", "day", "month"):
        rolled = store.sketch(rolled, unit)
    near = store.sketch_quantiles(rolled, [0.5, 0.99])
    exact = store.exact_quantiles(m, "month", [0.5, 0.99])
    within = F.abs(F.col("estimate") - F.col("exact")) <= 0.0100001 * F.abs("exact")
    return exact.join(near.drop("points"), ["entity_id", "at", "share"]).select("entity_id", "at", "share", "points", "exact", within.alias(
        "within"))


@query("""SELECT entity_id, observed, value, round(avg(value) OVER w, 4) AS recent, round(value - lag(value) OVER (PARTITION BY entity_id ORDER BY observed, event_id), 6) AS change,
coalesce(abs(value - avg(value) OVER w) > 3 * stddev_pop(value) OVER w, false) AND count(value) OVER w >= 5 AS anomaly
FROM (SELECT 'user-' || user_id AS entity_id, ts AS observed, value, event_id FROM events) WINDOW w AS (PARTITION BY entity_id ORDER BY observed, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def metric_moving_average(spark, d):
    return store.moving(derived.metrics(spark, d)).withColumnRenamed("at", "observed")


@query("""SELECT p.service_name AS caller, c.service_name AS callee, time_bucket(INTERVAL '5 minutes', c.ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS window_start, count(*) AS calls, quantile_disc(c.value, 0.5) AS p50, quantile_disc(c.value, 0.99) AS p99, round(avg((c.value > 90)::INTEGER), 6) AS error_rate
FROM spans c JOIN spans p ON c.parent_span_id = p.span_id WHERE p.service_name <> c.service_name GROUP BY 1, 2, 3""")
def edge_window_stats(spark, d):
    return store.edge_stats(derived.spans(spark, d).withColumn("is_error", F.col("value") > 90))


@query("""SELECT trace_id, span_id, service_name, 1.0::DOUBLE / rate AS weight FROM (SELECT s.*, CASE WHEN service_name = 'error' OR value > 90 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 100.0::DOUBLE / n) END AS rate
FROM spans s LEFT JOIN (SELECT service_name, count(*) AS n FROM spans WHERE NOT (service_name = 'error' OR value > 90) GROUP BY 1) USING (service_name)) WHERE ('0x' || left(md5(trace_id::VARCHAR), 6))::BIGINT < rate * 16777216""")
def span_sampling(spark, d):
    s = derived.spans(spark, d).withColumn("name", F.col("service_name"))
    counts = s.where("NOT (name = 'error' OR value > 90)").groupBy("service_name").agg(F.count("*").alias("n"))
    return ingest.sample_spans(s, 90.0, 100.0, counts).select("trace_id", "span_id", "service_name", "weight")


# listings, search documents


@query("SELECT id, canonical_name FROM services WHERE is_active AND namespace = 'asia'")
def namespace_listing(spark, d):
    return store.listing(derived.services(spark, d), "asia").select("id", "canonical_name")


@query("SELECT id AS entity_id, owner AS owner_team, 'a b' AS aliases, namespace FROM services")
def search_documents(spark, d):
    p = F.to_json(F.struct("owner", F.array(F.lit("a"), F.lit("b")).alias("aliases")))
    return store.search_documents(derived.services(spark, d).withColumn("properties", p)).select("entity_id", "owner_team", "aliases",
        "namespace")


@query("SELECT id FROM services WHERE owner = 'team-3' AND is_active")
def search_entities(spark, d):
    s = derived.services(spark, d).withColumn("properties", F.to_json(F.struct("owner")))
    return store.search_entities(s, owner_team="team-3", is_active=True).select("id")


# the whole way from records to the store


def _observed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Services (every tenth of an unknown type) and tables with their properties, calls and accesses, as observed."""
    s = derived.services(spark, d)
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    origin = {"source_type": F.lit("git"), "source_id": F.lit("src"), "observed_at": F.expr(AT), "ingestion_run_id": F.lit("run-1")}
    owner = F.when(k % 3 == 0, F.col("owner"))
    author = F.when(k % 3 == 1, F.lit("someone"))
    given = F.struct(owner.alias("owner"), author.alias("author"), (k % 15).alias("commit_count"), (k % 2 == 0).alias("has_tests"), (k % 4
        == 0).alias("has_api_spec"), (k % 5 == 0).alias("has_documentation"), F.lit(True).alias("has_monitoring"))
    services = s.select("id", F.when(k % 10 == 9, "NOPE").otherwise("SERVICE").alias("type"), F.concat(F.lit("Own"), "canonical_name").alias(
        "name"), "namespace", F.to_json(given).alias("properties"), "confidence", k.alias("ordinal"))
    t = derived.tables(spark, d)
    tables = t.select("id", "type", F.concat_ws(" ", "canonical_name", "id").alias("name"), "namespace", F.lit("{}").alias("properties"),
        "confidence", (F.lit(1 << 40) + F.xxhash64("id") % (1 << 39)).alias("ordinal"))
    more = {"sub_type": F.lit(""), "raw_name": F.lit(""), "is_partial": F.lit(False)} | origin
    c = derived.calls(spark, d).select("from_id", "to_id", "type", "confidence").unionByName(derived.accesses(spark, d).withColumn("confidence",
        F.lit(0.9)))
    edges = c.select(F.concat_ws(">", "from_id", "type", "to_id").alias("id"), "type", "from_id", "to_id", F.lit("{}").alias("properties"),
        "confidence", F.lit(False).alias("is_inferred"), F.xxhash64("from_id", "to_id", "type").alias("ordinal")).withColumns(origin)
    return services.unionByName(tables).withColumns(more), edges


def _ingested(spark, d) -> pipeline.Ingested:
    entities, edges = _observed(spark, d)
    registry = spark.createDataFrame([], "canonical_id string, type string, name string, namespace string, aliases array<string>")
    none = spark.createDataFrame([], "id string, type string, sub_type string, name string, namespace string, confidence double, "
        "properties string")
    no_edges = spark.createDataFrame([], "id string, type string, from_id string, to_id string, confidence double, properties string")
    return pipeline.ingest(entities, edges, registry, none, no_edges)


_BAD = "regexp_extract(id, '[0-9]+$')::BIGINT % 10 = 9"
_FLOW = f""", good AS (SELECT id FROM services WHERE NOT ({_BAD}) UNION ALL SELECT id FROM tables_),
seen AS (SELECT from_id, to_id, type, confidence FROM calls WHERE from_id <> to_id UNION ALL SELECT from_id, to_id, type, 0.9 FROM accesses),
every AS (SELECT *, false AS is_inferred, 1 AS n FROM seen UNION ALL SELECT from_id, to_id, 'DEPENDS_ON', round(confidence * 0.9, 6), true, 1 FROM seen WHERE type = 'IMPORTS'
UNION ALL SELECT r.from_id, w.from_id, 'CHANGE_COUPLED_WITH', 0.85, true, count(*) FROM accesses r JOIN accesses w ON r.to_id = w.to_id AND r.type = 'READS_FROM' AND w.type = 'WRITES_TO' AND r.from_id <> w.from_id GROUP BY 1, 2),
merged AS (SELECT from_id, to_id, type, max(confidence)::DOUBLE AS confidence, bool_and(is_inferred) AS is_inferred, sum(n)::BIGINT AS corroboration_count FROM every GROUP BY 1, 2, 3),
stored AS (SELECT * FROM merged WHERE from_id IN (SELECT id FROM good) AND to_id IN (SELECT id FROM good))"""


@query(_FLOW + " SELECT 'entity' AS kind, 'CREATE' AS op, count(*) AS n, 0 AS first FROM good UNION ALL SELECT 'relationship', 'CREATE', count(*), "
    "(SELECT count(*) FROM good) FROM stored")
def ingest_pipeline(spark, d):
    return _ingested(spark, d).mutations.groupBy("kind", "op").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


@query(f"SELECT 'entity' AS kind, id, 'type' AS error_field FROM services WHERE {_BAD} UNION ALL SELECT 'relationship', from_id || '>' || type || '>' || to_id, 'to_id' FROM calls WHERE from_id = to_id")
def ingest_rejects(spark, d):
    return _ingested(spark, d).rejected


@query(_FLOW + " SELECT from_id, to_id, type, confidence, is_inferred, corroboration_count FROM stored")
def ingest_edges(spark, d):
    return _ingested(spark, d).relationships.select("from_id", "to_id", "type", "confidence", "is_inferred", "corroboration_count")


@query(_FLOW + """, k AS (SELECT id, owner, regexp_extract(id, '[0-9]+$')::BIGINT AS k, (SELECT count(*) FROM merged m WHERE m.to_id = s.id AND m.type IN ('CALLS', 'DEPENDS_ON')) AS n
FROM services s WHERE id IN (SELECT id FROM good)),
m AS (SELECT *, (0.2 + 0.15 * (k % 3 <> 2)::INT + 0.15 * (k % 2 = 0)::INT + 0.2 * (k % 4 = 0)::INT + 0.15 * (k % 5 = 0)::INT)::DOUBLE AS mature FROM k)
SELECT id, CASE k % 3 WHEN 0 THEN owner WHEN 1 THEN 'someone' END AS team, CASE k % 3 WHEN 0 THEN 'declared' WHEN 1 THEN 'git_history' END AS source,
CASE WHEN k % 15 > 10 THEN 'HOT' WHEN k % 15 >= 2 THEN 'ACTIVE' ELSE 'STABLE' END AS velocity,
CASE WHEN n >= 7 THEN 'CRITICAL' WHEN n >= 5 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS criticality, round(least(1.0, 0.2 + 0.1 * n), 6)::DOUBLE AS criticality_score,
CASE WHEN mature > 0.8 THEN 'MATURE' WHEN mature > 0.5 THEN 'DEVELOPING' ELSE 'NASCENT' END AS maturity, round(mature, 6) AS maturity_score, 'git' AS source_type FROM m""")
def ingest_properties(spark, d):
    p = lambda path: F.get_json_object("properties", f"$.{path}")
    found = _ingested(spark, d).entities.where("type = 'SERVICE'")
    return found.select("id", p("primary_owner.team_name").alias("team"), p("primary_owner.source").alias("source"), p("velocity").alias("velocity"),
        p("criticality").alias("criticality"), p("criticality_score").cast("double").alias("criticality_score"), p("maturity").alias("maturity"),
        p("maturity_score").cast("double").alias("maturity_score"), p("source_type").alias("source_type"))


@query(f", k AS (SELECT id, regexp_extract(id, '[0-9]+$')::BIGINT AS k FROM services WHERE NOT ({_BAD})) SELECT 'entity' AS kind, id, 'UPDATE' AS op FROM k WHERE k % 30 = 0")
def ingest_again(spark, d):
    """A second run over the same records, in which some declared owners have changed: only these make mutations."""
    first = _ingested(spark, d)
    entities, edges = _observed(spark, d)
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    moved = F.regexp_replace("properties", '"owner":"[^"]*"', '"owner":"another"')
    entities = entities.withColumn("properties", F.when((F.col("type") == "SERVICE") & (k % 30 == 0), moved).otherwise(F.col("properties")))
    entities = entities.withColumn("ingestion_run_id", F.lit("run-2"))
    again = pipeline.ingest(entities, edges, first.registry, first.entities, first.relationships)
    return again.mutations.select("kind", "id", "op")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS op FROM customer")
def json_equality(spark, d):
    c = derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    n = F.col("c_nationkey")
    old = c.select("id",
        F.to_json(
            F.struct(n.alias("n"), F.struct(F.col("c_mktsegment").alias("b"), F.lit(1).alias("a")).alias("deep"),
                F.lit("run-1").alias("ingestion_run_id"))).alias("properties"))
    new = c.select("id",
        F.concat(F.lit('{"ingestion_run_id": "run-2", "deep": {"a": 1.0, "b": "'), "c_mktsegment", F.lit('"}, "n": '),
            F.when(F.col("id") % 3 == 0, n + 1).otherwise(n), F.lit("}")).alias("properties"))
    return pipeline.changes(new, old, "id", ["properties"]).select("id", "op")


@query("SELECT c_custkey AS id, c_custkey % 7 <> 0 AS kept FROM customer WHERE c_custkey % 7 <> 0")
def validate_pipeline_entities(spark, d):
    c = derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.lit("n").alias("namespace"),
        F.lit("TEAM").alias("type"))
    return pipeline.valid_entities(c).select("id", F.lit(True).alias("kept"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'type' WHEN s_suppkey % 4 = 1 THEN 'to_id' WHEN s_suppkey % 4 = 2 THEN "
    "'confidence' END AS error_field FROM supplier")
def validate_stored_relationships(spark, d):
    n = F.col("s_suppkey") % 4
    since = F.expr(START)
    rows = derived.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(n == 0, "NOPE").otherwise("CALLS").alias("type"),
        F.lit("a").alias("from_id"), F.when(n == 1, "a").otherwise("b").alias("to_id"),
        F.when(n == 2, 1.5).otherwise(0.5).alias("confidence"), since.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit("{}").alias("properties"))
    return records.stored_relationship_errors(rows).select("id", "error_field")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'DATABASE_SCHEMA' ELSE 'SERVICE' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN '{"is_partial":"true","name":1,"raw_name":"R","source_id":"mine"}' ELSE '{"name":1,"source_id":"mine"}' END AS properties FROM supplier""")
def storage_form(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    rows = derived.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"),
        F.when(even, "SCHEMA").otherwise("SERVICE").alias("type"), F.lit("n").alias("name"),
        F.when(even, "R").otherwise("n").alias("raw_name"), F.lit("src").alias("source_id"),
        F.lit('{"name": 1, "source_id": "mine"}').alias("properties"), even.alias("is_partial"))
    return pipeline.with_provenance(rows, "is_partial").select("id", "type", "properties")


# files and streams made from the tables


@query("SELECT id, type, canonical_name, namespace FROM services")
def records_round_trip(spark, d):
    path = own_path(spark, "records")
    s = derived.services(spark, d).select("id", "type", "canonical_name", "namespace")
    tables.write_records(s, derived.calls(spark, d).select("from_id", "to_id", "type"), path)
    return tables.read_records(spark, path, "entity", "id string, type string, canonical_name string, namespace string")


@query("SELECT DISTINCT p.service_name AS caller, c.service_name AS callee FROM spans c JOIN spans p ON c.parent_span_id = p.span_id WHERE "
    "p.service_name <> c.service_name")
def spans_from_files(spark, d):
    path = own_path(spark, "spans")
    derived.spans(spark, d).select(F.col("trace_id").cast("string"), F.col("span_id").cast("string"), F.col("parent_span_id").cast("string"),
        "service_name", F.col("service_name").alias("name")).write.json(path)
    lines = spark.read.schema("trace_id string, span_id string, parent_span_id string, service_name string, name string").json(path)
    return store.span_calls(lines)


@query("SELECT event_id::VARCHAR AS run_id, ts AS completed_at FROM events ORDER BY ts DESC, event_id::VARCHAR LIMIT 100")
def ledger_tail(spark, d):
    path = own_path(spark, "ledger")
    e = derived.table(spark, d, "events")
    tables.append_ledger(
        e.select(F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("completed_at"), F.lit("success").alias("status")),
        path)
    return tables.ledger_tail(spark, path, "run_id string, completed_at timestamp, status string").select("run_id", "completed_at")


_PATHS = "SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages"


@query(f""", p AS ({_PATHS}), tops AS (SELECT DISTINCT split_part(path, '/', 1) AS name FROM p),
ids AS (SELECT 'ent_' || left(sha256('git' || chr(31) || 'web' || chr(31) || 'MODULE' || chr(31) || name || chr(31) || 'ns'), 32) AS id, 'project' AS sub_type, name, 0.99::DOUBLE AS confidence FROM tops
UNION ALL SELECT 'ent_' || left(sha256('git' || chr(31) || 'web' || chr(31) || 'MODULE' || chr(31) || path || chr(31) || 'ns'), 32), 'file', path, 0.95::DOUBLE FROM p) SELECT * FROM ids""")
def git_entities(spark, d):
    paths = derived.table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    projects = paths.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project")).distinct().withColumn("name", F.col("project"))
    return tables.file_modules(paths, projects, "web", "ns", "run", "sha", "repo")[0].select("id", "sub_type", "name", "confidence")


@query(f""", p AS ({_PATHS}), e AS (SELECT 'ent_' || left(sha256('git' || chr(31) || 'web' || chr(31) || 'MODULE' || chr(31) || path || chr(31) || 'ns'), 32) AS from_id,
'ent_' || left(sha256('git' || chr(31) || 'web' || chr(31) || 'MODULE' || chr(31) || split_part(path, '/', 1) || chr(31) || 'ns'), 32) AS to_id FROM p) SELECT 'rel_' || left(sha256('DEPENDS_ON' || chr(31) || from_id || chr(31) || to_id || chr(31) || 'git'), 32) AS id, from_id, to_id, 0.95::DOUBLE AS confidence FROM e WHERE from_id <> to_id""")
def git_edges(spark, d):
    paths = derived.table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    projects = paths.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project")).distinct().withColumn("name", F.col("project"))
    return tables.file_modules(paths, projects, "web", "ns", "run", "sha", "repo")[1].select("id", "from_id", "to_id", "confidence")


def _stream(spark, df: DataFrame, schema: str):
    """df as JSON files, four of them or one for each 250,000 rows, and a stream of them in two batches."""
    path = own_path(spark, "arriving")
    files = max(4, -(-df.count() // PART_ROWS))
    df.repartition(files).write.options(**tables.MICROS).json(path)
    return ingest.read_json(spark, path, schema, files_per_batch=-(-files // 2))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'name' WHEN c_acctbal < 0 THEN 'confidence' END AS error_field FROM "
    "customer")
def stream_ingest(spark, d):
    c = derived.table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("TEAM").alias("type"), F.lit("").alias("sub_type"),
        F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.lit("").alias("raw_name"),
        F.lit("ns").alias("namespace"), F.lit("git").alias("source_type"), F.lit("s").alias("source_id"), F.expr(AT).alias("observed_at"),
        F.lit("{}").alias("properties"), (F.col("c_acctbal") / 20000).alias("confidence"), F.lit("run").alias("ingestion_run_id"))
    good, dead, mark = (own_path(spark, x) for x in ("good", "dead", "mark"))
    ingest.ingest(_stream(spark, rows, ingest.OBSERVED_ENTITY), good, dead, mark).awaitTermination()
    schema = rows.schema
    kept = spark.read.schema(schema).parquet(f"{good}/*").select(F.col("id").cast("long").alias("id"),
        F.lit(None).cast("string").alias("error_field"))
    lost = spark.read.schema(schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", error_field string").parquet(f"{dead}/*")
    return kept.unionByName(lost.select(F.col("id").cast("long").alias("id"), "error_field"))


@query("SELECT 'user-' || user_id AS key, max(ts) AS ts, arg_max(value, {t: ts, v: value, e: event_id}) AS value FROM events GROUP BY 1")
def stream_late_rows(spark, d):
    e = derived.table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("key"), "ts", "value", "event_id")
    path, mark = own_path(spark, "newest"), own_path(spark, "mark")
    state.newest_rows(_stream(spark, e, "key string, ts timestamp, value double, event_id long"), path, mark, "key", "ts").awaitTermination()
    return state.current(spark, path, "key").select("key", "ts", "value")


@query("SELECT 'user-' || user_id AS canonical_id, min(ts) AS first_seen, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS "
    "aliases FROM events GROUP BY 1")
def stream_registry(spark, d):
    e = derived.table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("canonical_id"), F.lit("TEAM").alias("type"),
        F.array("event_type").alias("aliases"), F.col("ts").alias("seen"))
    path, mark = own_path(spark, "identities"), own_path(spark, "mark")
    state.identities(_stream(spark, e, "canonical_id string, type string, aliases array<string>, seen timestamp"), path, mark).awaitTermination()
    return state.current(spark, path, "canonical_id").select("canonical_id", "first_seen", F.replace("aliases", F.lit("\n"), F.lit(",")).alias(
        "aliases"))


@query("SELECT service_name, count_if(value > 90 OR service_name = 'error')::BIGINT AS urgent, count_if(value > 90 OR service_name = 'error')::BIGINT AS kept FROM spans GROUP BY 1")
def stream_sampling(spark, d):
    """Of each service the failed and slow spans, and how many of them the sample has kept; the others are drawn."""
    s = derived.spans(spark, d).select("trace_id", "span_id", "service_name", F.col("service_name").alias("name"), "value")
    path, mark = own_path(spark, "sample"), own_path(spark, "mark")
    state.adaptive_sample(_stream(spark, s, "trace_id long, span_id long, service_name string, name string, value double"), path, mark, 90.0,
        100).awaitTermination()
    urgent = F.count_if((F.col("value") > 90) | (F.col("name") == "error"))
    kept = spark.read.parquet(path).groupBy("service_name").agg(urgent.alias("kept"))
    return s.groupBy("service_name").agg(urgent.alias("urgent")).join(kept, "service_name", "left")


@query("SELECT service_name, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS window_start, count(*) AS calls, "
    "max(value) AS largest FROM spans GROUP BY 1, 2")
def stream_span_windows(spark, d):
    s = derived.spans(spark, d).select("service_name", "ts", "value")
    out, mark = own_path(spark, "windows"), own_path(spark, "mark")
    windows = ingest.span_windows(_stream(spark, s, "service_name string, ts timestamp, value double"), late="1000 days")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    windows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start(
        ).awaitTermination()
    return spark.read.parquet(f"{out}/1").select("service_name", "window_start", "calls", "largest")


# signals from outside


@query("SELECT user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, event_type AS service_name, ts, round(value, 3) AS value, event_type = 'error' AS is_error FROM events")
def otlp_spans(spark, d):
    e = derived.table(spark, d, "events")
    nanos = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") * 1000
    took = (F.round("value", 3) * 1_000_000).cast("decimal(20,0)")
    attributes = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value")))
    span = F.struct(
        F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("").alias("parentSpanId"),
        F.lit("op").alias("name"), nanos.cast("decimal(20,0)").cast("string").alias("startTimeUnixNano"),
        (nanos + took).cast("decimal(20,0)").cast("string").alias("endTimeUnixNano"),
        F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"),
    )
    scopes = F.array(F.struct(F.array(span).alias("spans")))
    text = F.to_json(F.struct(F.array(F.struct(F.struct(attributes.alias("attributes")).alias("resource"), scopes.alias("scopeSpans"))).alias("resourceSpans")))
    out = signals.otlp_spans(e.select(text.alias("value")))
    return out.select("trace_id", "span_id", "service_name", "ts", F.round("value", 3).alias("value"), "is_error")


@query("""SELECT 'DEPLOYED_IN' AS type, 'ent_' || left(sha256('SERVICE|svc-' || (o_orderkey % 10) || '|prod'), 24) AS from_id, 'ent_' || left(sha256('DEPLOYMENT_EVENT|d-' || o_orderkey || '|prod'), 24) AS to_id FROM orders WHERE o_orderstatus = 'F'""")
def deployment_edges(spark, d):
    o = derived.table(spark, d, "orders")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    text = F.to_json(F.struct(F.concat(F.lit("d-"), "o_orderkey").alias("id"), F.concat(F.lit("Svc_"), F.col("o_orderkey") % 10).alias("service"), F.lit("eu").alias("environment"), F.lit("1").alias("version"), F.lit("ok").alias("status"), done.alias("finished_at")))
    return signals.deployments(o.select(text.alias("value")), "prod")[1]


@query("""SELECT DISTINCT 'FAILURE_CORRELATED_WITH' AS type, 'ent_' || left(sha256('SERVICE|' || least(a, b) || '|prod'), 24) AS from_id, 'ent_' || left(sha256('SERVICE|' || greatest(a, b) || '|prod'), 24) AS to_id
FROM (SELECT 'n-' || s_nationkey AS a, 's-' || s_suppkey AS b FROM supplier)""")
def incident_edges(spark, d):
    s = derived.table(spark, d, "supplier")
    named = F.array(F.concat(F.lit("s-"), "s_suppkey"), F.concat(F.lit("N_"), "s_nationkey"), F.concat(F.lit("s-"), "s_suppkey"))
    text = F.to_json(F.struct(F.concat(F.lit("i-"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("high").alias("severity"), named.alias("services")))
    return signals.incidents(s.select(text.alias("value")), "prod")[1]


@query("""SELECT 'DEPENDS_ON' AS type, 'ent_' || left(sha256('INFRASTRUCTURE_RESOURCE|net.' || n_nationkey || '|prod'), 24) AS from_id, 'ent_' || left(sha256('INFRASTRUCTURE_RESOURCE|net.' || n_regionkey || '|prod'), 24) AS to_id FROM nation""")
def infrastructure_edges(spark, d):
    n = derived.table(spark, d, "nation")
    text = F.to_json(F.struct(F.concat(F.lit("net."), "n_nationkey").alias("address"), F.lit("network").alias("type"), F.array(F.concat(F.lit("net."), "n_regionkey"), F.lit("net.unknown")).alias("depends_on")))
    return signals.resources(n.select(text.alias("value")), "prod")[1]
