"""Registered queries of the record and store operators over the derived graph, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.operators import catalogs, graph, records, store

from . import catalog_graph, catalog_links, catalog_rules, catalog_store, derived, question
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_graph", "catalog_links", "catalog_rules", "catalog_store"]
AT = "TIMESTAMP '2024-01-15 00:00:00'"


# names and ids


@query("SELECT id, 'ent_' || left(sha256('derived' || chr(31) || id || chr(31) || type || chr(31) || canonical_name || chr(31) || "
    "namespace), 32) AS observed_id, 'ent_' || left(sha256(type || '|' || canonical_name || '|' || namespace), 24) AS stored_id FROM "
    "services")
def entity_ids(spark, d):
    s = derived.services(spark, d)
    return s.select("id",
        fn.observed_entity_id(F.lit("derived"), F.col("id"), F.col("type"), F.col("canonical_name"), F.col("namespace")).alias("observed_id"),
        fn.stored_entity_id(F.col("type"), F.col("canonical_name"), F.col("namespace")).alias("stored_id"))


@query("SELECT from_id, to_id, type, 'rel_' || left(sha256(type || chr(31) || from_id || chr(31) || to_id || chr(31) || 'runtime'), 32) AS "
    "observed_id, 'rel_' || left(sha256(type || '|' || from_id || '|' || to_id), 24) AS stored_id, 'rel_' || left(sha256(type || '|' || "
    "from_id || '|' || to_id || '|inferred'), 24) AS pipeline_id FROM calls")
def relationship_ids(spark, d):
    c, k = derived.calls(spark, d), (F.col("type"), F.col("from_id"), F.col("to_id"))
    return c.select("from_id", "to_id", "type", fn.observed_relationship_id(*k, F.lit("runtime")).alias("observed_id"),
        fn.stored_relationship_id(*k).alias("stored_id"), fn.pipeline_relationship_id(*k, F.lit("")).alias("pipeline_id"))


@query("SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(translate(p_brand || 'Name_' || p_name, '_ ', '--'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '-+', '-', 'g'), '-') AS name FROM part")
def normalize_names(spark, d):
    return derived.table(spark, d, "part").select("p_partkey", fn.normalize_name(F.concat("p_brand", F.lit("Name_"), "p_name")).alias("name"))


@query("SELECT p_partkey AS id, CASE WHEN p_name LIKE '%widget' OR p_name LIKE '%gateway%' OR p_size > 40 THEN 'BFF' ELSE 'MICROSERVICE' "
    "END AS sub_type FROM part")
def classify_subtype(spark, d):
    p = derived.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("SERVICE").alias("type"), F.lit("").alias("sub_type"),
        F.regexp_replace("p_name", "widget$", "x-bff").alias("canonical_name"),
        F.to_json(F.struct((F.col("p_size") > 40).alias("exposed_to_internet"))).alias("properties"))
    return records.classify_sub_type(p).select("id", "sub_type")


# validation


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'type' WHEN c_custkey % 7 = 0 THEN 'name' WHEN c_acctbal < 0 "
    "THEN 'confidence' WHEN c_nationkey = 3 THEN 'source_id' END AS error_field FROM customer")
def validate_entities(spark, d):
    c = derived.table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "NOPE").otherwise("SERVICE").alias("type"),
        F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.lit("ns").alias("namespace"),
        (F.col("c_acctbal") / 20000).alias("confidence"), F.lit("git").alias("source_type"),
        F.when(F.col("c_nationkey") != 3, "s").alias("source_id"), F.current_timestamp().alias("observed_at"),
        F.lit("run").alias("ingestion_run_id"))
    return records.observed_entity_errors(rows.withColumn("id", F.col("id").cast("string"))).select(F.col("id").cast("long").alias("id"),
        "error_field")


@query("SELECT from_id, to_id, type, CASE WHEN from_id = to_id THEN 'to_id' WHEN confidence > 0.95 THEN 'confidence' END AS error_field "
    "FROM calls")
def validate_relationships(spark, d):
    c = derived.calls(spark, d).withColumns(
        {"id": F.lit("r"), "confidence": F.col("confidence") + 0.05, "source_type": F.lit("ast"), "observed_at": F.current_timestamp(),
            "ingestion_run_id": F.lit("run")})
    return records.observed_relationship_errors(c).select("from_id", "to_id", "type", "error_field")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'type' WHEN s_acctbal < 0 THEN 'confidence' WHEN s_suppkey % 5 = 1 THEN "
    "'valid_to' END AS error_field FROM supplier")
def validate_stored(spark, d):
    s, t = derived.table(spark, d, "supplier"), F.lit("2024-01-01").cast("timestamp")
    rows = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "NOPE").otherwise("SERVICE").alias("type"),
        F.col("s_name").alias("canonical_name"), F.lit("ns").alias("namespace"), (F.col("s_acctbal") / 20000).alias("confidence"),
        t.alias("valid_from"), F.when(F.col("s_suppkey") % 5 == 1, t - F.expr("INTERVAL 1 DAY")).alias("valid_to"),
        F.lit("{}").alias("properties"))
    return records.stored_entity_errors(rows).select("id", "error_field")


@query("SELECT a.from_id, a.to_id, a.type FROM (SELECT from_id, to_id, type FROM calls UNION ALL SELECT owner, id, 'OWNS' FROM services "
    "UNION ALL SELECT id, id, 'CALLS' FROM services UNION ALL SELECT id, 'nowhere', 'CALLS' FROM services) a WHERE a.from_id <> a.to_id "
    "AND a.to_id <> 'nowhere'")
def validate_pipeline_relationships(spark, d):
    s, c = derived.services(spark, d), derived.calls(spark, d)
    edges = c.select("from_id", "to_id", "type").unionByName(
        s.select(F.col("owner").alias("from_id"), F.col("id").alias("to_id"), F.lit("OWNS").alias("type"))).unionByName(
        s.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("CALLS").alias("type"))).unionByName(
        s.select(F.col("id").alias("from_id"), F.lit("nowhere").alias("to_id"), F.lit("CALLS").alias("type")))
    ents = s.select("id", "type").unionByName(s.select(F.col("owner").alias("id"), F.lit("TEAM").alias("type")).distinct())
    return records.pipeline_relationships(edges, ents).select("from_id", "to_id", "type")


# resolution, inference, merging


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'id' WHEN s.s_suppkey IS NOT NULL THEN 'name' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'alias' ELSE 'new' END AS matched_by,
CASE WHEN c_custkey % 3 = 0 THEN 'cust-' || c_custkey WHEN s.s_suppkey IS NOT NULL THEN 'svc-' || s.s_suppkey WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'seg-' || c_mktsegment ELSE 'cust-' || c_custkey END AS canonical_id
FROM customer LEFT JOIN supplier s ON c_custkey = s.s_suppkey AND c_custkey % 2 = 1""")
def entity_resolution(spark, d):
    c, s = derived.table(spark, d, "customer"), derived.table(spark, d, "supplier")
    named = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("n-"), "c_custkey")).otherwise(F.col("c_mktsegment"))
    observed = c.select(F.concat(F.lit("cust-"), "c_custkey").alias("id"), F.lit("SERVICE").alias("type"), named.alias("name"),
        F.col("c_mktsegment").alias("raw_name"), F.lit("x").alias("namespace"), "c_custkey")
    empty = F.array().cast("array<string>")
    registry = s.select(F.concat(F.lit("svc-"), "s_suppkey").alias("canonical_id"), F.lit("SERVICE").alias("type"),
        F.concat(F.lit("n-"), "s_suppkey").alias("name"), F.lit("x").alias("namespace"), empty.alias("aliases"))
    registry = registry.unionByName(
        c.where("c_custkey % 3 = 0").select(F.concat(F.lit("cust-"), "c_custkey").alias("canonical_id"), F.lit("SERVICE").alias("type"),
            F.concat(F.lit("own-"), "c_custkey").alias("name"), F.lit("x").alias("namespace"), empty.alias("aliases")))
    registry = registry.unionByName(
        c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_mktsegment").distinct().select(
            F.concat(F.lit("seg-"), "c_mktsegment").alias("canonical_id"), F.lit("SERVICE").alias("type"),
            F.concat(F.lit("s-"), "c_mktsegment").alias("name"), F.lit("x").alias("namespace"), F.array("c_mktsegment").alias("aliases")))
    out = records.resolve(observed, registry)
    return out.select(F.col("c_custkey").alias("id"),
        F.when(F.col("matched_by") == "raw_alias", "alias").otherwise(F.col("matched_by")).alias("matched_by"), "canonical_id")


@query("SELECT coalesce(a.owner, c.from_id) AS from_id, coalesce(b.owner, c.to_id) AS to_id, c.type FROM calls c LEFT JOIN services a ON "
    "c.from_id = a.id LEFT JOIN services b ON c.to_id = b.id")
def endpoint_remap(spark, d):
    return records.remap_endpoints(derived.calls(spark, d), derived.services(spark, d).select("id", "owner")).select("from_id", "to_id",
        "type")


@query("SELECT from_id, to_id, 'DEPENDS_ON' AS type, round(confidence * 0.9, 6) AS confidence FROM calls WHERE type = 'IMPORTS'")
def infer_imports(spark, d):
    return records.infer_from_imports(derived.calls(spark, d)).select("from_id", "to_id", "type", "confidence")


@query("SELECT r.from_id, w.from_id AS to_id, count(*) AS shared FROM accesses r JOIN accesses w ON r.to_id = w.to_id AND r.type = "
    "'READS_FROM' AND w.type = 'WRITES_TO' AND r.from_id <> w.from_id GROUP BY 1, 2")
def infer_shared_resource(spark, d):
    return records.infer_shared_resources(derived.accesses(spark, d)).select("from_id", "to_id", "shared")


@query("""SELECT 'svc-' || l_suppkey AS from_id, 'tbl-' || l_partkey AS to_id, l_returnflag AS type, max(l_discount) AS confidence, count(*) AS corroboration_count, bool_and(l_linestatus = 'O') AS is_inferred FROM lineitem GROUP BY 1, 2, 3""")
def dedup_relationships(spark, d):
    rows = derived.table(spark, d, "lineitem").select(F.concat(F.lit("svc-"), "l_suppkey").alias("from_id"),
        F.concat(F.lit("tbl-"), "l_partkey").alias("to_id"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"),
        F.lit("{}").alias("properties"), F.col("l_linestatus").alias("source_type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), (F.col("l_linestatus") == "O").alias("is_inferred"))
    return records.merge_relationships(rows).select("from_id", "to_id", "type", "confidence", "corroboration_count", "is_inferred")


@query("""SELECT 'cust-' || o_custkey AS id, arg_max(o_orderpriority, {c: o_totalprice, o: -o_orderkey}) AS canonical_name, max(o_totalprice) AS confidence, arg_max(o_orderstatus, o_orderkey) AS last_status, count(DISTINCT o_orderpriority) AS keys
FROM orders GROUP BY 1""")
def dedup_entities(spark, d):
    rows = derived.table(spark, d, "orders").select(F.concat(F.lit("cust-"), "o_custkey").alias("id"), F.lit("X").alias("type"),
        F.col("o_orderpriority").alias("canonical_name"), F.lit("n").alias("namespace"), F.col("o_totalprice").alias("confidence"),
        F.col("o_orderkey").alias("ordinal"),
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("1")).alias("properties"))
    return records.merge_entities(rows).select("id", "canonical_name", "confidence",
        F.element_at("properties", "status").alias("last_status"), (F.size("properties") - 1).cast("long").alias("keys"))


# enrichment


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'team-' || c_nationkey WHEN c_nationkey % 3 = 1 THEN c_name END AS "
    "owner, CASE WHEN c_nationkey % 3 = 0 THEN 0.95::DOUBLE WHEN c_nationkey % 3 = 1 THEN 0.5::DOUBLE END AS confidence FROM customer")
def enrich_ownership(spark, d):
    c = derived.table(spark, d, "customer")
    props = F.to_json(
        F.struct(F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("team-"), "c_nationkey")).alias("owner"),
            F.when(F.col("c_nationkey") % 3 < 2, F.col("c_name")).alias("author")))
    return c.select(F.col("c_custkey").alias("id"), records.ownership(props).alias("o")).select("id", "o.owner", "o.confidence")


@query("SELECT 'cust-' || c_custkey AS id, CASE WHEN count(o_orderkey) > 10 THEN 'HOT' WHEN count(o_orderkey) >= 2 THEN 'ACTIVE' ELSE "
    "'STABLE' END AS velocity FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def enrich_velocity(spark, d):
    n = derived.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = derived.table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.concat(F.lit("cust-"), "c_custkey").alias("id"), records.velocity(F.col("n")).alias("velocity"))


@query("SELECT s.id, coalesce(n, 0) AS inbound, round(least(1.0, 0.2 + 0.1 * coalesce(n, 0)), 6)::DOUBLE AS score, CASE WHEN coalesce(n, "
    "0) >= 7 THEN 'CRITICAL' WHEN coalesce(n, 0) >= 5 THEN 'HIGH' WHEN coalesce(n, 0) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS criticality "
    "FROM services s LEFT JOIN (SELECT to_id, count(*) AS n FROM calls WHERE type IN ('DEPENDS_ON', 'CALLS') GROUP BY 1) ON to_id = s.id")
def enrich_criticality(spark, d):
    n = records.inbound_counts(derived.calls(spark, d), ["DEPENDS_ON", "CALLS"])
    out = derived.services(spark, d).join(n, "id", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    return out.select("id", "inbound", F.round(records.criticality_score(F.col("inbound")), 6).alias("score"),
        records.criticality(F.col("inbound")).alias("criticality"))


@query("""SELECT p_partkey AS id, s AS score, CASE WHEN s > 0.8 THEN 'MATURE' WHEN s > 0.5 THEN 'DEVELOPING' ELSE 'NASCENT' END AS maturity FROM (SELECT p_partkey, round(0.10 + CASE WHEN p_size > 10 THEN 0.20 ELSE 0 END + CASE WHEN p_size > 20 THEN 0.15 ELSE 0 END + CASE WHEN p_size > 30 THEN 0.15 ELSE 0 END + CASE WHEN p_retailprice > 950 THEN 0.15 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 0.10 ELSE 0 END, 6)::DOUBLE AS s FROM part)""")
def enrich_maturity(spark, d):
    signs = {"has_api_spec": F.col("p_size") > 10, "has_tests": F.col("p_size") > 20, "has_documentation": F.col("p_size") > 30,
        "has_owner": F.col("p_retailprice") > 950, "has_monitoring": F.col("p_type") == "ECONOMY"}
    score = records.maturity_score(signs)
    return derived.table(spark, d, "part").select(F.col("p_partkey").alias("id"), score.alias("score"),
        records.maturity(score).alias("maturity"))


# diff, upsert, delete


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'CREATE' WHEN c_custkey % 4 = 1 THEN 'UPDATE' ELSE 'UNCHANGED' END AS op "
    "FROM customer")
def delta_compute(spark, d):
    c = derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"))
    new = c.withColumn("balance", F.when(F.col("id") % 4 == 1, F.col("balance") + 1).otherwise(F.col("balance")))
    return records.delta(new, c.where("id % 4 <> 0"), "id", ["name", "balance"]).select("id", "op")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, (CASE WHEN c_custkey % 4 = 0 "
    "THEN 1 WHEN c_custkey % 4 = 1 THEN 4 ELSE 3 END)::INTEGER AS version, CASE c_custkey % 4 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'UPDATED' "
    "WHEN 2 THEN 'NO_CHANGE' ELSE 'KEPT' END AS operation FROM customer")
def upsert_entities(spark, d):
    c = derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = c.where("id % 4 <> 3").withColumn("balance", F.when(F.col("id") % 4 == 1, F.col("balance") + 1).otherwise(F.col("balance")))
    return store.upsert(c.where("id % 4 <> 0").withColumn("version", F.lit(3)), new, "id", ["balance"])


@query("SELECT id, is_active AND owner <> 'team-3' AS is_active, CASE WHEN owner = 'team-3' AND is_active THEN 'DELETED' WHEN owner = "
    "'team-3' THEN 'NO_CHANGE' ELSE 'KEPT' END AS operation, (CASE WHEN owner = 'team-3' AND is_active THEN 2 ELSE 1 END)::INTEGER AS "
    "version FROM services")
def soft_delete(spark, d):
    s = derived.services(spark, d).withColumns({"valid_to": F.lit(None).cast("timestamp"), "version": F.lit(1)})
    return store.soft_delete(s, s.where("owner = 'team-3'"), F.expr(AT)).select("id", "is_active", "operation", "version")


@query("SELECT 'svc-' || l_suppkey AS from_id, 'cust-' || o_custkey AS to_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN "
    "customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def reject_unknown_endpoints(spark, d):
    li, o, c = (derived.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    edges = li.join(o, li.l_orderkey == o.o_orderkey).select(F.concat(F.lit("svc-"), "l_suppkey").alias("from_id"),
        F.concat(F.lit("cust-"), "o_custkey").alias("to_id")).distinct()
    known = derived.services(spark, d).select("id").unionByName(
        c.where("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("cust-"), "c_custkey").alias("id")))
    return store.rejected_edges(edges, known).select("from_id", "to_id")


# the log


@query("SELECT entry_id, mutation_type, occurred_at FROM change_log WHERE entity_id = 'user-7'")
def entity_history(spark, d):
    return store.read_log(derived.change_log(spark, d), entity_id="user-7").select("entry_id", "mutation_type", "occurred_at")


@query("SELECT entry_id, transaction_id, entity_id FROM change_log WHERE entry_id >= 50 ORDER BY entry_id LIMIT 100")
def log_read(spark, d):
    return store.read_log(derived.change_log(spark, d), from_entry=50, limit=100).select("entry_id", "transaction_id", "entity_id")


_REPLAY = "SELECT entity_id, max(entry_id) AS entry_id, count(*) AS version, arg_max(mutation_type, entry_id) <> 'ENTITY_SOFT_DELETED' AS is_active, arg_max(state, entry_id) AS state FROM change_log WHERE mutation_type LIKE 'ENTITY%'"


@query(_REPLAY + " GROUP BY 1")
def log_replay(spark, d):
    return store.replay(derived.change_log(spark, d)).drop("occurred_at")


@query(_REPLAY + f" AND occurred_at <= {AT} GROUP BY 1")
def graph_as_of(spark, d):
    return store.replay(derived.change_log(spark, d), until=F.expr(AT)).drop("occurred_at")


@query(_REPLAY + " AND entry_id <= 500 GROUP BY 1")
def timeline_prefix(spark, d):
    return store.replay(derived.change_log(spark, d), last_entry=500).drop("occurred_at")


@query(
    f"SELECT count(*) AS nodes, count_if(is_active) AS active, max(entry_id) AS last_entry FROM ({_REPLAY} AND occurred_at <= {AT} GROUP BY 1)")
def snapshot_stats(spark, d):
    return store.replay(derived.change_log(spark, d), until=F.expr(AT)).agg(F.count("*").alias("nodes"),
        F.count_if("is_active").alias("active"), F.max("entry_id").alias("last_entry"))


@query(
    f"SELECT count_if(mutation_type = 'ENTITY_CREATED') AS entities_created, count_if(mutation_type = 'ENTITY_UPDATED') AS entities_updated, count_if(mutation_type = 'ENTITY_SOFT_DELETED') AS entities_deleted, count_if(mutation_type = 'RELATIONSHIP_CREATED') AS relationships_created, 0::BIGINT AS relationships_updated, 0::BIGINT AS relationships_deleted, count(*) AS total FROM change_log WHERE occurred_at <= {AT}")
def evolution_diff(spark, d):
    return store.evolution(derived.change_log(spark, d), end=F.expr(AT))


@query(
    f"SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NULL THEN 'ADDED' WHEN b.entity_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM ({_REPLAY} AND occurred_at <= {AT} GROUP BY 1) a FULL JOIN ({_REPLAY} GROUP BY 1) b ON a.entity_id = b.entity_id WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR a.state IS DISTINCT FROM b.state OR a.is_active <> b.is_active")
def graph_diff(spark, d):
    log = derived.change_log(spark, d)
    return store.graph_diff(store.replay(log, until=F.expr(AT)), store.replay(log), "entity_id", ["state", "is_active"])


# lookup and search


@query("SELECT namespace, canonical_name, arg_max(id, {b: balance, i: id}) AS id FROM services WHERE is_active GROUP BY 1, 2")
def entity_by_name(spark, d):
    return store.by_name(derived.services(spark, d).withColumn("updated_at", F.col("balance"))).select("namespace", "canonical_name", "id")


@query("SELECT namespace, count(*) AS n FROM services GROUP BY 1")
def namespaces(spark, d):
    return store.namespaces(derived.services(spark, d))


@query("SELECT p_partkey AS id, p_name AS canonical_name FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def search_facets(spark, d):
    p = derived.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_name"),
        F.col("p_brand").alias("owner_team"), F.col("p_type").alias("criticality"))
    return store.search(p, owner_team="Brand#2", criticality="ECONOMY").select("id", "canonical_name")


@query("SELECT doc_id AS id, source FROM documents WHERE text ILIKE '%general public%'")
def search_text(spark, d):
    docs = derived.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("canonical_name"), "source")
    return store.search(docs, "GENERAL public").select("id", "source")


# metrics and spans


@query(f"SELECT 'user-' || user_id AS entity_id, ts AS at, value FROM events WHERE ts BETWEEN {AT} AND TIMESTAMP '2024-01-16 00:00:00'")
def metrics_range(spark, d):
    return store.metrics_range(derived.metrics(spark, d), F.expr(AT), F.expr("TIMESTAMP '2024-01-16 00:00:00'")).select("entity_id", "at",
        "value")


@query("SELECT 'user-' || user_id AS entity_id, max(ts) AS at, arg_max(value, {t: ts, e: event_id}) AS value FROM events GROUP BY 1")
def metrics_latest(spark, d):
    return store.latest_metrics(derived.metrics(spark, d)).select("entity_id", "at", "value")


@query("SELECT DISTINCT p.service_name AS caller, c.service_name AS callee FROM spans c JOIN spans p ON c.parent_span_id = p.span_id WHERE "
    "p.service_name <> c.service_name")
def span_calls(spark, d):
    return store.span_calls(derived.spans(spark, d))


@query("SELECT service_name, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS window_start, count(*) AS calls, "
    "round(sum(value), 4) AS total, max(value) AS largest FROM spans GROUP BY 1, 2")
def span_window_stats(spark, d):
    return store.span_stats(derived.spans(spark, d))


@query("SELECT user_id AS source_id, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, {t: ts, e: event_id}) AS "
    "last_status, coalesce(epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(CASE WHEN event_type <> 'error' THEN ts END)))::BIGINT, "
    "0) AS age_seconds FROM events GROUP BY 1")
def ledger_staleness(spark, d):
    e = derived.table(spark, d, "events").select(F.col("user_id").alias("source_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").alias("completed_at"),
        F.col("event_id").alias("run_id"))
    return store.staleness(e, F.expr("TIMESTAMP '2024-02-01'")).select("source_id", "last_status", "age_seconds")


@query("SELECT user_id AS source_id, count_if(event_type = 'error') AS failed, count_if(event_type = 'purchase') AS emitted, CASE WHEN "
    "count_if(event_type = 'error') > 0 AND count_if(event_type = 'purchase') > 0 THEN 'partial' WHEN count_if(event_type = 'error') > 0 "
    "THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY 1")
def run_status(spark, d):
    e = derived.table(spark, d, "events").groupBy(F.col("user_id").alias("source_id")).agg(
        F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("emitted"))
    return e.withColumn("status", store.run_status(F.col("failed"), F.col("emitted")))


# places, questions, coupling


@query(
    """SELECT 'src/' || p_type || '/' || p_name || '.go' AS path, p_size AS line, min('e-' || p_partkey) AS entity_id FROM (SELECT DISTINCT p_type, p_name, p_size FROM part) q JOIN part p USING (p_type, p_name) WHERE q.p_size BETWEEN p.p_size AND p.p_size + 3 GROUP BY 1, 2""".replace(
        "p_size AS line", "q.p_size AS line"))
def file_line_resolve(spark, d):
    p = derived.table(spark, d, "part")
    places = p.select(F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_name", F.lit(".go")).alias("path"),
        F.col("p_size").alias("line")).distinct()
    ents = p.select(F.concat(F.lit("e-"), "p_partkey").alias("id"), F.concat(F.lit("e-"), "p_partkey").alias("name"),
        F.concat("p_type", F.lit("/"), "p_name", F.lit(".go")).alias("file"), F.col("p_size").alias("start_line"),
        (F.col("p_size") + 3).alias("end_line"))
    return graph.resolve_locations(places, ents)


@query("""SELECT path, coalesce(max(p), '.') AS project FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) LEFT JOIN (SELECT DISTINCT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS p FROM pages) ON path = p OR starts_with(path, p || '/') GROUP BY 1""")
def project_of_file(spark, d):
    pages = derived.table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    projects = pages.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project")).distinct()
    return graph.longest_prefix(pages.select("path").distinct(), projects)


def _case(col: str) -> str:
    out = "CASE"
    for name, _, words in catalogs.QUESTION_WORDS:
        out += " WHEN " + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + f" THEN '{name}'"
    return out + " ELSE 'STRUCTURAL' END"


@query(f"SELECT conv_id, turn, {_case('text')} AS archetype FROM conversations")
def intent_classify(spark, d):
    return derived.table(spark, d, "conversations").select("conv_id", "turn", question.archetype(F.col("text")).alias("archetype"))


_Q = "(CASE event_type WHEN 'signup' THEN 'is there any smell' WHEN 'error' THEN 'What breaks if `user-' || user_id || '` fails' WHEN 'click' THEN 'history of late' WHEN 'view' THEN 'p99 of user-' || user_id ELSE 'who calls \"user ' || user_id || '\"' END)"


@query(f"""SELECT event_id, kind AS archetype, CASE kind WHEN 'GOVERNANCE' THEN NULL WHEN 'IMPACT' THEN 'IMPACT_ANALYSIS' WHEN 'TEMPORAL' THEN 'READ_LOG' WHEN 'RUNTIME' THEN NULL ELSE 'FETCH_NEIGHBORHOOD' END AS action,
CASE kind WHEN 'IMPACT' THEN 'user-' || user_id WHEN 'STRUCTURAL' THEN 'user ' || user_id END AS entity, CASE kind WHEN 'GOVERNANCE' THEN 'namespace needed' WHEN 'RUNTIME' THEN 'entity needed' END AS error FROM (SELECT event_id, user_id, {_case(_Q)} AS kind FROM events)""")
def plan_question(spark, d):
    ask = F.expr("CASE event_type WHEN 'signup' THEN 'is there any smell' WHEN 'error' THEN concat('What breaks if `user-', user_id, '` fails') WHEN 'click' THEN 'history of late' WHEN 'view' THEN concat('p99 of user-', user_id) ELSE concat('who calls \"user ', user_id, '\"') END")
    rows = derived.table(spark, d, "events").select("event_id", ask.alias("question"), F.lit(None).cast("string").alias("entity_name"),
        F.lit(None).cast("string").alias("namespace"))
    return question.plan_questions(rows).select("event_id", "archetype", "action", "entity", "error")


@query("""SELECT a.e AS left_id, b.e AS right_id, count(*) AS together, round(count(*) / (na + nb - count(*))::DOUBLE, 6) AS coupling FROM (SELECT DISTINCT l_orderkey AS k, 'svc-' || l_suppkey AS e FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS k, 'svc-' || l_suppkey AS e FROM lineitem) b ON a.k = b.k AND a.e < b.e JOIN (SELECT 'svc-' || l_suppkey AS e, count(DISTINCT l_orderkey) AS na FROM lineitem GROUP BY 1) x ON x.e = a.e JOIN (SELECT 'svc-' || l_suppkey AS e, count(DISTINCT l_orderkey) AS nb FROM lineitem GROUP BY 1) y ON y.e = b.e GROUP BY 1, 2, na, nb""")
def change_coupling(spark, d):
    rows = derived.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"),
        F.concat(F.lit("svc-"), "l_suppkey").alias("id"))
    return graph.change_coupling(rows)
