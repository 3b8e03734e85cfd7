"""Registered queries of the graph operators over the derived graph, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import graph, records
from kgloom.session import cut

from . import derived
from .registry import query

BUSIEST = "(SELECT to_id FROM calls GROUP BY 1 ORDER BY count(*) DESC, to_id LIMIT 1)"


def busiest(calls: DataFrame) -> str:
    """The node with the most edges into it."""
    return calls.groupBy("to_id").count().orderBy(F.desc("count"), "to_id").first()["to_id"]


# traversal


def _layers(direction: str, depth: int) -> str:
    out, back = "SELECT from_id AS s, to_id AS t FROM live", "SELECT to_id AS s, from_id AS t FROM live"
    step = {"out": out, "in": back, "both": f"{out} UNION {back}"}[direction]
    return f""", steps AS ({step}),
walk AS (SELECT {BUSIEST} AS node, 0 AS depth UNION SELECT t, depth + 1 FROM walk JOIN steps ON s = node WHERE depth < {depth}),
near AS (SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1)"""


def _neighborhood(direction: str):
    @query(_layers(direction, 2) + " SELECT node, depth FROM near WHERE depth > 0", f"neighborhood_{direction}")
    def nodes(spark, d):
        c = derived.calls(spark, d)
        return graph.neighborhood(c, busiest(c), 2, direction)[0]

    return nodes


for _d in ("out", "in", "both"):
    _neighborhood(_d)

_NEAR_EDGES = """SELECT DISTINCT from_id, to_id, type, confidence FROM live
WHERE from_id IN (SELECT node FROM near WHERE depth < 2) OR to_id IN (SELECT node FROM near WHERE depth < 2)"""


@query(_layers("both", 2) + " SELECT from_id, to_id, type FROM (" + _NEAR_EDGES + ")")
def neighborhood_edges(spark, d):
    c = derived.calls(spark, d)
    return graph.neighborhood(c, busiest(c), 2, "both")[1].select("from_id", "to_id", "type")


_DECAY = "CASE type WHEN 'IMPORTS' THEN 0.95::DOUBLE WHEN 'RUNTIME_CALLS' THEN 0.8::DOUBLE WHEN 'DEPENDS_ON' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END * confidence"


def _blast(depth: int) -> str:
    out = f", w AS (SELECT to_id AS s, from_id AS t, max({_DECAY}) AS w FROM live GROUP BY 1, 2), b0 AS (SELECT {BUSIEST} AS node, 1.0::DOUBLE AS p)"
    for k in range(1, depth + 1):
        out += f",\nb{k} AS (SELECT t AS node, max(p * w) AS p FROM b{k - 1} JOIN w ON s = node WHERE p * w > 0.10 AND t <> {BUSIEST} GROUP BY 1)"
    return out + ", hits AS (" + " UNION ALL ".join(
        f"SELECT node, round(p, 9) AS p, {k} AS depth FROM b{k}" for k in range(1, depth + 1)) + ")"


@query(
    _blast(
        5) + f" SELECT {BUSIEST} AS origin, node, round(max(p), 6) AS probability, arg_min(depth, {{p: -p, d: depth}})::INTEGER AS depth FROM hits GROUP BY node")
def blast_radius(spark, d):
    c = derived.calls(spark, d)
    return graph.blast_radius(c, spark.createDataFrame([(busiest(c),)], "origin string"))


_REACH = """, steps AS (SELECT DISTINCT to_id AS s, from_id AS t FROM live),
reach AS (SELECT id AS origin, id AS node, 0 AS depth FROM services UNION SELECT origin, t, depth + 1 FROM reach JOIN steps ON s = node WHERE depth < 3),
hit AS (SELECT origin, count(DISTINCT node) - 1 AS n FROM reach GROUP BY 1)"""


@query(_REACH + " SELECT origin AS id, n AS affected, round(100.0 * n / ((SELECT count(*) FROM services) - 1), 4) AS percent FROM hit")
def impact_percent(spark, d):
    return graph.impact_percent(derived.calls(spark, d), derived.services(spark, d))


@query(_REACH + " SELECT origin AS id, n AS affected, CASE WHEN n > 5 THEN 'High' WHEN n > 2 THEN 'Medium' ELSE 'Low' END AS risk FROM hit")
def pr_risk(spark, d):
    return graph.impact_percent(derived.calls(spark, d), derived.services(spark, d)).select("id", "affected",
        graph.change_risk(F.col("affected")).alias("risk"))


@query(_blast(5) + f""", ranked AS (SELECT node, max(p) AS p FROM hits GROUP BY 1), text AS (SELECT string_agg('`' || canonical_name || '` (' || type || ')', ', ' ORDER BY p DESC, node) AS t FROM ranked JOIN services ON id = node)
SELECT {BUSIEST} AS origin, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS names FROM text""")
def pr_affected_names(spark, d):
    c = derived.calls(spark, d)
    hit = graph.blast_radius(c, spark.createDataFrame([(busiest(c),)], "origin string"))
    return graph.affected_names(hit, derived.services(spark, d))


@query(f"""SELECT CASE WHEN from_id = {BUSIEST} THEN to_id ELSE from_id END AS peer,
CASE WHEN from_id = {BUSIEST} THEN 'dependency' ELSE 'dependent' END AS side, type FROM calls WHERE from_id = {BUSIEST} OR to_id = {BUSIEST}""")
def direct_dependents(spark, d):
    c = derived.calls(spark, d)
    return graph.direct_neighbors(c, busiest(c))


#: Confidences as millionths, so that products are whole numbers.
_BEST = """, best AS (SELECT from_id, to_id, round(max(confidence) * 1000000)::HUGEINT AS c FROM live
WHERE type IN ('IMPORTS', 'DEPENDS_ON') AND from_id <> to_id GROUP BY 1, 2)"""


@query(_BEST + """, chain AS (SELECT from_id, to_id, c, 1 AS hops, 1000000::HUGEINT AS one, [from_id, to_id] AS path FROM best WHERE 2 * c >= 1000000
UNION ALL SELECT h.from_id, b.to_id, h.c * b.c, hops + 1, one * 1000000, list_append(path, b.to_id) FROM chain h JOIN best b ON h.to_id = b.from_id
WHERE hops < 5 AND 2 * h.c * b.c >= one * 1000000 AND NOT list_contains(path, b.to_id)),
top AS (SELECT from_id, to_id, arg_min({h: hops, c: c, one: one, p: path}, {c: -c * (1000000000000000000000000000000 // one), h: hops, p: path}) AS b
FROM chain WHERE hops >= 2 GROUP BY 1, 2)
SELECT from_id, to_id, b.h::INTEGER AS hops, ((2 * b.c * 1000000 + b.one) // (2 * b.one))::DOUBLE / 1000000 AS confidence, array_to_string(b.p, '>') AS chain FROM top""")
def transitive_deps(spark, d):
    return graph.transitive_dependencies(derived.calls(spark, d))


# cycles, hubs, audits

_SCC = """, pairs AS (SELECT DISTINCT from_id, to_id FROM live),
closed AS (SELECT from_id AS a, to_id AS b FROM pairs UNION SELECT a, to_id FROM closed JOIN pairs ON b = from_id),
scc AS (SELECT x.a AS node, min(x.b) AS component FROM closed x JOIN closed y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""


@query(_SCC + " SELECT node, component FROM scc")
def scc(spark, d):
    return graph.strongly_connected(derived.calls(spark, d).where("is_active"))


_DEG = """, ins AS (SELECT to_id AS id, count(*) AS n FROM live GROUP BY 1), outs AS (SELECT from_id AS id, count(*) AS n FROM live GROUP BY 1),
deg AS (SELECT id, coalesce(ins.n, 0) AS in_degree, coalesce(outs.n, 0) AS out_degree FROM services LEFT JOIN ins USING (id) LEFT JOIN outs USING (id))"""
_HUB = """, hubs AS (SELECT id, in_degree + out_degree AS degree FROM deg
WHERE in_degree + out_degree > 3 AND in_degree + out_degree > (SELECT avg(in_degree + out_degree) + {s} * stddev_pop(in_degree + out_degree) FROM deg))"""


@query(_DEG + " SELECT id, in_degree, out_degree, in_degree + out_degree AS degree FROM deg")
def degree_counts(spark, d):
    return graph.degrees(derived.calls(spark, d).where("is_active"), derived.services(spark, d))


@query(_DEG + _HUB.format(s=1) + " SELECT id, degree FROM hubs")
def supernodes(spark, d):
    return graph.supernodes(derived.calls(spark, d).where("is_active"), derived.services(spark, d), sigmas=1.0)


@query(_DEG + " SELECT id, in_degree + out_degree AS degree FROM deg ORDER BY degree DESC, id LIMIT 5")
def centrality_top5(spark, d):
    return graph.central(derived.calls(spark, d).where("is_active"), derived.services(spark, d))


@query("SELECT to_id AS table_id, count(DISTINCT from_id) AS services FROM accesses GROUP BY 1 HAVING count(DISTINCT from_id) >= 2")
def shared_db_coupling(spark, d):
    return graph.shared_table_coupling(derived.accesses(spark, d))


@query("""SELECT to_id AS table_id, coalesce(array_to_string(list_sort(list(from_id) FILTER (WHERE type = 'READS_FROM')), ','), '') AS readers,
coalesce(array_to_string(list_sort(list(from_id) FILTER (WHERE type = 'WRITES_TO')), ','), '') AS writers,
count_if(type = 'READS_FROM')::BIGINT AS n_readers, count_if(type = 'WRITES_TO')::BIGINT AS n_writers FROM accesses GROUP BY 1""")
def readers_writers(spark, d):
    out = graph.readers_writers(derived.accesses(spark, d))
    return out.withColumns({"readers": F.array_join("readers", ","), "writers": F.array_join("writers", ",")})


@query("""SELECT from_id AS service_id, coalesce(array_to_string(list_sort(list(to_id) FILTER (WHERE type = 'READS_FROM')), ','), '') AS reads,
coalesce(array_to_string(list_sort(list(to_id) FILTER (WHERE type = 'WRITES_TO')), ','), '') AS writes FROM accesses GROUP BY 1""")
def service_accesses(spark, d):
    out = graph.service_accesses(derived.accesses(spark, d))
    return out.withColumns({"reads": F.array_join("reads", ","), "writes": F.array_join("writes", ",")})


_SMELLS = _SCC + _DEG + _HUB.format(s=4) + """, smells AS (SELECT 'circular_dependency' AS smell, 'CRITICAL' AS severity, component AS subject, count(*) AS size FROM scc GROUP BY 3
UNION ALL SELECT 'supernode', 'MEDIUM', id, degree FROM hubs
UNION ALL SELECT 'shared_database_coupling', 'HIGH', to_id, count(DISTINCT from_id) FROM accesses GROUP BY 3 HAVING count(DISTINCT from_id) >= 2)"""


def _smells(spark, d) -> DataFrame:
    return graph.health_audit(derived.services(spark, d), derived.calls(spark, d), derived.accesses(spark, d))


#: Owners in one of four ways by the id's number: a name, an empty name, a primary owner, none.
_EVEN = "(regexp_extract(id, '[0-9]+$')::BIGINT % 2 = 1)"


def _unowned(spark, d) -> DataFrame:
    s = derived.services(spark, d)
    n = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    named = F.to_json(F.struct(F.col("owner").alias("owner")))
    primary = F.to_json(F.struct(F.struct(F.col("owner").alias("team_name")).alias("primary_owner")))
    return graph.ownerless(
        s.withColumn("properties",
            F.when(n % 4 == 0, named).when(n % 4 == 2, primary).when(n % 4 == 1, F.lit('{"owner": ""}')).otherwise("{}")))


_NO_OWNER = f"unowned AS (SELECT id FROM services WHERE {_EVEN})"


@query(_SMELLS + " SELECT smell, severity, subject, size FROM smells")
def health_audit(spark, d):
    return _smells(spark, d)


@query(f"{_SMELLS}, {_NO_OWNER}" + """ SELECT CASE smell WHEN 'circular_dependency' THEN 'RULE-01' WHEN 'shared_database_coupling' THEN 'RULE-03' ELSE 'UNKNOWN' END AS rule_id,
CASE smell WHEN 'circular_dependency' THEN 'no-circular-dependencies' WHEN 'shared_database_coupling' THEN 'shared-database-table' WHEN 'require-service-owners' THEN 'require-service-owners' ELSE '' END AS rule, subject,
CASE smell WHEN 'circular_dependency' THEN 'FAIL' WHEN 'shared_database_coupling' THEN 'WARN' ELSE severity END AS severity,
CASE smell WHEN 'circular_dependency' THEN 'FAIL' WHEN 'shared_database_coupling' THEN 'WARN' ELSE 'SILENT' END AS outcome
FROM (SELECT smell, severity, subject FROM smells UNION ALL SELECT 'require-service-owners', 'HIGH', id FROM unowned)""")
def governance_violations(spark, d):
    rules = spark.createDataFrame([("RULE-01", "no-circular-dependencies", "FAIL"), ("RULE-03", "shared-database-table", "WARN")],
        "id string, name string, severity string")
    return graph.governance(_smells(spark, d), _unowned(spark, d), rules)


@query(f"{_SMELLS}, {_NO_OWNER}" + """ SELECT smell, subject, CASE smell WHEN 'circular_dependency' THEN 'Break the cycle of ' || size || ' nodes around ' || subject
WHEN 'supernode' THEN 'Divide hub ' || subject || ' of degree ' || size ELSE 'Let one service own table ' || subject || ', which ' || size || ' use' END AS suggestion FROM smells
UNION ALL SELECT 'require-service-owners', id, 'Assign an owner to ' || id FROM unowned""")
def suggestions(spark, d):
    return graph.suggestions(_smells(spark, d), _unowned(spark, d))


@query(_SMELLS + f" SELECT smell, subject FROM smells WHERE contains(subject, {BUSIEST}) OR contains({BUSIEST}, subject)")
def smells_of_change(spark, d):
    c = derived.calls(spark, d)
    smells = graph.health_audit(derived.services(spark, d), c, derived.accesses(spark, d))
    return graph.smells_of(smells, spark.createDataFrame([(busiest(c),)], "name string")).select("smell", "subject")


@query("""SELECT from_id, to_id, type, confidence, false AS is_inferred FROM calls UNION ALL SELECT from_id, to_id, 'DEPENDS_ON', round(confidence * 0.9, 6), true FROM calls WHERE type = 'IMPORTS'
UNION ALL SELECT DISTINCT r.from_id, w.from_id, 'CHANGE_COUPLED_WITH', 0.85::DOUBLE, true FROM accesses r JOIN accesses w ON r.to_id = w.to_id AND r.type = 'READS_FROM' AND w.type = 'WRITES_TO' AND r.from_id <> w.from_id""")
def explicit_and_inferred(spark, d):
    explicit = derived.calls(spark, d).select("from_id", "to_id", "type", "confidence", F.lit(False).alias("is_inferred"))
    return records.with_inferred(explicit, derived.accesses(spark, d))


# relevance

_WEIGHT = """CASE type WHEN 'RUNTIME_CALLS' THEN 0.9::DOUBLE WHEN 'IMPORTS' THEN 0.7::DOUBLE WHEN 'DEPENDS_ON' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END * confidence"""


def _relevance(passes: int) -> str:
    out = _layers("both", 2) + f""", ne AS ({_NEAR_EDGES}), r0 AS (SELECT {BUSIEST} AS node, 1.0::DOUBLE AS score),
rw AS (SELECT s, t, max(w) AS w FROM (SELECT from_id AS s, to_id AS t, {_WEIGHT} AS w FROM ne UNION ALL SELECT to_id, from_id, {_WEIGHT} FROM ne) GROUP BY 1, 2)"""
    for k in range(1, passes + 1):
        out += f""",
r{k} AS (SELECT node, max(score) AS score FROM (SELECT * FROM r{k - 1} UNION ALL SELECT t, score * w FROM r{k - 1} JOIN rw ON s = node WHERE score * w >= 0.15 - 1e-12 AND t <> {BUSIEST}) GROUP BY 1)"""
    return out + f", kept AS (SELECT node, round(score, 6) AS score FROM r{passes} WHERE node <> {BUSIEST} ORDER BY round(score, 6) DESC, node LIMIT 200)"


@query(_relevance(6) + " SELECT node, score FROM kept")
def relevance_score(spark, d):
    c = derived.calls(spark, d)
    return graph.relevance(c, busiest(c), back_off=False)[0]


@query(_relevance(6) + f""", ids AS (SELECT node FROM kept UNION ALL SELECT {BUSIEST})
SELECT from_id, to_id, type, confidence FROM ne WHERE from_id IN (SELECT node FROM ids) AND to_id IN (SELECT node FROM ids)""")
def relevance_edges(spark, d):
    c = derived.calls(spark, d)
    return graph.relevance(c, busiest(c), back_off=False)[1]


# anti-joins, namespaces, visibility


@query("SELECT id FROM services WHERE id NOT IN (SELECT to_id FROM calls WHERE type = 'CALLS')")
def entry_points(spark, d):
    return graph.entry_points(derived.services(spark, d), derived.calls(spark, d))


@query("SELECT id FROM services WHERE id NOT IN (SELECT to_id FROM calls) UNION ALL SELECT id FROM services WHERE NOT EXISTS (SELECT 1 "
    "FROM services WHERE id NOT IN (SELECT to_id FROM calls))")
def tree_roots(spark, d):
    return graph.roots(derived.services(spark, d), derived.calls(spark, d))


@query("SELECT 'cust-' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = "
    "'1-URGENT')")
def orphans(spark, d):
    people = derived.table(spark, d, "customer").select(F.concat(F.lit("cust-"), "c_custkey").alias("id"), F.lit("DEVELOPER").alias("type"))
    urgent = derived.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return graph.orphans(people, urgent.select(F.concat(F.lit("cust-"), "o_custkey").alias("to_id")))


@query(f"SELECT DISTINCT from_id AS id FROM calls WHERE to_id = {BUSIEST} AND from_id <> to_id")
def auth_protected(spark, d):
    c = derived.calls(spark, d)
    return graph.protected_by(derived.services(spark, d), c, busiest(c))


@query("SELECT from_id, to_id, type FROM live WHERE from_id IN (SELECT id FROM services WHERE namespace = 'asia') AND to_id IN (SELECT id "
    "FROM services WHERE namespace = 'asia')")
def namespace_edges(spark, d):
    return graph.within(derived.services(spark, d), derived.calls(spark, d), "asia").select("from_id", "to_id", "type")


def _typed(spark, d) -> DataFrame:
    """Services and tables as one entity table."""
    s, t = derived.services(spark, d), derived.tables(spark, d)
    return s.select("id", "type", "canonical_name", "namespace", "is_active").unionByName(
        t.select("id", "type", "canonical_name", "namespace", "is_active"))


@query("SELECT 'node' AS kind, id, '' AS to_id FROM services UNION ALL SELECT 'link', from_id, to_id FROM calls")
def visibility_filter(spark, d):
    c = derived.calls(spark, d).select("from_id", "to_id", "type").unionByName(derived.accesses(spark, d))
    nodes, links = graph.visible(cut(_typed(spark, d)), c, {"DATABASE_TABLE", "TEAM"})
    return nodes.select(F.lit("node").alias("kind"), "id", F.lit("").alias("to_id")).unionByName(
        links.select(F.lit("link").alias("kind"), F.col("from_id").alias("id"), "to_id"))


@query("SELECT c.from_id, c.to_id, p99 FROM calls c JOIN (SELECT l_suppkey, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem "
    "GROUP BY 1) ON c.from_id = 'svc-' || l_suppkey WHERE p99 > 60000")
def slow_callers(spark, d):
    latencies = derived.table(spark, d, "lineitem").select(F.concat(F.lit("svc-"), "l_suppkey").alias("id"), F.col("l_extendedprice").alias("value"))
    return graph.slow_callers(derived.calls(spark, d), latencies, 60000)
