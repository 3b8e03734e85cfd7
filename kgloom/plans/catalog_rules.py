"""Registered queries of rules, scores, orders and trees, texts and source scans, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom import functions as fn
from kgloom.operators import graph, paths, rules
from kgloom.sources import code

from kgloom.session import cut

from . import derived, render
from .catalog_graph import BUSIEST, busiest
from .registry import query

AT = "TIMESTAMP '2024-01-31 00:00:00'"


# scores and rules


@query("""SELECT c_custkey AS id, CASE k WHEN 'STRUCTURAL_DIRECT' THEN CASE WHEN c > 0.85 THEN 'ACCEPT' WHEN c >= 0.6 THEN 'REVIEW' ELSE 'REJECT' END WHEN 'RUNTIME' THEN CASE WHEN c > 0.9 THEN 'ACCEPT' WHEN c >= 0.7 THEN 'REVIEW' ELSE 'REJECT' END
WHEN 'TEMPORAL_FAILURE' THEN CASE WHEN c > 0.75 THEN 'ACCEPT' WHEN c >= 0.55 THEN 'REVIEW' ELSE 'REJECT' END END AS band
FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'STRUCTURAL_DIRECT' WHEN 'MACHINERY' THEN 'RUNTIME' WHEN 'AUTOMOBILE' THEN 'TEMPORAL_FAILURE' ELSE 'OTHER' END AS k, abs(c_acctbal) / 10000 AS c FROM customer)""")
def acceptance_bands(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "STRUCTURAL_DIRECT").when(F.col("c_mktsegment") == "MACHINERY", "RUNTIME").when(
        F.col("c_mktsegment") == "AUTOMOBILE", "TEMPORAL_FAILURE").otherwise("OTHER")
    return derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"),
        rules.band(kind, F.abs("c_acctbal") / 10000).alias("band"))


_SIMILAR = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"


@query(f"""SELECT p_partkey AS id, round(0.40::DOUBLE * (CASE WHEN p_name = p_brand THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.2::DOUBLE + CASE WHEN p_size > 25 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN p_size < 10 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)
 + 0.15::DOUBLE * (0.30::DOUBLE * ({_SIMILAR.format(a="p_name", b="p_type")}) + 0.15::DOUBLE + CASE WHEN p_size % 2 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN left(p_name, 3) = left(p_type, 3) OR right(p_name, 3) = right(p_type, 3) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
 + 0.25::DOUBLE * least(0.8::DOUBLE, 0.3::DOUBLE * (p_size % 4) + CASE WHEN p_size > 25 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM part""")
def match_scores(spark, d):
    p = derived.table(spark, d, "part")
    big = F.col("p_size") > 25
    a = F.struct(F.col("p_name").alias("name"), F.lit("ns").alias("namespace"), F.lit("S").alias("type"), F.lit("r").alias("source_ref"))
    b = F.struct(F.col("p_brand").alias("name"), F.lit("ns").alias("namespace"), F.when(big, "S").otherwise("T").alias("type"),
        F.when(F.col("p_size") < 10, "r").otherwise("q").alias("source_ref"))
    other = F.struct(F.col("p_type").alias("name"), F.lit("ns").alias("namespace"))
    x = p.select("*", a.alias("a"), b.alias("b"), other.alias("o"))
    shared = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y")))
    exact, fuzzy = rules.exact_score(x), rules.fuzzy_score(F.col("a"), F.col("o"), F.array(F.lit("x")), shared)
    structural = rules.structural_score(F.col("p_size") % 4, F.lit(0), F.lit(0), big)
    return x.select(F.col("p_partkey").alias("id"), rules.match_score(exact=exact, fuzzy=fuzzy, structural=structural).alias("score"))


@query("""SELECT id, candidate, score, CASE WHEN next >= 0.8 AND score - next < 0.05 THEN 'CONFLICT' WHEN score >= 0.95 THEN 'CERTAIN_MERGE' WHEN score >= 0.8 THEN 'LIKELY_MERGE' WHEN score >= 0.6 THEN 'UNCERTAIN' ELSE 'NO_MATCH' END AS decision
FROM (SELECT id, candidate, score, row_number() OVER w AS r, lead(score) OVER w AS next FROM (SELECT o_custkey AS id, o_orderkey AS candidate, floor(o_totalprice) % 1000 / 1000 AS score FROM orders) WINDOW w AS (PARTITION BY id ORDER BY score DESC, candidate)) WHERE r = 1""")
def match_decisions(spark, d):
    o = derived.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("candidate"),
        (F.floor("o_totalprice") % 1000 / 1000).alias("score"))
    return rules.best_candidates(o)


@query("""SELECT id, owner, top_team, round(most / total, 6) AS top_share, top_team <> owner AND most / total > 0.3 AS drift FROM (SELECT id, owner, arg_max(team, (c, team)) AS top_team, max(c)::DOUBLE AS most, sum(c)::DOUBLE AS total
FROM (SELECT 'svc-' || l_suppkey AS id, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'R' END AS owner, l_returnflag AS team, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1, 2)""")
def ownership_drift(spark, d):
    li = derived.table(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("svc-"), "l_suppkey").alias("id"), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("R").alias("owner"),
        F.col("l_returnflag").alias("team"), F.lit(1).alias("commits"))
    return rules.ownership_drift(rows, share=0.3)


@query(f"""SELECT 'user-' || user_id AS id, round(n / (90 / 7.0::DOUBLE), 6) AS per_week, round(sqrt(greatest(0.0, s / 13.0::DOUBLE - (n / 13.0::DOUBLE) * (n / 13.0::DOUBLE))), 6) AS volatility,
CASE WHEN n = 0 THEN 'FROZEN' WHEN n / (90 / 7.0::DOUBLE) > 10 THEN 'HOT' WHEN n / (90 / 7.0::DOUBLE) >= 2 THEN 'ACTIVE' ELSE 'STABLE' END AS velocity
FROM (SELECT user_id, sum(c)::DOUBLE AS n, sum(c * c)::DOUBLE AS s FROM (SELECT user_id, floor((epoch({AT}) - floor(epoch(ts))) / 604800) AS week, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1)""")
def weekly_velocity(spark, d):
    e = derived.table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("id"), F.col("ts").alias("at"))
    return rules.weekly_velocity(e, F.expr(AT))


@query("""SELECT user_id AS id, 'k' AS key, arg_max(value, {r: r, t: ts, v: value}) AS value, arg_max(origin, {r: r, t: ts, v: value}) AS origin
FROM (SELECT user_id, ts, value, CASE event_type WHEN 'signup' THEN 'manual' WHEN 'error' THEN 'runtime' WHEN 'view' THEN 'inferred' ELSE 'default' END AS origin, CASE event_type WHEN 'signup' THEN 3 WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS r FROM events) GROUP BY 1""")
def annotation_priority(spark, d):
    origin = F.when(F.col("event_type") == "signup", "manual").when(F.col("event_type") == "error", "runtime").when(
        F.col("event_type") == "view", "inferred").otherwise("default")
    e = derived.table(spark, d, "events").select(F.col("user_id").alias("id"), F.lit("k").alias("key"), "value", origin.alias("origin"),
        F.col("ts").alias("at"))
    return rules.strongest_annotation(e)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'CON-001' WHEN c_custkey % 5 = 1 THEN 'CON-003' WHEN c_custkey % 5 = 2 THEN 'CON-002' END AS rule, CASE WHEN c_custkey % 5 = 0 THEN 'REJECT' WHEN c_custkey % 5 IN (1, 2) THEN 'KEEP' ELSE 'APPLY' END AS action FROM customer""")
def consistency_rules(spark, d):
    k = F.col("id") % 5
    old = derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("SERVICE").alias("type"),
        F.lit(0.8).alias("confidence"), F.lit("a").alias("owner"))
    new = old.where("id % 5 <> 4").withColumns(
        {"type": F.when(k == 0, "FUNCTION").otherwise("SERVICE"), "confidence": F.when(k.isin(1, 2), 0.5).otherwise(0.9),
            "owner": F.when(k == 1, "b").otherwise("a")})
    new = new.unionByName(old.where("id % 5 = 4"))
    return rules.consistency(new, old).select("id", "rule", "action")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'CON-004' WHEN n_nationkey % 5 = 1 THEN 'SEM-001' WHEN n_nationkey % 5 = 2 THEN 'SEM-002' WHEN n_nationkey % 5 = 3 THEN 'SEM-005' END AS rule,
CASE WHEN n_nationkey % 5 < 3 THEN 'REJECT' WHEN n_nationkey % 5 = 3 THEN 'FLAG' ELSE 'ACCEPT' END AS action FROM nation""")
def semantic_rules(spark, d):
    k = F.col("n_nationkey") % 5
    kinds = [("team", "TEAM", "ACTIVE"), ("svc", "SERVICE", "ACTIVE"), ("old", "SERVICE", "DEPRECATED"), ("fn", "FUNCTION", "ACTIVE"),
        ("vm", "INFRASTRUCTURE_RESOURCE", "ACTIVE")]
    pick = lambda *names: F.coalesce(*[F.when(k == i, n) for i, n in enumerate(names)])
    edges = derived.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"),
        pick("OWNS", "OWNS", "DEPLOYED_ON", "DEPENDS_ON", "OWNS").alias("type"), pick("svc", "svc", "fn", "svc", "team").alias("from_id"),
        pick("team", "old", "vm", "old", "svc").alias("to_id"))
    return rules.semantics(edges, spark.createDataFrame(kinds, "id string, type string, lifecycle_stage string")).select("id", "rule",
        "action")


@query("SELECT (SELECT count(*) FROM supplier) AS services, (SELECT count(*) FROM part) AS tables, (SELECT count(*) FROM supplier) + "
    "(SELECT count(*) FROM part) AS entities")
def type_counts(spark, d):
    return rules.type_counts(derived.services(spark, d).select("id", "type").unionByName(derived.tables(spark, d).select("id", "type")))


# orders and trees


@query("""SELECT 'n-' || n_nationkey AS node, (CASE WHEN n_nationkey = 0 THEN 0 ELSE floor(log2(n_nationkey)) + 1 END)::INTEGER AS layer FROM nation""")
def topological_layers(spark, d):
    n = derived.table(spark, d, "nation").select(F.concat(F.lit("n-"), "n_nationkey").alias("id"), "n_nationkey")
    edges = n.where("n_nationkey > 0").select(F.col("id").alias("from_id"),
        F.concat(F.lit("n-"), F.floor(F.col("n_nationkey") / 2)).alias("to_id"))
    return paths.layers(edges, n)


@query("""SELECT 'region-' || r_regionkey AS root, array_to_string(['region-' || r_regionkey], '>') AS path, 0 AS level, false AS cycle FROM region
UNION ALL SELECT 'region-' || n_regionkey, 'region-' || n_regionkey || '>nation-' || n_nationkey, 1, false FROM nation
UNION ALL SELECT 'region-' || n_regionkey, 'region-' || n_regionkey || '>nation-' || n_nationkey || '>region-' || n_regionkey, 2, true FROM nation
UNION ALL SELECT 'region-' || n_regionkey, 'region-' || n_regionkey || '>nation-' || n_nationkey || '>svc-' || s_suppkey, 2, false FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def path_tree(spark, d):
    n, s = derived.table(spark, d, "nation"), derived.table(spark, d, "supplier")
    region, nation = F.concat(F.lit("region-"), "n_regionkey"), F.concat(F.lit("nation-"), "n_nationkey")
    edges = n.select(region.alias("from_id"), nation.alias("to_id"), F.lit("HAS").alias("type")).unionByName(
        n.select(nation.alias("from_id"), region.alias("to_id"), F.lit("IN").alias("type")))
    edges = edges.unionByName(
        s.select(F.concat(F.lit("nation-"), "s_nationkey").alias("from_id"), F.concat(F.lit("svc-"), "s_suppkey").alias("to_id"),
            F.lit("HAS").alias("type")))
    roots = derived.table(spark, d, "region").select(F.concat(F.lit("region-"), "r_regionkey").alias("id"))
    return paths.trees(edges, roots, 3).select("root", F.array_join("path", ">").alias("path"), "level", "cycle")


_DIR = "regexp_replace('dir_' || regexp_replace({0}, '[^A-Za-z0-9_-]', '_', 'g'), '__+', '_', 'g')"


@query(f""", p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT page_id, path, string_split(path, '/') AS parts FROM p),
f AS (SELECT page_id, parts, unnest(range(1, len(parts))) AS n FROM s)
SELECT DISTINCT CASE WHEN n = 1 THEN 'web' ELSE {_DIR.format("array_to_string(parts[1 : n - 1], '/')")} END AS parent, {_DIR.format("array_to_string(parts[1 : n], '/')")} AS child, parts[n] AS label FROM f
UNION SELECT CASE WHEN len(parts) > 1 THEN {_DIR.format("array_to_string(parts[1 : len(parts) - 1], '/')")} ELSE 'web' END, 'page-' || page_id, NULL FROM s""")
def directory_tree(spark, d):
    p = derived.table(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("id"),
        F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.lit("web").alias("project_id"))
    return paths.directories(p)


# texts


@query("""SELECT doc_id, CASE WHEN strpos(t, '```sql' || chr(10)) > 0 THEN trim(split_part(split_part(t, '```sql' || chr(10), 2), '```', 1), chr(10) || ' ') END AS fence, trim(split_part(split_part(t, '### ONE' || chr(10), 2), chr(10) || '### ', 1)) AS section
FROM (SELECT doc_id, '### ONE' || chr(10) || source || ' ' || lang || chr(10) || '### TWO' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '```sql' || chr(10) || 'SELECT ' || doc_id || chr(10) || '```' ELSE 'none' END AS t FROM documents)""")
def fenced_sections(spark, d):
    t = F.concat(F.lit("### ONE\n"), "source", F.lit(" "), "lang", F.lit("\n### TWO\n"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```sql\nSELECT "), "doc_id", F.lit("\n```"))).otherwise("none"))
    return derived.table(spark, d, "documents").select("doc_id", fn.fenced(t, "sql").alias("fence"), fn.section(t, "ONE").alias("section"))


@query("""SELECT conv_id, turn, role || ' = ' || conv_id AS subject, (CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 3 END)::INTEGER AS used_by, 1 AS uses, 0 AS nearby FROM conversations""")
def answer_summaries(spark, d):
    n = F.col("turn") % 3
    used = F.when(n > 0, F.concat(F.lit("\n\n### Used by"), F.repeat(F.lit("\nx = y, CALLS 0.90"), n))).otherwise("")
    text = F.concat(F.lit("### Subject\n"), "role", F.lit(" = "), "conv_id", F.lit("\nSERVICE, ACTIVE"), used, F.lit("\n\n### Uses\nt = u"))
    rows = derived.table(spark, d, "conversations").select("conv_id", "turn", text.alias("context"))
    return render.summaries(rows).select("conv_id", "turn", "subject", "used_by", "uses", "nearby")


@query(f"""SELECT CASE WHEN to_id = {BUSIEST} THEN 'in' ELSE 'out' END AS side, CASE WHEN to_id = {BUSIEST} THEN from_id ELSE to_id END AS id, c.type, c.confidence, s.canonical_name, s.confidence AS score
FROM calls c JOIN services s ON s.id = CASE WHEN to_id = {BUSIEST} THEN from_id ELSE to_id END WHERE (from_id = {BUSIEST}) <> (to_id = {BUSIEST})""")
def context_peers(spark, d):
    c = derived.calls(spark, d)
    nodes = derived.services(spark, d).select("id", "canonical_name", F.col("confidence").alias("score"))
    return render.peers(c, nodes, busiest(c)).select("side", "id", "type", "confidence", "canonical_name", "score")


@query("SELECT c_custkey AS id, 'a,b' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ',' || c_mktsegment END AS aliases FROM customer")
def aliases_appended(spark, d):
    known = F.array(F.lit("a"), F.lit("b"))
    new = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("b"), F.lit("a"))).otherwise(
        F.array(F.lit("a"), "c_mktsegment", "c_mktsegment"))
    return derived.table(spark, d, "customer").select(F.col("c_custkey").alias("id"),
        F.array_join(fn.append_absent(known, new), ",").alias("aliases"))


# source scans, over files made from the tables


def _scan_python(spark, d):
    s = derived.table(spark, d, "nation")
    body = F.concat(F.lit("import os\nfrom lib import x\n\ndef run_"), "n_nationkey", F.lit("():\n    pass\n\nclass Nation"), "n_nationkey",
        F.lit(":\n    def inner(self):\n        pass\n"))
    return code.python_records(
        s.select(F.concat(F.lit("app/m"), "n_nationkey", F.lit(".py")).alias("path"), body.alias("text")).unionByName(
            spark.createDataFrame([("lib/__init__.py", "")], "path string, text string")))


@query("""SELECT 'MODULE' AS type, 'app.m' || n_nationkey AS name, 0.95::DOUBLE AS confidence FROM nation UNION ALL SELECT 'MODULE', 'lib', 0.95 UNION ALL SELECT 'FUNCTION', 'app.m' || n_nationkey || '.run_' || n_nationkey, 0.95 FROM nation UNION ALL SELECT 'CLASS', 'app.m' || n_nationkey || '.Nation' || n_nationkey, 0.95 FROM nation""")
def scan_python_entities(spark, d):
    return _scan_python(spark, d)[0].select("type", "name", "confidence")


@query("""SELECT 'IMPORTS' AS type, 'app.m' || n_nationkey AS from_name, 'lib' AS to_name, 0.99::DOUBLE AS confidence FROM nation UNION ALL SELECT 'DEPENDS_ON', 'app.m' || n_nationkey || '.run_' || n_nationkey, 'app.m' || n_nationkey, 0.99 FROM nation UNION ALL SELECT 'DEPENDS_ON', 'app.m' || n_nationkey || '.Nation' || n_nationkey, 'app.m' || n_nationkey, 0.99 FROM nation""")
def scan_python_edges(spark, d):
    return _scan_python(spark, d)[1].select("type", "from_name", "to_name", "confidence")


def _scan_typescript(spark, d):
    s = derived.table(spark, d, "nation")
    body = F.concat(F.lit("import { h } from '../util';\nimport x from 'outside';\nexport function run"), "n_nationkey",
        F.lit("() {}\nconst arrow = (a) => a;\n"))
    return code.typescript_records(
        s.select(F.concat(F.lit("src/m"), "n_nationkey", F.lit(".ts")).alias("path"), body.alias("text")).unionByName(
            spark.createDataFrame([("util/index.ts", ""), ("src/skip.test.ts", "function no() {}")], "path string, text string")))


@query("""SELECT 'IMPORTS' AS type, 'src/m' || n_nationkey AS from_name, 'util/index' AS to_name, 0.99::DOUBLE AS confidence FROM nation UNION ALL SELECT 'DEPENDS_ON', 'src/m' || n_nationkey || '.run' || n_nationkey, 'src/m' || n_nationkey, 0.99 FROM nation UNION ALL SELECT 'DEPENDS_ON', 'src/m' || n_nationkey || '.arrow', 'src/m' || n_nationkey, 0.99 FROM nation""")
def scan_typescript_edges(spark, d):
    return _scan_typescript(spark, d)[1].select("type", "from_name", "to_name", "confidence")


@query("""SELECT 'API_ENDPOINT' AS type, upper(v) || ' /' || lower(r_name) AS name, 0.95::DOUBLE AS confidence FROM region, (SELECT unnest(['get', 'post']) AS v)""")
def scan_openapi(spark, d):
    r = derived.table(spark, d, "region")
    yaml = F.concat(F.lit("openapi: 3.0.0\npaths:\n  /"), F.lower("r_name"), F.lit(":\n    get:\n      summary: x\n    post:\n      summary: y\n    x-other:\n      z: 1\n"))
    text = F.concat(F.lit('{"paths": {"/'), F.lower("r_name"), F.lit('": {"get": {}, "post": {}, "trace": {}}}}'))
    even = F.col("r_regionkey") % 2 == 0
    files = r.select(F.concat("r_name", F.when(even, ".openapi.yaml").otherwise(".openapi.json")).alias("path"),
        F.when(even, yaml).otherwise(text).alias("text"))
    return code.openapi_records(files).select("type", "name", "confidence")


@query(f"""SELECT canonical_name || ' = ' || id AS subject, (SELECT count(*) FROM calls WHERE to_id = {BUSIEST} AND from_id <> to_id)::INTEGER AS used_by,
(SELECT count(*) FROM calls WHERE from_id = {BUSIEST} AND from_id <> to_id)::INTEGER AS uses FROM services WHERE id = {BUSIEST}""")
def report_origin(spark, d):
    """The whole context of the busiest service, summed up: all of its own edges are named."""
    c = derived.calls(spark, d)
    origin = busiest(c)
    nodes, _, _ = graph.relevance(c, origin)
    text = render.context(derived.services(spark, d), c, cut(nodes), origin, 10_000_000)
    return render.summaries(spark.createDataFrame([(text.text,)], "context string")).select("subject", "used_by", "uses")
