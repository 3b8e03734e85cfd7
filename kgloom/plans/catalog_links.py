"""Registered queries of similarity joins, substring joins, merges in chains, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import graph, layout, order, similar, substring, write
from kgloom.session import own_path

from . import derived
from .catalog_store import AT, _stored
from .registry import query

# similar names

_NEAR = "(greatest(length(a), length(b)) - levenshtein(a, b)) * 100 >= {} * greatest(length(a), length(b))"


@query(f"""SELECT x.n AS a, y.n AS b, levenshtein(x.n, y.n)::INTEGER AS distance FROM (SELECT DISTINCT p_name AS n FROM part) x
JOIN (SELECT DISTINCT p_name AS n FROM part) y ON x.n < y.n WHERE {_NEAR.format(60).replace("(a", "(x.n").replace("b)", "y.n)")}""")
def similar_part_names(spark, d):
    return similar.similar_pairs(derived.table(spark, d, "part").select(F.col("p_name").alias("text")), 60)


#: SQL's distance counts bytes.
_PEOPLE = """, people AS (SELECT 'cl-' || client_id AS id, regexp_replace(name, '[^ -~]', '?', 'g') AS name, coalesce(segment, '') AS namespace FROM clients
WHERE name IS NOT NULL), first AS (SELECT name, namespace, min(id) AS id FROM people GROUP BY 1, 2)"""
_MADE = f"""{_PEOPLE}, names AS (SELECT DISTINCT name AS n FROM people),
near AS (SELECT x.n AS a, y.n AS b, levenshtein(x.n, y.n)::INTEGER AS distance FROM names x JOIN names y ON x.n < y.n AND abs(length(x.n) - length(y.n)) <= 4
WHERE {_NEAR.format(85).replace("(a", "(x.n").replace("b)", "y.n)")}),
two AS (SELECT l.id AS p, r.id AS q, round(1 - distance / greatest(length(a), length(b))::DOUBLE, 6) AS score FROM near JOIN first l ON l.name = a
JOIN first r ON r.name = b AND r.namespace = l.namespace),
made AS (SELECT p AS id, q AS candidate, score FROM two UNION ALL SELECT q, p, score FROM two
UNION ALL SELECT p.id, f.id, 1.0 FROM people p JOIN first f ON p.name = f.name AND p.namespace = f.namespace AND p.id <> f.id)"""


def _people(spark, d) -> DataFrame:
    c = derived.table(spark, d, "clients")
    return c.select(F.concat(F.lit("cl-"), "client_id").alias("id"), F.regexp_replace("name", "[^ -~]", "?").alias("name"), F.coalesce("segment",
        F.lit("")).alias("namespace"), F.lit("CLIENT").alias("type")).distinct()


@query(_MADE.replace("FROM clients", "FROM (SELECT DISTINCT client_id, name, segment FROM clients)") + " SELECT id, candidate, score FROM made")
def similar_candidates(spark, d):
    return similar.candidates(_people(spark, d), 85)


@query(_MADE.replace("FROM clients", "FROM (SELECT DISTINCT client_id, name, segment FROM clients)") + """,
links AS (SELECT id AS p, candidate AS q FROM made WHERE score >= 0.9 UNION SELECT candidate, id FROM made WHERE score >= 0.9),
walk AS (SELECT p AS a, p AS b FROM links UNION SELECT a, q FROM walk JOIN links ON b = p)
SELECT a AS source_id, min(b) AS target_id FROM walk GROUP BY 1 HAVING min(b) < a""")
def entity_clusters(spark, d):
    return similar.clusters(similar.candidates(_people(spark, d), 85), 0.9)


@query(_MADE.replace("FROM clients", "FROM (SELECT DISTINCT client_id, name, segment FROM clients)") + """,
r AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS n FROM made WINDOW w AS (PARTITION BY id ORDER BY score DESC, candidate))
SELECT id, candidate, score, CASE WHEN next >= 0.8 AND score - next < 0.05 THEN 'CONFLICT' WHEN score >= 0.95 THEN 'CERTAIN_MERGE' WHEN score >= 0.8 THEN 'LIKELY_MERGE'
WHEN score >= 0.6 THEN 'UNCERTAIN' ELSE 'NO_MATCH' END AS decision FROM r WHERE n = 1""")
def best_matches(spark, d):
    return similar.best_matches(_people(spark, d), 85)


# chains of merges

_CHAIN = """, direct AS (SELECT 'svc-' || s_suppkey AS source, 'svc-' || (s_suppkey // 3) AS target FROM supplier WHERE s_suppkey // 3 <> s_suppkey AND s_suppkey % 5 <> 0),
walk AS (SELECT source, target FROM direct UNION SELECT walk.source, direct.target FROM walk JOIN direct ON walk.target = direct.source),
pairs AS (SELECT source, target FROM walk WHERE target NOT IN (SELECT source FROM direct)),
moved AS (SELECT coalesce(p.target, a.from_id) AS from_id, a.to_id, a.type FROM accesses a LEFT JOIN pairs p ON a.from_id = p.source)"""


def _chained(spark, d) -> tuple[DataFrame, DataFrame]:
    """A service whose number is no multiple of five becomes one with that of a third of its number, and so on."""
    entities, edges = _stored(spark, d)
    n = F.col("s_suppkey")
    up = F.floor(n / 3).cast("long")
    merges = derived.table(spark, d, "supplier").where((up != n) & (n % 5 != 0)).select(F.concat(F.lit("svc-"), n).alias("source_id"), F.concat(F.lit(
        "svc-"), up).alias("target_id"))
    return write.merge_entities(entities, edges, merges, F.expr(AT))


@query(_CHAIN + " SELECT DISTINCT from_id, to_id, type FROM moved")
def merge_chain_edges(spark, d):
    return _chained(spark, d)[1].select("from_id", "to_id", "type")


@query(_CHAIN + " SELECT id, is_active AND id NOT IN (SELECT source FROM pairs) AS is_active, (CASE WHEN is_active AND id IN (SELECT source "
    "FROM pairs) THEN 2 ELSE 1 END)::INTEGER AS version FROM services")
def merge_chain_nodes(spark, d):
    return _chained(spark, d)[0].select("id", "is_active", "version")


# substrings


@query(""", words AS (SELECT DISTINCT lower(split_part(name, ' ', -1)) AS pattern FROM clients WHERE name IS NOT NULL),
mails AS (SELECT DISTINCT email AS text FROM clients WHERE email IS NOT NULL)
SELECT text, pattern FROM mails JOIN words ON contains(text, pattern)""")
def names_in_mails(spark, d):
    c = derived.table(spark, d, "clients")
    words = c.select(F.lower(F.element_at(F.split("name", " "), -1)).alias("pattern"))
    return substring.holding(c.select(F.col("email").alias("text")), words)


@query("SELECT doc_id AS id, source FROM documents WHERE text ILIKE '%general public%' OR text ILIKE '%w1%'")
def search_index(spark, d):
    docs = derived.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    path = own_path(spark, "index")
    substring.write_index(docs, "text", path)
    found = [substring.search_index(docs, "text", path, t).select("id", "source") for t in ("General PUBLIC", "W1")]
    return found[0].unionByName(found[1]).distinct()


# coupling above a threshold, as-of joins


@query(""", r AS (SELECT DISTINCT l_partkey AS k, 'svc-' || l_suppkey AS e FROM lineitem), n AS (SELECT e, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT a.e AS left_id, b.e AS right_id, count(*) AS together FROM r a JOIN r b ON a.k = b.k AND a.e < b.e GROUP BY 1, 2)
SELECT left_id, right_id, together, round(together / (x.n + y.n - together)::DOUBLE, 6) AS coupling FROM p JOIN n x ON x.e = left_id JOIN n y ON y.e = right_id
WHERE 100 * together >= 17 * (x.n + y.n - together)""")
def change_coupling_above(spark, d):
    rows = derived.table(spark, d, "lineitem").select(F.col("l_partkey").alias("commit_id"), F.concat(F.lit("svc-"), "l_suppkey").alias("id"))
    return graph.coupled_above(rows, 17)


@query(""", s AS (SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY 1, 2)
SELECT click_id, c.client_id, c.ts, s.sale_id FROM (SELECT DISTINCT click_id, client_id, ts FROM clicks) c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts >= s.sold_at""")
def last_sale_before_click(spark, d):
    clicks = derived.table(spark, d, "clicks").select("click_id", "client_id", "ts").distinct()
    sales = derived.table(spark, d, "sales").select("client_id", F.col("sold_at").alias("ts"), "sale_id")
    found = order.asof(clicks, sales, "client_id", "ts", ["sale_id"])
    return found.select("click_id", "client_id", "ts", F.col("found.sale_id").alias("sale_id"))


# lookups that read a part


def _laid_out(spark, d) -> str:
    path = own_path(spark, "layout")
    layout.append(derived.change_log(spark, d).select("entry_id", "transaction_id", "entity_id", "mutation_type", "occurred_at"), path, "entity_id",
        "occurred_at", "transaction_id")
    return path


@query("SELECT entry_id, entity_id, occurred_at FROM change_log WHERE entity_id IN ('user-1', 'user-7', 'nobody') AND occurred_at BETWEEN "
    "TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'")
def entity_history_pruned(spark, d):
    found = layout.read(spark, _laid_out(spark, d), "entity_id", "occurred_at", ["user-1", "user-7", "nobody"], F.expr("TIMESTAMP '2024-01-05'"),
        F.expr("TIMESTAMP '2024-01-20 12:00:00'"))
    return found.select("entry_id", "entity_id", "occurred_at")


@query("SELECT entry_id, transaction_id, entity_id FROM change_log WHERE transaction_id = 'txn-3'")
def log_by_transaction_pruned(spark, d):
    return layout.read_second(spark, _laid_out(spark, d), "transaction_id", "txn-3").select("entry_id", "transaction_id", "entity_id")


@query("SELECT entity_id, count(*) AS points, max(occurred_at) AS last FROM change_log WHERE occurred_at >= TIMESTAMP '2024-01-25' GROUP BY 1")
def log_range_pruned(spark, d):
    found = layout.read(spark, _laid_out(spark, d), "entity_id", "occurred_at", start=F.expr("TIMESTAMP '2024-01-25'"))
    return found.groupBy("entity_id").agg(F.count("*").alias("points"), F.max("occurred_at").alias("last"))
