"""A software graph derived from the business tables, for queries and their SQL.

Suppliers are services (namespace: their region, owner: their nation's team), parts are database tables, line items
are reads and writes, suppliers that share an order call each other (all pairs of them), events are the change log and the
metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.session import dealt, once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region,
        F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.concat(F.lit("svc-"), "s_suppkey").alias("id"), F.lit("SERVICE").alias("type"), F.lit("").alias("sub_type"), F.col("s_name").alias("canonical_name"), F.lower("r_name").alias("namespace"),
        F.round((F.col("s_suppkey") % 50 + 50) / 100.0, 6).alias("confidence"), (F.col("s_acctbal") >= 0).alias("is_active"), F.concat(F.lit("team-"), "n_nationkey").alias("owner"), F.col("s_acctbal").alias("balance"),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("tbl-"), "p_partkey").alias("id"), F.lit("DATABASE_TABLE").alias("type"), F.lit("").alias("sub_type"), F.col("p_name").alias("canonical_name"), F.lit("data").alias("namespace"),
        F.lit(0.9).alias("confidence"), F.lit(True).alias("is_active"),
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct reads and writes of tables by services."""
    kind = F.when(F.col("l_returnflag") == "R", "WRITES_TO").otherwise("READS_FROM")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("svc-"), "l_suppkey").alias("from_id"),
        F.concat(F.lit("tbl-"), "l_partkey").alias("to_id"), kind.alias("type")).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of suppliers in an order, from the earlier line to the later, by the later line's kind: parallel edges of
    several types, loops, and edges that are inactive as no earlier line is open. Written once a session and folder, as all that
    follows reads it."""
    return once(spark, f"calls {sf_dir}", lambda: _calls(spark, sf_dir))


#: Of a call's later line, by its number in ``_calls``.
CALL_KINDS = ("CALLS", "RUNTIME_CALLS", "IMPORTS", "DEPENDS_ON")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines meet by orders and pairs by their later end (and an eighth of the earlier ones, so that a hub is not one task's), in parts
    that counts make small; flags are numbers until the pairs are counted."""
    lines = table(spark, sf_dir, "lineitem")
    sizes = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.expr(
        "n * (n - 1) div 2")), F.lit(0)).alias("pairs")).first()
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_linestatus") == "F", 2).otherwise(3)
    one = lines.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("a"), F.col("l_linenumber").alias("i"), (F.col("l_linestatus") == "O").alias("open"))
    two = lines.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("j"), kind.alias("kind"))
    met = dealt(one, sizes["rows"], "k").join(dealt(two, sizes["rows"], "k"), "k").where("i < j").select("a", "b", "kind", "open", F.expr(
        "pmod(a, 8)").alias("eighth"))
    pairs = dealt(met, sizes["pairs"], "b", "eighth").groupBy("b", "eighth", "a", "kind").agg(F.count("*").alias("n"), F.bool_or("open").alias("is_active"))
    confidence = F.round(0.5 + 0.05 * F.least("n", F.lit(10)), 6)
    return pairs.select(F.concat(F.lit("svc-"), "a").alias("from_id"), F.concat(F.lit("svc-"), "b").alias("to_id"), F.get(F.array(*map(F.lit,
        CALL_KINDS)), F.col("kind")).alias("type"), confidence.alias("confidence"), "is_active")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries: a user's rows are one entity's."""
    kind = F.when(F.col("event_type") == "signup", "ENTITY_CREATED").when(F.col("event_type") == "error", "ENTITY_SOFT_DELETED").when(
        F.col("event_type") == "purchase", "RELATIONSHIP_CREATED").otherwise("ENTITY_UPDATED")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("entry_id"), F.concat(F.lit("txn-"), F.floor(F.col("event_id") / 10)).alias("transaction_id"), kind.alias("mutation_type"), F.concat(F.lit("user-"), "user_id").alias("entity_id"),
        F.col("value").alias("state"), F.col("props").alias("after_state"), F.col("ts").alias("occurred_at"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), "user_id").alias("entity_id"), F.col("ts").alias("at"),
        F.col("value"), F.col("event_id"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order, each the child of the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"),
        F.lag("event_id").over(w).alias("parent_span_id"), F.col("event_type").alias("service_name"), "ts", "value")


#: The same derivation for DuckDB.
SQL = """WITH RECURSIVE
services AS (SELECT 'svc-' || s_suppkey AS id, 'SERVICE' AS type, '' AS sub_type, s_name AS canonical_name, lower(r_name) AS namespace,
  round((s_suppkey % 50 + 50) / 100.0, 6)::DOUBLE AS confidence, s_acctbal >= 0 AS is_active, 'team-' || n_nationkey AS owner, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tables_ AS (SELECT 'tbl-' || p_partkey AS id, 'DATABASE_TABLE' AS type, p_name AS canonical_name, 'data' AS namespace FROM part),
accesses AS (SELECT DISTINCT 'svc-' || l_suppkey AS from_id, 'tbl-' || l_partkey AS to_id, CASE WHEN l_returnflag = 'R' THEN 'WRITES_TO' ELSE 'READS_FROM' END AS type FROM lineitem),
calls AS (SELECT 'svc-' || a AS from_id, 'svc-' || b AS to_id, type, round(0.5 + 0.05 * least(n, 10), 6)::DOUBLE AS confidence, is_active FROM (
  SELECT x.l_suppkey AS a, y.l_suppkey AS b, CASE WHEN y.l_returnflag = 'A' THEN 'CALLS' WHEN y.l_returnflag = 'N' THEN 'RUNTIME_CALLS' WHEN y.l_linestatus = 'F' THEN 'IMPORTS' ELSE 'DEPENDS_ON' END AS type,
    count(*) AS n, bool_or(x.l_linestatus = 'O') AS is_active FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY 1, 2, 3)),
live AS (SELECT * FROM calls WHERE is_active),
change_log AS (SELECT event_id AS entry_id, 'txn-' || (event_id // 10) AS transaction_id,
  CASE event_type WHEN 'signup' THEN 'ENTITY_CREATED' WHEN 'error' THEN 'ENTITY_SOFT_DELETED' WHEN 'purchase' THEN 'RELATIONSHIP_CREATED' ELSE 'ENTITY_UPDATED' END AS mutation_type,
  'user-' || user_id AS entity_id, value AS state, props AS after_state, ts AS occurred_at FROM events),
spans AS (SELECT user_id AS trace_id, event_id AS span_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_span_id, event_type AS service_name, ts, value FROM events)
"""
