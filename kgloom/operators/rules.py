"""Scores and rules on records: match scores, acceptance bands, drift, velocity over time, consistency and semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Over which confidence an inference is accepted, and from which it is reviewed.
BANDS = {"STRUCTURAL_DIRECT": (0.85, 0.60), "STRUCTURAL_TRANSITIVE": (0.80, 0.50), "RUNTIME": (0.90, 0.70), "TEMPORAL_CHANGE": (0.80, 0.60),
    "TEMPORAL_FAILURE": (0.75, 0.55)}
# Weights of the partial match scores, and the decisions by score.
MATCH_WEIGHTS = {"exact": 0.40, "structural": 0.25, "fuzzy": 0.15, "cooccurrence": 0.12, "temporal": 0.08}
DECISIONS = [("CERTAIN_MERGE", 0.95), ("LIKELY_MERGE", 0.80), ("UNCERTAIN", 0.60)]
# Who wins, from the last to the first.
ANNOTATION_ORDER = ["default", "inferred", "runtime", "manual"]


def band(kind: Column, confidence: Column) -> Column:
    """ACCEPT, REVIEW or REJECT; null for a kind without bands."""
    out = F.lit(None).cast("string")
    for k, (accept, review) in BANDS.items():
        out = F.when(kind == k, F.when(confidence > accept, "ACCEPT").when(confidence >= review, "REVIEW").otherwise("REJECT")).otherwise(
            out)
    return out


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, less by each edit as a part of the longer name, 0 at the least."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def exact_score(pairs: DataFrame) -> Column:
    """pairs hold a and b: structs of name, namespace, type, source_ref."""
    one = lambda c, v: F.when(pairs[f"a.{c}"] == pairs[f"b.{c}"], v).otherwise(0.0)
    return one("name", 0.50) + one("namespace", 0.20) + one("type", 0.15) + one("source_ref", 0.15)


def fuzzy_score(a: Column, b: Column, a_aliases: Column, b_aliases: Column) -> Column:
    """Names up to 0.30, namespaces up to 0.15, a common alias 0.20, a common beginning or end of three letters 0.10."""
    ends = (F.left(a["name"], F.lit(3)) == F.left(b["name"], F.lit(3))) | (F.right(a["name"], F.lit(3)) == F.right(b["name"], F.lit(3)))
    return 0.30 * name_similarity(a["name"], b["name"]) + 0.15 * name_similarity(a["namespace"], b["namespace"]) + F.when(
        F.arrays_overlap(a_aliases, b_aliases), 0.20).otherwise(0.0) + F.when(ends, 0.10).otherwise(0.0)


def structural_score(endpoints: Column, tables: Column, dependencies: Column, same_target: Column) -> Column:
    """From numbers of common endpoints, tables and dependencies, and whether both are deployed to one place; 0.80 at most."""
    return F.least(F.lit(0.80), 0.30 * endpoints + 0.25 * tables + 0.20 * dependencies + F.when(same_target, 0.15).otherwise(0.0))


def cooccurrence_score(traces: Column, deploys: Column, incidents: Column, commits: Column) -> Column:
    """From flags of always occurring together; 0.60 at most."""
    return F.least(F.lit(0.60),
        sum((F.when(c, v).otherwise(0.0) for c, v in ((traces, 0.25), (deploys, 0.20), (incidents, 0.15), (commits, 0.15))), F.lit(0.0)))


def temporal_score(same_start: Column, after_rename: Column, replaced: Column) -> Column:
    return F.least(F.lit(0.40),
        sum((F.when(c, v).otherwise(0.0) for c, v in ((same_start, 0.15), (after_rename, 0.25), (replaced, 0.20))), F.lit(0.0)))


def match_score(**scores: Column) -> Column:
    """The weighted sum; missing parts count nothing."""
    return F.round(sum((scores[k] * v for k, v in MATCH_WEIGHTS.items() if k in scores), F.lit(0.0)), 6)


def match_decision(score: Column) -> Column:
    out = F.lit("NO_MATCH")
    for name, least in reversed(DECISIONS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def best_candidates(scored: DataFrame, close: float = 0.05) -> DataFrame:
    """Each id's best candidate (id, candidate, score) and decision; CONFLICT where the next one is about as good and both would
    merge."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "candidate")
    ranked = scored.withColumns({"n": F.row_number().over(w), "next": F.lead("score").over(w)}).where("n = 1")
    clash = (F.col("next") >= DECISIONS[1][1]) & (F.col("score") - F.col("next") < close)
    return ranked.select("id", "candidate", "score",
        F.when(F.coalesce(clash, F.lit(False)), "CONFLICT").otherwise(match_decision(F.col("score"))).alias("decision"))


def ownership_drift(contributions: DataFrame, share: float = 0.5) -> DataFrame:
    """id, owner, top_team, top_share, drift: whether another team than the declared owner made most of the commits.

    contributions: id, owner, team, commits."""
    by = contributions.groupBy("id", "owner", "team").agg(F.sum("commits").alias("c"))
    out = by.groupBy("id", "owner").agg(F.max_by("team", F.struct("c", "team")).alias("top_team"), F.max("c").alias("most"),
        F.sum("c").alias("all"))
    top = F.col("most") / F.col("all")
    return out.select("id", "owner", "top_team", F.round(top, 6).alias("top_share"),
        ((F.col("top_team") != F.col("owner")) & (top > share)).alias("drift"))


def weekly_velocity(commits: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """id, per_week, volatility (deviation of the weekly numbers, weeks without commits included), velocity of the last days.

    commits: id, at. FROZEN: none in that time; else HOT over 10 a week, ACTIVE from 2, STABLE below."""
    weeks = days / 7.0
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("at")) / (7 * 86400))
    recent = (F.col("at") <= now) & (F.unix_timestamp(now) - F.unix_timestamp("at") < days * 86400)
    # the sum of squares of a few weekly numbers needs no row for an empty week
    weekly = commits.select("id", F.when(recent, age).alias("week")).groupBy("id", "week").agg(F.count("*").alias("n"))
    n = F.coalesce(F.sum(F.when(F.col("week").isNotNull(), F.col("n"))), F.lit(0))
    squares = F.coalesce(F.sum(F.when(F.col("week").isNotNull(), F.col("n") * F.col("n"))), F.lit(0))
    out = weekly.groupBy("id").agg(n.alias("n"), squares.alias("s"))
    full = -(-days // 7)
    mean = F.col("n") / full
    rate = F.col("n") / weeks
    speed = F.when(F.col("n") == 0, "FROZEN").when(rate > 10, "HOT").when(rate >= 2, "ACTIVE").otherwise("STABLE")
    return out.select("id", F.round(rate, 6).alias("per_week"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("s") / full - mean * mean)), 6).alias("volatility"), speed.alias("velocity"))


def strongest_annotation(annotations: DataFrame) -> DataFrame:
    """One value for each (id, key): manual before runtime before inferred before default, the latest of equals.

    annotations: id, key, value, origin, at."""
    rank = F.coalesce(*[F.when(F.col("origin") == o, k) for k, o in enumerate(ANNOTATION_ORDER)], F.lit(-1))
    return annotations.withColumn("r", rank).groupBy("id", "key").agg(
        F.max_by(F.struct("value", "origin"), F.struct("r", "at", "value")).alias("b")).select("id", "key", "b.value", "b.origin")


def consistency(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """proposed (id, type, confidence, owner) with rule, action: CON-001 a changed type is rejected, CON-002 a lower confidence keeps what
    is stored, CON-003 another owner at a lower confidence keeps the owner; else null and APPLY."""
    cur = current.select("id", F.col("type").alias("old_type"), F.col("confidence").alias("old_confidence"),
        F.col("owner").alias("old_owner"))
    p = proposed.join(cur, "id", "left")
    lower = F.col("confidence") < F.col("old_confidence")
    rule = F.when(F.col("old_type") != F.col("type"), "CON-001").when(lower & (F.col("old_owner") != F.col("owner")), "CON-003").when(lower,
        "CON-002")
    return p.withColumn("rule", rule).withColumn("action",
        F.when(F.col("rule") == "CON-001", "REJECT").when(F.col("rule").isNotNull(), "KEEP").otherwise("APPLY")).drop("old_type",
        "old_confidence", "old_owner")


def semantics(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (id, type, from_id, to_id) with rule, action: SEM-001 only teams own services, SEM-002 functions aren't deployed on
    infrastructure, SEM-003 two that depend on each other, SEM-005 a dependency on what is deprecated, CON-004 an OWNS edge the
    wrong way round; else null and ACCEPT. entities: id, type, lifecycle_stage."""
    a = entities.select(F.col("id").alias("from_id"), F.col("type").alias("from_type"))
    b = entities.select(F.col("id").alias("to_id"), F.col("type").alias("to_type"), F.col("lifecycle_stage").alias("to_stage"))
    back = edges.where("type = 'DEPENDS_ON'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"),
        F.lit("DEPENDS_ON").alias("type"), F.lit(True).alias("mutual")).distinct()
    e = edges.join(a, "from_id", "left").join(b, "to_id", "left").join(back, ["from_id", "to_id", "type"], "left")
    t = F.col("type")
    owns = t == "OWNS"
    rule = (
        F.when(owns & (F.col("from_type") == "SERVICE") & (F.col("to_type") == "TEAM"), "CON-004").when(owns & ~((F.col("from_type") == "TEAM") & (F.col("to_type") == "SERVICE")), "SEM-001")
        .when((t == "DEPLOYED_ON") & (F.col("from_type") == "FUNCTION") & (F.col("to_type") == "INFRASTRUCTURE_RESOURCE"), "SEM-002")
        .when(F.col("mutual"), "SEM-003").when((t == "DEPENDS_ON") & (F.col("to_stage") == "DEPRECATED"), "SEM-005")
    )
    action = F.when(F.col("rule").isin("CON-004", "SEM-001", "SEM-002"), "REJECT").when(F.col("rule").isNotNull(), "FLAG").otherwise(
        "ACCEPT")
    return e.withColumn("rule", rule).withColumn("action", action).select(*edges.columns, "rule", "action")


def orphan_edges(edges: DataFrame, services: DataFrame, reach: DataFrame) -> DataFrame:
    """SEM-004: edges of which neither end is a service or reaches one (reach: node, of those that do)."""
    fine = services.select("id").unionByName(reach.select(F.col("node").alias("id"))).distinct()
    return edges.join(fine.toDF("from_id"), "from_id", "left_anti").join(fine.toDF("to_id"), "to_id", "left_anti").select(*edges.columns)


def type_counts(entities: DataFrame) -> DataFrame:
    """services, tables and all entities, in one row."""
    return entities.agg(F.count_if(F.col("type") == "SERVICE").alias("services"),
        F.count_if(F.col("type") == "DATABASE_TABLE").alias("tables"), F.count("*").alias("entities"))


def drift_alerts(log: DataFrame, kind: str = "RUNTIME_CALLS") -> DataFrame:
    """An alert for each edge of that kind that was created: entry_id, relationship_id, severity."""
    hit = (F.col("mutation_type") == "RELATIONSHIP_CREATED") & (F.get_json_object("after_state", "$.type") == kind)
    return log.where(hit).select("entry_id", "relationship_id", F.lit("HIGH").alias("severity"))
