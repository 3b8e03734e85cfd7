"""The versioned store: upserts, soft deletes, the change log and its replay, search, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import json_list, json_text, owner_team

# Log entry kinds that carry a state.
STATE_KINDS = ["ENTITY_CREATED", "ENTITY_UPDATED", "ENTITY_SOFT_DELETED", "ENTITY_RESTORED"]


def upsert(current: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """The table after the upsert: new rows start at version 1, changed ones go up by one, equal ones stay as they are.

    operation tells what happened; a supplied version (column ``expected``) that isn't the current one is a conflict."""
    cur = current.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in compared], F.col("version").alias("old_version"))
    has = "expected" in new.columns
    out = cur.join(new.withColumn("__new", F.lit(True)), key, "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    known, arrives = F.col("old_version").isNotNull(), F.col("__new").isNotNull()
    clash = known & (F.coalesce(F.col("expected"), F.lit(0)) != 0) & (F.col("expected") != F.col("old_version")) if has else F.lit(False)
    op = F.when(~arrives, "KEPT").when(~known, "CREATED").when(clash, "CONFLICT").when(same, "NO_CHANGE").otherwise("UPDATED")
    out = out.withColumn("operation", op)
    take = F.col("operation").isin("CREATED", "UPDATED")
    version = F.when(F.col("operation") == "CREATED", 1).when(F.col("operation") == "UPDATED", F.col("old_version") + 1).otherwise(
        F.col("old_version"))
    return out.select(key, *[F.when(take, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in compared],
        version.cast("int").alias("version"), "operation")


def soft_delete(current: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Rows named in ids (id) become inactive with a closed interval and the next version; edges stay untouched."""
    marked = current.join(ids.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    hit = F.col("__gone").isNotNull() & F.col("is_active")
    op = F.when(hit, "DELETED").when(F.col("__gone").isNotNull(), "NO_CHANGE").otherwise("KEPT")
    return marked.withColumns(
        {"operation": op, "valid_to": F.when(hit, at).otherwise(F.col("valid_to")),
            "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")), "is_active": F.col("is_active") & ~hit}).drop("__gone")


def rejected_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end that no entity, active or not, has."""
    known = entities.select("id")
    lost = relationships.join(known.toDF("from_id"), "from_id", "left_anti")
    rest = relationships.join(known.toDF("from_id"), "from_id", "left_semi").join(known.toDF("to_id"), "to_id", "left_anti")
    return lost.unionByName(rest)


def page(limit: int | None) -> int:
    """How many entries a page has: 100 where no number is given, or one that isn't in 1..1000."""
    return limit if limit is not None and 0 < limit <= 1000 else 100


def read_log(log: DataFrame, from_entry: int | None = None, entity_id: str | None = None, transaction_id: str | None = None,
    limit: int | None = None, relationship_id: str | None = None) -> DataFrame:
    """The entries that match all that is given, in their order where limit makes a page of them."""
    for c, v in (("entity_id", entity_id), ("relationship_id", relationship_id), ("transaction_id", transaction_id)):
        if v is not None:
            log = log.where(F.col(c) == v)
    if from_entry is not None:
        log = log.where(F.col("entry_id") >= from_entry)
    return log.orderBy("entry_id").limit(limit) if limit else log


def replay(log: DataFrame, until: Column | None = None, last_entry: int | None = None) -> DataFrame:
    """The state of every entity after the log (up to a time or entry): its last entry's; one pass, no sort."""
    rows = log.where(F.col("mutation_type").isin(STATE_KINDS))
    if until is not None:
        rows = rows.where(F.col("occurred_at") <= until)
    if last_entry is not None:
        rows = rows.where(F.col("entry_id") <= last_entry)
    last = F.max_by(F.struct("mutation_type", "state", "occurred_at"), "entry_id")
    out = rows.groupBy("entity_id").agg(last.alias("x"), F.max("entry_id").alias("entry_id"), F.count("*").alias("version"))
    return out.select("entity_id", "entry_id", "version", (F.col("x.mutation_type") != "ENTITY_SOFT_DELETED").alias("is_active"),
        F.col("x.state").alias("state"), F.col("x.occurred_at").alias("occurred_at"))


def evolution(log: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """How often each kind of change happened in [start, end], in one row."""
    if start is not None:
        log = log.where(F.col("occurred_at") >= start)
    if end is not None:
        log = log.where(F.col("occurred_at") <= end)
    kinds = {"entities_created": "ENTITY_CREATED", "entities_updated": "ENTITY_UPDATED", "entities_deleted": "ENTITY_SOFT_DELETED",
        "relationships_created": "RELATIONSHIP_CREATED", "relationships_updated": "RELATIONSHIP_UPDATED",
        "relationships_deleted": "RELATIONSHIP_DELETED"}
    return log.agg(*[F.count_if(F.col("mutation_type") == v).alias(k) for k, v in kinds.items()], F.count("*").alias("total"))


def by_name(entities: DataFrame) -> DataFrame:
    """The latest active entity of every namespace and name."""
    w = Window.partitionBy("namespace", "canonical_name").orderBy(F.desc("updated_at"), "id")
    return entities.where("is_active").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def search(docs: DataFrame, text: str | None = None, limit: int | None = None, **facets) -> DataFrame:
    """Documents that match all given facets exactly and hold text in their name, aliases or tags, in any ASCII case; with a limit,
    the first by name."""
    for c, v in facets.items():
        docs = docs.where(F.col(c) == v)
    if text:
        found = F.lit(False)
        for c in ("canonical_name", "aliases", "tags"):
            if c in docs.columns:
                found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        docs = docs.where(found)
    return docs.orderBy("canonical_name", *(["id"] if "id" in docs.columns else [])).limit(limit) if limit else docs


def search_documents(entities: DataFrame) -> DataFrame:
    """What is searched of each entity (id, type, sub_type, canonical_name, namespace, is_active, properties as JSON). A view: nothing is
    queued, so nothing is lost."""
    text = lambda k: json_text(F.col("properties"), k)
    listed = lambda k: json_list(F.col("properties"), k)
    return entities.select(
        F.col("id").alias("entity_id"), "canonical_name", listed("aliases").alias("aliases"), F.col("type").alias("entity_type"), "sub_type", "namespace", owner_team(F.col("properties")).alias("owner_team"),
        text("criticality").alias("criticality"), text("maturity").alias("maturity"), text("velocity").alias("velocity"), "is_active", listed("architectural_smells").alias("architectural_smells"), listed("tags").alias("tags"),
    )


def search_entities(entities: DataFrame, text: str | None = None, limit: int | None = None, **facets) -> DataFrame:
    """The entities whose search documents match, by name."""
    found = search(search_documents(entities).withColumnRenamed("entity_id", "id"), text, limit, **facets)
    return entities.join(found.select("id"), "id", "left_semi")


def listing(entities: DataFrame, namespace: str, limit: int | None = None) -> DataFrame:
    """Active entities of a namespace; with a limit, the first by name."""
    own = entities.where(F.col("is_active") & (F.col("namespace") == namespace))
    return own.orderBy("canonical_name", "id").limit(limit) if limit else own


def namespaces(entities: DataFrame) -> DataFrame:
    """Each namespace and how many entities it has."""
    return entities.groupBy("namespace").agg(F.count("*").alias("n"))


def metrics_range(metrics: DataFrame, start: Column | None = None, end: Column | None = None, now: Column | None = None) -> DataFrame:
    """Points (of entities or of relationships) in [start, end]: up to now, and from a day before the end, where they are not given."""
    end = end if end is not None else now if now is not None else F.current_timestamp()
    start = start if start is not None else end - F.expr("INTERVAL 24 HOURS")
    return metrics.where(F.col("at").between(start, end))


def with_latest_metrics(entities: DataFrame, metrics: DataFrame) -> DataFrame:
    """Entities with metrics_summary, their last point, or null."""
    last = latest_metrics(metrics).select(F.col("entity_id").alias("id"), F.struct("at", "value").alias("metrics_summary"))
    return entities.join(last, "id", "left")


def rollup(metrics: DataFrame, unit: str) -> DataFrame:
    """Points, their sum (a decimal, so that no level rounds), largest and smallest by entity and unit of time (minute, hour, day, month);
    rolls up its own results too."""
    again = "points" in metrics.columns
    points = F.sum("points") if again else F.count("*")
    total = F.col("total") if again else F.col("value").cast("decimal(28,12)")
    largest, smallest = ("largest", "smallest") if again else ("value", "value")
    return metrics.groupBy("entity_id", F.date_trunc(unit, "at").alias("at")).agg(points.alias("points"), F.sum(total).cast(
        "decimal(38,12)").alias("total"), F.max(largest).alias("largest"), F.min(smallest).alias("smallest"))


def sketch(metrics: DataFrame, unit: str, accuracy: float = 0.01) -> DataFrame:
    """entity_id, at, sign, bucket, n: how many values of an entity and unit of time lie in each bucket, whose bounds grow by a constant
    factor, so that a bucket's middle lies within ``accuracy`` (relative) of all its values. Rolls up its own results too, without any
    further error; null values and NaN are left out. An entity has as many rows as its values' orders of magnitude need, not
    as it has points."""
    if "bucket" in metrics.columns:
        rows, n = metrics, F.sum("n")
    else:
        base = math.log((1 + accuracy) / (1 - accuracy))
        v = F.col("value")
        rows = metrics.where(v.isNotNull() & ~F.isnan(v)).withColumns({"sign": F.signum(v).cast("int"), "bucket": F.when(v == 0, 0).otherwise(
            F.ceil(F.log(F.abs(v)) / base)).cast("int")})
        n = F.count("*")
    return rows.groupBy("entity_id", F.date_trunc(unit, "at").alias("at"), "sign", "bucket").agg(n.alias("n"))


def sketch_quantiles(sketches: DataFrame, shares: list[float], accuracy: float = 0.01) -> DataFrame:
    """entity_id, at, share, points, estimate: the value at each share (the smallest that so many are not over), within ``accuracy`` of
    it; sketches of the same accuracy."""
    factor = (1 + accuracy) / (1 - accuracy)
    value = F.col("sign") * 2 * F.pow(F.lit(factor), "bucket") / (factor + 1)
    whole = Window.partitionBy("entity_id", "at")
    ranked = sketches.withColumn("estimate", value).withColumns({"upto": F.sum("n").over(whole.orderBy("estimate").rowsBetween(
        Window.unboundedPreceding, 0)), "points": F.sum("n").over(whole)})
    wanted = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share")
        * F.col("points"))))
    return wanted.where("upto - n < rank AND rank <= upto").select("entity_id", "at", "share", "points", "estimate")


def exact_quantiles(metrics: DataFrame, unit: str, shares: list[float]) -> DataFrame:
    """The same from all points: entity_id, at, share, points, exact."""
    v = F.col("value")
    rows = metrics.where(v.isNotNull() & ~F.isnan(v)).groupBy("entity_id", F.date_trunc(unit, "at").alias("at")).agg(F.count("*").alias("points"),
        F.array(*(F.struct(F.lit(q).alias("share"), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias("exact")) for q in
            shares)).alias("q"))
    return rows.select("entity_id", "at", "points", F.explode("q").alias("q")).select("entity_id", "at", "q.share", "points", "q.exact")


def moving(metrics: DataFrame, points: int = 5, sigmas: float = 3.0) -> DataFrame:
    """Each point with the mean of its entity's last points before it (recent), the change since the last, and whether it lies more than
    so many deviations from the mean."""
    w = Window.partitionBy("entity_id").orderBy("at", "event_id")
    back = w.rowsBetween(-points, -1)
    mean, sd = F.avg("value").over(back), F.stddev_pop("value").over(back)
    odd = F.coalesce(F.abs(F.col("value") - mean) > sigmas * sd, F.lit(False)) & (F.count("value").over(back) >= points)
    return metrics.select("entity_id", "at", "value", F.round(mean, 4).alias("recent"),
        F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"), odd.alias("anomaly"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Each entity's last point: max_by, so no sort and a combining first step."""
    return metrics.groupBy("entity_id").agg(F.max_by(F.struct("at", "value", "event_id"), F.struct("at", "event_id")).alias("x")).select(
        "entity_id", "x.*")


def _last_spans(spans: DataFrame, same_trace: bool, order: str | None) -> DataFrame:
    """One span an id: the last by ``order`` (without it, by the largest service name)."""
    key = ["trace_id", "span_id"] if same_trace else ["span_id"]
    by = F.struct(*([order] if order else []), "service_name")
    return spans.groupBy(*key).agg(F.max_by("service_name", by).alias("caller")).withColumnRenamed("span_id", "parent_span_id")


def span_calls(spans: DataFrame, same_trace: bool = False, order: str | None = None) -> DataFrame:
    """Distinct calls between services whose spans are parent and child. Of spans with one id the last is the parent."""
    child = spans.where("parent_span_id IS NOT NULL").select("parent_span_id", F.col("service_name").alias("callee"),
        *(["trace_id"] if same_trace else [])).distinct()
    joined = child.join(_last_spans(spans, same_trace, order), ["parent_span_id", *(["trace_id"] if same_trace else [])])
    return joined.where("caller <> callee AND caller <> '' AND callee <> ''").select("caller", "callee").distinct()


def edge_stats(spans: DataFrame, width: str = "5 minutes", order: str | None = None) -> DataFrame:
    """Calls, median and 99th percentile of the value and the share of errors for each calling pair and window."""
    child = spans.where("parent_span_id IS NOT NULL").select("parent_span_id", F.col("service_name").alias("callee"), "ts", "value",
        "is_error")
    joined = child.join(_last_spans(spans, False, order), "parent_span_id").where("caller <> callee AND caller <> '' AND callee <> ''")
    part = lambda p: F.percentile_approx("value", p, 10_000)
    out = joined.groupBy("caller", "callee", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"), part(0.5).alias("p50"),
        part(0.99).alias("p99"), F.round(F.avg(F.col("is_error").cast("int")), 6).alias("error_rate"))
    return out.select("caller", "callee", F.col("w.start").alias("window_start"), "calls", "p50", "p99", "error_rate")


def span_stats(spans: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Calls, mean and largest value for each service and window."""
    out = spans.groupBy("service_name", F.window("ts", width).alias("w")).agg(F.count("*").alias("calls"),
        F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest"))
    return out.select("service_name", F.col("w.start").alias("window_start"), "calls", "total", "largest")


def run_status(failed: Column, emitted: Column) -> Column:
    return F.when((failed > 0) & (emitted > 0), "partial").when(failed > 0, "failed").otherwise("success")


def staleness(ledger: DataFrame, now: Column) -> DataFrame:
    """Per source its last status and the seconds since its last success (0: none)."""
    last = F.max(F.when(F.col("status") == "success", F.col("completed_at")))
    out = ledger.groupBy("source_id").agg(F.max_by("status", F.struct("completed_at", "run_id")).alias("last_status"),
        last.alias("last_success"))
    return out.withColumn("age_seconds", F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last_success"), F.lit(0)))


def graph_diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """ADDED, REMOVED and CHANGED rows between two graph states."""
    a, b = (df.select(F.col(key), F.struct(*compared).alias(n)) for df, n in ((old, "x"), (new, "y")))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("x").isNull(), "ADDED").when(F.col("y").isNull(), "REMOVED").when(~F.col("x").eqNullSafe(F.col("y")), "CHANGED")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "change")
