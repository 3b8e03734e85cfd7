"""Single-pass operators on entity and relationship records: validation, resolution, inference, merging, enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import json_text, json_true, normalize_name
from kgloom.session import counted, cut, dealt

from . import catalogs, pairs
from .order import numbered


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _first(*rules: tuple[Column, str]) -> Column:
    """The field of the first failing rule; null where all hold."""
    out = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(out)
    return out


def observed_entity_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("error_field", _first(
        (_blank("id"), "id"), (~F.col("type").isin(catalogs.OBSERVED_ENTITY_TYPES), "type"), (_blank("name"), "name"), (_blank("namespace"), "namespace"),
        (~F.col("confidence").between(0, 1), "confidence"), (_blank("source_type"), "source_type"), (_blank("source_id"), "source_id"), (F.col("observed_at").isNull(), "observed_at"), (_blank("ingestion_run_id"), "ingestion_run_id"),
    ))


def observed_relationship_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("error_field", _first(
        (_blank("id"), "id"), (~F.col("type").isin(catalogs.OBSERVED_RELATIONSHIP_TYPES), "type"), (_blank("from_id"), "from_id"), (_blank("to_id"), "to_id"), (F.col("from_id") == F.col("to_id"), "to_id"),
        (~F.col("confidence").between(0, 1), "confidence"), (_blank("source_type"), "source_type"), (F.col("observed_at").isNull(), "observed_at"), (_blank("ingestion_run_id"), "ingestion_run_id"),
    ))


def stored_entity_errors(df: DataFrame, most_properties: int = 500) -> DataFrame:
    too_many = F.coalesce(F.size(F.json_object_keys("properties")) > most_properties, F.lit(False))
    return df.withColumn("error_field", _first(
        (~F.col("type").isin(catalogs.STORED_ENTITY_TYPES), "type"), (_blank("canonical_name") | (F.octet_length("canonical_name") > 256), "canonical_name"), (_blank("namespace"), "namespace"),
        (~F.col("confidence").between(0, 1), "confidence"), (F.col("valid_from").isNull(), "valid_from"), (F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False)), "valid_to"), (too_many, "properties"),
    ))


def stored_relationship_errors(df: DataFrame, most_properties: int = 200) -> DataFrame:
    too_many = F.coalesce(F.size(F.json_object_keys("properties")) > most_properties, F.lit(False))
    return df.withColumn("error_field", _first(
        (~F.col("type").isin(catalogs.STORED_RELATIONSHIP_TYPES), "type"), (_blank("from_id"), "from_id"), (_blank("to_id") | (F.col("from_id") == F.col("to_id")), "to_id"),
        (~F.col("confidence").between(0, 1), "confidence"), (F.col("valid_from").isNull(), "valid_from"), (F.coalesce(F.col("valid_to") < F.col("valid_from"), F.lit(False)), "valid_to"), (too_many, "properties"),
    ))


def classify_sub_type(df: DataFrame) -> DataFrame:
    """A service that faces clients is a BFF, any other a MICROSERVICE; other types keep theirs."""
    name = F.col("canonical_name")
    front = name.endswith("-bff") | name.contains("gateway") | json_true(F.col("properties"), "exposed_to_internet")
    return df.withColumn("sub_type",
        F.when(F.col("type") == "SERVICE", F.when(front, "BFF").otherwise("MICROSERVICE")).otherwise(F.col("sub_type")))


def normalize(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_name", F.col("canonical_name")).withColumn("canonical_name", normalize_name(F.col("canonical_name")))


def resolve(observed: DataFrame, registry: DataFrame, match_type: bool = False) -> DataFrame:
    """canonical_id by id, else (name, namespace), else an alias equal to the name, else to the raw name, else the own id.

    observed: id, type, name, raw_name, namespace. registry: canonical_id, type, name, namespace, aliases (array)."""
    kind = (lambda x: ["type"] if match_type else [])(0)
    by_id = registry.select(F.col("canonical_id").alias("id"), F.col("canonical_id").alias("c1"))
    by_name = registry.groupBy("name", "namespace", *kind).agg(F.min("canonical_id").alias("c2"))
    alias = registry.select("canonical_id", "namespace", *kind, F.explode("aliases").alias("alias")).groupBy("alias", "namespace",
        *kind).agg(F.min("canonical_id").alias("c"))
    out = observed.join(by_id, "id", "left").join(by_name, ["name", "namespace", *kind], "left")
    out = out.join(alias.withColumnsRenamed({"alias": "name", "c": "c3"}), ["name", "namespace", *kind], "left")
    out = out.join(alias.withColumnsRenamed({"alias": "raw_name", "c": "c4"}), ["raw_name", "namespace", *kind], "left")
    how = F.when(F.col("c1").isNotNull(), "id").when(F.col("c2").isNotNull(), "name").when(F.col("c3").isNotNull(), "alias").when(
        F.col("c4").isNotNull(), "raw_alias").otherwise("new")
    return out.withColumn("canonical_id", F.coalesce("c1", "c2", "c3", "c4", "id")).withColumn("matched_by", how).drop("c1", "c2", "c3",
        "c4")


def remap_endpoints(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Endpoints by the map (old_id, new_id); unknown ones stay."""
    one, two = ids.toDF("from_id", "new_from"), ids.toDF("to_id", "new_to")
    out = relationships.join(one, "from_id", "left").join(two, "to_id", "left")
    return out.withColumn("from_id", F.coalesce("new_from", "from_id")).withColumn("to_id", F.coalesce("new_to", "to_id")).drop("new_from",
        "new_to")


def infer_from_imports(relationships: DataFrame) -> DataFrame:
    """A dependency at nine tenths of each import's confidence."""
    found = relationships.where("type = 'IMPORTS'")
    return found.withColumns({"type": F.lit("DEPENDS_ON"), "confidence": F.round(F.col("confidence") * 0.9, 6), "is_inferred": F.lit(True)})


def with_inferred(relationships: DataFrame, accesses: DataFrame | None = None) -> DataFrame:
    """Explicit relationships, the dependencies that their imports make, and the couplings over shared tables."""
    out = relationships.unionByName(infer_from_imports(relationships), allowMissingColumns=True)
    if accesses is not None:
        out = out.unionByName(infer_shared_resources(accesses).select("from_id", "to_id", "type", "confidence", "is_inferred"),
            allowMissingColumns=True)
    return out


def infer_shared_resources(accesses: DataFrame, salt_rows: int = 10_000) -> DataFrame:
    """Reader and writer of one table are coupled: from_id (reader), to_id (writer), shared (how many tables), shared_table (the first).

    Readers and writers are numbered. A table's writers are packed into lists of about 1,000 numbers and meet its readers there; what is dealt to
    the readers is a list for each table read, not a row for each pair, and pairs are made and counted where the lists arrive, in parts that
    counts make small (``pairs``). The readers of a table are split by salts of about ``salt_rows`` rows, each with a copy of its writers, and the
    lists of readers of very many tables by slots of writers, so neither a table that everyone reads nor who reads everything is one task's."""
    own = accesses.where("type IN ('READS_FROM', 'WRITES_TO') AND from_id IS NOT NULL AND to_id IS NOT NULL").select("to_id", "from_id", (F.col("type")
        == "WRITES_TO").alias("writes"))
    who = own.groupBy("from_id").agg(F.count_if(~F.col("writes")).alias("reads"))
    who = cut(numbered(who, "n", "from_id").withColumn("n", F.col("n").cast("int")))
    names = counted(who.select("n", "from_id"))
    own = cut(own.join(names, "from_id").select("to_id", "n", "writes").distinct())
    sizes = cut(own.groupBy("to_id").agg(F.count_if(~F.col("writes")).alias("r"), F.count_if("writes").alias("w")).where("r > 0 AND w > 0"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = sizes.agg(zero(F.sum("r")).alias("rows"), zero(F.sum(F.expr("r * w"))).alias("pairs"), zero(F.max("r")).alias("top")).first()
    most = who.agg(zero(F.max("reads"))).first()[0]
    slots = pairs.slots(most, total["pairs"], total["rows"])
    salts = F.ceil(F.col("r") / salt_rows).cast("int")
    if total["top"] <= salt_rows:
        salt, every = F.lit(0).alias("salt"), F.lit(0).alias("salt")
    else:
        salt, every = F.pmod(F.xxhash64("n"), salts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    sized = own.join(sizes, "to_id")
    left = sized.where("NOT writes").select("to_id", F.col("n").alias("a"), salt)
    packed = sized.where("writes").select("to_id", "n", "r", *pairs.pack("n", "w", slots)).groupBy("to_id", "r", "slot", "pack").agg(F.collect_list("n").alias(
        "others"))
    right = packed.select("to_id", "slot", "others", every)
    met = dealt(left, total["rows"], "to_id", "salt").join(dealt(right, total["rows"], "to_id", "salt"), ["to_id", "salt"])
    found = pairs.counted(met.select("a", "slot", "others", F.lit(1).alias("least"), F.col("to_id").alias("label")), total["pairs"], labelled=True)
    named = found.join(names.toDF("a", "from_id"), "a").join(names.toDF("b", "to_id"), "b")
    return named.select("from_id", "to_id", F.lit("CHANGE_COUPLED_WITH").alias("type"), F.lit(0.85).alias("confidence"), F.lit(True).alias("is_inferred"),
        F.col("n").alias("shared"), F.col("label").alias("shared_table"))


def merge_relationships(relationships: DataFrame, first_source: bool = False) -> DataFrame:
    """One row for each (from, to, type): the most confident (then the earliest ordinal) gives the properties. A row counts as often as
    its ``weight`` says, if there is one. ``sources`` are all, in the order of ordinals; with ``first_source`` there is ``source``, the first, alone.

    Rows are dealt by their key once and then sorted by its hash, as most have no like and merging before they are dealt gains little."""
    times = F.sum(F.coalesce("weight", F.lit(1))) if "weight" in relationships.columns else F.count("*")
    best = F.max_by(F.struct("confidence", "properties", "source_type"), F.struct(F.col("confidence"), -F.col("ordinal")))
    source = F.when(F.coalesce("source_type", F.lit("")) != "", F.struct("ordinal", "source_type"))
    if first_source:
        sources, name = F.min(source)["source_type"], "source"
    else:
        sources, name = F.transform(F.array_sort(F.collect_list(source)), lambda x: x["source_type"]), "sources"
    key = ["from_id", "to_id", "type"]
    dealt_out = relationships.repartition(*key).withColumn("__h", F.xxhash64(*key))
    out = dealt_out.groupBy("__h", *key).agg(best.alias("best"), sources.alias(name), times.alias("corroboration_count"), F.bool_and("is_inferred").alias(
        "is_inferred"))
    return out.select(*key, "best.confidence", "best.properties", name, "corroboration_count", "is_inferred")


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row for each id: scalars of the most confident row (the first of equals); later properties win key by key.

    properties is a map here; its entries are reduced by (id, key), so that no id's rows are gathered."""
    best = F.max_by(F.struct("type", "canonical_name", "namespace", "confidence"), F.struct(F.col("confidence"), -F.col("ordinal")))
    rows = entities.groupBy("id").agg(best.alias("best"))
    entries = entities.select("id", "ordinal", F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(
        F.max_by("v", "ordinal").alias("v"))
    last = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))
    kind = entities.schema["properties"].dataType
    return rows.join(last, "id", "left").select("id", "best.*", F.coalesce("properties", F.create_map().cast(kind)).alias("properties"))


def ownership(properties: Column) -> Column:
    owner, author = json_text(properties, "owner"), json_text(properties, "author")
    made = lambda who, c, how: F.struct(who.alias("owner"), F.lit(c).alias("confidence"), F.lit(how).alias("source"))
    return F.when(owner.isNotNull(), made(owner, 0.95, "declared")).when(author.isNotNull(), made(author, 0.5, "git_history"))


def velocity(commits: Column) -> Column:
    n = F.coalesce(commits, F.lit(0))
    return F.when(n > 10, "HOT").when(n >= 2, "ACTIVE").otherwise("STABLE")


def criticality_score(inbound: Column) -> Column:
    return F.least(F.lit(1.0), 0.2 + 0.1 * inbound)


def criticality(inbound: Column) -> Column:
    return F.when(inbound >= 7, "CRITICAL").when(inbound >= 5, "HIGH").when(inbound >= 3, "MEDIUM").otherwise("LOW")


def inbound_counts(relationships: DataFrame, kinds: list[str]) -> DataFrame:
    return relationships.where(F.col("type").isin(kinds)).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("inbound"))


# What each sign adds to the maturity score.
MATURITY = {"has_api_spec": 0.20, "has_tests": 0.15, "has_documentation": 0.15, "has_owner": 0.15, "has_monitoring": 0.10,
    "has_resource_limits": 0.15}


def maturity_score(signs: dict[str, Column]) -> Column:
    return F.round(sum((F.when(signs[k], v).otherwise(0.0) for k, v in MATURITY.items() if k in signs), F.lit(0.10)), 6)


def maturity(score: Column) -> Column:
    return F.when(score > 0.80, "MATURE").when(score > 0.50, "DEVELOPING").otherwise("NASCENT")


def pipeline_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Keeps edges of two known, different ends; an OWNS edge must go from a team to a service."""
    known = entities.select("id", "type")
    ends = relationships.join(known.toDF("from_id", "from_type"), "from_id").join(known.toDF("to_id", "to_type"), "to_id")
    return ends.where("from_id <> to_id AND (type <> 'OWNS' OR (from_type = 'TEAM' AND to_type = 'SERVICE'))").drop("from_type", "to_type")


def storage_form(observed: DataFrame) -> DataFrame:
    """Type names as stored, and where a record comes from kept among its properties (a JSON text)."""
    renamed = F.coalesce(*[F.when(F.col("type") == a, b) for a, b in catalogs.RENAMED_TYPES.items()], F.col("type"))
    kept = F.to_json(
        F.struct(F.col("source_type"), F.col("source_id"),
            F.when(F.col("raw_name") != F.col("canonical_name"), F.col("raw_name")).alias("raw_name")))
    return observed.withColumn("type", renamed).withColumn("provenance", kept)


def delta(proposed: DataFrame, current: DataFrame, key: str, compared: list[str], forms: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """op for each proposed row against the current one: CREATE, UPDATE or UNCHANGED. Columns in ``forms`` are equal if these are; a form is
    made of the few values that differ alone."""
    old = current.select(F.col(key), F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in compared])
    same = F.lit(True)
    for c in compared:
        equal, form = F.col(c).eqNullSafe(F.col(f"__{c}")), (forms or {}).get(c)
        same = same & (F.when(equal, True).otherwise(form(F.col(c)).eqNullSafe(form(F.col(f"__{c}")))) if form else equal)
    op = F.when(F.col("__known").isNull(), "CREATE").when(same, "UNCHANGED").otherwise("UPDATE")
    return proposed.join(old, key, "left").withColumn("op", op).drop("__known", *[f"__{c}" for c in compared])


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
