"""Pairs of similar strings without comparing all, and what entity resolution makes of them.

Two strings are similar if their edit distance is at most a share of the longer one's length. The longer, cut into one segment
more than it may have edits, then keeps at least one segment whole, and the shorter one holds that segment near the same place.
So both meet by equality on (length, number, segment); every pair that meets is verified once. The shorter string offers only
those places that edits on both sides of the segment allow. Strings, not rows, are joined: repeated rows cost nothing, and
a segment that very many strings share is a join key that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut

from . import pointers, rules


def _allowed(length: Column, per_cent: int) -> Column:
    """Edits that leave so many per cent of similarity."""
    return F.call_function("div", length * (100 - per_cent), F.lit(100)).cast("int")


def _segments(longer: DataFrame, per_cent: int) -> DataFrame:
    """text, length, part, piece: the parts of each string, near equal, the longer ones last."""
    rows = longer.withColumn("length", F.char_length("text")).withColumn("k", _allowed(F.col("length"), per_cent))
    return _part(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k"))))).select(*longer.columns, "length", "part",
        F.substring("text", F.col("start") + 1, F.col("size")).alias("piece"))


def _part(rows: DataFrame) -> DataFrame:
    """Adds start (from 0) and size of a string's ``part`` out of k + 1."""
    base, longer = F.expr("length div (k + 1)"), F.expr("length % (k + 1)")
    before = F.greatest(F.lit(0), F.col("part") - (F.col("k") + 1 - longer))
    return rows.withColumns({"start": (F.col("part") * base + before).cast("int"), "size": (base + F.when(
        F.col("part") >= F.col("k") + 1 - longer, 1).otherwise(0)).cast("int")})


def _offers(shorter: DataFrame, per_cent: int) -> DataFrame:
    """text, length, part, piece: what strings of each length, not shorter than the own, may have kept of which part."""
    own = shorter.withColumn("own", F.char_length("text"))
    most = F.expr(f"int(own * 100 div {per_cent})") if per_cent else F.col("own")
    rows = own.withColumn("length", F.explode(F.sequence(F.col("own"), F.greatest("own", most)))).withColumn("k", _allowed(
        F.col("length"), per_cent)).where("length - own <= k")
    rows = _part(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k")))))
    less, right = F.col("own") - F.col("length"), F.col("k") - F.col("part")
    low = F.greatest(F.lit(0), F.col("start") - F.col("part"), F.col("start") + less - right)
    high = F.least(F.col("own") - F.col("size"), F.col("start") + F.col("part"), F.col("start") + less + right)
    rows = rows.withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high")
    return rows.withColumn("at", F.explode(F.sequence(F.col("low"), F.col("high")))).select(*shorter.columns, "length", "part",
        F.substring("text", F.col("at") + 1, F.col("size")).alias("piece")).distinct()


def similar_pairs(strings: DataFrame, per_cent: int = 80, within: tuple[str, ...] = ()) -> DataFrame:
    """a, b, distance, and the columns ``within``: every two different strings (text; null ones are left out) that agree in those columns,
    with 100 * (longer - distance) >= per_cent * longer, a before b. per_cent lies in 1..100. Those that share a segment are compared where
    they meet, as far as edits are allowed, and only similar ones are moved to drop repeats. Strings so short that they may lose every
    character share empty parts, so those of one length and less all meet; that takes a similarity under 1 / length."""
    if not 1 <= per_cent <= 100:
        raise ValueError("similarity is 1 to 100 per cent")
    texts = cut(strings.select("text", *within).where("text IS NOT NULL").distinct())
    longer = _segments(texts, per_cent)
    met = _offers(texts, per_cent).withColumnRenamed("text", "other").join(longer, [*within, "length", "part", "piece"])
    met = met.where((F.char_length("other") < F.col("length")) | (F.col("other") < F.col("text")))
    near = met.withColumn("distance", F.expr(f"levenshtein(other, text, int(length * {100 - per_cent} div 100))")).where("distance >= 0")
    return near.select(*within, F.least("text", "other").alias("a"), F.greatest("text", "other").alias("b"), "distance").distinct()


def candidates(entities: DataFrame, per_cent: int = 80, by: tuple[str, ...] = ("namespace", "type")) -> DataFrame:
    """id, candidate, score: entities (id, name and the columns ``by``) whose names are similar or equal and that agree in ``by``; each two
    once a direction, scored as far as names tell: one less the share of edits. A name that many entities of one ``by`` have meets
    by its first id, so equal ones make no square of pairs."""
    rows = entities.select("id", "name", *by).where("name IS NOT NULL")
    first = cut(rows.groupBy("name", *by).agg(F.min("id").alias("id")))
    near = similar_pairs(first.select(F.col("name").alias("text"), *by), per_cent, by)
    left, right = (first.select(F.col("name").alias(n), *by, F.col("id").alias(i)) for n, i in (("a", "id_a"), ("b", "id_b")))
    pairs = near.join(left, ["a", *by]).join(right, ["b", *by])
    score = F.round(1 - F.col("distance") / F.greatest(F.char_length("a"), F.char_length("b")), 6)
    one = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("candidate"), score.alias("score"))
    two = pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("candidate"), score.alias("score"))
    same = rows.join(first.withColumnRenamed("id", "candidate"), ["name", *by]).where("id <> candidate").select("id", "candidate", F.lit(
        1.0).alias("score"))
    return one.unionByName(two).unionByName(same)


def clusters(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """source_id, target_id of the entities to merge: matches (id, candidate, score) of at least that score tie entities together,
    and each group becomes its smallest id."""
    pairs = scored.where(F.col("score") >= least).select(F.col("id").alias("a"), F.col("candidate").alias("b"))
    return pointers.components(pairs).where("node <> component").select(F.col("node").alias("source_id"), F.col("component").alias("target_id"))


def best_matches(entities: DataFrame, per_cent: int = 80, by: tuple[str, ...] = ("namespace", "type")) -> DataFrame:
    """Each entity's best candidate, score and decision, over pairs made by similarity of names."""
    return rules.best_candidates(candidates(entities, per_cent, by))
