"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import common, decontamination, jaccard_join, language_id, line_dedup, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows to drop, of about 100 bytes each, that may be sent to all tasks.
FEW = 500_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` becomes the recognised one. Rejected ones go: null or
    letterless texts, and texts that two languages' dictionaries code equally well."""
    found = language_id.identify_language(docs.select(*COLUMNS))
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that keep nothing but white space; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, as ids may repeat; written, so that the numbers stay."""
    return common.saved(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed")


def without(rows: DataFrame, away: DataFrame, key: str) -> DataFrame:
    """rows without those that away names by key: sent to all tasks if there are few (counted), else joined by a shuffle."""
    away = common.saved(away, "away")
    return rows.join(F.broadcast(away) if away.count() <= FEW else away, key, "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id, one of several. Rows without an id stay."""
    rows = keyed(docs)
    known = rows.where("doc_id IS NOT NULL")
    groups = jaccard_join.near_duplicates(known.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"),
        F.col("component_id").alias("group"))
    groups = common.saved(groups.join(known.select("row", "doc_id"), "row"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.row")
    return without(rows, groups.join(first, "row", "left_anti").select("row"), "row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Rows of one id and one text share their fate, so they need no number."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*COLUMNS,
        F.struct("doc_id", F.xxhash64(text).alias("h"), F.crc32(F.encode(text, "UTF-8")).alias("c"), F.octet_length(text).alias("n")).alias(
            "key"))
    found = decontamination.contamination(rows.select(F.col("key").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences' pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL has neither the tokenizer nor the compressor; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            docs = common.saved(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
