"""The registered queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, divergence, funnels, jaccard_join, language_id, license_scan, line_dedup, oracle, packing, repeats, sharding
from . import toxicity, vptree, wavelet


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.own_path(spark, "tokens")
    wavelet.write_token_shards(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return wavelet.read_documents(spark.read.parquet(path))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_language(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op4_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(common.table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(common.table(spark, sf_dir, "documents")).drop("found")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.table(spark, sf_dir, "documents"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(common.table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.count_funnels(common.table(spark, sf_dir, "clicks"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_wavelet_tokens, op3_toxicity, op4_vp_trees, op5_license_scan, op6_jaccard_join,
        op7_language_id, op8_line_dedup, op9_kd_sharding, op10_best_fit_packing, op11_suffix_array_dedup, op12_funnels, op13_source_divergence)}
#: The others need a tokenizer, a trained model, an approximate search or a tree; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": oracle.OP1, "op5_license_scan": oracle.op5(), "op6_jaccard_join": oracle.OP6,
    "op8_line_dedup": oracle.OP8, "op11_suffix_array_dedup": oracle.OP11, "op12_funnels": oracle.op12(), "op13_source_divergence": oracle.OP13}
