"""Language by compression: a zstandard raw-content dictionary for each language; the smallest code wins.

Every labelled language is learned. A dictionary is cut from at most ``sample`` distinct texts of its language, of each at
most its first ``sample_chars`` characters, ``piece`` bytes at a time, so that no document fills it and copies count once. Of a text all letters count, lower-cased, and one blank for each run of other characters; they are
coded whole, in windows of ``window`` bytes. Where the two best languages' sizes differ
by less than ``min_margin`` of the text's size the row is marked rejected, as are texts that are null or without a letter.

Ties go to the language that sorts first. Null languages and ids don't train; without any
learned language every row is ``und``. Repeated rows and rows with one doc_id are each predicted on their own. A column of the input under one of the result's names is
replaced; other extra columns stay. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .compression import WORDS, Coder, byte_windows


def letters(text: str) -> bytes:
    return f" {' '.join(WORDS.findall(text.lower()))} ".encode()


def train(rows: list[tuple[str, str]], dict_bytes: int = 32 << 10, piece: int = 1024) -> dict[str, bytes]:
    """Dictionary content by language, from (language, text) rows."""
    out: dict[str, bytes] = {}
    for lang in sorted({x for x, _ in rows}):
        texts = sorted({letters(t) for x, t in rows if x == lang}, key=xxhash.xxh64_intdigest)
        got, at = [], 0
        while sum(map(len, got)) < dict_bytes and any(len(t) > at for t in texts):
            got += [t[at : at + piece] for t in texts if len(t) > at]
            at += piece
        out[lang] = b"".join(got)[:dict_bytes] or b"        "
    return out


class Identifier:
    def __init__(self, content: dict[str, bytes], window: int = 2048, level: int = 5):
        self.coders, self.window = {k: Coder(v.ljust(8), level) for k, v in sorted(content.items())}, window

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the margin of the best to the next as a part of the text's size."""
        if not text or not self.coders or not WORDS.search(text):
            return "und", 0.0, 0.0
        raw = letters(text)
        windows = byte_windows(raw, self.window)
        sizes = {k: sum(c.lengths(windows)) for k, c in self.coders.items()}
        best = min(sizes, key=lambda k: (sizes[k], k))
        rest = [v for k, v in sizes.items() if k != best]
        margin = (min(rest) - sizes[best]) / len(raw) if rest else 1.0
        return best, 1 / sum(math.exp(-min(700.0, 60 * (v - sizes[best]) / len(raw))) for v in sizes.values()), margin


def sample_rows(docs: DataFrame, folds: int, held: int, sample: int, sample_chars: int) -> list[tuple[str, str]]:
    """(language, text) of at most ``sample`` distinct texts of each language, the first by a hash of the text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"))
    known = ids.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.id_bucket(F.col("doc_id"), folds) != held))
    known = known.select("lang", F.substring("text", 1, sample_chars).alias("text")).withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("h")
    ranked = known.select("lang", "h").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
    keys = docs.sparkSession.createDataFrame(ranked.select("lang", "h").collect(), "lang string, h long")  # their texts are collected too
    rows = known.join(F.broadcast(keys), ["lang", "h"]).select("lang", "text").distinct().collect()
    return [(r["lang"], r["text"]) for r in rows]


def identify_language(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = 200, sample_chars: int = 20_000,
    min_margin: float = 0.0005) -> DataFrame:
    """docs with held_out, lang_pred, score, margin and rejected."""
    spark = common.tune(docs.sparkSession)
    content = train(sample_rows(docs, folds, held, sample, sample_chars))
    sent = spark.sparkContext.broadcast(content)  # 32 KB a language
    made: list[Identifier] = []
    new = ("held_out", "lang_pred", "score", "margin", "rejected")
    names = [c for c in docs.columns if c not in new]
    docs = docs.select(*names)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Identifier(sent.value))
        for batch in batches:
            lang, score, margin = zip(*(made[0](t) for t in batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), (),
                ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                names=[*names, "lang_pred", "score", "margin"])

    held_out = F.coalesce(common.id_bucket(F.col("doc_id").cast("long"), folds) == held, F.lit(False))
    return docs.mapInArrow(common.lean(run), schema).withColumns(
        {"held_out": held_out, "rejected": (F.col("lang_pred") == "und") | (F.col("margin") < min_margin)})
