"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Each word of a text becomes 16 bytes: a code of its first letters and a code of the whole word, so that a match in a
dictionary is worth the same whatever the word's length, and parts of words never match. Either dictionary is raw content
cut from its class's training texts: their words by the number of texts that hold them, at most ``most``, the most
frequent last, where they are the cheapest to refer to. Words that both classes use stand in both dictionaries; words that
one class holds significantly more often stand in its own alone, behind the others. A word counts once a context (the word before), so neither copies of a
document nor one long document make it frequent. A window of words is coded with both dictionaries; a text's distance is
the largest saving of the toxic one over the ordinary one, and the threshold is the one that errs least, classes weighed
as they occur, on labelled rows kept from training.

zstandard's own trainer weighs by frequency alone, which puts the few words that tell into the same dictionary sizes as
chance words; README has the figures.

At most ``sample`` labelled ids of either class are used, one text each, of which at most ``sample_chars`` characters;
scoring takes every window of every text. Null, empty and wordless texts have distance 0. An id labelled both ways is toxic.
Rows with null id or null label don't train. Rows with one doc_id are scored apart. Where a class has no rows at all, every
score is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .compression import WORDS, raw_dictionary

BEGINNING = 4


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    threshold: float
    window: int = 24
    level: int = 5

    def scorer(self) -> Scorer:
        return Scorer(self)


def _code(word: str) -> bytes:
    return xxhash.xxh64_digest("^" + word[:BEGINNING]) + xxhash.xxh64_digest(word)


class Scorer:
    KEPT = 500_000

    def __init__(self, model: ToxicityModel):
        self.m, self.known = model, {}
        one = lambda d: zstandard.ZstdCompressor(level=model.level, dict_data=raw_dictionary(d, model.level) if len(d) >= 8 else None,
            write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.with_toxic, self.with_ordinary = one(model.toxic), one(model.ordinary)

    def distance(self, text: str) -> int:
        if len(self.known) > self.KEPT:
            self.known = {}
        known, n = self.known, self.m.window
        words = WORDS.findall(text.lower())
        for w in set(words).difference(known):
            known[w] = _code(w)
        codes = list(map(known.__getitem__, words))
        most = 0
        for i in range(0, len(codes), n):
            w = b"".join(codes[i : i + n])
            most = max(most, len(self.with_ordinary(w)) - len(self.with_toxic(w)))
        return most

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(min(50.0, self.m.threshold - self.distance(text))))


def _contexts(texts: list[str]) -> tuple[Counter, int]:
    """In how many texts each word stands after a word that it hasn't followed in texts before."""
    seen: set = set()
    words: Counter = Counter()
    for t in texts:
        own = WORDS.findall(t.lower())
        new = set(zip(["", *own], own, strict=False)) - seen
        seen |= new
        words.update({w for _, w in new})
    return words, len(texts)


def _significant(k: int, n: int, o: int, m: int, odds: float, chance: float) -> bool:
    """Whether k of n texts against o of m are too many for chance (Chernoff's bound on the binomial tail) and by those odds."""
    if (k + 0.5) / (n + 1) * (m + 1) < odds * (o + 0.5):
        return False
    p, q = n / (n + m), k / (k + o)
    rest = (1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0
    return (k + o) * (q * math.log(q / p) + rest) >= chance


def _contents(a: tuple[Counter, int], b: tuple[Counter, int], odds: float, most: int) -> tuple[bytes, bytes]:
    """Both classes' dictionaries: the words of both, and at the end the class's own typical ones."""
    (one, n), (two, m) = a, b
    both = one + two
    chance = math.log(max(2, len(both)) / 5)  # about five words of all may pass by chance
    own = {s for s in one if _significant(one[s], n, two[s], m, odds, chance)}, {
        s for s in two if _significant(two[s], m, one[s], n, odds, chance)}
    shared = sorted((c, s) for s, c in both.most_common(most) if c > 1 and s not in own[0] and s not in own[1])
    return tuple(b"".join(_code(s) for _, s in [*shared, *sorted((count[s], s) for s in ours)][-most:]) for ours,
        count in zip(own, (one, two), strict=True))


def train(toxic: list[str], ordinary: list[str], share: float = 0.5, odds: float = 12.0, most: int = 4000) -> ToxicityModel:
    """Dictionaries from three of four texts, the threshold from the fourth. share: the toxic part of all rows."""
    fit = lambda x: [t for i, t in enumerate(x) if i % 4] or x
    held = lambda x: x[::4]
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", 1e9)
    model = ToxicityModel(*_contents(_contexts(fit(toxic)), _contexts(fit(ordinary)), odds, most), 0.0)
    scorer = model.scorer()
    t, o = (np.array([scorer.distance(x) for x in held(side)]) for side in (toxic, ordinary))
    levels = np.unique(np.concatenate([t, o, [1]]))
    wrong = [(share * (t < v).mean() + (1 - share) * (o >= v).mean(), -v) for v in levels if v > 0]
    best = -min(wrong)[1]
    model.threshold = float(best) - 0.5
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int, sample_chars: int) -> tuple[list[str], list[str],
    float]:
    """Texts of at most ``sample`` toxic and ordinary ids of the learning folds, by the order of a hash, and the toxic part of all."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(
        F.col("toxic").isin(0, 1) & (common.id_bucket(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (1, 0)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
        F.substring(F.col("text").cast("string"), 1, sample_chars).alias("text")).where("text <> ''")
    rows = texts.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # one text an id
    rows = sorted({(r.toxic, r.text) for r in rows}, key=lambda r: xxhash.xxh64_intdigest(r[1]))
    return [t for y, t in rows if y == 1], [t for y, t in rows if y == 0], counts.get(1, 0) / max(1, sum(counts.values()))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 2000,
    sample_chars: int = 20_000) -> DataFrame:
    spark = common.tune(docs.sparkSession)
    model = train(*sample_rows(docs, labels, folds, held, sample, sample_chars))
    sent = spark.sparkContext.broadcast(model)  # at most 4000 words a class
    made: list[Scorer] = []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(sent.value.scorer())
        for batch in batches:
            values = [made[0].score(t) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(common.lean(score), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(common.id_bucket(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
