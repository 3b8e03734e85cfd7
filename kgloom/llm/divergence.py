"""How a source's words differ from those of the other sources and of the whole language.

First pass: the number of documents that hold each term, by language, summed in each task before the shuffle; terms of
``least`` documents and more are kept. Second pass: each text, reduced to its terms between single blanks, is scanned by an
Aho-Corasick automaton of the kept terms, each padded with a blank on both sides so that it matches whole terms only; the
matches are the term's occurrences. A vocabulary is dealt by hash into shards of ``shard_terms`` terms, and texts' terms go to
the shard that may know them, so no task holds a vocabulary that grows with the corpus, and no text is scanned twice. Texts of
a language and shard are dealt further into salts of at most about ``salt_bytes``; the shard's terms go to each.

What comes out are sparse postings (language, source, term, count > 0). A pair of sources is the sum over the terms both
hold, by a join of the postings, plus what the others give, which depends on the count alone and is summed by count.

All arithmetic is exact: whole numbers, decimals where they may exceed 64 bits. Null text, lang or source is read as ''. Every row is
a document, so repeated ids and texts count again. A document without terms still makes its group. A language that keeps no
term has pairs of value 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What is no part of a term becomes a blank, A-Z become a-z.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNIT = 1_000_000_000
#: Distinct terms that a task counts before it hands the counts on.
HELD = 400_000


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERMS).split()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _frequencies(docs: DataFrame) -> DataFrame:
    """lang, term and in how many documents it stands, in parts."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def out(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in seen.items():
            term = pa.array(list(c.keys()), pa.binary()).cast(pa.string())
            yield common.record(schema, lang=pa.repeat(lang, len(c)), term=term, n=list(c.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), common.texts(batch), strict=True):
                seen.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, seen.values())) > HELD:
                yield from out(seen)
                seen = {}
        yield from out(seen)

    return docs.select("lang", "text").mapInArrow(common.lean(run), "lang string, term string, n long")


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, the terms that stand in at least so many of its documents, and in how many, df."""
    return _frequencies(_documents(docs)).groupBy("lang", "term").agg(F.sum("n").alias("df")).where(F.col("df") >= least)


def _scan_texts(docs: DataFrame, shards: int) -> DataFrame:
    """Each text's terms between blanks, a row for each shard that may know some."""
    names = ("lang", "source", "terms", "shard")
    schema = pa.schema([(n, pa.int32() if n == "shard" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if shards == 1:
                    rows.append((lang, source, f" {text.encode('utf-8', 'replace').translate(TERMS).decode()} ", 0))
                    continue
                parts: dict[int, list[bytes]] = {}
                for t in terms_of(text):
                    parts.setdefault(zlib.crc32(t) % shards, []).append(t)
                rows += [(lang, source, f" {b' '.join(p).decode()} ", s) for s, p in parts.items()]
            yield common.record(schema, **{n: [r[i] for r in rows] for i, n in enumerate(names)})

    return docs.mapInArrow(common.lean(run), "lang string, source string, terms string, shard int")


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        out.add_word(f" {term} ", i)
    out.make_automaton()
    return out


def count_terms(docs: DataFrame, kept: DataFrame, shard_terms: int = 500_000, salt_bytes: int = 32 << 20) -> DataFrame:
    """Sparse postings: lang, source, term, n (occurrences, at least 1) of the kept terms (written)."""
    common.tune(docs.sparkSession)
    rows = _documents(docs)
    most = kept.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(1, -(-most // shard_terms))
    longest = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, -(-longest // shards // salt_bytes))
    # salted by the row too, as equal texts may be many
    texts = _scan_texts(rows, shards).withColumn("salt", F.pmod(F.xxhash64("terms", F.monotonically_increasing_id()), F.lit(salts)))
    shard = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(shards)).cast("int").alias("shard")
    # a row of at most about shard_terms terms for each language, shard and salt; the frequent ones first, to lie close together
    known = F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("df"), "term")))["term"]
    words = kept.groupBy("lang", shard).agg(known.alias("known")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast(
        "long"), F.lit(salts - 1).cast("long"))))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        terms = right.column("known")[0].as_py()
        automaton = _automaton(terms)
        found: dict[str, list[np.ndarray]] = {}
        for batch in left.select(["source", "terms"]).to_batches(200):
            for source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(source, []).append(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int32))
        lang, known, out = left.column("lang")[0].as_py(), pa.array(terms, pa.string()), []
        for source, hits in found.items():
            n = np.bincount(np.concatenate(hits), minlength=len(terms))
            held = np.flatnonzero(n)
            out.append(common.record(schema, lang=pa.repeat(lang, len(held)), source=pa.repeat(source, len(held)), term=known.take(pa.array(held)),
                n=n[held]))
        return pa.Table.from_batches(out, schema)

    key = ["lang", "shard", "salt"]
    counts = texts.groupBy(*key).cogroup(words.groupBy(*key)).applyInArrow(scan, "lang string, source string, term string, n long")
    return common.saved(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "postings")


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms))."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), (total + terms).cast("decimal(19,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = 3, top: int = 200, shard_terms: int = 500_000, salt_bytes: int = 32 << 20) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: how far each other source of the language is. Part ``term``: the
    ``top`` terms that the source uses more than its language does."""
    kept = common.saved(kept_terms(docs, least), "terms")
    postings = count_terms(docs, kept, shard_terms, salt_bytes)
    key = ["lang", "source"]
    langs = _documents(docs).select(*key).distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = postings.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = langs.join(sums, key, "left").join(sizes, "lang", "left").select(*key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total",
        "held", "v")))
    groups = common.saved(groups.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("total"), F.col("v")))), "groups")

    # what a source gives to terms, by how many terms it gives it to
    p = common.saved(postings.join(groups, key).select(*key, "term", "n", _p(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"), "shares")
    levels = p.groupBy(*key, "p").agg(F.count("*").alias("m"))
    a, b = (groups.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "held", "p0", "v"))) for s in "ab")
    pairs = a.join(b.drop("v_b"), "lang").where("source_a <> source_b")
    one = levels.select("lang", F.col("source").alias("source_a"), "p", "m").join(b, "lang").where("source_a <> source_b")
    one = one.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m") * _f(F.col("p"), F.col("p0_b"))).alias("x"))
    two = levels.select("lang", F.col("source").alias("source_b"), "p", "m").join(a, "lang").where("source_a <> source_b")
    two = two.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m") * _f(F.col("p0_a"), F.col("p"))).alias("y"))
    # each two sources of a term meet once, for both directions
    left, right = (p.select("lang", "term", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "p0"))) for s in "ab")
    both = left.join(right, ["lang", "term"]).where("source_a < source_b")

    def more(x: str, y: str) -> Column:
        px, py, ox, oy = (F.col(c) for c in (f"p_{x}", f"p_{y}", f"p0_{x}", f"p0_{y}"))
        return F.sum(_f(px, py) - _f(px, oy) - _f(ox, py) + _f(ox, oy))

    both = both.groupBy("lang", "source_a", "source_b").agg(more("a", "b").alias("ab"), more("b", "a").alias("ba"))
    both = both.select("lang", F.explode(F.array(F.struct("source_a", "source_b", F.col("ab").alias("z")), F.struct(F.col("source_b").alias(
        "source_a"), F.col("source_a").alias("source_b"), F.col("ba").alias("z")))).alias("e")).select("lang", "e.*")
    by = ["lang", "source_a", "source_b"]
    rest = (F.col("v_a") - F.col("held_a") - F.col("held_b")) * _f(F.col("p0_a"), F.col("p0_b"))
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in "xyz"), F.coalesce(rest, F.lit(0)))
    pairs = pairs.join(one, by, "left").join(two, by, "left").join(both, by, "left").select("lang", F.col("source_a").alias("source"),
        F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))

    whole = postings.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    in_all = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("v").alias("v"))
    q = whole.join(in_all, "lang").select("lang", "term", _p(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"))
    own = p.join(q, ["lang", "term"]).where("p > q").select(*key, F.lit("term").alias("part"), F.col("term").alias("item"),
        _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(own.withColumn("rank", rank).where(F.col("rank") <= top))
