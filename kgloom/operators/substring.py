"""Which strings hold which: joins and searches over an inverted index of q-grams, and the lines that ranges hold.

A text's grams are its q characters (in a written index, bytes) from every place on. A text that holds a pattern holds all of the pattern's grams, so the
postings of its rarest ones give the candidates, and each is verified once: in searches of the rarest two, where patterns shorter than q
are the beginnings of grams, in joins of the rarest one, in lengths near the pattern's own.
Everything meets by equality of grams; no text is compared with all patterns. Nulls hold nothing and are held by nothing; the empty
pattern is held by every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kgloom.session import FEW_ROWS, counted, cut, scratch, ship

Q = 3
#: Lengths in characters of the keys by which joins find patterns.
KEYS = (1, 2, 3, 4, 6, 9, 13, 19, 28)
#: Folders of a written index, bytes of texts whose postings are made at a time, ids of a task that writes them.
PARTS, BLOCK, PART_IDS = 64, 2 << 20, 4_000_000


def grams(text: Column, q: int = Q, whole: bool = False) -> Column:
    """The distinct strings of q characters; those at the end that are shorter too, unless ``whole``. One pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q if whole else 1},{q}}}))"), F.lit(1)))


def _keys(text: Column, size: int) -> Column:
    return F.transform(grams(text, size, True), lambda g: F.xxhash64(g))


def holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text, pattern: every distinct text (column text) with every distinct pattern (column pattern) that it holds.

    A pattern's keys are hashes of its strings of the largest of ``KEYS`` that it is long enough for, at least two thirds of it up to
    the last of them; texts have keys of those sizes that some pattern has. What meets grows with what is held, not with texts times
    patterns over so many grams as there are of a few characters."""
    named = cut(texts.select("text").where("text IS NOT NULL").distinct().withColumn("t", F.monotonically_increasing_id()))
    sought = cut(patterns.select("pattern").where("pattern IS NOT NULL").distinct().withColumn("size", F.greatest(*[F.when(F.char_length(
        "pattern") >= k, k).otherwise(0) for k in KEYS])))
    sizes = sorted(r[0] for r in sought.where("size > 0").select("size").distinct().collect())  # as many as KEYS at most
    # one row at most
    found = named.join(F.broadcast(sought.where("size = 0").limit(1))).select("text", "pattern")
    if not sizes:
        return found
    key = F.coalesce(*[F.when(F.col("size") == k, _keys(F.col("pattern"), k)) for k in sizes])
    wanted = cut(sought.where("size > 0").select("pattern", F.explode(key).alias("key")))
    posted = named.select("t", F.explode(F.array_distinct(F.concat(*[_keys(F.col("text"), k) for k in sizes]))).alias("key"))
    known = cut(posted.join(counted(cut(wanted.select("key").distinct())), "key", "left_semi"))
    counts = known.groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "key", "left").groupBy("pattern").agg(F.min(F.struct("n", "key")).alias("rare"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    near = rarest.where("all").select("pattern", "rare.key").join(known, "key").select("t", "pattern")
    return found.unionByName(near.join(named, "t").where(F.contains("text", "pattern")).select("text", "pattern"))


def touching(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: distinct strings of left (text) and right (text) of which one holds the other."""
    one = holding(left, right.select(F.col("text").alias("pattern"))).toDF("a", "b")
    two = holding(right, left.select(F.col("text").alias("pattern"))).toDF("b", "a")
    return one.unionByName(two.select("a", "b")).distinct()


def _code(gram: bytes, q: int) -> int:
    """A gram of the written index: its bytes, filled up with zeros, and how many it has."""
    return int.from_bytes(gram.ljust(q, b"\0"), "big") << 3 | len(gram)


def _part(gram):
    return gram % 8191 % PARTS


def _posted(q: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: from id and text, the grams of every ``BLOCK`` bytes of texts, each with the ids that have it there, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for a in range(int(bounds[0]), int(bounds[-1]), BLOCK):
                b = min(a + BLOCK, int(bounds[-1]))
                low, high = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b)
                row = np.repeat(np.arange(high - low), np.diff(np.clip(bounds[low:high + 1], a, b)))
                size = np.minimum(bounds[low + 1:high + 1][row] - np.arange(a, b), q)
                key = np.zeros(b - a, np.int64)
                for k in range(q):
                    key <<= 8
                    here = data[a + k:b + k]
                    key[:len(here)] |= np.where(size[:len(here)] > k, here, np.uint8(0))
                key <<= 3
                key |= size
                bits = int(high - low - 1).bit_length()
                key <<= bits
                key |= row
                key.sort()
                key = key[np.append(True, key[1:] != key[:-1])]
                gram = key >> bits
                start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
                ends = np.append(start, len(gram))
                ids = batch.column("id").take(pa.array(low + (key & ((1 << bits) - 1))))
                yield pa.RecordBatch.from_arrays([pa.array(gram[start]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
                    pa.array(np.diff(ends))], names=["gram", "ids", "n"])

    return run


def write_index(docs: DataFrame, column: str, path: str, q: int = Q) -> None:
    """Writes the postings of a text column (lower-cased; docs: id and that column) into folders by gram, sorted by gram inside, and
    how many each gram has. Grams are of q bytes (5 at most), those at a text's end that are shorter too. What is moved is not a row for
    each gram and id, but one for each gram and ``BLOCK`` bytes of texts, with its ids; ids of a text over a block's end stand in both."""
    spark = ship(docs.sparkSession)
    with scratch(spark):
        texts = docs.select("id", F.lower(column).alias("text")).where("text IS NOT NULL")
        # made once, as dealing by ranges looks at them twice
        blocks = cut(texts.mapInArrow(_posted(q), f"gram long, ids array<{docs.schema['id'].dataType.simpleString()}>, n long"))
        total = blocks.agg(F.sum("n")).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_IDS))
        named = blocks.withColumn("part", _part(F.col("gram")).cast("int"))
        named.repartitionByRange(parts, "part", "gram", F.xxhash64("ids")).sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(
            f"{path}/postings")
    counts = spark.read.schema("gram long, n long, part int").parquet(f"{path}/postings").groupBy("part", "gram").agg(F.sum("n").alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/counts")


def search_index(docs: DataFrame, column: str, path: str, text: str, q: int = Q) -> DataFrame:
    """The docs whose column holds text, in any case. Reads the folders of the text's two rarest grams only, and verifies what they
    name. Texts shorter than q bytes read the whole index's grams that begin so. What is named is sent to
    the docs where the index counts it to be little; else both are dealt by id."""
    spark, low = docs.sparkSession, text.lower()
    verified, sought = F.contains(F.lower(column), F.lit(low)), low.encode()
    if not low:
        return docs.where(F.col(column).isNotNull())
    schema = StructType([StructField("gram", LongType()), StructField("ids", ArrayType(docs.schema["id"].dataType)), StructField("part", IntegerType())])
    posted = spark.read.schema(schema).parquet(f"{path}/postings")
    counts = spark.read.schema("gram long, n long, part int").parquet(f"{path}/counts")
    few = lambda df, n: F.broadcast(df) if n <= FEW_ROWS else df
    own = sorted({_code(sought[i:i + q], q) for i in range(len(sought) - q + 1)})
    if not own:
        fill = q - len(sought)
        begin = F.col("gram").between(_code(sought + bytes(fill), q) >> 3 << 3, _code(sought + b"\xff" * fill, q) | 7)
        named = posted.where(begin).select(F.explode("ids").alias("id")).distinct()
        return docs.join(few(named, counts.where(begin).agg(F.sum("n")).first()[0] or 0), "id", "left_semi").where(verified)
    parts = {g: _part(g) for g in own}
    counts = counts.where(F.col("part").isin(sorted(set(parts.values()))) & F.col("gram").isin(own))
    n = {r["gram"]: r["n"] for r in counts.collect()}  # as many as the searched text has
    if len(n) < len(own):
        return docs.limit(0)
    ids, least = None, min(n.values())
    for g in sorted(own, key=lambda g: (n[g], g))[:2]:
        some = posted.where((F.col("part") == parts[g]) & (F.col("gram") == g)).select(F.explode("ids").alias("id"))
        ids = some if ids is None else some.join(few(ids, least), "id", "left_semi")
    return docs.join(few(ids, least), "id", "left_semi").where(verified)


def path_matches(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, file: distinct paths and files that are equal, or one of which is the other's end after a slash: each end of one side
    meets the other side by equality."""

    def ends(df: DataFrame, name: str) -> DataFrame:
        parts = F.split(name, "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        return df.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(F.array_distinct(tails)).alias("end"))

    left, right = paths.select("path").distinct(), files.select("file").distinct()
    one = ends(paths, "path").join(right.withColumn("end", F.col("file")), "end").select("path", "file")
    two = left.withColumn("end", F.col("path")).join(ends(files, "file"), "end").select("path", "file")
    return one.unionByName(two).distinct()


def _level(size: Column) -> Column:
    """The least k with 2**k >= size."""
    return F.greatest(F.lit(0), F.ceil(F.log2(size.cast("double")))).cast("int")


def at_lines(places: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """places (columns ``on``, line) with the ranges (columns ``on``, start_line, end_line) around their line; a null line is in all. A
    range lies in one or two buckets of the power of two over its length, so a place looks into one bucket for each length that its
    ranges have, not into all ranges."""
    sized = ranges.where("start_line <= end_line").withColumn("level", _level(F.col("end_line") - F.col("start_line") + 1))
    bucket = lambda c: F.expr(f"shiftright({c}, level)")
    kept = sized.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket("start_line"), bucket("end_line")))))
    levels = sized.select(*on, "level").distinct()
    looked = places.where("line IS NOT NULL").join(levels, on).withColumn("bucket", bucket("line"))
    inside = looked.join(kept, [*on, "level", "bucket"]).where("line BETWEEN start_line AND end_line").drop("level", "bucket")
    anywhere = places.where("line IS NULL").join(ranges, on)
    return inside.unionByName(anywhere.select(*inside.columns))
