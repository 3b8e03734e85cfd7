"""Removal of long byte strings that an earlier document holds, by suffix arrays.

A byte goes if it is covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id. Strings are judged
on the input, may overlap, and never cross documents.

Equal strings must meet in one shard. Every window of ``width`` bytes has an anchor, the smallest hash of its ``gram``-byte
strings; windows that follow each other mostly share it and form a piece. Anchors of one document only are ruled out by an
aggregation of narrow rows and a join, which read them dealt once. The other pieces are cut from the texts; equal ones become one row with the smallest
doc_id, so that a passage in every document is one row a task, and are dealt by anchor into shards. There, pieces of one document
that no other can share a window with are left out, and the others get a suffix array (``suffix_array``) and its permuted common prefixes; neighbours that share ``width`` bytes are one string, whose smallest
document decides about all its places. What comes back to the texts are spans of pieces. More than ``hot``
distinct pieces of one anchor might be too many for a shard: their windows become rows of their own and are grouped by content, which
gives the same spans.

Null or empty text has no bytes. A row with a null doc_id keeps all and takes none from others. Rows of one doc_id are one
document: they take nothing from each other. Texts of any length are cut and kept whole. An empty table gives no rows. Extra columns
stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix_array import Suffixes

#: Windows in a row that one piece may have at most, and bytes of text that are hashed at a time.
RUN, BLOCK = 63, 1 << 17
#: Of Spark's own 64-bit hash.
SEED = 42
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashes(data: bytes, gram: int) -> np.ndarray:
    """Of the ``gram``-byte string at each byte (those at the end left out)."""
    n = len(data)
    words = np.ndarray((n - 7,), "<u8", data, 0, (1,))
    size = n - gram + 1
    h = np.zeros(size, np.uint64)
    for at, mix in zip([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])], _MIX, strict=False):
        h += words[at:at + size] * mix
    h ^= h >> np.uint64(29)
    h *= _MIX[3]
    h ^= h >> np.uint64(32)
    return h


def _anchors(data: bytes, width: int, gram: int) -> np.ndarray:
    """The anchor of the window at each byte (windows at the end left out)."""
    h = _hashes(data, gram)
    span, done = width - gram + 1, 1
    while 2 * done <= span:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:len(h) - (span - done)], h[span - done:]) if done < span else h


def pieces(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its text's number, the anchor, the first window's byte and the number of windows."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        data = b"".join(x for _, _, x in group)
        if len(data) < width:
            return
        size = np.array([len(x) for _, _, x in group])
        end = np.cumsum(size)
        m = _anchors(data, width, gram)
        of = np.repeat(np.arange(len(group), dtype=np.int32), size)[:len(m)]
        good = np.ones(len(data), bool)
        for e in end.tolist():
            good[max(0, e - width + 1):e] = False
        good = good[:len(m)]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(m)))
        first, count = first[good[first]], count[good[first]]
        # a run that is too long for one piece becomes several
        parts = -(-count // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * RUN, np.minimum(RUN, np.repeat(count, parts) - nth * RUN)
        text, begin = (np.array([g[k] for g in group]) for k in (0, 1))
        found.append((text[of[first]], m[first].view(np.int64), first - (end - size)[of[first]] + begin[of[first]], count))

    held = 0
    for i, text in enumerate(texts):
        if len(text) < width:
            continue
        # a long text in overlapping parts, so that each window lies in one
        for begin in range(0, len(text) - width + 1, BLOCK):
            part = text[begin:begin + BLOCK + width - 1]
            group.append((i, begin, part))
            held += len(part)
            if held >= BLOCK:
                flush()
                group, held = [], 0
    flush()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def related(strings: list[bytes], anchors: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Which pieces may hold a window that another of these holds. Such a window has their anchor in it, and half of its other bytes lie
    on one side of that: a piece whose anchor, wherever it stands, has neither of its sides in common with another piece holds none."""
    data, size = b"".join(strings), np.array([len(s) for s in strings])
    end, side = np.cumsum(size), (width - gram) // 2
    of = np.repeat(np.arange(len(strings), dtype=np.int32), size)
    h = _hashes(data, gram)
    at = np.flatnonzero(h == anchors.view(np.uint64)[of[:len(h)]])
    out = np.zeros(len(strings), bool)
    for first in (at - side, at):
        piece = of[at]
        inside = (first >= (end - size)[piece]) & (first + gram + side <= end[piece])
        first, piece = first[inside], piece[inside]
        key = np.zeros(len(first), np.uint64)
        for off in (*range(0, side, gram), side):
            key = (key ^ h[first + off]) * _MIX[0]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[piece[order[1:][same]]] = out[piece[order[:-1][same]]] = True
    return out


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    """row (stands for rows of one doc_id and one text), doc, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc, text).alias("row"), doc.alias("doc"), text.alias("text")).where("doc IS NOT NULL")


def _shared(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """For rows that hold anchors of two rows or more: row and its pieces of these (anchor, first window, windows). Written."""
    marked = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, h, first, count = pieces(_encoded(batch), width, gram)
            yield common.record(marked, h=h, row=batch.column("row").to_numpy()[of], at=first * (RUN + 1) + count)

    # dealt once: both sides of the join need the same three columns of it
    places = rows.select("row", "text").mapInArrow(common.lean(each), "h long, row long, at long").repartition("h")
    anchors = places.groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("at").alias("n")).where("low < high AND n > 1")
    found = places.join(anchors.select("h").hint("shuffle_hash"), "h").groupBy("row").agg(F.collect_list(F.struct("h", "at")).alias("places"))
    return common.saved(found, "places")


def _cut(rows: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """row, doc, h, first, and the piece's bytes (written)."""
    schema = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("first", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 100):
            places = batch.column("places")
            size = np.diff(places.offsets.to_numpy())
            flat = places.flatten()
            h, at = (flat.field(k).to_numpy() for k in (0, 1))
            of = np.repeat(np.arange(batch.num_rows), size)
            first, count = at // (RUN + 1), at % (RUN + 1)
            texts = _encoded(batch)
            cut = [texts[i][a:b] for i, a, b in zip(of.tolist(), first.tolist(), (first + count + width - 1).tolist(), strict=True)]
            row, doc = (batch.column(c).to_numpy()[of] for c in ("row", "doc"))
            yield common.record(schema, row=row, doc=doc, h=h, first=first, piece=cut)

    joined = rows.join(shared.hint("shuffle_hash"), "row").select("row", "doc", "text", "places")
    path = common.own_path(rows.sparkSession, "pieces", keep=True)
    cut = joined.mapInArrow(common.lean(run), "row long, doc long, h long, first long, piece binary")
    # pieces overlap, so a real compressor makes little of them
    cut.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(cut.schema).parquet(path)


def _by_window(pieces: DataFrame, width: int) -> DataFrame:
    """As ``_spans``, for pieces of anchors that too many distinct pieces have: window by window, equal ones summed up first."""
    windows = pieces.select("h", "id", "low", "high", F.posexplode(F.expr(
        f"transform(sequence(1, octet_length(piece) - {width - 1}), i -> substring(piece, i, {width}))")).alias("at", "window"))
    least = windows.groupBy("window").agg(F.min("low").alias("least"))
    at = F.col("at").cast("long")
    return windows.join(least, "window").where("least < high").select("h", "id", at.alias("low"), at.alias("high"), "least")


def _spans(found: DataFrame, width: int, gram: int, shard_bytes: int, hot: int) -> DataFrame:
    """For each piece the runs of windows (low .. high) whose smallest document is ``least``: h, id, low, high, least."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("least", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        low, high = (group.column(c).to_numpy() for c in ("low", "high"))
        group = group.filter(pa.array((low < high) | related(group.column("piece").to_pylist(), group.column("h").to_numpy(), width, gram)))
        strings = group.column("piece").to_pylist()
        if not strings:
            return schema.empty_table()
        s = Suffixes(strings)
        owner = group.column("low").to_numpy()[s.of]
        shared, order = s.common(), s.sa
        first = np.flatnonzero(shared[order] < width)
        least = np.repeat(np.minimum.reduceat(owner[order], first), np.diff(np.append(first, len(order))))
        best = np.full(len(s.text), -1, np.int64)
        best[order] = least
        # windows in text order; a run ends with its piece or where another document is the smallest
        at = np.flatnonzero((s.rest >= width) & (best < group.column("high").to_numpy()[s.of]))
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (best[at[1:]] != best[at[:-1]]) | (s.of[at[1:]] != s.of[at[:-1]])
        a = at[new]
        b = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
        of = s.of[a]
        start = np.searchsorted(s.of, of)
        names = np.array([xxhash.xxh64_intdigest(strings[i], SEED) for i in of.tolist()], np.uint64).view(np.int64)
        return pa.table({"h": group.column("h").to_numpy()[of], "id": names, "low": a - start, "high": b - start, "least": best[a]}, schema=schema)

    distinct = found.groupBy("h", "piece").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    distinct = common.saved(distinct, "distinct")
    total = distinct.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod("h", F.lit(shards)).alias("shard")
    # only a shard of more pieces can have an anchor of more
    full = common.saved(distinct.groupBy(shard).agg(F.count("*").alias("n")).where(F.col("n") > hot).select("shard"), "full")
    apart = full.count() > 0
    if apart:
        crowded = distinct.select("h", shard).join(full, "shard", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
        many = common.saved(crowded.where(F.col("n") > hot).select("h"), "hot")
    usual = distinct.join(many, "h", "left_anti") if apart else distinct
    spans = usual.groupBy(shard).applyInArrow(search, "h long, id long, low long, high long, least long")
    return spans.unionByName(_by_window(distinct.join(many, "h", "left_semi").withColumn("id", F.xxhash64("piece")), width)) if apart else spans


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 16, shard_bytes: int = 1 << 20, hot: int = 50_000) -> DataFrame:
    """docs with four more columns: n_bytes, n_removed, n_spans (maximal removed runs) and ``kept``, the other bytes."""
    common.tune(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names)
    spark = docs.sparkSession
    with common.swept(spark), common.scratch(spark):
        rows = _keyed(docs)
        with common.scratch(spark):
            found = _cut(rows, _shared(rows, width, gram), width)
        with common.scratch(spark):
            spans = common.saved(_spans(found, width, gram, shard_bytes, hot), "spans", keep=True).withColumnsRenamed({"h": "h2", "id": "id2"})
        at = found.select("row", "doc", "h", F.xxhash64("piece").alias("id"), "first")
        gone = at.join(spans, (F.col("h") == F.col("h2")) & (F.col("id") == F.col("id2"))).where("least < doc").select(F.col("row").alias(
            "__row"), (F.col("first") + F.col("low")).alias("a"), (F.col("first") + F.col("high") + width).alias("b"))
        gone = common.saved(gone.groupBy("__row").agg(F.collect_list(F.struct("a", "b")).alias("__gone")), "cuts", keep=True)
    schema = docs.withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"),
        "kept": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 250):
            texts = _encoded(batch)
            kept, removed, runs = [], [], []
            for text, gone in zip(texts, batch.column("__gone").to_pylist(), strict=True):
                left, end, n = [], 0, 0
                for a, b in sorted((g["a"], g["b"]) for g in gone or ()):
                    if a > end or not n:
                        left.append(text[end:a])
                        n += 1
                    end = max(end, b)
                left.append(text[end:])
                kept.append(b"".join(left))
                removed.append(len(text) - len(kept[-1]))
                runs.append(n)
            out = {c: batch.column(c) for c in names} | {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(
                removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = docs.withColumn("__row", key).join(gone, "__row", "left").select(*names, "__gone")
    return joined.mapInArrow(common.lean(run), schema)


