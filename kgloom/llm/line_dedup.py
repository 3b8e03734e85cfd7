"""Line dedup: a sharded minimal perfect hash over repeated line hashes; documents probe its arrays.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least ``min_chars``
code points that stand in two documents or more lose all their lines but those of the smallest doc_id.

Keys become 128-bit hashes; counting them is one aggregation of narrow rows (combined before the shuffle, so a line
that every document holds costs one row a task). The repeated ones are dealt into shards by hash; each shard gets a
minimal perfect hash (levels of bit arrays, rank gives the slot) over arrays of fingerprint, count and keeper. Lines that
stand in one document only are counted too, but have no place in the arrays, as they are never dropped.
Up to ``broadcast_keys`` repeated keys (28 bytes each) the arrays are sent to all tasks; beyond that, line hashes go
to their shard, salted so that a hot line spreads, and only the lines to drop come back.

Null or empty text is one empty line. Null doc_ids hold no line and lose none. Rows with one doc_id count as one
document. A text of any length is cut and probed in one piece. An empty table gives no rows. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLANK = b" \t\n\x0b\x0c\r"
INDEX_SCHEMA = "shard int, n long, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary"


def keys_of(text: str, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and each one's 128-bit hash (none where the key is short)."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out = []
    for line in lines:
        key = line.strip(BLANK).lower()
        out.append(
            xxhash.xxh3_128_digest(key) if len(key) >= min_chars and (
                key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars) else None)
    return lines, out


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29)) ^ h2) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of 128-bit keys (two halves): at each level the keys that stand alone take their bit, the others
    go on. Keys that share a half are apart; those given twice count once."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, load: float = 2.0) -> PerfectHash:
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        h1, h2, sizes, planes = h1[new], h2[new], [], []
        while len(h1):
            size = max(64, int(load * len(h1)))
            at = _place(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            planes.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(planes) if planes else np.zeros(0, bool))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for keys that it doesn't hold."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=True)):
            at = start + _place(h1[left], h2[left], level, size).astype(np.int64)
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left = left[~here]
        return out


class LineIndex:
    """Shards of the index, each with its hash function and arrays."""

    def __init__(self, rows: list[dict]):
        self.shards = {}
        for r in rows:
            sizes = np.frombuffer(r["sizes"], "<i8")
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            self.shards[r["shard"]] = (PerfectHash(sizes, bits), np.frombuffer(r["fingerprints"], "<u8"), np.frombuffer(r["counts"], "<i8"),
                np.frombuffer(r["keepers"], "<i8"))

    def probe(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each key (0: not repeated), and the smallest."""
        count, keeper = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        for s in np.unique(shard).tolist():
            if s in self.shards:
                at = np.flatnonzero(shard == s)
                mph, marks, counts, keepers = self.shards[s]
                slot = mph.slots(h1[at], h2[at])
                good = slot >= 0
                good[good] = marks[slot[good]] == h2[at[good]]
                count[at[good]], keeper[at[good]] = counts[slot[good]], keepers[slot[good]]
        return count, keeper


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    two = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return two[:, 0], two[:, 1]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each document and distinct long key: h1, h2, doc_id."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                if d is not None:
                    own = {h for h in keys_of(t, min_chars)[1] if h is not None}
                    hashes += own
                    ids += [d] * len(own)
            h1, h2 = _halves(hashes)
            yield common.record(schema, h1=h1.view(np.int64), h2=h2.view(np.int64), doc_id=ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run),
        "h1 long, h2 long, doc_id long")


def build_index(docs: DataFrame, min_chars: int = 10, shard_keys: int = 250_000) -> tuple[DataFrame, int, int]:
    """The index's shards as a written table, their number, and the number of repeated keys."""
    schema = pa.schema(
        [("shard", pa.int32()), ("n", pa.int64()), *((k, pa.binary()) for k in ("sizes", "bits", "fingerprints", "counts", "keepers"))])

    def build(group: pa.Table) -> pa.Table:
        x = {k: group.column(k).to_numpy() for k in ("h1", "h2", "n", "keeper", "shard")}
        h1 = x["h1"].view(np.uint64)
        h2 = x["h2"].view(np.uint64)
        mph = PerfectHash.build(h1, h2)
        slot = mph.slots(h1, h2)
        arrays = [np.zeros(len(h1), kind) for kind in ("<u8", "<i8", "<i8")]
        for a, v in zip(arrays, (h2, x["n"], x["keeper"]), strict=True):
            a[slot] = v
        return pa.Table.from_batches(
            [
                common.record(schema, shard=[int(x["shard"][0])], n=[len(h1)], sizes=[mph.sizes.astype("<i8").tobytes()],
                    bits=[np.packbits(mph.bits).tobytes()], fingerprints=[arrays[0].tobytes()], counts=[arrays[1].tobytes()],
                    keepers=[arrays[2].tobytes()])])

    common.tune(docs.sparkSession)
    seen = line_hashes(docs, min_chars).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"),
        F.max("doc_id").alias("last"))
    repeated = common.saved(seen.where("keeper < last").drop("last"), "lines")
    total = repeated.count()
    shards = max(1, -(-total // shard_keys))
    index = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, INDEX_SCHEMA)
    return common.saved(index, "line-index"), shards, total


def dedup_lines(docs: DataFrame, min_chars: int = 10, broadcast_keys: int = 2_000_000, shard_keys: int = 250_000,
    salt_rows: int = 1_000_000) -> DataFrame:
    """docs with the kept text in ``text`` and two more columns, n_lines and n_dropped."""
    spark = common.tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*names)
    index, shards, total = build_index(docs, min_chars, shard_keys)
    schema = docs.withColumn("text", F.col("text").cast("string")).withColumns(
        {"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    if total <= broadcast_keys:
        sent = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])
        drops, source = None, docs
    else:
        sent, drops = None, _dropped(docs, index, shards, min_chars, salt_rows)
        key = "__doc"
        source = docs.withColumn(key, F.col("doc_id").cast("long")).join(drops, key, "left").drop(key)
    opened: list[LineIndex] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 250):
            split = [keys_of(t, min_chars) for t in common.texts(batch)]
            ids = batch.column("doc_id").to_pylist()
            places = [(i, j) for i, (_, hs) in enumerate(split) for j, h in enumerate(hs) if h is not None and ids[i] is not None]
            gone: list[set] = [set() for _ in split]
            if sent is not None:
                if not opened:
                    opened.append(LineIndex(sent.value))
                h1, h2 = _halves([split[i][1][j] for i, j in places])
                count, keeper = opened[0].probe((h1.view(np.int64) % shards).astype(np.int64), h1, h2)
                for k in np.flatnonzero(count > 0).tolist():
                    i, j = places[k]
                    if keeper[k] != ids[i]:
                        gone[i].add(j)
            else:
                away = [set(x or ()) for x in batch.column("__gone").to_pylist()]
                for i, j in places:
                    if split[i][1][j] in away[i]:
                        gone[i].add(j)
            kept = [b"\n".join(x for j, x in enumerate(lines) if j not in gone[i]).decode("utf-8", "surrogatepass") for i,
                (lines, _) in enumerate(split)]
            out = {c: batch.column(c) for c in names} | {"text": pa.array(kept), "n_lines": pa.array([len(x) for x, _ in split], pa.int64()),
                "n_dropped": pa.array([len(g) for g in gone], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return source.mapInArrow(common.lean(run), schema)


def _dropped(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, salt_rows: int) -> DataFrame:
    """For documents that lose lines, the hashes of those (__doc, __gone)."""
    lines = line_hashes(docs, min_chars)
    busiest = lines.groupBy(F.pmod("h1", F.lit(shards))).count().agg(F.max("count")).first()[0] or 1
    salts = max(1, -(-busiest // salt_rows))
    schema = pa.schema([("__doc", pa.int64()), ("h", pa.binary())])
    keyed = lines.withColumns({"shard": F.pmod("h1", F.lit(shards)).cast("int"), "salt": F.pmod(F.hash("doc_id"), F.lit(salts)).cast("int")})
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        h1, h2 = (left.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        ids = left.column("doc_id").to_numpy()
        count, keeper = LineIndex(right.to_pylist()).probe(left.column("shard").to_numpy(), h1, h2)
        at = np.flatnonzero((count > 0) & (keeper != ids))
        two = np.stack([h1[at], h2[at]], 1).astype("<u8")
        return pa.table({"__doc": ids[at], "h": [x.tobytes() for x in two]}, schema=schema)

    found = keyed.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "__doc long, h binary")
    return found.groupBy("__doc").agg(F.collect_list("h").alias("__gone"))
