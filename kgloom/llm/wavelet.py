"""Token-id shards as wavelet matrices: succinct bit-planes with rank and select, one compressed blob a shard.

Blob: ``KGWM2``, header (count of ids, planes), then for each plane its zero count, the ones before each frame of
``FRAME`` bits (the rank samples, which select searches too), the frames' ends, and the frames: packed bits,
each compressed with zstandard on its own. Opening reads the directories alone; access, rank, count and select inflate only the
frames that they touch, about two a plane, and keep the last ones used. ``ids`` inflates all.

Shards are rows of a Parquet table (``part, seq, first_doc, n_docs, n_null, n_tokens, doc_ids, doc_tokens, blob``), so any
store that Spark can reach will do, task retries leave nothing behind, and no Python file access is needed.
Ids stand in ascending ``doc_id`` order: parts are ranges of it, ``seq`` counts within a part.

Null text is empty; a document of any length lies whole in one shard; rows with one ``doc_id`` stay apart, in order
of their text; null ids come first. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

MAGIC = b"KGWM2"
SHARD_SCHEMA = "part int, seq int, first_doc long, n_docs long, n_null long, n_tokens long, doc_ids binary, doc_tokens binary, blob binary"
DOC_SCHEMA = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
#: Bits of a frame.
FRAME = 1 << 16


def to_blob(ids: np.ndarray, level: int = 1) -> bytes:
    """The wavelet matrix of ids (unsigned 32-bit)."""
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    a = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    out, pack = [MAGIC, struct.pack("<QB", len(a), planes)], zstandard.ZstdCompressor(level=level)
    step = FRAME // 8
    for k in range(planes - 1, -1, -1):
        ones = ((a >> a.dtype.type(k)) & a.dtype.type(1)).astype(bool)
        packed = np.packbits(ones, bitorder="little").tobytes()
        frames = [pack.compress(packed[i : i + step]) for i in range(0, len(packed), step)]
        ranks = [0, *(int(ones[i : i + FRAME].sum()) for i in range(0, len(ones), FRAME))]
        low = a[~ones]
        out += [struct.pack("<Q", len(low)), np.cumsum(ranks, dtype="<u8").tobytes(),
            np.cumsum([0, *map(len, frames)], dtype="<u8").tobytes(), *frames]
        a = np.concatenate([low, a[ones]])
    return b"".join(out)


class WaveletMatrix:
    def __init__(self, blob: bytes, kept_frames: int = 64):
        if blob[:5] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, self.planes = struct.unpack_from("<QB", blob, 5)
        self.blob, self.kept, self.open, self.inflated = blob, kept_frames, {}, 0
        self.unpack = zstandard.ZstdDecompressor()
        frames = -(-self.n // FRAME)
        at, self.zeros, self.ranks, self.ends, self.first = 14, [], [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", blob, at)[0])
            self.ranks.append(np.frombuffer(blob, "<u8", frames + 1, at + 8))
            self.ends.append(np.frombuffer(blob, "<u8", frames + 1, at + 16 + 8 * frames))
            self.first.append(at + 24 + 16 * frames)
            at = self.first[-1] + int(self.ends[-1][-1])

    def _frame(self, plane: int, k: int) -> np.ndarray:
        """The packed bits of one frame."""
        got = self.open.pop((plane, k), None)
        if got is None:
            lo, hi = (self.first[plane] + int(x) for x in self.ends[plane][k : k + 2])
            got = np.frombuffer(self.unpack.decompress(self.blob[lo:hi], max_output_size=FRAME // 8), np.uint8)
            self.inflated += 1
            if len(self.open) >= self.kept:
                del self.open[next(iter(self.open))]
        self.open[plane, k] = got
        return got

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i."""
        k, rest = divmod(i, FRAME)
        n = int(self.ranks[plane][k])
        if rest:
            bits = self._frame(plane, k)
            n += int(np.bitwise_count(bits[: rest >> 3]).sum())
            n += (int(bits[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0
        return n

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.planes):
            one = int(self._frame(k, i // FRAME)[i % FRAME >> 3]) >> (i & 7) & 1
            out = out << 1 | one
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if one else i - ones
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for k in range(self.planes):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (self.planes - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """How often the id occurs before place i."""
        if symbol >> self.planes:
            return 0
        lo, hi = self._range(symbol, min(max(i, 0), self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if one else np.minimum(np.arange(len(ranks)) * FRAME, self.n) - ranks
        frame = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._frame(plane, frame), bitorder="little")
        return frame * FRAME + int(np.flatnonzero(bits == one)[k - int(before[frame])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            one = symbol >> (self.planes - 1 - p) & 1
            i = self._select_bit(p, one, i - self.zeros[p] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing each plane's partition from the last up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for k in range(self.planes - 1, -1, -1):
            own = [self.unpack.decompress(self.blob[self.first[k] + int(x) : self.first[k] + int(y)], max_output_size=FRAME // 8) for x,
                y in itertools.pairwise(self.ends[k])]
            ones = np.unpackbits(np.frombuffer(b"".join(own), np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(v)
            up[~ones], up[ones] = v[: self.zeros[k]], v[self.zeros[k] :] | kind(1 << (self.planes - 1 - k))
            v = up
        return v.astype(np.uint32)


def _shard(part: int, seq: int, docs: list, lens: list, ids: list, schema: pa.Schema) -> pa.RecordBatch:
    all_ids = np.concatenate(ids)
    known = [d for d in docs if d is not None]
    return common.record(
        schema, part=[part], seq=[seq], first_doc=[known[0] if known else None], n_docs=[len(docs)], n_null=[len(docs) - len(known)], n_tokens=[len(all_ids)],
        doc_ids=[np.array([0] * (len(docs) - len(known)) + known, "<i8").tobytes()], doc_tokens=[np.array(lens, "<i8").tobytes()], blob=[to_blob(all_ids)],
    )


def write_token_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, shard_tokens: int = 1 << 20) -> None:
    """Encodes every text, adds end_id, and writes shards of about shard_tokens ids in doc_id order."""
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_null", pa.int64()),
            ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_tokens", pa.binary()), ("blob", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, seq, size = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        docs, lens, held = [], [], []
        end = np.array([end_id], np.uint32)
        for batch in common.slices(batches, 250):
            ids, n = enc.encode(common.texts(batch))
            at = 0
            for d, k in zip(batch.column("doc_id").to_pylist(), n.tolist(), strict=True):
                docs.append(d)
                lens.append(k + 1)
                held += [ids[at : at + k], end]
                at, size = at + k, size + k + 1
                if size >= shard_tokens:
                    yield _shard(part, seq, docs, lens, held, schema)
                    docs, lens, held, seq, size = [], [], [], seq + 1, 0
        if docs:
            yield _shard(part, seq, docs, lens, held, schema)

    common.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(common.lean(encode), SHARD_SCHEMA).write.parquet(
        path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document what the shards hold: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            x = {k: v[0] for k, v in batch.to_pydict().items()}
            ids = WaveletMatrix(x["blob"]).ids().astype("<u4")
            docs, lens = np.frombuffer(x["doc_ids"], "<i8"), np.frombuffer(x["doc_tokens"], "<i8")
            ends = np.cumsum(lens)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
            doc = pa.array(docs, pa.int64(), mask=np.arange(len(docs)) < x["n_null"])  # they come first
            yield common.record(schema, part=np.full(len(docs), x["part"], np.int32), seq=np.full(len(docs), x["seq"], np.int32), doc_id=doc,
                local_start=ends - lens, n_tokens=lens, ids_crc32=crc)

    small = shards.select("part", "seq", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part, and parts are as many as the cluster's shuffle partitions
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    inside = small.select("part", "seq",
        (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("seq_base"))
    base = inside.join(before, "part").select("part", "seq", (F.col("part_base") + F.col("seq_base")).alias("base"))
    found = shards.select("part", "seq", "n_null", "doc_ids", "doc_tokens", "blob").mapInArrow(common.lean(decode), DOC_SCHEMA)
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def find_token(shards: DataFrame, token: int, most: int | None = None) -> DataFrame:
    """part, seq, count and places (in the shard's ids, ascending; at most so many of each shard) of one id, by rank and select in each
    shard's blob: no shard's ids are unfolded."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("count", pa.int64()), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            x = {k: v[0] for k, v in batch.to_pydict().items()}
            m = WaveletMatrix(x["blob"])
            n = m.count(token)
            yield common.record(schema, part=[x["part"]], seq=[x["seq"]], count=[n],
                places=[[m.select(token, k) for k in range(n if most is None else min(n, most))]])

    return shards.select("part", "seq", "blob").mapInArrow(common.lean(run), "part int, seq int, count long, places array<long>")
