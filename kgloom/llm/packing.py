"""Packing by best-fit decreasing: a segment tree over remaining capacities finds the tightest open window.

Documents are cut into full windows first; what remains of each is placed by length, longest first, into the
window with the least room that still holds it. A task packs what it has read in batches of at most
``batch_tokens`` ids and ``batch_pieces`` pieces (and one document more), so memory is bounded and no document moves between
tasks: there is no shuffle. Only a batch's last windows can stay far from full.

Null text is empty (its end id alone is packed). Rows with one doc_id are packed apart. An empty table gives no rows.
Extra columns are ignored. Numbers of sequences follow the task's number, so a task that runs again gives the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"

#: Pre-tokens that a worker knows at once: fewer than elsewhere, as packing comes last, when executors are full.
KEPT = 250_000


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities tells which have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A window with the smallest capacity >= least, removed."""
        any_, i = self.any, least + self.size
        if not any_[i]:
            while i > 1 and (i & 1 or not any_[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if any_[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.at[room].pop()
        if not self.at[room]:
            any_[i] = 0
            i >>= 1
            while i and not (any_[2 * i] or any_[2 * i + 1]):
                any_[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Window and offset of each item, and the windows' fill. Items of 1..capacity; ties go by their order."""
    window, offset, fill, open_ = [0] * len(lengths), [0] * len(lengths), [], OpenWindows(capacity)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        room, w = open_.take(n) or (capacity, len(fill))
        if w == len(fill):
            fill.append(0)
        window[i], offset[i] = w, fill[w]
        fill[w] += n
        if room > n:
            open_.add(room - n, w)
    return window, offset, fill


def padded(used: int, capacity: int) -> int:
    """A sequence's stored length: the capacity, but a power of two stays as it is."""
    return used if used & (used - 1) == 0 else capacity


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, batch_tokens: int = 16 << 20,
    batch_pieces: int = 1 << 18) -> DataFrame:
    """One row per piece; extra columns: sequence_tokens (ids in the sequence), padded_to (its stored length)."""
    kinds = [(k.split()[0], pa.int64()) for k in SCHEMA.split(", ")]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first = encoder(tokenizer), TaskContext.get().partitionId() << 32
        enc.KEPT = KEPT
        pieces: list[tuple] = []
        size, made = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal pieces, size, made
            window, offset, fill = best_fit([p[2] for p in pieces], capacity)
            doc, start, length, crc, total = zip(*pieces, strict=True)
            used = [fill[w] for w in window]
            out = common.record(schema, doc_id=doc, start=start, length=length, ids_crc32=crc, doc_tokens=total,
                sequence_id=[first + made + w for w in window], offset=offset, sequence_tokens=used,
                padded_to=[padded(u, capacity) for u in used])
            pieces, size, made = [], 0, made + len(fill)
            return out

        for turn, batch in enumerate(common.slices(batches, 250), 1):
            if turn % 8 == 0:
                common.release()
            ids, n = enc.encode(common.texts(batch))
            ids = ids.astype("<u4")
            at = 0
            for d, k in zip(batch.column("doc_id").to_pylist(), n.tolist(), strict=True):
                whole = memoryview(np.append(ids[at : at + k], np.uint32(end_id)).astype("<u4").tobytes())
                at += k
                for s in range(0, k + 1, capacity):
                    e = min(s + capacity, k + 1)
                    pieces.append((d, s, e - s, zlib.crc32(whole[4 * s : 4 * e]), k + 1))
                size += k + 1
                if size >= batch_tokens or len(pieces) >= batch_pieces:
                    yield flush()
        if pieces:
            yield flush()
        enc.forget()  # a worker may serve other operators next

    common.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run),
        SCHEMA)
