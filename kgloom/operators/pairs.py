"""Pairs counted from lists: what moves is one list for each member of a set, not one row for each pair in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import PART_ROWS, dealt, ship

if TYPE_CHECKING:
    import pyarrow as pa

#: Pairs that a task has in memory at once, unless one number has more.
STEP = 1 << 21


def _counts(labelled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def runs(key):
        import numpy as np

        return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        a, least, size = (np.asarray(x) for x in (rows["a"], rows["least"], pc.list_value_length(rows["others"])))
        others, offsets = np.asarray(pc.list_flatten(rows["others"])), np.cumsum(size) - size
        if labelled:
            coded = pc.dictionary_encode(rows["label"]).combine_chunks()
            order = np.asarray(pc.array_sort_indices(coded.dictionary))
            labels, rank = coded.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            label = rank[np.asarray(coded.indices)]
        by = np.argsort(a, kind="stable")
        ends, start = np.cumsum(size[by]), 0
        while start < len(by):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
            end = int(np.searchsorted(a[by], a[by[end - 1]], "right"))
            some, start = by[start:end], end
            n = size[some]
            who, place = np.unique(a[some], return_inverse=True)
            other = others[np.repeat(offsets[some] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
            if not len(other):
                continue
            wide, at = int(other.max()).bit_length(), np.repeat(place, n)
            if not labelled:
                key = np.sort(at << wide | other)
            else:
                deep, own = len(labels).bit_length(), np.repeat(label[some], n)
                if len(who).bit_length() + wide + deep < 64:
                    key = np.sort((at << wide | other) << deep | own)
                    key, own = key >> deep, key & ((1 << deep) - 1)
                else:
                    order = np.lexsort((own, other, at))
                    key, own = (at << wide | other)[order], own[order]
            first = runs(key)
            together = np.diff(np.r_[first, len(key)])
            at, other = key[first] >> wide, key[first] & ((1 << wide) - 1)
            fewest = np.zeros(len(who), np.int64)
            np.maximum.at(fewest, place, least[some])
            kept = (together >= fewest[at]) & (who[at] != other)
            made = {"a": who[at][kept].astype(np.int32), "b": other[kept].astype(np.int32), "n": together[kept]}
            if labelled:
                made["label"] = labels.take(pa.array(own[first][kept]))
            yield from pa.table(made).to_batches(max_chunksize=1 << 16)

    return count


def slots(most: int, pairs: int, rows: int) -> int:
    """Into how many slots the others of a number are dealt, so that one with so many lists at most has no more than some million pairs."""
    return max(1, -(-most * pairs // max(1, rows * 16 * PART_ROWS)))


def counted(lists: DataFrame, pairs: int, labelled: bool = False) -> DataFrame:
    """a, b, n (and label, the smallest): in how many lists of a number a each other number b stands, where that is at least a's ``least``.

    lists: a, slot, others (array<int>, each once), least (int; equal in an a's lists), and label. a and b are ints; an a is not its own other. Lists
    are dealt by a and slot, in parts that counts keep near two million pairs (pairs: how many there are), and a part's pairs are made and counted
    by sorting, a step of about as many at a time."""
    ship(lists.sparkSession)
    cols = ["a", "least", "others", *(["label"] if labelled else [])]
    shape = "a int, b int, n long" + (", label string" if labelled else "")
    return dealt(lists.select("slot", *cols), pairs, "a", "slot", part_rows=4 * PART_ROWS).select(*cols).mapInArrow(_counts(labelled), shape)


def pack(value: str, size: str, n_slots: int, each: int = 1000) -> tuple:
    """slot and pack of a value in a set of so many (a column): lists of about ``each``, dealt by slots first."""
    return F.pmod(F.xxhash64(value), F.lit(n_slots)).alias("slot"), F.pmod(F.xxhash64(value, F.lit(1)), F.ceil(F.col(size) / (1.0 * each * n_slots))).alias("pack")
