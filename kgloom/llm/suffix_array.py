"""Suffix arrays by induced sorting, for many short strings at once, and their permuted common prefixes.

The strings stand one after the other, each closed by an end mark that is smaller than every byte and differs from all other
marks (a later one is smaller), so no comparison runs over the end of a string.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller ones are sorted by recursion over the
names of the substrings between them, until names occur few times and are told apart by rank doubling; the others are induced from these, bucket by bucket. Buckets are scanned in batches:
neighbouring buckets none of whose suffixes is placed into another bucket of the batch have their predecessors placed by
one stable sort, in the order in which a scan one by one would place them.
"""

from __future__ import annotations

import numpy as np

#: Names that occur more often than this, on average, are sorted by recursion, others by doubling.
DOUBLE = 64


def _kinds(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    n = len(t)
    at = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype=np.int32), np.int32(n))
    out = np.ones(n, bool)
    if n > 1:
        # equal symbols follow the first difference to the right; before it stands always one, as the last symbol is the smallest
        out[:-1] = (t[:-1] < t[1:])[np.minimum.accumulate(at[::-1])[::-1]]
    return out


def _batches(low: np.ndarray, high: np.ndarray, size: int) -> list[tuple[int, int, bool]]:
    """Bucket ranges (from, to, whether it is one that feeds itself) so that no pair (low, high) of different buckets lies in
    one range."""
    own = np.zeros(size, bool)
    own[low[low == high]] = True
    limit = np.full(size, size, np.int32)
    np.minimum.at(limit, low, np.where(low < high, high, np.int32(size)))
    out, start, end = [], 0, size
    stops = np.flatnonzero((limit < size) | own)
    for b, to, alone in zip(stops.tolist(), limit[stops].tolist(), own[stops].tolist(), strict=True):
        if end <= b:
            out.append((start, end, False))
            start, end = end, size
        if alone:
            if start < b:
                out.append((start, b, False))
            out.append((b, b + 1, True))
            start, end = b + 1, size
        end = min(end, to) if not alone else size
    if start < end < size:
        out.append((start, end, False))
        start = end
    if start < size:
        out.append((start, size, False))
    return out


def _place(sa: np.ndarray, t: np.ndarray, edge: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Appends suffixes, in order, to their buckets: from the front (step 1) or from the back (-1)."""
    if not len(suffixes):
        return
    c = t[suffixes]
    order = np.argsort(c, kind="stable")
    c = c[order]
    # the last of each symbol
    last = np.append((c[1:] != c[:-1]).nonzero()[0], len(c) - 1)
    symbol = c[last]
    count = last.copy()
    count[0] += 1
    count[1:] -= last[:-1]
    # where each symbol's first would lie if the block began there
    base = edge[symbol] - step * (last - count + 1) - (step < 0)
    sa[base.repeat(count) + step * np.arange(len(c))] = suffixes[order]
    edge[symbol] += step * count


class _Induction:
    def __init__(self, t: np.ndarray, symbols: int, ends: np.ndarray):
        self.t, self.ends, self.smaller = t, ends, _kinds(t)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=symbols))])
        larger, smaller = np.flatnonzero(~self.smaller[:-1]), np.flatnonzero(self.smaller[:-1] & (t[:-1] > 0))
        self.up = _batches(t[larger + 1].astype(np.int32), t[larger].astype(np.int32), symbols)
        mirror = symbols - 1
        self.down = [(mirror + 1 - b, mirror + 1 - a, alone) for a, b, alone in _batches(mirror - t[smaller + 1].astype(np.int32),
            mirror - t[smaller].astype(np.int32), symbols)]
        self.lms = np.flatnonzero(np.append(False, self.smaller[1:] & ~self.smaller[:-1]))
        self.forth, self.back = ~self.smaller, self.smaller & (t > 0)
        self.is_lms = np.zeros(len(t), bool)
        self.is_lms[self.lms] = True
        self.larger = np.bincount(t[~self.smaller], minlength=symbols)

    def _before(self, block: np.ndarray, smaller: bool) -> np.ndarray:
        j = block[block > 0] - 1
        return j[(self.back if smaller else self.forth)[j]]

    def run(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, sorted as far as the order of the leftmost-smaller ones (given, end marks left out) reaches."""
        t, bounds = self.t, self.bounds
        sa = np.full(len(t), -1, np.int32)
        sa[:len(self.ends)] = self.ends
        _place(sa, t, bounds[1:].copy(), lms[::-1], -1)
        head, split = bounds[:-1].copy(), bounds[:-1] + self.larger
        for a, b, alone in self.up:
            if alone:
                done = bounds[a]
                while done < head[a]:
                    upto = head[a]
                    _place(sa, t, head, self._before(sa[done:upto], False), 1)
                    done = upto
                block = sa[split[a]:bounds[b]]
            else:
                block = sa[bounds[a]:bounds[b]]
            _place(sa, t, head, self._before(block[block >= 0], False), 1)
        tail = bounds[1:].copy()
        filled = np.arange(len(t), dtype=np.int32) < np.repeat(split.astype(np.int32), np.diff(bounds))
        filled[:len(self.ends)] = True
        sa[~filled] = -1
        for a, b, alone in self.down:
            if alone:
                done = bounds[b]
                while done > tail[a]:
                    upto = tail[a]
                    _place(sa, t, tail, self._before(sa[upto:done][::-1], True), -1)
                    done = upto
                block = sa[bounds[a]:split[a]][::-1]
            else:
                block = sa[bounds[a]:bounds[b]][::-1]
            _place(sa, t, tail, self._before(block[block >= 0], True), -1)
        return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For leftmost-smaller suffixes in order, whether their substring differs from the one before."""
    length = np.ones(len(t), np.int32)
    length[lms[:-1]] += np.diff(lms).astype(np.int32)
    a, b = order[:-1], order[1:]
    new = (length[a] != length[b]) | (t[a] == 0)
    left = np.flatnonzero(~new)
    # several symbols at a time, those past the end left out
    per = 8 // t.itemsize
    words = np.ndarray((len(t),), "<u8", t.tobytes() + bytes(8), 0, (t.itemsize,))
    masks = np.array([(1 << 8 * t.itemsize * k) - 1 for k in range(per + 1)], np.uint64)
    off = 0
    while len(left):
        x, y = a[left], b[left]
        rest = length[x] - off
        same = (words[x + off] ^ words[y + off]) & masks[np.minimum(rest, per)] == 0
        new[left[~same]] = True
        left, off = left[same & (rest > per)], off + per
    return np.append(True, new)


def _settle(t: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array of a text whose last symbol is the smallest and occurs once: equal symbols are told apart by the ranks of what
    follows, twice as far each time."""
    count = np.bincount(t, minlength=symbols)
    rank = (np.cumsum(count) - count)[t]
    left, step = np.flatnonzero(count[t] > 1), 1
    while len(left):
        # both ranks in one number
        key = rank[left] * len(t) + rank[left + step]
        order = np.argsort(key)
        left, key = left[order], key[order]
        own = rank[left]
        at = np.arange(len(left))
        group = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), at, 0))
        new = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[left] = own + start - group
        alone = new & np.append(new[1:], True)
        left, step = left[~alone], 2 * step
    out = np.empty(len(t), np.int32)
    out[rank] = np.arange(len(t), dtype=np.int32)
    return out


def _sort(t: np.ndarray, symbols: int, ends: np.ndarray) -> np.ndarray:
    """The suffix array of t, whose symbol 0 stands at ``ends`` only, given in their order; t's last symbol is the first of them."""
    work = _Induction(t, symbols, ends)
    inner = work.lms[t[work.lms] > 0]
    sa = work.run(inner)
    order = sa[work.is_lms[sa]]
    name = np.cumsum(_names(t, work.lms, order)) - 1
    names = int(name[-1]) + 1
    if names < len(order):
        place = np.empty(len(t), np.int32)
        place[order] = name
        reduced = place[work.lms]
        if DOUBLE * names > len(reduced):
            found = _settle(reduced, names)
        else:
            found = _sort(reduced.astype(np.uint16 if names <= 1 << 16 else np.int32), names, np.array([len(reduced) - 1]))
        order = work.lms[found]
    return work.run(order[t[order] > 0])


class Suffixes:
    """The sorted suffixes of strings: ``sa`` (positions in the joined text, in order, end marks left out), and for every
    position ``rest``, the bytes to its string's end, and ``of``, its string."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.text = b"\0".join(strings) + b"\0"
        byte = np.frombuffer(self.text, np.uint8)
        close = np.cumsum(size + 1) - 1
        t = byte.astype(np.uint16) + np.uint16(1)
        t[close] = 0
        self.of = np.repeat(np.arange(len(strings), dtype=np.int32), size + 1)
        self.rest = close.astype(np.int32)[self.of] - np.arange(len(t), dtype=np.int32)
        # bytes that do not occur have no buckets
        used = np.zeros(257, bool)
        used[t] = True
        used[0] = True
        self._symbols = (np.cumsum(used) - 1).astype(np.uint16)[t]
        self.sa = _sort(self._symbols, int(used.sum()), close[::-1])[len(strings):]

    def common(self) -> np.ndarray:
        """By text position: the bytes a suffix shares with the one before it in the order. Where the preceding symbols agree,
        it is one less than at the position before; the others are compared, eight bytes at a time."""
        n, sa = len(self.text), self.sa
        before = np.full(n, -1, np.int32)
        before[sa[1:]] = sa[:-1]
        t = self._symbols
        at = np.arange(n, dtype=np.int32)
        fresh = np.ones(n, bool)
        fresh[1:] = (before[1:] <= 0) | (t[:-1] == 0) | (t[:-1] != t[before[1:] - 1])
        words = np.ndarray((n,), "<u8", self.text + bytes(8), 0, (1,))
        i = np.flatnonzero(fresh & (before >= 0))
        j = before[i]
        most = np.minimum(self.rest[i], self.rest[j])
        out = np.zeros(n, np.int32)
        left, off = np.arange(len(i)), 0
        while len(left):
            x = words[i[left] + off] ^ words[j[left] + off]
            more = (x == 0) & (most[left] > off + 8)
            ended, x = left[~more], x[~more]
            # the lowest bit that differs lies in the first byte that does
            low = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1
            out[i[ended]] = np.minimum(off + np.where(x == 0, 8, low >> 3), most[ended])
            left, off = left[more], off + 8
        last = np.maximum.accumulate(np.where(fresh, at, np.int32(0)))
        return np.where(before >= 0, out[last] - (at - last), 0)
