"""Token ids exactly as the tokenizers library gives them, with each distinct pre-token encoded once.

The library spends most of its time on words that it has seen before. Here the text is cut into
pre-tokens with numpy, a pre-token's ids come from the tokenizer's own BPE model when it is first met,
and later occurrences are looked up by a hash of their bytes. The bytes of each known pre-token are kept and every
occurrence is compared with them; a text in which a hash meets other bytes goes through the library whole. Only texts
within printable Latin-1, without apostrophes or an added token's string, are cut this way; all others go through the
library whole. So do all texts of a tokenizer of which the two known cutting rules don't hold.
"""

from __future__ import annotations

import json

import numpy as np
from pandas._libs.hashtable import UInt64Factorizer
from tokenizers import Tokenizer

SPACE, LETTER, NUMBER, OTHER, END, UNSAFE = range(6)


def _classes() -> np.ndarray:
    out = np.full(256, UNSAFE, np.uint8)
    for c in range(256):
        x = chr(c)
        if x in "\t\n\x0b\x0c\r \xa0":
            out[c] = SPACE
        elif x == "'" or c < 32 or 127 <= c < 160 or c == 0xAD:
            continue
        elif x.isalpha():
            out[c] = LETTER
        elif x.isnumeric():
            out[c] = NUMBER
        else:
            out[c] = OTHER
    return out


def _visible() -> dict[int, str]:
    """The byte-level alphabet, for a Latin-1 character of UTF-8 text."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}
    byte = [chr(b if b in plain else rest[b]) for b in range(256)]
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}


#: By length 0 to 8: what remains of eight bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Encoder:
    #: Latin-1 bytes cut at once, and distinct pre-tokens kept; then the table starts anew.
    CHUNK, KEPT = 1 << 17, 500_000

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre, norm = json.dumps(spec.get("pre_tokenizer") or {}), spec.get("normalizer")
        self.rule = None
        if spec["model"]["type"] == "BPE" and not any(t["normalized"] for t in spec.get("added_tokens") or []) and not spec["model"].get(
            "dropout") and "ByteLevel" in pre:
            if norm is None and '"use_regex": true' in pre and '"add_prefix_space": false' in pre and '"Sequence"' not in pre:
                self.rule = "spaced"
            elif norm and "Lowercase" in json.dumps(norm) and spec["model"].get("end_of_word_suffix") and '"Split"' in pre:
                self.rule = "words"
        self.cls, self.map = _classes(), _visible()
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(2**62, 2**63)) | 5
        self.power = self.inverse = np.ones(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        """Drops the table of known pre-tokens."""
        self.known, self.n = UInt64Factorizer(1 << 16), 0
        self.off, self.len = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0
        # the pre-tokens' own bytes: length, the first sixteen, and the rest of longer ones
        self.size, self.head, self.mid = np.zeros(1024, np.int64), np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.tail: dict[int, bytes] = {}

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            m = 1 << (n - 1).bit_length()
            inv = pow(self.base, -1, 2**64)
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, self.base, np.uint64)]))
                self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, inv, np.uint64)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's number of ids."""
        parts: list[np.ndarray | None] = [None] * len(texts)
        todo: list[tuple[int, bytes]] = []
        slow: list[int] = []
        for i, t in enumerate(texts):
            if not self.rule or any(a in t for a in self.added):
                slow.append(i)
                continue
            try:
                todo.append((i, (t.lower() if self.rule == "words" else t).encode("latin-1")))
            except UnicodeEncodeError:
                slow.append(i)
        at = 0
        while at < len(todo):
            end, size = at, 0
            while end < len(todo) and (end == at or size + len(todo[end][1]) < self.CHUNK):
                size += len(todo[end][1]) + 1
                end += 1
            slow += self._fast(todo[at:end], parts)
            at = end
        for k in range(0, len(slow), 64):
            some = slow[k : k + 64]
            for i, e in zip(some, self.tok.encode_batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
        return np.concatenate(parts or [np.zeros(0, np.uint32)]).astype(np.uint32), np.array([len(p) for p in parts], np.int64)

    def _fast(self, docs: list[tuple[int, bytes]], parts: list) -> list[int]:
        """Fills parts; returns the documents that need the library."""
        whole = b"\0".join(b for _, b in docs) + bytes(17)
        raw = np.frombuffer(whole, np.uint8)[:-16]
        sizes = np.array([len(b) + 1 for _, b in docs], np.int64)
        ends = np.cumsum(sizes)
        cls = np.take(self.cls, raw)
        cls[ends - 1] = END
        if (bad := np.flatnonzero(cls == UNSAFE)).size:
            out = {int(x) for x in np.searchsorted(ends, bad, side="right")}
            left = [d for k, d in enumerate(docs) if k not in out]
            return [docs[k][0] for k in sorted(out)] + (self._fast(left, parts) if left else [])
        prev = np.empty_like(cls)
        prev[0], prev[1:] = END, cls[:-1]
        start = cls != prev
        if self.rule == "spaced":
            after = np.empty_like(cls)
            after[-1], after[:-1] = END, cls[1:]
            space = cls == SPACE
            start |= space & (after != SPACE) & (after != END)
            blank = np.zeros(len(raw), bool)
            blank[1:] = raw[:-1] == 32
            start &= ~(blank & ~space & (cls != END))
        else:
            start |= cls == NUMBER
        start[ends - 1] = True
        cut = np.flatnonzero(start)
        first = cls[cut]
        keep = first != END if self.rule == "spaced" else (first != END) & (first != SPACE)
        stop = np.empty_like(cut)
        stop[:-1], stop[-1] = cut[1:], len(raw)
        cut, stop = cut[keep], stop[keep]
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(np.take(self.value, raw) * self.power[: len(raw)], out=total[1:])
            h = (total[stop] - total[cut]) * self.inverse[cut] + (stop - cut).astype(np.uint64)
        if self.n > self.KEPT:
            self.forget()
        codes = self.known.factorize(h)
        if codes.size and (new := codes.max() + 1 - self.n) > 0:
            where = np.empty(new, np.int64)
            fresh = np.flatnonzero(codes >= self.n)
            where[codes[fresh[::-1]] - self.n] = fresh[::-1]
            text, tokenize, table = raw.tobytes().decode("latin-1"), self.tok.model.tokenize, self.map
            for w in where.tolist():
                self._add(whole[cut[w] : stop[w]], [t.id for t in tokenize(text[cut[w] : stop[w]].translate(table))])
        if (other := self._differ(whole, cut, stop, codes)).size:
            out = {int(x) for x in np.searchsorted(ends, cut[other], side="right")}
            left = [d for k, d in enumerate(docs) if k not in out]
            return [docs[k][0] for k in sorted(out)] + (self._fast(left, parts) if left else [])
        n, o = self.len[codes], self.off[codes]
        done = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=done[1:])
        ids = self.pool[np.repeat(o - done[:-1], n) + np.arange(done[-1])]
        edge = done[np.searchsorted(cut, np.concatenate([[0], ends]))]
        for k, (i, _) in enumerate(docs):
            parts[i] = ids[edge[k] : edge[k + 1]]
        return []

    def _differ(self, whole: bytes, cut: np.ndarray, stop: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Pre-tokens whose bytes aren't those of the known one that has their hash."""
        eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
        size = stop - cut
        wrong = (self.size[codes] != size) | (self.head[codes] != eight[cut] & _MASK[np.minimum(size, 8)])
        over = np.flatnonzero(size > 8)
        wrong[over] |= self.mid[codes[over]] != eight[cut[over] + 8] & _MASK[np.minimum(size[over] - 8, 8)]
        for w in np.flatnonzero(size > 16).tolist():
            wrong[w] |= self.tail.get(int(codes[w])) != whole[cut[w] + 16 : stop[w]]
        return np.flatnonzero(wrong)

    def _add(self, own: bytes, ids: list[int]) -> None:
        i, end = self.n, self.used + len(ids)
        if i >= len(self.off):
            self.off, self.len, self.size, self.head, self.mid = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len, self.size, self.head, self.mid))
        self.size[i], self.head[i], self.mid[i] = len(own), int.from_bytes(own[:8], "little"), int.from_bytes(own[8:16], "little")
        if len(own) > 16:
            self.tail[i] = own[16:]
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : end] = ids
        self.off[i], self.len[i], self.used, self.n = self.used, len(ids), end, i + 1


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its table serves all of the worker's tasks."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
