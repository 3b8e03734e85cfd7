"""Word shingles as 64-bit hashes, for many texts at once with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_rng = np.random.default_rng(7)
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_SEED = _rng.integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: By length 0 to 8: what remains of eight bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (cut at ASCII white space, A-Z as a-z), and each text's number of words.

    Up to 16 bytes are mixed as two numbers, so that words of one length differ where their bytes do but for chance; longer words
    are hashed by xxh3."""
    own = np.take(_LOWER, np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8))
    raw = np.concatenate([own, np.zeros(16, np.uint8)])
    space = np.take(_SPACE, own)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    size = stop - start
    with np.errstate(over="ignore"):
        h = mix((eight[start] & _MASK[np.minimum(size, 8)]) + _SEED[0])
        over = np.flatnonzero(size > 8)
        h[over] = mix(h[over] * _SEED[1] + (eight[start[over] + 8] & _MASK[np.minimum(size[over] - 8, 8)]))
        h = mix(h + size.astype(np.uint64) * _SEED[2])
    data = memoryview(raw)
    for w in np.flatnonzero(size > 16).tolist():
        h[w] = xxhash.xxh3_64_intdigest(data[start[w] : stop[w]])
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1 if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(start, ends)
    return h, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], k: int, chunk: int = 1 << 18) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; fewer words make one shingle, none no shingle."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < chunk):
            size += len(texts[end])
            end += 1
        words, counts = word_hashes(texts[at:end])
        with np.errstate(over="ignore"):
            whole = mix(sum(words[j : len(words) - k + 1 + j] * _STEP[j] for j in range(k))) if len(words) >= k else words[:0]
            pos = 0
            for n in counts.tolist():
                if n >= k:
                    out.append(np.unique(whole[pos : pos + n - k + 1]))
                elif n:
                    out.append(mix((words[pos : pos + n] * _STEP[:n]).sum(keepdims=True) + np.uint64(n)))
                else:
                    out.append(words[:0])
                pos += n
        at = end
    return out
