"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of anything but ASCII white space.  A shingle is ``k`` words in a row;
a text of fewer words has one shingle of all of them, a text without words has none.
The n-th occurrence of a shingle in a text is an element of its own (a layer), so that
sets of elements stand for multisets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_POWER = np.cumprod(np.full(8, _BASE))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, from 0 to n at least."""
    if not _TABLES or len(_TABLES[0]) <= n:
        size = max(n + 1, 1 << 20)
        _TABLES[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x))]) for x in (_BASE, _INVERSE)]
    return _TABLES[0], _TABLES[1]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has.

    A word's hash is a polynomial in its bytes, taken from running sums over the batch.
    """
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_WHITE[raw]
    cut = np.zeros(n + 1, bool)  # a text's end cuts a word
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, offsets))


def layers(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The elements of each text, sorted within it, and how many it has."""
    h, counts = words(texts)
    ends = np.cumsum(counts)
    short = (counts > 0) & (counts < k)
    per_text = np.where(short, 1, np.maximum(counts - k + 1, 0))
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    x = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        x = (x + h[i : i + len(x)]) * _POWER[i + 1] if len(x) else x
    whole = doc[: len(x)] == doc[k - 1 :] if len(x) else np.zeros(0, bool)
    found, owner = mix(x[whole]), doc[: len(x)][whole]
    if short.any():
        few = np.flatnonzero(short)
        one = np.array([_join(h[ends[i] - counts[i] : ends[i]]) for i in few.tolist()], np.uint64)
        found, owner = np.concatenate([found, one]), np.concatenate([owner, few])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    same = np.zeros(len(found), bool)
    same[1:] = (found[1:] == found[:-1]) & (owner[1:] == owner[:-1])
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(found))))
    found = mix(found + (np.arange(len(found)) - run).astype(np.uint64) * _GOLD)
    return found[np.lexsort((found, owner))], per_text


def _join(h: np.ndarray) -> np.uint64:
    out = np.uint64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = (out ^ x) * _GOLD
    return out
