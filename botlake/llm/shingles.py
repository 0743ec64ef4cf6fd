"""Word shingles of whole texts as 64-bit hashes, and minwise signatures, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .columns import ODD, U64, mix, span_hashes, utf8


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start and end of every word `[^\\x20\\x09-\\x0D]+`; words don't cross texts."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    data = table[data]
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    inside = ~space[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = ends[:-1][ends[:-1] < ends[1:]]
    last = ends[1:][ends[:-1] < ends[1:]] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    return data, np.flatnonzero(opens), np.flatnonzero(closes) + 1


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and offsets.

    A text of fewer words than size has its whole sequence as its one shingle; a text without words has none.
    """
    data, ends = utf8(texts)
    n = len(ends) - 1
    data, starts, stops = words(data, ends)
    owner = np.searchsorted(ends, starts, side="right") - 1
    owner = owner.astype(np.int64)
    hashes = span_hashes(data, starts, stops)
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    total = len(hashes)
    acc = np.zeros(total, U64)
    width = np.minimum(count, size)[owner] if total else np.zeros(0, np.int64)
    begins = np.arange(total) + width <= first[1:][owner] if total else np.zeros(0, bool)
    at = np.flatnonzero(begins)
    for k in range(size):
        use = at[width[at] > k]
        acc[use] = mix(acc[use] * ODD + hashes[use + k] + U64(k + 1))
    acc, own = acc[at], owner[at]
    # distinct within a text: sort by (text, hash)
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    keep = np.ones(len(acc), bool)
    keep[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    acc, own = acc[keep], own[keep]
    return acc, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def digests(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set (sum and exclusive or of differently mixed members)."""
    n = len(ends) - 1
    one, two = np.zeros(n, U64), np.zeros(n, U64)
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        one[full] = np.add.reduceat(mix(hashes + ODD), ends[:-1][full])
        two[full] = np.bitwise_xor.reduceat(mix(hashes * ODD), ends[:-1][full])
    return mix(one + (ends[1:] - ends[:-1]).astype(U64)), two


def signatures(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Minwise values (32 bits) of every set: an array (sets, width). Empty sets have all ones."""
    n = len(ends) - 1
    out = np.full((n, width), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if not len(full):
        return out
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 2**63, width, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, width, dtype=np.int64).astype(U64)
    at = ends[:-1][full]
    for i in range(width):
        h = ((hashes * a[i] + b[i]) >> U64(32)).astype(np.uint32)
        out[full, i] = np.minimum.reduceat(h, at)
    return out
