"""Helpers that the operators of this subpackage share: Arrow buffers as numpy, byte hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)  # 2^64 divided by the golden ratio, an odd multiplier


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after the other, and n + 1 offsets; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (shift, multiply, shift)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), U64)
    done, step = 1, base & 0xFFFFFFFFFFFFFFFF
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U64(step)
        done, step = done + take, step * step & 0xFFFFFFFFFFFFFFFF
    return out[:n]


BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span [start, end): a polynomial over the
    bytes from prefix sums modulo 2^64, shifted to the span's start and mixed with its length."""
    n = len(data)
    letters = mix(np.arange(256, dtype=U64) * U64(0xA24BAED4963EE407) + U64((salt + 1) * int(ODD) % 2**64))
    sums = np.zeros(n + 1, U64)
    np.cumsum(letters[data] * powers(BASE, n), out=sums[1:])
    back = powers(INVERSE, n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * ODD)


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, so that what is computed of one part bounds a worker's memory."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each (a longer row stands alone)."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        out.append((lo, hi))
        lo = hi
    return out
