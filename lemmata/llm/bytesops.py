"""Vectorised operations on UTF-8 byte buffers, shared by the operators that run in Arrow batches.

Hashes are 64-bit: each byte is mapped through a fixed random table, a polynomial over
the ring of integers modulo 2**64 is taken by prefix sums, and the value is finalised by
a multiply-xorshift mixer.  Everything here is a pure function of the bytes, so results
do not depend on how rows are split into batches or tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Byte values that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, base in (("up", BASE), ("down", BASE_INV)):
                a = np.full(size, base, U64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=U64))
        return cls.up, cls.down


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``between`` takes the hash of any slice."""
    up, _ = Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of each slice [start, end)."""
    _, down = Powers.get(len(sums))
    return (sums[end] - sums[start]) * down[start]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash, number per text) of every word of every text, in order.

    Works through whole texts, about ``chunk`` bytes at a time, so that the arrays stay in cache.
    """
    parts, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
        at = offsets[first : last + 1]
        parts.append([x + at[0] if i < 2 else x for i, x in enumerate(_words(data[at[0] : at[-1]], at - at[0], lower))])
        first = last
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    full = offsets[:-1] < offsets[1:]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
    value = mix(between(prefix(data), start, end) + (end - start).astype(U64))
    return start, end, value, np.diff(np.searchsorted(start, offsets))


def batches_of(batches, limit: int, column: str = "text"):
    """Re-cut record batches so that each holds at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = np.diff(text_buffer(batch.column(column))[1])
        if not len(sizes):
            continue
        cut, total, begin = [], 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                cut.append((begin, i))
                begin, total = i, 0
            total += int(n)
        cut.append((begin, len(sizes)))
        for a, b in cut:
            yield batch.slice(a, b - a)
