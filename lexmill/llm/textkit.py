"""Vectorised text primitives over Arrow string buffers; no Python work per row or per word.

A word is a maximal run of word bytes. With ``ALNUM`` these are ASCII letters and
digits and every byte of a multi-byte character; with ``BLANK`` every byte above
the space. Hashes are 64-bit, independent of process, machine and batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 17
SLICE_BYTES = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))


def _byte_values(word: np.ndarray) -> np.ndarray:
    return np.where(word, seeds(256, 7) | np.uint64(1), np.uint64(0))


_b = np.arange(256)
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
BLANK = _b > 32
_VALUES = {id(ALNUM): _byte_values(ALNUM), id(BLANK): _byte_values(BLANK)}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.full(BLOCK, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of each span of non-zero values; span i begins at start[i] and ends before the next zero or start."""
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    up, down = _powers()
    edge = np.append(start, len(values))
    i = 0
    while i < len(start):
        j = int(np.searchsorted(edge, edge[i] + BLOCK, "right")) - 1
        lo = int(edge[i])
        if j > i:
            part = values[lo : int(edge[j])]
            at = start[i:j] - lo
            out[i:j] = np.add.reduceat(part * up[: len(part)], at) * down[at]
        else:  # one span longer than a block
            j, total, power = i + 1, 0, 1
            for k in range(lo, int(edge[i + 1]), BLOCK):
                part = values[k : min(k + BLOCK, int(edge[i + 1]))]
                total = (total + int((part * up[: len(part)]).sum(dtype=np.uint64)) * power) % (1 << 64)
                power = power * int(up[-1]) * int(BASE) % (1 << 64)
            out[i] = total
        i = j
    return mix(out)


class Words(NamedTuple):
    """Words of a slice of rows. ptr[i]:ptr[i+1] are the words of row i; start and end are byte positions in the row."""

    first: int
    ptr: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def lower(column: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        raw = column.cast(pa.binary()).to_pylist()
        return pa.array([None if x is None else x.decode("utf-8", "replace").lower() for x in raw], pa.string())


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about budget bytes; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, j
        i = j


def words(column: pa.Array, kind: np.ndarray = ALNUM, fold: bool = True) -> Iterator[Words]:
    """Words of all rows, whole rows in slices; fold: lower case first."""
    data, offsets = buffers(lower(column) if fold else column)
    values = _VALUES[id(kind)]
    for i, j in slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        part = data[lo:hi]
        at = offsets[i : j + 1] - lo
        inside = kind[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = at[:-1][np.diff(at) > 0]
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = at[1:][np.diff(at) > 0] - 1
        ends[last] = inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        ptr = np.searchsorted(start, at)
        base = np.repeat(at[:-1], np.diff(ptr))
        yield Words(i, ptr, span_hashes(values[part], start), start - base, end - base)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items, across rows too: callers drop windows that leave a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    done, have = None, 0
    square, size = h, 1
    while True:
        if k & size:
            if done is None:
                done, have = square, size
            else:  # the part so far, then this block
                m = len(h) - have - size + 1
                done = done[:m] * np.uint64(pow(int(BASE), size, 1 << 64)) + square[have : have + m]
                have += size
        if size * 2 > k:
            break
        m = len(square) - size
        square = square[:m] * np.uint64(pow(int(BASE), size, 1 << 64)) + square[size : size + m]
        size *= 2
    return mix(done[:n])


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of every w consecutive items, the rightmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    value, at, size = h, np.arange(len(h)), 1

    def join(v1, a1, v2, a2):
        right = v2 <= v1
        return np.where(right, v2, v1), np.where(right, a2, a1)

    while size * 2 <= w:
        m = len(value) - size
        value, at = join(value[:m], at[:m], value[size:], at[size:])
        size *= 2
    if size < w:
        s = w - size
        _, at = join(value[:n], at[:n], value[s : s + n], at[s : s + n])
    return at[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
