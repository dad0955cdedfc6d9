"""Numpy passes over the bytes of many texts at once, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_BACK = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        have = np.full(max(n, 1 << 20), _BASE if kind == "up" else _BACK, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null is empty. A run exceeds most_bytes only with one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most_bytes, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where solid holds, cut at text borders."""
    n = len(solid)
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = solid[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = solid[1:]
        last = offsets[1:] - 1
        after[last[(last >= 0) & (offsets[1:] > offsets[:-1])]] = False
    return starts, np.flatnonzero(solid & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=sums[1:])
    back = _power("down", len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    starts, ends = spans(~IS_SPACE[data], offsets)
    return hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of one sequence; of a shorter, non-empty one, a single hash of the whole."""
    if not len(word):
        return word
    n = min(n, len(word))
    out = np.full(len(word) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * U(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k]
    return mix(out)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
