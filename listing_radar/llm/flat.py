"""Texts of an Arrow column as one flat byte array: words, word hashes and shingles without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: everything but blank and 09-0D; and letters, digits and bytes beyond ASCII only.
ANY_WORD = np.ones(256, dtype=bool)
ANY_WORD[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20_240_201).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """0..n-th powers of the base or of its inverse modulo 2^64."""
    if len(_powers[which]) < n + 1:
        step = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(n + 1, SLICE_BYTES + 1), step, dtype=np.uint64)
        factors[0] = 1
        _powers[which] = np.cumprod(factors, dtype=np.uint64)
    return _powers[which][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ANY_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of the first word (one more entry than texts)."""
    inside = kind[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of byte value times base^position over i <= position < j, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data))[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power("down", len(sums))[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of each word; with ``fold``, A-Z count as a-z. Works through a long text in pieces cut at words."""
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES)))
        lo, hi = starts[at], ends[upto - 1]
        part = _LOWER[data[lo:hi]] if fold else data[lo:hi]
        out[at:upto] = range_hashes(prefix_hashes(part), starts[at:upto] - lo, ends[at:upto] - lo)
        at = upto
    return out


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the number of the first run of each text.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    counts = np.diff(firsts)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], runs) + np.repeat(firsts[:-1], runs)
    length = np.repeat(np.minimum(counts, size), runs)
    value = np.full(len(at), 0x51ED270B, dtype=np.uint64) + length.astype(np.uint64)
    for k in range(size):
        more = k < length
        following = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else value
        value = np.where(more, mix(value * U(0xD6E8FEB86659FD93) + following), value)
    return value, bounds
