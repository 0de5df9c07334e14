"""Words, shingles and their hashes over whole Arrow batches, in numpy.

Texts stay in one byte buffer; words are start and end positions in it. Hashes of spans
come from prefix sums of a polynomial modulo 2**64 (the base is odd, so powers invert) and
are then mixed, so a batch costs a few passes over its bytes whatever the word lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: U64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows with the longest request."""
    table = _powers.get(int(base))
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, U64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if size <= 8 * CHUNK_BYTES:
            _powers[int(base)] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span; equal spans have equal hashes."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(spans + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a run of texts: byte positions, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about CHUNK_BYTES; no text is split."""
    data, offsets = buffers(texts)
    row = 0
    while row < len(texts):
        upto = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        upto = min(max(upto, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes other than space and \\t..\\r inside each text."""
    inside = WORD_BYTE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edges = offsets[offsets < len(data)]
    left = before[:-1].copy()
    left[edges] = False
    starts = np.flatnonzero(inside & ~left)
    right = np.zeros(len(data), bool)
    right[:-1] = inside[1:]
    right[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~right) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (len - k + 1 of them, none if fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return span_hashes(hashes, at, at + k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
