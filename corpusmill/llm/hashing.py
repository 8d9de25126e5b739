"""Vectorised hashing of the words in Arrow string columns.

A chunk of a column is one byte buffer. Word hashes are polynomial in the bytes,
modulo 2^64, taken from one running sum over the buffer, so no Python loop sees a
byte or a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
EXACT = np.arange(256, dtype=np.uint8)
LOWER = EXACT.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
#: Everything but ASCII letters, digits and bytes of longer characters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        grown[0] = 1
        have = _powers[base] = np.multiply.accumulate(grown)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about limit bytes; null is empty, long rows stay whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_table(BASE, len(data))[: len(data)], out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * _power_table(_INVERSE, len(data) + 1)[starts]
    return mix(hashed + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = WHITE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word after folding bytes, number of words of each row); by default A-Z become lower case."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    data = fold[data]
    gap = gaps[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets[:-1]] = True
    fresh[-1] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & (before | fresh[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    ends = np.flatnonzero(~gap & (after | fresh[1:])) + 1
    per_row = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return ranges(data, starts, ends), per_row


def shingles(hashed: np.ndarray, per_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, runs of each row); a row with fewer words has its whole sequence, one without words none."""
    ends = np.cumsum(per_row)
    starts = ends - per_row
    full = np.zeros(len(hashed), np.uint64)
    valid = len(hashed) - k + 1
    if valid > 0:
        for j in range(k):
            full[:valid] = mix(full[:valid] + hashed[j : j + valid] * np.uint64(2 * j + 1))
    short = (per_row > 0) & (per_row < k)
    for row in np.flatnonzero(short):
        x = np.zeros(1, np.uint64)
        for j in range(starts[row], ends[row]):
            x = mix(x + hashed[j : j + 1] * np.uint64(2 * (j - starts[row]) + 1))
        full[starts[row]] = mix(x + np.uint64(0x51ED27) * np.uint64(per_row[row]))[0]
    counts = np.where(short, 1, np.maximum(per_row - k + 1, 0))
    keep = np.arange(len(hashed)) - np.repeat(starts, per_row) < np.repeat(counts, per_row)
    return full[keep], counts
