"""Words and rolling hashes of Arrow text columns, vectorised over the UTF-8 bytes.

All separators used here are ASCII, and no byte of a multi-byte character is
ASCII, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that belong to words of ``[^\x20\x09-\x0D]+``.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that belong to words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Odd multipliers of the rolling hashes.
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SEGMENT = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            both.append(np.cumprod(t))
        have = _tables[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(column, limit: int = 2 << 20):
    """Ranges of rows with about ``limit`` bytes of text each; a longer row is a range of its own."""
    n = len(column)
    if not n:
        return
    _, offsets = utf8(column)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    rows: np.ndarray  # row r has the words rows[r] to rows[r + 1]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD) -> Words:
    """Maximal runs of member bytes within each row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64))
    inside = member[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, w: Words, base: int = BASE_1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(w.start), np.uint64)
    i = 0
    while i < len(out):
        first = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, first + _SEGMENT, "right")))
        last = w.end[j - 1]
        up, down = powers(base, last - first)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        s, e = w.start[i:j] - first, w.end[i:j] - first
        out[i:j] = mix((total[e] - total[s]) * down[s])
        i = j
    return out


def window_hashes(h: np.ndarray, size: int, base: int = BASE_2) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive words; runs across rows are the caller's to leave out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, _SEGMENT):
        hi = min(n, lo + _SEGMENT)
        part = h[lo : hi + size - 1]
        up, down = powers(base, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=total[1:])
        out[lo:hi] = mix((total[size:] - total[:-size]) * down[: hi - lo])
    return out


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order (sorting beats hashing on these sizes)."""
    x = np.sort(x)
    if not len(x):
        return x
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def within_rows(w: Words, size: int) -> np.ndarray:
    """For each word, whether ``size`` words from it on lie in its row."""
    n = np.diff(w.rows)
    left = np.repeat(w.rows[1:], n) - np.arange(len(w.start))
    return left >= size
