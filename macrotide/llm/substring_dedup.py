"""Exact substring dedup with difference-cover anchors.

A window is 20 consecutive words. Every word in a window whose word sequence also
starts earlier (smaller doc_id, or same document and earlier start) is removed.

Only words at places p with p mod 13 in {0, 1, 3, 9} get an anchor, the hash of the
8 words from there. The four residues form a difference cover: two equal windows,
wherever they start, have an offset below 13 at which both are at cover places, so
they share an anchor that lies within both. The steps:

1. The documents become a bucketed table of blocks (``storage.blocked_table``).
2. Each block sends its distinct anchors, in hash slices. A slice answers each block
   with one bit per anchor: whether the anchor occurs twice or more anywhere.
3. Around repeated anchors each block extends to whole windows, settles repeats
   within itself, and sends the first of each window (96-bit hash, doc_id, start).
   A slice answers with one bit per window: whether an earlier start exists.
4. Each block applies the bits to its words.

A block sends a hash once, however frequent it is, so a passage in a third of all
documents costs a slice at most one entry per block. Nothing reaches the driver.

Null texts have no words. A null doc_id comes before all others. Rows that share a
doc_id count as one place in the order: of equal windows at equal starts in such
rows, the one stored first is the first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BASE_1, row_blocks, sorted_unique, utf8, window_hashes, within_rows, word_hashes, words
from .storage import NULL_ID, blocked_table, finished, materialise, slices, text_bytes

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_REQUEST = "g long, slice int, keys binary, more binary"
_ANSWER = "g long, slice int, bits binary"
_BASE_3 = 0xA24BAED4963EE407
#: One entry of the second exchange.
_ENTRY = np.dtype([("h1", "<u8"), ("doc", "<i8"), ("h2", "<u4"), ("at", "<u4")])


def _blocks_of(table: pa.Table):
    """(row range, text bytes, offsets, words, word hashes) for parts of a block's rows."""
    text = table.column("text")
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    for lo, hi in row_blocks(text):
        data, offsets = utf8(text.slice(lo, hi - lo))
        w = words(data, offsets)
        yield lo, hi, data, w, word_hashes(data, w)


def _anchors(w, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of documents that hold a window, and their hashes."""
    n = np.diff(w.rows)
    place = np.arange(len(h)) - np.repeat(w.rows[:-1], n)
    at_cover = np.isin(np.arange(PERIOD), COVER)[place % PERIOD]
    at = np.flatnonzero(at_cover & within_rows(w, ANCHOR) & np.repeat(n >= WINDOW, n))
    return at, window_hashes(h, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64)


def _slices_of(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of the slices that sorted keys fall into by their top bits."""
    s = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return list(zip(s[first].tolist(), first.tolist(), np.append(first[1:], len(s)).tolist(), strict=True))


def _sliced(g: int, keys: np.ndarray, bits: int, payload) -> list[tuple]:
    """Cuts sorted keys by their top bits; payload(lo, hi) gives the two binaries of a slice."""
    return [(g, s, *payload(lo, hi)) for s, lo, hi in _slices_of(keys, bits)]


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


_REQUEST_TYPES = (["g", "slice", "keys", "more"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])
_ANSWER_TYPES = (["g", "slice", "bits"], [pa.int64(), pa.int32(), pa.binary()])


def _ask_anchors(bits: int):
    """Distinct anchors of a block; 48 of their bits are sent, and a bit for those that the block itself repeats."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        found = np.sort(np.concatenate([_anchors(w, h)[1] for _, _, _, w, h in _blocks_of(table)]))
        keep = np.ones(len(found), bool)
        keep[1:] = found[1:] != found[:-1]
        first = np.flatnonzero(keep)
        keys = found[first]
        twice = np.diff(np.append(first, len(found))) > 1

        def payload(lo, hi):
            low = (keys[lo:hi] << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
            return low.tobytes(), np.packbits(twice[lo:hi]).tobytes()

        return _rows(_sliced(g, keys, bits, payload), *_REQUEST_TYPES)

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    g, s = table.column("g").to_pylist(), table.column("slice").to_pylist()
    parts = []
    for x in table.column("keys").to_pylist():
        wide = np.zeros((len(x) // 6, 8), np.uint8)
        wide[:, 2:] = np.frombuffer(x, np.uint8).reshape(-1, 6)
        parts.append(wide.ravel().view(">u8").astype(np.uint64))
    twice = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for k, m in zip(parts, table.column("more").to_pylist(), strict=True)]
    every = np.sort(np.concatenate([*parts, *(k[t] for k, t in zip(parts, twice, strict=True))]))
    repeated = sorted_unique(every[1:][every[1:] == every[:-1]])
    out = []
    for gg, ss, k in zip(g, s, parts, strict=True):
        at = np.searchsorted(repeated, k)
        out.append((gg, ss, np.packbits(repeated[np.minimum(at, len(repeated) - 1)] == k if len(repeated) else np.zeros(len(k), bool)).tobytes()))
    return _rows(out, *_ANSWER_TYPES)


def _bits(answers: pa.Table, keys: np.ndarray, bits: int) -> np.ndarray:
    """One flag per sorted key from the answers of its slices."""
    flags = np.zeros(len(keys), bool)
    at = {s: (lo, hi) for s, lo, hi in _slices_of(keys, bits)}
    for s, b in zip(answers.column("slice").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        lo, hi = at[s]
        flags[lo:hi] = np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo)
    return flags


class _Block:
    """A block's candidate windows: the first of each kind in the block, sorted by hash, and the rest."""

    def __init__(self, table: pa.Table, answers: pa.Table, bits: int):
        parts = list(_blocks_of(table))
        found = [_anchors(w, h) for _, _, _, w, h in parts]
        keys = sorted_unique(np.concatenate([k for _, k in found]))
        repeated = keys[_bits(answers, keys, bits)]
        ids = np.array([NULL_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        entries, self.where = [], []
        for p, ((lo, hi, data, w, h), (at, k)) in enumerate(zip(parts, found, strict=True)):
            seen = np.searchsorted(repeated, k)
            at = at[repeated[np.minimum(seen, len(repeated) - 1)] == k] if len(repeated) else at[:0]
            # windows that hold a repeated anchor: those that start up to 12 words before it, in its row
            row_start = w.rows[np.searchsorted(w.rows, at, "right") - 1]
            change = np.zeros(len(h) + 1, np.int32)
            np.add.at(change, np.maximum(at - PERIOD + 1, row_start), 1)
            np.add.at(change, at + 1, -1)
            start = np.flatnonzero((np.cumsum(change[:-1]) > 0) & within_rows(w, WINDOW))
            row = np.searchsorted(w.rows, start, "right") - 1
            e = np.empty(len(start), _ENTRY)
            if len(start):
                e["h1"] = window_hashes(h, WINDOW)[start]
                e["h2"] = (window_hashes(word_hashes(data, w, _BASE_3), WINDOW, BASE_1)[start] >> np.uint64(32)).astype(np.uint32)
            e["doc"], e["at"] = ids[lo + row], start - w.rows[row]
            entries.append(e)
            self.where.append(np.stack([np.full(len(start), p), start], 1))
        self.parts = parts
        self.where = np.concatenate(self.where)
        e = np.concatenate(entries)
        order = np.lexsort((e["at"], e["doc"], e["h2"], e["h1"]))
        self.entries, self.where = e[order], self.where[order]
        e = self.entries
        self.first = np.ones(len(e), bool)
        self.first[1:] = (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])


def _ask_windows(bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], *_REQUEST_TYPES)
        block = _Block(table, answers, bits)
        mine = block.entries[block.first]

        def payload(lo, hi):
            part = mine[lo:hi]
            return part["h1"].tobytes() + part["h2"].tobytes(), part["doc"].tobytes() + part["at"].tobytes()

        return _rows(_sliced(table.column("g")[0].as_py(), mine["h1"], bits, payload), *_REQUEST_TYPES)

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    g, s = table.column("g").to_pylist(), table.column("slice").to_pylist()
    parts = []
    for k, m in zip(table.column("keys").to_pylist(), table.column("more").to_pylist(), strict=True):
        n = len(k) // 12
        e = np.empty(n, _ENTRY)
        e["h1"], e["h2"] = np.frombuffer(k, "<u8", n), np.frombuffer(k, "<u4", n, 8 * n)
        e["doc"], e["at"] = np.frombuffer(m, "<i8", n), np.frombuffer(m, "<u4", n, 8 * n)
        parts.append(e)
    e = np.concatenate(parts)
    order = np.lexsort((e["at"], e["doc"], e["h2"], e["h1"]))
    x = e[order]
    later = np.zeros(len(x), bool)
    later[1:] = (x["h1"][1:] == x["h1"][:-1]) & (x["h2"][1:] == x["h2"][:-1])
    flags = np.empty(len(x), bool)
    flags[order] = later
    cut = np.cumsum([0, *map(len, parts)])
    return _rows([(gg, ss, np.packbits(flags[a:b]).tobytes()) for gg, ss, a, b in zip(g, s, cut, cut[1:], strict=False)], *_ANSWER_TYPES)


def _apply(bits: int, with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        columns = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
        if not table.num_rows:
            return _rows([], list(columns), list(columns.values()))
        kind = np.array(answers.column("kind").to_pylist(), np.int64)
        block = _Block(table, answers.filter(pa.array(kind == 0)), bits)
        mine = np.flatnonzero(block.first)
        repeats = ~block.first
        repeats[mine] = _bits(answers.filter(pa.array(kind == 1)), block.entries["h1"][mine], bits)
        where = block.where[repeats]
        out = []
        for p, (_, _, data, w, h) in enumerate(block.parts):
            start = where[where[:, 0] == p, 1]
            change = np.zeros(len(h) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, start + WINDOW, -1)
            kept = np.cumsum(change[:-1]) == 0
            # kept words joined by one space: copy their bytes, then put the space after each but a row's last
            length = w.end - w.start
            row = np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
            n_kept = np.bincount(row[kept], minlength=len(w.rows) - 1)
            joined = _joined(data, w.start[kept], length[kept])
            ends = np.cumsum(np.bincount(row[kept], weights=length[kept] + 1, minlength=len(w.rows) - 1)).astype(np.int64)
            for r, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
                out.append((int(w.rows[r + 1] - w.rows[r]), int(n_kept[r]), joined[a : b - 1] if b > a else b""))
        rows = [(d, n, n - k, hashlib.sha256(t).hexdigest(), *([t.decode()] if with_text else [])) for d, (n, k, t) in zip(table.column("doc_id").to_pylist(), out, strict=True)]
        return _rows(rows, list(columns), list(columns.values()))

    return run


def _joined(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """The words' bytes with one space after each."""
    ends = np.cumsum(length + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    source = np.arange(len(out)) + np.repeat(start - (ends - length - 1), length + 1)
    is_space = np.zeros(len(out), bool)
    is_space[ends - 1] = True
    out[~is_space] = data[source[~is_space]]
    return out.tobytes()


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256 (and kept_text, if wanted)."""
    total = text_bytes(docs)
    bits = slices(2 * total).bit_length() - 1
    table = blocked_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), total)
    by_block = table.groupBy("g")
    anchors = materialise(by_block.applyInArrow(_ask_anchors(bits), _REQUEST).groupBy("slice").applyInArrow(_answer_anchors, _ANSWER))
    asked = by_block.cogroup(anchors.groupBy("g")).applyInArrow(_ask_windows(bits), _REQUEST)
    windows = materialise(asked.groupBy("slice").applyInArrow(_answer_windows, _ANSWER))
    both = anchors.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return finished(by_block.cogroup(both.groupBy("g")).applyInArrow(_apply(bits, with_text), schema), table, anchors, windows)
