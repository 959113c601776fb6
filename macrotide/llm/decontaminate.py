"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task takes its documents in shards, builds the array of all suffixes of a shard's
word sequence and binary-searches every suffix of the benchmark items in it. A word that
no benchmark item has ends every match, so a shard's text is cut there, as at the end of
a document; every suffix of what is left is in the array. Suffixes are compared as far as
they match: neighbours in the order give the longest verbatim match at each word of a
document, of whatever length, and the ranges of suffixes that begin with an item's window
give the places of all windows.

The documents are scanned once and never shuffled. The benchmark is the query set: it is
cut into blocks of a bounded size, which the driver reads and sends one at a time, and each
shard is searched for one block after another, of which a worker holds one. An item is
never cut, so an item longer than a block is a block of its own. The distinct word hashes of
all items, 8 bytes each, go to all tasks.

Words, after lower-casing A-Z, are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, compared by
64-bit hashes. A location is a stretch of a document that equals a stretch of an item, that
neither neighbour extends and that holds a window: 13 words, or all words of a shorter item.
The longest match may be shorter than a window; of equally long ones the first in the document
counts, and of the items that hold it the least id (null last).

Null or empty texts have no words: such a document is clean, such an item occurs
nowhere. Repeated document rows are judged one by one; repeated items count once. Null item
ids are left out of the list of items. An empty benchmark leaves all documents clean. Other
columns of the inputs are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, BASE_2, LOWER, powers, row_blocks, sorted_unique, utf8, word_hashes, words

WINDOW = 13
#: Bytes of benchmark text in a block; as suffixes they take some 12 times as much in a worker.
BENCHMARK_BLOCK_BYTES = 4 << 20

_MATCHES = (
    "doc_id long, n_words long, hits array<int>, items array<long>, longest int, longest_start int, longest_item long, "
    "locations array<struct<start:int,length:int,item_id:long,item_start:int>>"
)


def suffix_array(h: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Word positions in the order of the suffixes that start there, up to their ``ends``, which sort before any word.

    By doubling the number of words that are compared, for suffixes still tied only.
    Suffixes that agree in ``depth`` words stay in any order.
    """
    n = len(h)
    order = np.argsort(h)
    slots, keys = np.arange(n), h[order]
    rank = np.zeros(n, np.int64)
    step = 1
    while len(slots):
        at = order[slots]
        new = np.ones(len(slots), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        # tied with a neighbour, and not because both have ended
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied & (ends[at] - at >= step)]
        if step >= depth:
            break
        at = order[slots]
        after = at + step
        keys = rank[at] * (n + 1) + np.where(after < ends[at], rank[np.minimum(after, n - 1)], 0)
        pick = np.argsort(keys)
        order[slots], keys = at[pick], keys[pick]
        step *= 2
    return order


class Sequence:
    """Words end to end, in pieces whose ends no match crosses, with the array of all suffixes."""

    def __init__(self, h: np.ndarray, ends: np.ndarray, depth: int):
        self.h, self.ends = h, ends
        self.order = suffix_array(h, ends, depth)
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(BASE_2, len(h))[0], out=self.total[1:])

    def span(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the ``n`` words from ``at`` on."""
        return (self.total[at + n] - self.total[at]) * powers(BASE_2, len(self.h))[1][at]


def common(x: Sequence, at: np.ndarray, y: Sequence, to: np.ndarray) -> np.ndarray:
    """How many words the suffixes of ``x`` at ``at`` share with those of ``y`` at ``to``, from their first on."""
    limit = np.minimum(x.ends[at] - at, y.ends[to] - to)
    good, bad = np.zeros(len(at), np.int64), limit + 1
    begun = np.flatnonzero(x.h[at] == y.h[to])
    good[begun] = 1
    # first the length doubles as long as the words agree, then the gap between good and bad is halved
    grow = begun[limit[begun] > 1]
    while len(grow):
        n = np.minimum(2 * good[grow], limit[grow])
        same = x.span(at[grow], n) == y.span(to[grow], n)
        good[grow[same]], bad[grow[~same]] = n[same], n[~same]
        grow = grow[same & (n < limit[grow])]
    gap = begun[bad[begun] - good[begun] > 1]
    while len(gap):
        n = (good[gap] + bad[gap]) // 2
        same = x.span(at[gap], n) == y.span(to[gap], n)
        good[gap[same]], bad[gap[~same]] = n[same], n[~same]
        gap = gap[bad[gap] - good[gap] > 1]
    return good


def search(text: Sequence, other: Sequence, at: np.ndarray, n: np.ndarray, after: bool) -> np.ndarray:
    """How many suffixes of ``text`` sort below each stretch (``at``, ``n``) of ``other``; with ``after``, or begin with it."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(text.h), np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        a, s = at[open_], text.order[mid]
        m = np.minimum(common(other, a, text, s), n[open_])
        whole, ended = m == n[open_], s + m == text.ends[s]
        less = text.h[np.minimum(s + m, len(text.h) - 1)] < other.h[np.minimum(a + m, len(other.h) - 1)]
        below = np.where(whole, after, ended | less)
        lo[open_[below]], hi[open_[~below]] = mid[below] + 1, mid[~below]
    return lo


class Suffixes:
    """A block of the benchmark: its words, all their suffixes in order, and the windows among them."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        items = sorted(set(items), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        w = words(data, offsets, ALNUM)
        n = np.diff(w.rows)
        self.item_ids = [i for i, _ in items]
        self.depth = int(n.max(initial=0))
        self.words = Sequence(word_hashes(data, w), np.repeat(w.rows[1:], n), self.depth)
        self.item = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.item)) - np.repeat(w.rows[:-1], n)
        self.size = np.minimum(n, window)[self.item]
        self.whole = self.place + self.size <= n[self.item]


def isin_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


class Shard:
    """The words of some documents that the benchmark has too, with row and place of each."""

    def __init__(self, text, vocabulary: np.ndarray, depth: int):
        data, offsets = utf8(text)
        data = LOWER[data]
        w = words(data, offsets, ALNUM)
        h = word_hashes(data, w)
        self.n_words = np.diff(w.rows)
        at = np.flatnonzero(isin_sorted(h, vocabulary))
        self.row = np.repeat(np.arange(len(self.n_words)), self.n_words)[at]
        self.place = at - w.rows[self.row]
        last = np.ones(len(at), bool)
        last[:-1] = (np.diff(at) > 1) | (np.diff(self.row) > 0)
        ends = np.flatnonzero(last) + 1
        self.words = Sequence(h[at], np.repeat(ends, np.diff(ends, prepend=0)), depth)


def insertions(shard: Shard, block: Suffixes) -> np.ndarray:
    """For each suffix of the block, in their order, how many of the shard's are below it."""
    at = block.words.order
    return search(shard.words, block.words, at, block.words.ends[at] - at, False)


def windows_found(shard: Shard, block: Suffixes, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of the shard, suffix of the block) wherever a window of the block begins in the shard."""
    text, at = shard.words, block.words.order
    reach = np.zeros(len(at), np.int64)
    for side in (below - 1, below):
        inside = np.flatnonzero((side >= 0) & (side < len(text.h)))
        reach[inside] = np.maximum(reach[inside], common(block.words, at[inside], text, text.order[side[inside]]))
    at = at[block.whole[at] & (reach >= block.size[at])]
    lo, hi = (search(text, block.words, at, block.size[at], after) for after in (False, True))
    n = hi - lo
    slot = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    return text.order[slot], np.repeat(at, n)


def longest_found(shard: Shard, block: Suffixes, below: np.ndarray) -> list[tuple]:
    """(row, length, start, item_id) of the longest match of each row that has one."""
    text, order = shard.words, block.words.order
    if not len(text.h) or not len(order):
        return []
    # the block's suffixes next to each of the shard's
    before = np.cumsum(np.bincount(below, minlength=len(text.h) + 1))[: len(text.h)] - 1
    reach = np.zeros(len(text.h), np.int64)
    for side in (before, before + 1):
        inside = np.flatnonzero((side >= 0) & (side < len(order)))
        at = text.order[inside]
        reach[at] = np.maximum(reach[at], common(text, at, block.words, order[side[inside]]))
    first = np.flatnonzero(np.diff(shard.row, prepend=-1))
    best = np.maximum.reduceat(reach, first)
    top = np.flatnonzero(reach == np.repeat(best, np.diff(np.append(first, len(reach)))))
    top = top[np.diff(shard.row[top], prepend=-1) > 0]
    top, best = top[best > 0], best[best > 0]
    lo, hi = (search(block.words, text, top, best, after) for after in (False, True))
    item = block.item[order]
    held = [block.item_ids[item[a:b].min()] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    return list(zip(shard.row[top].tolist(), best.tolist(), shard.place[top].tolist(), held, strict=True))


class Location(NamedTuple):
    start: int
    length: int
    item_id: int | None
    item_start: int


def locations(place: np.ndarray, suffix: np.ndarray, block: Suffixes) -> set[Location]:
    """Windows of one document that follow each other in step with an item, as one stretch each."""
    item, there, size = block.item[suffix], block.place[suffix], block.size[suffix]
    order = np.lexsort((place, place - there, item))
    p, i, t, n = place[order], item[order], there[order], size[order]
    new = np.ones(len(p), bool)
    new[1:] = (i[1:] != i[:-1]) | (np.diff(p - t) != 0) | (np.diff(p) != 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(p)) - 1
    spans = p[last] + n[last] - p[start]
    return {Location(a, b, block.item_ids[c], d) for a, b, c, d in zip(p[start].tolist(), spans.tolist(), i[start].tolist(), t[start].tolist(), strict=True)}


class Benchmark:
    """The blocks of the benchmark, its distinct words and its longest item's number of words, as sent to tasks."""

    def __init__(self, benchmark: DataFrame, window: int, block_bytes: int):
        context = benchmark.sparkSession.sparkContext
        self.blocks, self.depth, known = [], 0, np.zeros(0, np.uint64)
        held, size = [], 0

        def send():
            nonlocal known, held, size
            block = Suffixes(held, window)
            self.depth = max(self.depth, block.depth)
            known = np.union1d(known, sorted_unique(block.words.h))
            self.blocks.append(context.broadcast(block))
            held, size = [], 0

        for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").filter("text <> ''").toLocalIterator():
            n = len(text.encode())
            if held and size + n > block_bytes:
                send()
            held.append((item_id, text))
            size += n
        if held:
            send()
        self.words = context.broadcast(known)

    def each(self):
        for sent in self.blocks:
            yield sent.value
            if len(self.blocks) > 1:  # a worker holds one block at a time
                vars(sent).pop("_value", None)


class Report:
    """What a shard's documents have of the benchmark; ``longest`` is left out unless asked for."""

    def __init__(self, text, benchmark: Benchmark, longest: bool = True):
        shard = Shard(text, benchmark.words.value, benchmark.depth)
        rows = len(shard.n_words)
        self.n_words = shard.n_words
        self.hits = [np.zeros(0, np.int64)] * rows
        self.items: list[set] = [set() for _ in range(rows)]
        self.locations: list[set] = [set() for _ in range(rows)]
        self.longest: list[tuple] = [(0, None, None)] * rows
        if not len(shard.row):
            return
        for block in benchmark.each():
            below = insertions(shard, block)
            at, suffix = windows_found(shard, block, below)
            by_row = np.argsort(shard.row[at], kind="stable")
            at, suffix = at[by_row], suffix[by_row]
            row = shard.row[at]
            cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)] if len(row) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self._add(int(row[a]), shard.place[at[a:b]], suffix[a:b], block)
            for r, *match in longest_found(shard, block, below) if longest else ():
                self.longest[r] = min(self.longest[r], tuple(match), key=_by_length)

    def _add(self, row: int, place: np.ndarray, suffix: np.ndarray, block: Suffixes) -> None:
        size = block.size[suffix]
        covered = np.repeat(place - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.hits[row] = np.union1d(self.hits[row], covered)
        self.items[row] |= {block.item_ids[i] for i in np.unique(block.item[suffix]).tolist()} - {None}
        self.locations[row] |= locations(place, suffix, block)


def _by_length(match: tuple) -> tuple:
    length, start, item = match
    return -length, start or 0, item is None, item or 0


def _by_place(x: Location) -> tuple:
    return x.start, x.length, x.item_id is None, x.item_id or 0, x.item_start


_LOCATION = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_id", pa.int64()), ("item_start", pa.int32())])


def _matcher(benchmark: Benchmark):
    def run(batches):
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1)):
                found = Report(batch.column(1).slice(lo, hi - lo), benchmark)
                length, start, item = zip(*found.longest, strict=True)
                places = [[x._asdict() for x in sorted(some, key=_by_place)] for some in found.locations]
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(found.n_words, pa.int64()),
                    pa.array([x.tolist() for x in found.hits], pa.list_(pa.int32())),
                    pa.array([sorted(x) for x in found.items], pa.list_(pa.int64())),
                    pa.array(length, pa.int32()),
                    pa.array(start, pa.int32()),
                    pa.array(item, pa.int64()),
                    pa.array(places, pa.list_(_LOCATION)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "hits", "items", "longest", "longest_start", "longest_item", "locations"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, hits (word places), items, longest (words, with start and item) and locations."""
    sent = Benchmark(benchmark, window, block_bytes)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_matcher(sent), _MATCHES)


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Digest columns and the rule: contaminated if n_hit > 0 and ``share`` * n_hit >= n_words."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.size("hits").cast("long")
    line = F.transform("locations", lambda x: F.format_string("%d,%d,%s,%d\n", x["start"], x["length"], x["item_id"].cast("string"), x["item_start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("longest").cast("long").alias("longest_match"),
        F.col("longest_start").cast("long").alias("longest_start"),
        "longest_item",
        F.size("locations").cast("long").alias("n_locations"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("locations_sha256"),
    )


def _keeper(benchmark: Benchmark, share: int, text_at: int):
    def run(batches):
        for batch in batches:
            for lo, hi in row_blocks(batch.column(text_at)):
                found = Report(batch.column(text_at).slice(lo, hi - lo), benchmark, longest=False)
                n_hit = np.array([len(x) for x in found.hits], np.int64)
                yield batch.slice(lo, hi - lo).filter(pa.array((n_hit == 0) | (share * n_hit < found.n_words)))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BENCHMARK_BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are; each row is decided on in the scan."""
    return docs.mapInArrow(_keeper(Benchmark(benchmark, window, block_bytes), share, docs.columns.index("text")), docs.schema)
