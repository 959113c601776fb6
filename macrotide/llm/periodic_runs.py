"""Runs of repeated word sequences within a document, by suffix trees and longest common extensions.

A run is a stretch of consecutive words (``[^\\x20\\x09-\\x0D]+``) with smallest period q, at
least ``least`` and 2q words long, that no neighbouring word extends. The steps, within one scan
and without a shuffle:

1. Every word of a run lies in a window of ``least // 2`` words that the same stretch of the document
   holds twice (of a run of L words the first L - q start such pairs, and L - q is at least
   half of L). Words in no such window cut the document into stretches, and stretches are cut again until
   nothing changes. This leaves all runs whole.
2. The stretches that are left, end to end with a separator of its own after each, get an Ukkonen suffix tree,
   and so does their reversal. The tour over a tree's leaves, with the depth of the branching node between
   neighbours and a sparse table of range minima over these, gives the longest common extension of any two
   places forwards or backwards in constant time.
3. Of each place the longest Lyndon word that starts there, under the words' order and under the opposite one,
   ends at the next smaller suffix. Every run holds such a word as its root; each is extended both
   ways, and extensions of two periods or more are the runs.

Memory grows with the longest stretch of one document (some 600 bytes a word); other stretches
are handled ``CHUNK`` words at a time. Null and empty texts have no words and no runs. Rows are
independent of each other: repeated rows give repeated results, null doc_ids stay, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, row_blocks, utf8, window_hashes, word_hashes, words

LEAST = 12
#: Words of short stretches that share a tree.
CHUNK = 1 << 15

_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Ukkonen's tree of symbols whose last one occurs once.

    An inner node is a number, with the length of its string in ``depth`` and one of the suffixes below it
    in ``head``; a leaf is the complement of where its suffix starts.
    """

    def __init__(self, symbols: list[int]):
        self.depth, self.head, self.kids = depth, head, kids = [0], [0], [{}]
        link = [0]
        node = edge = size = rest = 0
        for i, c in enumerate(symbols):
            rest += 1
            last = 0
            while rest:
                if not size:
                    edge = i
                below = kids[node]
                child = below.get(symbols[edge])
                if child is None:
                    below[symbols[edge]] = ~(i - rest + 1)
                    if last:
                        link[last], last = node, 0
                else:
                    if child >= 0:
                        span = depth[child] - depth[node]
                        if size >= span:
                            edge += span
                            size -= span
                            node = child
                            continue
                        at = head[child]
                    else:
                        at = ~child
                    here = symbols[at + depth[node] + size]
                    if here == c:
                        size += 1
                        if last:
                            link[last] = node
                        break
                    new = len(depth)
                    depth.append(depth[node] + size)
                    head.append(at)
                    link.append(0)
                    kids.append({here: child, c: ~(i - rest + 1)})
                    below[symbols[edge]] = new
                    if last:
                        link[last] = new
                    last = new
                rest -= 1
                if not node and size:
                    size -= 1
                    edge = i - rest + 1
                else:
                    node = link[node]

    def tour(self, place: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (as suffix starts) in the order of a walk, and the depth of the branching node before each.

        With ``place``, children are visited by the place of their first symbol."""
        depth, kids = self.depth, self.kids
        leaves, before = [], []
        todo, lift, low = [0], [0], 0
        while todo:
            node, up = todo.pop(), lift.pop()
            if up >= 0:
                low = up
            if node < 0:
                leaves.append(~node)
                before.append(low)
                continue
            below = kids[node]
            if place is None:
                todo.extend(below.values())
            else:
                todo.extend([below[s] for s in sorted(below, key=place.__getitem__, reverse=True)])
            lift.extend([depth[node]] * len(below))
            lift[-1] = -1  # the first child is met straight from the node
        return np.array(leaves, np.int64), np.array(before, np.int64)


class Extensions:
    """Longest common extensions of pairs of places, as range minima over a tree's tour."""

    def __init__(self, leaves: np.ndarray, before: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.levels = [before.astype(np.int32)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(before):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols from places a and b (which differ) on."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place whose suffix ranks lower, or the end."""
    ranks = rank.tolist()
    n = len(ranks)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while stack and ranks[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def find_runs(symbols: list[int], separators: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) in order of start and period; symbols below ``separators`` occur once, one of them last."""
    n, most = len(symbols), max(symbols)
    tree = SuffixTree(symbols)
    plain = list(range(most + 1))
    turned = plain[:separators] + [most + separators - s for s in plain[separators:]]
    tours = [tree.tour(plain), tree.tour(turned)]
    forward = Extensions(*tours[0])
    roots = []
    for leaves, _ in tours:
        rank = np.empty(n, np.int64)
        rank[leaves] = np.arange(n)
        ends = _next_smaller(rank)
        starts = np.flatnonzero(ends < n)
        roots.append(starts * n + ends[starts])
    del tree, tours
    roots = np.unique(np.concatenate(roots))
    i, j = roots // n, roots % n
    # the reversal needs an ending of its own: the separator in front, which is the first one's turn
    back = Extensions(*SuffixTree([*symbols[-2::-1], symbols[-1]]).tour())
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    left[inner] = back.of(n - 1 - i[inner], n - 1 - j[inner])
    period = j - i
    start, end = i - left, j + forward.of(i, j)
    found = np.flatnonzero(end - start >= np.maximum(least, 2 * period))
    return np.unique(np.stack([start, period, end - start], 1)[found], axis=0)[:, [0, 2, 1]]


def _stretches(h: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that can hold runs; rows are the bounds of the documents."""
    size = least // 2
    start, end = rows[:-1], rows[1:]
    grams = window_hashes(h, size)
    while True:
        keep = end - start >= least
        start, end = start[keep], end[keep]
        if not len(start):
            return start, end
        count = end - start - size + 1
        skipped = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(start - skipped, count)
        keys = grams[at] ^ mix(np.repeat(np.arange(len(start), dtype=np.uint64), count))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        change = np.zeros(len(h) + 1, np.int32)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + size, -1)
        covered = np.zeros(len(h) + 2, bool)
        covered[1:-1] = np.cumsum(change[:-1]) > 0
        first = covered[1:-1] & ~covered[:-2]
        first[start] |= covered[1:-1][start]
        last = covered[1:-1] & ~covered[2:]
        last[end - 1] |= covered[1:-1][end - 1]
        new_start, new_end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(new_start) == len(start) and (new_start == start).all() and (new_end == end).all():
            return start, end
        start, end = new_start, new_end


def _runs_of(tokens: list[bytes], start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of all stretches, places as in ``tokens``."""
    found, todo = [], list(zip(start.tolist(), end.tolist(), strict=True))
    while todo:
        held, k = 0, 0
        while k < len(todo) and (not k or held + todo[k][1] - todo[k][0] <= CHUNK):
            held += todo[k][1] - todo[k][0]
            k += 1
        part, todo = todo[:k], todo[k:]
        names: dict[bytes, int] = {}
        symbols, shift = [], []
        for nth, (a, b) in enumerate(part):
            shift.append((len(symbols), a))
            symbols.extend([names.setdefault(t, len(names) + k) for t in tokens[a:b]])
            symbols.append(nth)
        runs = find_runs(symbols, k, least)
        here, there = np.array(shift, np.int64).T
        runs[:, 0] += (there - here)[np.searchsorted(here, runs[:, 0], "right") - 1]
        found.append(runs)
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _collapse(least: int):
    def run(batches):
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), 1 << 20):
                text = batch.column(1).slice(lo, hi - lo)
                data, offsets = utf8(text)
                w = words(data, offsets)
                whole = data.tobytes()
                tokens = [whole[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
                runs = _runs_of(tokens, *_stretches(word_hashes(data, w), w.rows, least), least)
                row = np.searchsorted(w.rows, runs[:, 0], "right") - 1
                change = np.zeros(len(tokens) + 1, np.int32)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                dropped = np.cumsum(change[:-1]) > 0
                bounds = w.rows.tolist()
                plain = np.zeros(len(bounds) - 1, bool)
                plain[row] = True
                kept = []
                for r, touched in enumerate(plain.tolist()):
                    mine = tokens[bounds[r] : bounds[r + 1]]
                    if touched:
                        mine = [t for t, gone in zip(mine, dropped[bounds[r] : bounds[r + 1]].tolist(), strict=True) if not gone]
                    kept.append(b" ".join(mine))
                first = np.searchsorted(row, np.arange(len(bounds)))
                columns = (runs[:, 0] - w.rows[row], runs[:, 1], runs[:, 2])
                listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.rows)), listed, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document row: doc_id, n_words, its runs in order of start and period, and the text in which each run keeps its first period."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_collapse(least), _FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of a tenth of the documents, by the hash of their id, become periodic from a place on; a null id plants none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("long")
    from_, period = g % n, 1 + F.floor((n - g % n) / (3 + g % 8))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    rows = rows.withColumn("w", F.when((F.col("h") % 10 == 0), found))
    rows = rows.withColumn("a", F.when(n > 0, from_)).withColumn("p", F.when(n > 0, period))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The figures of each document's runs: number, the longest one, and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), F.lit(0))
    rows = collapse(docs, least).withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
