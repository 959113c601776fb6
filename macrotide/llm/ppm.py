"""Language-model scoring by prediction by partial matching over bytes.

The model is the byte-context trie of the training documents: for every context of
at most ``order`` bytes the counts of the bytes that followed it. A byte is coded
in the longest context that training has seen; if it never followed there, an
escape (method D: half a count for each distinct follower) leads to the next
shorter context, where the followers already ruled out are excluded; below the
empty context all bytes not yet excluded are equally probable. Texts are lower-cased
(A-Z), preceded by ``order`` bytes 0xFF and ended by one byte 0xFF, which no UTF-8
text contains. The score is the log10 probability of the bytes and the end.

The trie is never in one place. Blocks of documents send their distinct
(context, byte) pairs with training counts, in slices by the context's last two
bytes; a slice holds all contexts with these ends, hence all escape chains down to
length 2. Lengths 1 and 0 come from one table of at most 65,536 counts, which all
slices get. A slice answers each block with the log probability of each pair. Words
for the base score travel the same way: distinct word hashes out, counts back.

Null texts are empty: their only token is the end. A null doc_id counts as the empty
text for the split (crc32 0: held out). Repeated rows are scored one by one, and
each counts in training. Without training documents every byte costs
log10(256) and the base score is 0 (null division is never reached: V+1 is 1).
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, row_blocks, sorted_unique, utf8, word_hashes, words
from .storage import blocked_table, finished, materialise, slices, text_bytes

ORDER = 5
EDGE = 0xFF
SMOOTHING = 0.1
#: Stands for the end token among word hashes.
END_KEY = np.uint64(0x5EED_0E0D_0E0D_5EED)

_REQUEST = "g long, kind int, slice int, keys binary, counts binary"
_ANSWER = "g long, kind int, slice int, answers binary, distinct long, total long"
GRAM, TOKEN = 0, 1


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the byte and its context at each place of each row, ends included, and each row's first key.

    A key holds the nearest context byte on top, the byte itself at the bottom.
    """
    n = np.diff(offsets)
    # rows laid out with the edge bytes between them: order before each row, one after it
    at = np.arange(len(data)) + np.repeat(np.arange(len(n)) * (order + 1) + order, n)
    padded = np.full(len(data) + len(n) * (order + 1), EDGE, np.uint8)
    padded[at] = data
    first = offsets[:-1] + np.arange(len(n)) * (order + 1)  # of each row's padding
    keys = np.zeros(max(0, len(padded) - order), np.uint64)
    wide = padded.astype(np.uint64)
    for back in range(order, 0, -1):
        keys |= wide[order - back : len(padded) - back] << np.uint64(8 * (order + 1 - back))
    keys |= wide[order:]
    rows = np.concatenate([[0], np.cumsum(n + 1)])
    pick = np.arange(rows[-1]) + np.repeat(first - rows[:-1], n + 1)
    return keys[pick], rows


def _count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    if not len(x):
        return x, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[first], np.diff(np.append(first, len(x)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal keys."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in the sorted known ones; asked for in order, neighbours are near each other in memory."""
    order = np.argsort(keys)
    found = np.empty(len(keys), np.int64)
    found[order] = np.searchsorted(known, keys[order])
    return found


def _gram_slice(keys: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The slice of a pair, by the last two context bytes."""
    two = keys >> np.uint64(8 * (order - 1))
    return (two * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _parts(table: pa.Table):
    """Row range, lower-cased bytes and offsets of parts of a block."""
    text = table.column("text")
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
    for lo, hi in row_blocks(text, 1 << 20):
        data, offsets = utf8(text.slice(lo, hi - lo))
        yield lo, hi, LOWER[data], offsets


def _tokens(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of each row, the end token last, and each row's first token."""
    w = words(data, offsets)
    rows = w.rows + np.arange(len(w.rows))
    keys = np.full(rows[-1], END_KEY, np.uint64)
    keys[np.arange(len(w.start)) + np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))] = word_hashes(data, w)
    return keys, rows


def _of_rows(values: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return values[np.repeat(keep, np.diff(rows))]


def _distinct(table: pa.Table, order: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, distinct keys, their training counts) of a block."""
    train = np.array(table.column("train").to_pylist(), bool)
    found: dict[int, list] = {GRAM: [], TOKEN: []}
    for lo, hi, data, offsets in _parts(table):
        for kind, (keys, rows) in ((GRAM, grams(data, offsets, order)), (TOKEN, _tokens(data, offsets))):
            for flag in (True, False):
                k, c = _count(_of_rows(keys, rows, train[lo:hi] == flag))
                found[kind].append((k, c * flag))
    return [(kind, *_merge(parts)) for kind, parts in found.items()]


def _layout(kind: int, keys: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order in which a block sends sorted keys, and (slice, from, to) of the slices that it has keys of."""
    if kind == GRAM:
        s = _gram_slice(keys, order, bits)
        by = np.argsort(s, kind="stable")
        s = s[by]
    else:
        by, s = np.arange(len(keys)), (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return by, list(zip(s[first].tolist(), first.tolist(), np.append(first[1:], len(s)).tolist(), strict=True))


def _table(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


def _ask(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        g, out = table.column("g")[0].as_py(), []
        for kind, keys, counts in _distinct(table, order):
            by, parts = _layout(kind, keys, order, bits)
            keys, counts = keys[by], counts[by].astype("<u4")
            out += [(g, kind, s, keys[lo:hi].tobytes(), counts[lo:hi].tobytes()) for s, lo, hi in parts]
        return _table(out, ["g", "kind", "slice", "keys", "counts"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


class Level:
    """Contexts of one length: for each the total and the number of followers, and the counts of the pairs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        self.keys, self.counts = keys[seen], counts[seen].astype(np.float64)
        contexts = self.keys >> np.uint64(8)
        first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(contexts) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.first = first
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        self.followers = np.diff(np.append(first, len(contexts))).astype(np.float64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _look(self.keys, keys, self.counts)

    def exclude(self, parent: Level, shorten) -> None:
        """What the parent context loses when one comes from here: the counts there of the followers seen here."""
        lost = parent.count(shorten(self.keys))
        self.excluded = np.add.reduceat(lost, self.first) if len(self.first) else np.zeros(0)


def _look(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0.0)


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, order: int, bigrams: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the last byte of each key after its context; counts are training counts.

    keys: distinct and sorted, all that end in the same pairs of context bytes. bigrams:
    sorted keys (context byte, byte) of the whole training text and their counts.
    """

    def cut(k, length):  # the key of the nearest ``length`` context bytes and the byte
        return ((k >> np.uint64(8 * (order - length) + 8)) << np.uint64(8)) | (k & np.uint64(0xFF))

    levels: dict[int, Level] = {}
    for length in range(order, 1, -1):
        levels[length] = Level(*_merge([(cut(keys, length), counts)]))
    levels[1] = Level(*bigrams)
    levels[0] = Level(*_merge([(bigrams[0] & np.uint64(0xFF), bigrams[1])]))
    for length in range(order, 0, -1):
        levels[length].exclude(levels[length - 1], lambda k, n=length: ((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(0xFF)))

    result = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    excluded, excluded_n = np.zeros(len(keys)), np.zeros(len(keys))
    for length in range(order, -1, -1):
        level = levels[length]
        k = cut(keys, length)
        context = k >> np.uint64(8)
        total, followers = _look(level.contexts, context, level.total), _look(level.contexts, context, level.followers)
        n = level.count(k)
        mass, kinds = total - excluded, followers - excluded_n
        known = open_ & (total > 0)
        hit = known & (n > 0)
        result[hit] += np.log10((n[hit] - 0.5) / mass[hit])
        escape = known & ~hit & (kinds > 0)
        result[escape] += np.log10(kinds[escape] / 2 / mass[escape])
        open_ &= ~hit
        if length:
            excluded = np.where(total > 0, _look(level.contexts, context, level.excluded), 0.0)
        excluded_n = np.where(total > 0, followers, 0.0)
    result[open_] -= np.log10(np.maximum(256 - excluded_n[open_], 1))
    return result


def _answer(order: int, bigrams):
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        g, s = table.column("g").to_pylist(), table.column("slice").to_pylist()
        parts = [(np.frombuffer(k, "<u8"), np.frombuffer(c, "<u4").astype(np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        keys, counts = _merge(parts)
        if kind == GRAM:
            values = log10_probabilities(keys, counts, order, bigrams.value)
        else:
            values = counts.astype(np.float64)
        out = []
        for i, (gg, ss, (k, _)) in enumerate(zip(g, s, parts, strict=True)):
            mine = values[np.searchsorted(keys, k)].astype("<f8").tobytes()
            out.append((gg, kind, ss, mine, int((counts > 0).sum()) if i == 0 else 0, int(counts.sum()) if i == 0 else 0))
        return _table(out, ["g", "kind", "slice", "answers", "distinct", "total"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()])

    return run


def _bigram_counts(batches):
    for batch in batches:
        total = np.zeros(1 << 16, np.int64)
        for lo, hi in row_blocks(batch.column(0)):
            keys, _ = grams(*(f(x) for f, x in zip((lambda d: LOWER[d], lambda o: o), utf8(batch.column(0).slice(lo, hi - lo)), strict=True)), 1)
            total += np.bincount(keys.astype(np.int64), minlength=1 << 16)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total[key], pa.int64())], ["key", "n"])


def _score(order: int, bits: int, n_total: int, n_distinct: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], names, types)
        look = {}
        got: dict[int, dict] = {GRAM: {}, TOKEN: {}}
        for k, s, a in zip(*(answers.column(c).to_pylist() for c in ("kind", "slice", "answers")), strict=True):
            got[k][s] = np.frombuffer(a, "<f8")
        for kind, keys, _ in _distinct(table, order):
            by, parts = _layout(kind, keys, order, bits)
            values = np.empty(len(keys))
            for s, lo, hi in parts:
                values[by[lo:hi]] = got[kind][s]
            look[kind] = (keys, values)
        train = table.column("train").to_pylist()
        ids = table.column("doc_id").to_pylist()
        denominator = n_total + SMOOTHING * (n_distinct + 1)
        out = []
        for lo, hi, data, offsets in _parts(table):
            sums = {}
            for kind, (keys, rows) in ((GRAM, grams(data, offsets, order)), (TOKEN, _tokens(data, offsets))):
                known, values = look[kind]
                x = values[_places(known, keys)]
                if kind == TOKEN:
                    sums["n"] = np.diff(rows)
                    sums["known"] = np.add.reduceat((x > 0).astype(np.int64), rows[:-1])
                    x = np.log10((x + SMOOTHING) / denominator)
                sums[kind] = np.add.reduceat(x, rows[:-1])
            out += zip(ids[lo:hi], (not t for t in train[lo:hi]), sums["n"].tolist(), sums["known"].tolist(), [n_total] * (hi - lo), sums[TOKEN].tolist(), sums[GRAM].tolist(), strict=True)
        return _table(out, names, types)

    return run


def score(docs: DataFrame, order: int = ORDER, held_out=None) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out: a condition on the rows; by default crc32(doc_id as text) mod 10 is 0.
    """
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out).alias("train"))
    total = text_bytes(docs)
    bits = slices(2 * total).bit_length() - 1
    two = plain.filter("train").select("text").mapInArrow(_bigram_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = sorted((r["key"], r["n"]) for r in two.collect())  # at most 65,536
    bigrams = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)))
    table = blocked_table(plain, total, 12 << 20)
    by_block = table.groupBy("g")
    asked = by_block.applyInArrow(_ask(order, bits), _REQUEST)
    answers = materialise(asked.groupBy("kind", "slice").applyInArrow(_answer(order, bigrams), _ANSWER))
    n_distinct, n_total = answers.filter(F.col("kind") == TOKEN).agg(F.sum("distinct"), F.sum("total")).first()
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = by_block.cogroup(answers.drop("distinct", "total").groupBy("g")).applyInArrow(_score(order, bits, n_total or 0, n_distinct or 0), schema)
    return finished(scored, table, answers)
