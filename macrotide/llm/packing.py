"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Documents are tokenised once, in parallel, and cut into pieces of at most the
capacity. Only the histogram of lengths (at most ``capacity`` counts, whatever the
corpus) reaches the driver. There, for one bin after another, a bitset subset-sum
over the lengths still available finds the fullest feasible combination that
holds the longest piece left; the combination is taken as often as its lengths
last, so the number of combinations is bounded by the number of lengths, not of
pieces. The plan names, for each length, which ranks of that length go where, and
pieces find their place by a join on (length, range of ranks).

Null texts are empty; an empty text is one piece, its end token alone. Documents
with the same doc_id and text are told apart by nothing but their place, and
each gets its own. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import row_blocks, utf8
from .storage import materialise

CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker remembers; beyond that those not met again lately are forgotten.
WORD_CACHE = 500_000
#: Bytes of text that are split and numbered at once.
BLOCK_BYTES = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of texts, word by word.

    The pre-tokeniser never joins text across a space or line feed, so the ids of a text are
    those of its words one after another. Arrow splits the texts of a batch and numbers their
    distinct words; only those are looked up. Ids are kept as little-endian unsigned 32-bit bytes,
    in two generations: a word met again moves to the young one, and when that is half of the
    memory, the old one is dropped, so frequent words stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith("</w>")]] = True
        self.marks = dict(zip(".,!", self._each([".", ",", "!"]), strict=True))
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: encoded side by side, then cut where the ids end a word."""
        if not words:
            return []
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(words):  # a script in which letters alone are not one pre-token
            return self._each(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def lookup(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words."""
        if len(self.young) > WORD_CACHE // 2:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        found = list(map(young.get, words))
        split, fresh, others = [], {}, []
        for i, known in enumerate(found):
            if known is not None:
                continue
            w = words[i]
            if (known := old.get(w)) is not None:
                found[i] = young[w] = known
                continue
            # a word of letters with one mark after it has the ids of the lower-case letters, then those of the mark
            core, mark = (w[:-1], w[-1]) if w[-1] in self.marks else (w, "")
            if not core.isalpha() or "\u03a3" in core or "\u0130" in core:
                others.append(i)
                continue
            core = core.lower()
            split.append((i, core, mark))
            if core not in fresh:
                fresh[core] = young.get(core) or old.get(core)
        new = [w for w, known in fresh.items() if known is None]
        fresh.update(zip(new, self._letters(new), strict=True))
        for i, core, mark in split:
            young[core] = ids = fresh[core]
            young[words[i]] = found[i] = ids + self.marks[mark] if mark else ids
        for i, ids in zip(others, self._each([words[i] for i in others]), strict=True):
            young[words[i]] = found[i] = ids
        return found

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text begins; null is empty."""
        spaced = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), "\n", " ")
        data, _ = utf8(spaced)
        if not (data >> 1 == 0x66).any() and not pc.any(pc.match_substring(spaced, "<|")).as_py():
            # the model lower-cases too, but after composing marks (bytes CC and CD) and setting special tokens apart
            spaced = pc.ascii_lower(spaced)
        split = pc.split_pattern(spaced, " ")
        coded = pc.dictionary_encode(split.flatten())
        ids = self.lookup(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        word = coded.indices.to_numpy()
        count = size[word]
        until = np.zeros(len(word) + 1, np.int64)
        np.cumsum(count, out=until[1:])
        first = (np.cumsum(size, dtype=np.int64) - size)[word] - until[:-1]
        at = np.repeat(first, count)
        at += np.arange(until[-1])
        offsets = split.offsets.to_numpy()
        return np.frombuffer(b"".join(ids), "<u4")[at], until[offsets - offsets[0]]


_models: dict[str, WordIds] = {}


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = _models.get(path) or _models.setdefault(path, WordIds(path))
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), BLOCK_BYTES):
                ids, starts = words.texts(batch.column(1).slice(lo, hi - lo))
                data, starts = memoryview(ids.tobytes()), (starts * 4).tolist()
                rows: list[tuple] = []
                for r, doc in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    own = bytes(data[starts[r] : starts[r + 1]]) + end
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents' token sequences, cut; with ``with_ids`` also the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(tokenizer, capacity, end_id, with_ids), schema)


def fullest(counts: np.ndarray, longest: int, room: int) -> list[tuple[int, int]]:
    """Lengths and how often each, the longest among them, whose sum comes as close to ``room`` as any does.

    Bit r of ``reach`` says that some choice among the lengths seen so far sums to r.
    """
    target = room - longest
    reach, mask = 1, (1 << (target + 1)) - 1
    steps: list[tuple[int, int]] = []
    available = np.flatnonzero(counts[: target + 1])[::-1]
    for length in available.tolist():
        left = int(counts[length]) - (length == longest)
        for _ in range(min(left, target // length)):
            steps.append((length, reach))
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            reach = grown
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + 1
            at -= length
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, bins, first sequence, offset): ranks first.. of a length go into that many sequences at that offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(capacity + 1, np.int64)
    out, sequence, longest = [], 0, capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        combination = fullest(counts, longest, capacity)
        bins = min(int(counts[length]) // n for length, n in combination)
        offset = 0
        for length, n in combination:
            for _ in range(n):
                out.append((length, int(used[length]), bins, sequence, offset))
                used[length] += bins
                offset += length
            counts[length] -= n * bins
        sequence += bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset (and ids, if wanted)."""
    spark = docs.sparkSession
    # written with a number for each row, so that equal rows can be told apart and dealt over slices
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    planned = plan(histogram, capacity)
    ranges = spark.createDataFrame(planned, "length long, first_rank long, bins long, first_sequence long, offset long")
    # ranks within a length: within hash slices first, then shifted by the slices before; with the square root
    # of the number of pieces as the number of slices, neither step gathers more than about that many rows of one length
    slices = max(1, math.isqrt(total))
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)))
    by_slice = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(by_slice), F.lit(0))).drop("n")
    inner = Window.partitionBy("length", "_slice").orderBy("_row")
    ranked = sliced.withColumn("_in_slice", F.row_number().over(inner) - 1).join(before, ["length", "_slice"]).withColumn("_rank", F.col("_in_slice") + F.col("_before"))
    # at most a few ranges for each of at most ``capacity`` lengths: gathered per length, then the last one that starts
    # at the rank or before it is found by halving steps
    lookup = ranges.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "bins", "first_sequence", "offset"))).alias("_ranges"))
    widest = max(Counter(r[0] for r in planned).values(), default=1)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(widest.bit_length()))))
    starts = lambda at: F.get("_ranges", at - 1)["first_rank"]
    last = F.aggregate(steps, F.lit(0), lambda at, step: F.when(starts(at + step) <= F.col("_rank"), at + step).otherwise(at))
    place = F.element_at("_ranges", last)
    kept = [c for c in cut.columns if c != "_row"]
    return (
        ranked.join(F.broadcast(lookup), "length")
        .withColumn("_place", place)
        .select(*kept, (F.col("_place.first_sequence") + F.col("_rank") - F.col("_place.first_rank")).alias("sequence_id"), F.col("_place.offset").alias("offset"))
    )
