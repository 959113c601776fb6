"""MinHash near-dedup with ProbMinHash signatures of shingle sets.

A shingle is five consecutive words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a text
of one to four words is one shingle. However often a shingle occurs, it weighs 1, as in
the similarity that links are decided by; weights by count would part near copies that
differ in how often a passage is repeated.
Every shingle is a Poisson process whose rate is its weight: its arrivals fall on
random registers, each register keeps its earliest arrival's shingle, and a shingle
stops once it can no longer beat the latest register of its document. Two registers
agree with the probability Jaccard similarity, at equal weights that of the sets. Signatures of 128
registers are cut into 32 bands of 4; documents that share a band are verified by the
exact Jaccard similarity of their shingle sets, and links (0.8 or more) are joined to
classes (``components.similar_components``).

A document is its doc_id (or null, which comes first) and the hash of its text; rows equal
in both are one document. Documents with equal shingle sets are one class before any
banding, so exact copies never meet in a band. Null or wordless texts are similar to
nothing: each is a class of its own. Of each class the document with the least doc_id
(then text hash) stays. ``class_id`` is that doc_id, so where ids are null or repeated
several classes can bear one ``class_id``. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, mix, row_blocks, utf8, window_hashes, within_rows, word_hashes, words
from .components import similar_components
from .storage import NULL_ID, discard, materialise

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4

_SIGNED = "id long, text_hash long, k1 long, k2 long, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, their counts, and each row's first one."""
    data = LOWER[data]
    w = words(data, offsets)
    h = word_hashes(data, w)
    n = np.diff(w.rows)
    place = np.flatnonzero(within_rows(w, size))
    values = window_hashes(h, size)[place] if len(place) else np.zeros(0, np.uint64)
    row = np.searchsorted(w.rows, place, "right") - 1
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([window_hashes(h[w.rows[r] : w.rows[r + 1]], int(n[r]))[0] for r in short], np.uint64)
        values, row = np.concatenate([values, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        values, row = values[order], row[order]
    rows = np.searchsorted(row, np.arange(len(n) + 1))
    values = values.copy()
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        values[lo:hi].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return values[first], np.diff(np.append(first, len(values))), np.searchsorted(row[first], np.arange(len(n) + 1))


def prob_min_hash(items: np.ndarray, weights: np.ndarray, rows: np.ndarray, registers: int) -> np.ndarray:
    """Registers of each row: the item whose weighted Poisson process reaches each register first."""
    n = len(rows) - 1
    earliest = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    row = np.repeat(np.arange(n), np.diff(rows))
    time = np.zeros(len(items))
    k = 0
    while len(items):
        k += 1
        random = mix(items + np.uint64((k * 0xD1342543DE82EF95) & (2**64 - 1)))
        time = time - np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        slot = row * registers + (mix(random ^ np.uint64(0x94D049BB133111EB)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        holder[slot[won]] = items[won]
        latest = earliest.reshape(n, registers).max(1)
        go = time < latest[row]
        items, weights, row, time = items[go], weights[go], row[go], time[go]
    return holder.reshape(n, registers)


def _sign(size: int, bands: int, rows_per_band: int):
    def run(batches):
        for batch in batches:
            for lo, hi in row_blocks(batch.column(2), 1 << 20):
                items, _, rows = shingles(*utf8(batch.column(2).slice(lo, hi - lo)), size)
                held = np.flatnonzero(np.diff(rows))
                registers = prob_min_hash(items, np.ones(len(items)), np.append(rows[held], len(items)), bands * rows_per_band)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(held), bands))
                for r in range(rows_per_band):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + registers[:, r::rows_per_band])
                ids, text_hash = (batch.column(c).slice(lo, hi - lo) for c in (0, 1))
                # a text without words is a group of its own: keyed by the document itself
                k1, k2 = (mix(x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for x in (ids, text_hash))
                if len(held):
                    k1[held], k2[held] = (np.add.reduceat(mix(items ^ np.uint64(c)), rows[held]) for c in (0, 0x2545F4914F6CDD1D))
                offsets = np.zeros(len(ids) + 1, np.int32)
                offsets[held + 1] = bands
                yield pa.RecordBatch.from_arrays(
                    [ids, text_hash, pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(key.ravel().view(np.int64)))],
                    ["id", "text_hash", "k1", "k2", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1), 1 << 20):
                items, _, rows = shingles(*utf8(batch.column(1).slice(lo, hi - lo)), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(items.view(np.int64)))], ["id", "items"])

    return run


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` with what tells documents apart: id, the doc_id with a place for null, and text_hash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), *columns)


def _classes(docs: DataFrame, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, first) per row; first: (id, text_hash) of the document of the row's class that stays."""
    plain = _keyed(docs, "text")
    signed = materialise(plain.mapInArrow(_sign(size, bands, rows), _SIGNED))
    # a copy group is a node of the links; it is written, so its number stays
    copies = materialise(signed.groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash")).alias("first")).withColumn("node", F.monotonically_increasing_id()))
    chosen = signed.join(copies.select("first.id", "first.text_hash", "k1", "k2", "node"), ["id", "text_hash", "k1", "k2"]).dropDuplicates(["node"])
    buckets = chosen.select(F.explode("bands").alias("bucket"), F.col("node").alias("id"))

    def features(nodes: DataFrame) -> DataFrame:
        wanted = copies.join(nodes.withColumnRenamed("id", "node"), "node", "left_semi").select("first.id", "first.text_hash", "node")
        texts = plain.join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
        return texts.select(F.col("node").alias("id"), "text").mapInArrow(_sets(size), "id long, items array<long>")

    roots = similar_components(buckets, features, threshold)
    named = copies.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root"))
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    found = signed.join(named.join(stays, "root").select("k1", "k2", "stays"), ["k1", "k2"]).select("id", "text_hash", F.col("stays").alias("first"))
    found = materialise(found)
    discard(signed, copies, roots)
    return found


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document row: doc_id, class_id (least doc_id of its class) and kept (whether it is the document that stays)."""
    found = _classes(docs, threshold, size, bands, rows)
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id"))
    class_id = F.when(F.col("first.id") != NULL_ID, F.col("first.id"))
    return found.select(doc_id.alias("doc_id"), class_id.alias("class_id"), (F.struct("id", "text_hash") == F.col("first")).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, once each, with its columns."""
    kept = _classes(docs, threshold, SHINGLE, BANDS, ROWS).select("first.id", "first.text_hash").distinct()
    # the input's columns travel in one struct, so that none of their names can clash
    rows = _keyed(docs, F.struct(*docs.columns).alias("row")).join(kept, ["id", "text_hash"], "left_semi")
    return rows.dropDuplicates(["id", "text_hash"]).select("row.*")
