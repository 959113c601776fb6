"""Exact Jaccard self-join of shingle sets by adaptive multi-match prefixes, joined to components.

A shingle is five consecutive words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a text of one to four words is one
shingle. Documents are linked if the Jaccard similarity of their sets is ``THRESHOLD`` or more. The steps:

1. Documents with equal sets are one node. Blocks of nodes send their distinct shingles, in hash slices; a slice answers with
   the number of nodes that hold each one, on a scale of logarithms, which with the hash gives one order of all shingles, rare ones first.
2. A set of n shingles shares at least o = ceil(0.8 n) with any partner. If fewer than o of its shingles occur elsewhere, it has
   none. Of two linked sets, for any number k up to o, the first n - o + k shingles of both share at least k. Each set chooses its own k: a longer
   prefix costs more postings, but a pair must meet in more of them before it is verified. The choice is the k of least estimated cost, from
   the numbers of step 1. A pair has to meet as often as the smaller of its two numbers says, in the prefixes that belong to it.
3. Each posting is compared with the least node of its shingle first; then in crowded shingles members of different components meet
   random partners, while that pays. What is left are pairs of members of one shingle in different components that no bound rules out
   (sizes, the triangle inequality with the least node, parity sketches); they are counted by shared postings and
   verified by their whole sets. So no group of linked documents is expanded into all its pairs, and no link between components is lost.

Null or wordless texts have an empty set and are linked with nothing: each is its own component. Documents are told apart by
doc_id (null comes first) and the hash of the text; repeated rows are one node and each gets a result row. A component's id is
its least doc_id, null if a null id is in it. Shingles are 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix, row_blocks, utf8
from .components import CROWD, PAYS, _may_link, _meetings, _merged, _with_roots, connected, parity_sketches, similarity
from .minhash import SHINGLE, _keyed, shingles
from .storage import NULL_ID, blocked_table, discard, finished, lean_shuffles, materialise, slices, text_bytes
from .substring_dedup import _rows, _sliced, _slices_of

THRESHOLD = 0.8
#: The most matches that a pair can be asked for before it is verified.
MOST = 8
#: Cost of verifying a pair, in postings for each shingle of the set.
VERIFY = 0.1
#: Steps of the logarithmic scale for each doubling of a count.
STEPS = 8

_SIGNED = "id long, text_hash long, n_shingles long, k1 long, k2 long"
_REQUEST = "g long, slice int, keys binary, more binary"
_ANSWER = "g long, slice int, classes binary"
_PREFIX = "id long, size int, need int, tokens array<long>, levels array<int>, items array<long>"
_REQUEST_TYPES = (["g", "slice", "keys", "more"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])
_ANSWER_TYPES = (["g", "slice", "classes"], [pa.int64(), pa.int32(), pa.binary()])


def _sign(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi in row_blocks(batch.column(2), 1 << 20):
                items, _, rows = shingles(*utf8(batch.column(2).slice(lo, hi - lo)), size)
                n = np.diff(rows)
                held = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                if len(held):
                    for k, c in enumerate((0, 0x2545F4914F6CDD1D)):
                        sums[k, held] = np.add.reduceat(mix(items ^ np.uint64(c)), rows[held])
                ids, text_hash = (batch.column(c).slice(lo, hi - lo) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, text_hash, pa.array(n), *(pa.array(x.view(np.int64)) for x in sums)], ["id", "text_hash", "n_shingles", "k1", "k2"])

    return run


def _sets_of(table: pa.Table, size: int):
    """(node, its shingles) parts of a block: nodes, shingles, and each node's first."""
    text = table.column("text").combine_chunks()
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    nodes = table.column("node").to_numpy()
    for lo, hi in row_blocks(text, 1 << 20):
        items, _, rows = shingles(*utf8(text.slice(lo, hi - lo)), size)
        yield nodes[lo:hi], items, rows


def _keys(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct shingles and in how many of its nodes they are."""
    keys = np.sort(np.concatenate([items for _, items, _ in _sets_of(table, size)]))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _ask(size: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _keys(table, size)
        counts = counts.astype("<u4")

        def payload(lo, hi):
            # bits that the slice does not know; the lowest ones are left out, which merges few shingles and only in the counts
            low = (keys[lo:hi] << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
            many = np.flatnonzero(counts[lo:hi] > 1).astype("<u4")
            return low.tobytes(), many.tobytes() + counts[lo:hi][many].tobytes()

        return _rows(_sliced(table.column("g")[0].as_py(), keys, bits, payload), *_REQUEST_TYPES)

    return run


def _answer(table: pa.Table) -> pa.Table:
    parts, counts = [], []
    for k, m in zip(table.column("keys").to_pylist(), table.column("more").to_pylist(), strict=True):
        wide = np.zeros((len(k) // 6, 8), np.uint8)
        wide[:, 2:] = np.frombuffer(k, np.uint8).reshape(-1, 6)
        parts.append(wide.ravel().view(">u8").astype(np.uint64))
        at, many = np.frombuffer(m, "<u4").reshape(2, -1)
        count = np.ones(len(parts[-1]), np.int64)
        count[at] = many
        counts.append(count)
    every, count = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(every)
    x = every[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    total = np.add.reduceat(count[order], first)
    classes = np.minimum(255, STEPS * np.log2(total) + 1e-9).astype(np.uint8)
    of = np.empty(len(every), np.uint8)
    of[order] = np.repeat(classes, np.diff(np.append(first, len(x))))
    cut = np.cumsum([0, *map(len, parts)])
    g, s = table.column("g").to_pylist(), table.column("slice").to_pylist()
    return _rows([(gg, ss, of[a:b].tobytes()) for gg, ss, a, b in zip(g, s, cut, cut[1:], strict=False)], *_ANSWER_TYPES)


def choose(classes: np.ndarray, base: int, overlap: int) -> int:
    """How many matches a set asks for: classes of its shingles in order, the length of its one-match prefix, its least overlap."""
    others = np.exp2(classes[: base + MOST - 1] / STEPS) - 1
    k = np.arange(1, min(MOST, overlap) + 1)
    postings = np.cumsum(others)[np.minimum(base + k - 2, len(others) - 1)]
    return int(k[np.argmin(postings + VERIFY * len(classes) * postings / k)])


def prefix(classes: np.ndarray, percent: int) -> tuple[int, int, int] | None:
    """(length, length of the one-match prefix, matches asked for) of a set of ordered shingles; None if it can have no partner."""
    n = len(classes)
    overlap = -(-percent * n // 100)
    if np.count_nonzero(classes) < overlap:
        return None
    base = n - overlap + 1
    need = choose(classes, base, overlap)
    return min(n, base + need - 1), base, need


def _prefixes(size: int, bits: int, percent: int):
    names = [c.strip().split(" ")[0] for c in _PREFIX.split(", ")]
    lists = {"tokens": pa.list_(pa.int64()), "levels": pa.list_(pa.int32()), "items": pa.list_(pa.int64())}

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        if table.num_rows:
            keys, _ = _keys(table, size)
            known = np.zeros(len(keys), np.uint8)
            at = {s: (lo, hi) for s, lo, hi in _slices_of(keys, bits)}
            for s, b in zip(answers.column("slice").to_pylist(), answers.column("classes").to_pylist(), strict=True):
                lo, hi = at[s]
                known[lo:hi] = np.frombuffer(b, np.uint8)
            for nodes, items, rows in _sets_of(table, size):
                of = known[np.searchsorted(keys, items)]
                for node, lo, hi in zip(nodes.tolist(), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    mine, classes = items[lo:hi], of[lo:hi]
                    order = np.argsort(classes, kind="stable")  # the shingles are in order of their hash
                    found = prefix(classes[order], percent) if hi > lo else None
                    if not found:
                        continue
                    length, base, need = found
                    place = np.arange(length)
                    shared = classes[order[:length]] > 0
                    out["id"].append(node)
                    out["size"].append(hi - lo)
                    out["need"].append(need)
                    out["tokens"].append(mine[order[:length]][shared].view(np.int64))
                    out["levels"].append(np.maximum(1, place - base + 2)[shared].astype(np.int32))
                    out["items"].append(mine.view(np.int64))
        return pa.table({n: pa.array(out[n], lists.get(n, pa.int64() if n == "id" else pa.int32())) for n in names})

    return run


def prefixes(nodes: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """A written table of the nodes (node, text) that may have a partner: size, need, prefix tokens with their levels, whole set."""
    total = text_bytes(nodes)
    bits = slices(4 * total).bit_length() - 1
    with lean_shuffles(nodes.sparkSession):
        table = blocked_table(nodes.select("node", "text"), total)
    by_block = table.groupBy("g")
    answers = materialise(by_block.applyInArrow(_ask(size, bits), _REQUEST).groupBy("slice").applyInArrow(_answer, _ANSWER))
    return finished(by_block.cogroup(answers.groupBy("g")).applyInArrow(_prefixes(size, bits, percent), _PREFIX), table, answers)


def _met_often(rest: DataFrame, may_link) -> DataFrame:
    """Pairs (a, b) of different components that share as many postings as the smaller of their needs, on levels up to it."""
    need = F.least("x.need", "y.need")
    on = may_link & (F.greatest("x.level", "y.level") <= need)
    met = rest.alias("x").join(rest.alias("y"), on)
    pairs = met.groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).agg(F.count("*").alias("n"), F.first(need).alias("need"))
    return pairs.filter("n >= need").select("a", "b")


def joined(found: DataFrame, threshold: float, longs: int = 16) -> DataFrame:
    """(id, root) of all nodes that have a link, from the table of prefixes. A written table."""
    features = found.select("id", "items")
    postings = found.select("id", "size", "need", F.explode(F.arrays_zip("tokens", "levels")).alias("x")).select(F.col("x.tokens").alias("bucket"), "id", "size", "need", F.col("x.levels").alias("level"))
    # the least nodes are aggregated before the shuffle and joined back, so the rows of a hot shingle can be split over tasks
    shared = postings.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    members = materialise(postings.join(shared, "bucket"))
    star = members.filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    first = materialise(similarity(star, features))
    roots = connected(first.filter(F.col("jaccard") >= threshold).select("a", "b"))
    placed = _with_roots(members.join(first.withColumnRenamed("b", "id"), ["a", "id"], "left").withColumn("near", F.coalesce("jaccard", F.lit(1.0))), roots)
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    left = materialise(placed.join(mixed, "bucket").select("bucket", "n", "id", "near", "need", "level"))
    discard(members)
    if left.isEmpty():
        discard(left, first)
        return roots
    sketches = parity_sketches(features.join(left.select("id").distinct(), "id", "left_semi"), longs)
    sketched = finished(left.join(sketches, "id"), left)
    fits = F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size") - 1e-9
    may_link, turn, pays = _may_link(threshold, longs) & fits, 0, True
    while pays:
        met = materialise(similarity(_meetings(_with_roots(sketched.filter(F.col("n") > CROWD), roots), turn, may_link), features))
        links = materialise(met.filter(F.col("jaccard") >= threshold))
        n, turn = links.count(), turn + 1
        pays = n > PAYS * met.count()
        discard(met)
        if n:
            roots = _merged(roots, links)
        else:
            discard(links)
    rest = materialise(_with_roots(sketched, roots))
    more = materialise(similarity(_met_often(rest, may_link).join(first, ["a", "b"], "left_anti"), features).filter(F.col("jaccard") >= threshold))
    discard(rest, sketched, first)
    if more.isEmpty():
        discard(more)
        return roots
    return _merged(roots, more)


def components(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id, the least doc_id that links lead to. A written table.

    percent: the similarity of linked sets, 100 times their intersection over their union."""
    plain = _keyed(docs, "text")
    signed = materialise(plain.mapInArrow(_sign(size), _SIGNED))
    grouped = signed.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    copies = materialise(grouped.withColumn("node", F.monotonically_increasing_id()))  # written, so the number stays
    texts = plain.join(copies.select("first.id", "first.text_hash", "node"), ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    found = prefixes(texts, percent, size)
    roots = joined(found, percent / 100)
    named = copies.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("k1", "k2", F.col("first.id").alias("least"), F.coalesce("root", "node").alias("root"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(component, "root").select("k1", "k2", "component_id")
    rows = signed.join(ids, ["k1", "k2"], "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return finished(rows.select(*(F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in rows.columns)), signed, copies, found, roots)
