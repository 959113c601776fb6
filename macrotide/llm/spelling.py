"""Grouping of spelling variants: words one edit apart, found by dynamic programming over sorted lists.

A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; words of at least ``SHORTEST``
code points that occur ``OFTEN`` times or more form the vocabulary. Two words are near if one
inserted, deleted or replaced code point makes one of the other.

1. Blocks of text send distinct words with counts, which are summed over all documents.
2. Of two near words, of m and m or m + 1 code points, either the first m // 2 code points are equal or the last m - m // 2.
   Each word therefore joins up to four groups: as a shorter and as a longer word, by its
   beginning, or (spelt backwards) by its end. A group of more than ``CROWD`` words is cut again in the same way,
   in the middle of the part that is still unknown: of its pairs, that part's first or last half is equal too. When at most ``FINE`` code points are
   unknown, the alphabet bounds the group, so no group grows with the data and none is sampled.
3. In a sorted group, each word is compared with the list in one scan: a row of the edit matrix has
   three cells (the band of one edit), rows up to the common prefix of neighbours are used again, and
   as soon as a row exceeds one edit, all words that share the prefix it stands for are skipped.
4. A word's form is its near word of largest count (ties: the smallest in code-point order), if this is ``RATIO`` times its own or more;
   following forms, which pointer doubling does for all words at once, leads to the root.

Null and empty texts have no words. Repeated rows and rows without a doc_id count like others. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, finished, materialise

SHORTEST, OFTEN, RATIO = 7, 2, 10
#: Larger groups are cut again, unless no more than FINE code points are unknown.
CROWD, FINE = 2_000, 2
#: Distinct words that a task holds before it hands them on.
HELD = 200_000
#: Above all code points.
_LAST = "\U0010ffff"

_WORDS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf]){%d,}" % SHORTEST)


def _counted(rename):
    def run(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py()
                if text:
                    found = Counter(_WORDS.findall(text.lower()))
                    for word, n in rename(doc_id, found) if rename else found.items():
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, rename=None) -> DataFrame:
    """(word, n) of all words that are long and frequent enough.

    rename(doc_id, counts), if given, yields (word, count) in place of a document's own counts;
    words are lower-case UTF-8 of SHORTEST code points or more.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(rename), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= SHORTEST) & (F.col("n") >= OFTEN))


def _near_to(query: str, at: int, words: list[str], shared: list[int], fixed: int) -> Iterator[int]:
    """Places of words one edit from ``query``, as long or longer by one; of those as long, only later ones.

    ``shared`` holds the common prefix of each word with the one before it; all words begin with the same ``fixed`` code points.
    """
    m, n = len(query), len(words)
    # the row of a prefix of k code points: least edits (2: more than one) that make it of the query's first k - 1, k, k + 1
    rows = [(2, 0, 1)] * (fixed + 1)
    i = 0
    while i < n:
        word = words[i]
        size = len(word)
        k = min(shared[i], len(rows) - 1) if i else fixed
        del rows[k + 1 :]
        fits = True
        while k < size:
            low, mid, high = rows[k]
            c = word[k]
            # from (k - 1, k, k + 1) to (k, k + 1, k + 2) letters of the query
            new_low = 2 if k > m else min(low + (k < 1 or query[k - 1] != c) if k else 2, mid + 1)
            new_mid = 2 if k + 1 > m else min(mid + (query[k] != c), high + 1, new_low + 1)
            new_high = 2 if k + 2 > m else min(high + (query[k + 1] != c), new_mid + 1)
            k += 1
            if min(new_low, new_mid, new_high) > 1:
                # no word with these k code points can be near: go on behind the last of them
                i = bisect_left(words, word[:k] + _LAST, i + 1)
                fits = False
                break
            rows.append((min(new_low, 2), min(new_mid, 2), min(new_high, 2)))
        if not fits:
            # the next word shares at most k - 1 code points with this one, whose rows are all there
            continue
        if i != at and (size == m + 1 or size == m and i > at):
            low, mid, _ = rows[size]
            if (mid if size == m else low) == 1:
                yield i
        i += 1


def _shared(words: list[str]) -> list[int]:
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        out[i] = k
    return out


def near_in_group(words: list[str], m: int) -> Iterator[tuple[str, str]]:
    """Near pairs of sorted distinct words of m or m + 1 code points, the one of m first."""
    shared = _shared(words)
    fixed = min(shared[1:], default=0)
    for at, query in enumerate(words):
        if len(query) == m:
            for i in _near_to(query, at, words, shared, min(fixed, m)):
                yield query, words[i]


def _links(batches):
    """Rows (group, m, backwards, word) in order of group and word come in; near pairs go out."""
    a, b = [], []

    def finish(group):
        if len(group) > 1:
            m, backwards = group[0][1], group[0][2]
            for x, y in near_in_group([w for _, _, _, w in group], m):
                a.append(x[::-1] if backwards else x)
                b.append(y[::-1] if backwards else y)

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])
        a.clear()
        b.clear()
        return batch

    group: list = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if group and row[0] != group[0][0]:
                finish(group)
                group = []
            group.append(row)
        if a:
            yield out()
    finish(group)
    if a:
        yield out()


def _cut(rows: DataFrame) -> DataFrame:
    """Groups cut in the middle of what is unknown: the unknown part is ``open`` code points from ``at`` on, of the shorter word."""
    half = (F.col("open") / 2).cast("int")
    parts = F.array(
        # the part's first half is known as well, or its last one; places count from the word's start in spelling order
        F.struct((F.col("at") + half).alias("at"), (F.col("open") - half).alias("open"), F.substring("word", F.col("at") + 1, half).alias("known"), F.lit(0).alias("side")),
        F.struct(F.col("at"), half.alias("open"), F.substring("word", F.length("word") - F.col("after") - (F.col("open") - half) + 1, F.col("open") - half).alias("known"), F.lit(1).alias("side")),
    )
    x = rows.select("word", "m", "backwards", "after", "open", "group", F.explode(parts).alias("x"))
    after = F.when(F.col("x.side") == 1, F.col("after") + F.col("open") - F.col("x.open")).otherwise(F.col("after"))
    return x.select("word", "m", "backwards", F.col("x.at").alias("at"), F.col("x.open").alias("open"), after.alias("after"), _hash("group", "x.side", "x.known").alias("group"))


def _hash(*columns) -> Column:
    """A key of 128 bits."""
    return F.concat(*(F.hex(F.xxhash64(F.lit(seed), *map(F.col, columns))) for seed in (1, 2)))


def _groups(words: DataFrame) -> DataFrame:
    """(group, m, backwards, word) with the unknown part (at, open, after): the groups of each word."""
    n = F.length("word")
    sizes = words.select("word", F.explode(F.array(n, n - 1)).alias("m")).filter(F.col("m") >= SHORTEST)
    half = (F.col("m") / 2).cast("int")
    # by its beginning: what follows is unknown; by its end: spelt backwards, so that what is known comes first again
    ways = F.array(F.struct(F.lit(False).alias("backwards"), half.alias("at")), F.struct(F.lit(True).alias("backwards"), (F.col("m") - half).alias("at")))
    each = sizes.select("word", "m", F.explode(ways).alias("x")).select("m", "x.backwards", "x.at", F.when(F.col("x.backwards"), F.reverse("word")).otherwise(F.col("word")).alias("word"))
    each = each.withColumn("known", F.substring("word", F.lit(1), F.col("at")))
    return each.select("word", "m", "backwards", "at", (F.col("m") - F.col("at")).alias("open"), F.lit(0).alias("after"), _hash("m", "backwards", "known").alias("group"))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) of near words, once each, a the shorter or the one that was found first; words: (word), distinct. A written table."""
    found, rows = [], materialise(_groups(words))
    while True:
        sizes = materialise(rows.groupBy("group").agg(F.count("*").alias("n"), F.max("open").alias("most")).filter("n > 1"))
        crowded = (F.col("n") > crowd) & (F.col("most") > FINE)
        small = rows.join(sizes.filter(~crowded).select("group"), "group")
        # a group is one key of the shuffle; sorting brings its words together, in order
        dealt = small.select("group", "m", "backwards", "word").repartition("group").sortWithinPartitions("group", "word")
        found.append(materialise(dealt.mapInArrow(_links, "a string, b string")))
        large = sizes.filter(crowded).select("group")
        if large.isEmpty():
            discard(rows, sizes)
            break
        rows = finished(_cut(rows.join(large, "group")), rows, sizes)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return finished(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), *found)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling; forms: (word, form) of words that have one. Forms grow tenfold in count, so chains and rounds are few."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = after
        if now.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, rename=None, crowd: int = CROWD) -> DataFrame:
    """Per vocabulary word: word, form, root, n, n_near and form_n; a written table."""
    words = materialise(vocabulary(docs, rename))
    pairs = near_pairs(words.select("word"), crowd)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a near word's count, then each word's best: an aggregate of one struct, so a word near to many is no group in memory
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.max("near_n").alias("top"), F.min_by("b", F.struct(-F.col("near_n"), F.col("b"))).alias("best"))
    rows = materialise(
        words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(F.col("top") >= RATIO * F.col("n"), F.col(c)).alias(a) for c, a in (("best", "form"), ("top", "form_n"))))
    )
    discard(words, pairs)
    roots = _roots(rows.filter("form IS NOT NULL").select("word", "form"))
    result = rows.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return finished(result, rows, roots)


def misspelt(doc_id: int | None, counts: Counter) -> Iterator[tuple[bytes, int]]:
    """The counts of a document in which one word in 31, by its hash with the doc_id, has lost a code point (a null id counts as empty)."""
    seed = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for word, n in counts.items():
        h = crc32(word, seed)
        if h % 31 == 0:
            text = word.decode()
            k = h % len(text)
            word = (text[:k] + text[k + 1 :]).encode()
        yield word, n
