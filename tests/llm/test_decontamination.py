"""Suffix arrays, longest matches and locations against plain comparison of all stretches."""

import random
import re

import numpy as np
import pytest

from macrotide.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stretches(doc, item):
    """(start, length, item_start) of all equal stretches that no neighbour extends."""
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and not (i and j and doc[i - 1] == item[j - 1]):
                n = 1
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                yield i, n, j


def judged(text, items):
    doc, found, best = tokens(text), set(), (0, None, None)
    for item_id, t in items:
        item = tokens(t)
        for start, n, there in stretches(doc, item):
            if n >= min(13, len(item)):
                found.add((start, n, item_id, there))
            best = min(best, (n, start, item_id), key=lambda x: (-x[0], x[1] or 0, x[2] is None, x[2] or 0))
    places = sorted(found, key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0, x[3]))
    return len(doc), sorted({p for s, n, _, _ in found for p in range(s, s + n)}), sorted({i for _, _, i, _ in found} - {None}), *best, places


def reported(docs, bench, **how):
    rows = decontaminate.matches(docs, bench, **how).collect()
    return sorted((str(r.doc_id), (r.n_words, r.hits, r.items, r.longest, r.longest_start, r.longest_item, [tuple(x) for x in r.locations])) for r in rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    item = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (40, 25, 30, 14, 13, 12, 5, 1, 70)]
    item.append(item[0][:20] + item[1])
    items = [(i, " ".join(x)) for i, x in enumerate(item)] + [(None, " ".join(item[2])), (3, " ".join(item[3])), (20, None), (21, ""), (22, "?!")]

    def noise(n):
        return [f"v{rng.randrange(900)}" if rng.random() < 0.7 else f"w{rng.randrange(60)}" for _ in range(n)]

    docs = [noise(30) + x[a : a + k] + noise(20) for x in item for a, k in ((0, len(x)), (3, 12), (2, 13), (5, 21))]
    docs += [item[0] * 3, item[8] + item[8][::-1], noise(3000) + item[8], ["w7"] * 200]
    texts = [(i, " ".join(x)) for i, x in enumerate(docs)]
    return items, texts + [(0, texts[0][1]), (None, texts[1][1].upper()), (None, None), (900, ""), (901, ". , !")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 1])
def test_matches_are_those_of_all_stretches(spark, corpus, block_bytes):
    items, docs = corpus
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(d, t, d, 0) for d, t in docs], "doc_id long, text string, item_id long, hits int").repartition(3)
    want = sorted((str(d), judged(t, items)) for d, t in docs)
    got = reported(table, bench, block_bytes=block_bytes)
    assert got == want
    lengths = {x[3] for _, x in got}
    assert 12 in lengths and max(lengths) >= 70 and any(len(x[6]) > 1 for _, x in got)
    bad = [20 * len(x[1]) >= x[0] and len(x[1]) > 0 for x in (judged(t, items) for _, t in docs)]
    kept = decontaminate.clean(table, bench, block_bytes=block_bytes)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(d), t or "") for (d, t), b in zip(docs, bad, strict=True) if not b)


def test_empty_tables(spark, corpus):
    items, docs = corpus
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert decontaminate.verdict(decontaminate.matches(table.limit(0), bench)).count() == 0
    rows = decontaminate.verdict(decontaminate.matches(table, bench.limit(0))).collect()
    assert len(rows) == len(docs) and all((r.n_hit, r.longest_match, r.longest_start, r.n_locations, r.contaminated) == (0, 0, None, 0, False) for r in rows)


def test_long_text_and_long_item(spark):
    words = [f"x{i * 7919 % 5003}" for i in range(60_000)]
    items = [(1, " ".join(words[10_000:50_000])), (2, "rare words only")]
    rows = reported(spark.createDataFrame([(1, " ".join(words)), (2, "no such thing")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    (_, long), (_, short) = rows
    # the words repeat with period 5003, so the item's text fits at several places; the first is 10,000 modulo the period
    assert long[3:6] == (40_000, 10_000 % 5003, 1) and len(long[1]) == 60_000
    assert short[3] == 0 and short[6] == []


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array_sorts_all_suffixes(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 30, 300):
        h = rng.integers(1, letters + 1, n).astype(np.uint64)
        ends = np.sort(np.append(rng.integers(0, n + 1, n // 8), n))
        ends = ends[np.searchsorted(ends, np.arange(n), "right")]
        order = decontaminate.suffix_array(h, ends, n)
        suffixes = [tuple(h[i : ends[i]].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and suffixes == sorted(suffixes)
