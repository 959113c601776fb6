"""Spelling variants, periodic runs and the Jaccard join against brute force, with nulls, empty, repeated and very long texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from macrotide.llm import html_extract, ngram_join, periodic_runs, spelling

WORD = r"[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(d, t, "x", 1, [d]) for d, t in rows], "doc_id long, text string, word string, n long, runs array<long>").repartition(3)


# spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, planted):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if planted and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by = {w: [x for x in words if x != w and near(w, x)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in by.items() if v}
    form = {w: x for w, x in best.items() if words[x] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(by[w]), words.get(form.get(w))) for w, n in words.items())


@pytest.mark.parametrize("crowd", [spelling.CROWD, 3])
def test_spelling_variants(spark, crowd):
    rng = random.Random(3)
    stems = ["bananaïtre", "mississippi", "straßenbahn", "aaaaaaaa", "information", "abcdefghij" * 30]
    rows = [(None, "nullified nullified"), (4, None), (5, ""), (6, " 12 34 "), (7, "short words only here"), (8, "×÷×÷×÷× ×÷×÷×÷×")]
    for d in range(10, 40):
        text = []
        for s in stems:
            text += [s] * 9
            for _ in range(6):
                k = rng.randrange(len(s))
                text.append(rng.choice([s[:k] + s[k + 1 :], s[:k] + "e" + s[k:], s[:k] + "x" + s[k + 1 :], s[:k] + s[k + 1 :] + "s", "e" + s]).title())
        rows.append((d, "-".join(text)))
    rows += rows[-2:]  # repeated rows count again
    for planted in (False, True):
        want = brute_variants(rows, planted)
        got = sorted(tuple(r) for r in spelling.variants(table(spark, rows), spelling.misspelt if planted else None, crowd).select("word", "form", "root", "n", "n_near", "form_n").collect())
        assert got == want and any(r[1] for r in want)
    chain = [(1, "variants " * 400 + "variantz " * 30 + "variatz " * 2)]
    assert {r.word: (r.form, r.root) for r in spelling.variants(table(spark, chain)).collect()} == {"variants": (None, "variants"), "variantz": ("variants", "variants"), "variatz": ("variantz", "variants")}
    assert spelling.variants(table(spark, rows).limit(0)).count() == 0


def test_near_in_group_is_exact():
    rng = random.Random(2)
    for _ in range(400):
        m = rng.randint(1, 7)
        start = "".join(rng.choice("ab") for _ in range(rng.randint(0, m)))
        words = sorted({(start + "".join(rng.choice("abc") for _ in range(9)))[: rng.choice([m, m + 1])] for _ in range(rng.randint(1, 40))})
        want = sorted((a, b) for a in words if len(a) == m for b in words if a != b and near(a, b) and (len(b) == m + 1 or len(b) == m and b > a))
        assert sorted(spelling.near_in_group(words, m)) == want


# periodic runs


def brute_runs(s, least=12):
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        same, i = [s[i] == s[i + q] for i in range(n - q)] + [False], 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            a = i
            while same[i]:
                i += 1
            length = i + q - a
            if length >= max(least, 2 * q) and not any(all(s[k] == s[k + p] for k in range(a, a + length - p)) for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(d, t):
    w = re.findall(WORD, t or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_report(d, t):
    w = planted_words(d, t)
    runs = brute_runs(w)
    gone = {k for a, length, q in runs for k in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_find_runs_is_exact():
    rng = random.Random(1)
    for _ in range(600):
        n, k = rng.randint(1, 60), rng.choice([1, 2, 3, 4])
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        least = rng.choice([2, 4, 12])
        assert [tuple(r) for r in periodic_runs.find_runs([x + 1 for x in s] + [0], 1, least).tolist()] == brute_runs(s, least)


def test_periodic_runs(spark, monkeypatch):
    rng = random.Random(4)
    plain = lambda n, k: " ".join(f"w{rng.randrange(k)}é" for _ in range(n))
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "x " * 11), (6, "x " * 5 + "y\n" * 12), (7, "ab cd ef " * 9 + "tail"), (8, ("p q r s t u v " * 2).strip()), (9, "p q r s t u v " * 2 + "p")]
    rows += [(d, plain(rng.randint(1, 150), rng.choice([2, 3, 40, 1000]))) for d in range(10, 120)]
    rows += [(d, "\n".join([plain(30, 500)] * 2 + [plain(9, 50)] * 3)) for d in range(120, 140)]
    rows += [rows[7], rows[7], (200, plain(700, 5000) + " " + "la li " * 900), (201, "same " * 3000)]
    want = Counter(brute_report(d, t) for d, t in rows if d not in (200, 201))
    got = [tuple(r) for r in periodic_runs.report(periodic_runs.planted(table(spark, rows))).collect()]
    assert Counter(r for r in got if r[0] not in (200, 201)) == want
    assert sum(r[1] for r in want) > 40 and any(r[1] > 1 for r in want)
    # very long runs, against their words by hand; two rows hold one run of one period
    long = {r[0]: r for r in periodic_runs.collapse(table(spark, [r for r in rows if r[0] in (200, 201)])).collect()}
    assert [tuple(x) for x in long[201].runs] == [(0, 3000, 1)] and long[201].collapsed == "same"
    assert [tuple(x) for x in long[200].runs] == [(700, 1800, 2)] and long[200].n_words == 2500 and long[200].collapsed.endswith(" la li")
    assert periodic_runs.report(periodic_runs.planted(table(spark, rows).limit(0))).count() == 0


def test_stretches_share_trees_or_not(monkeypatch):
    rng = random.Random(6)
    docs = [[b"%d" % rng.randrange(3) for _ in range(40)] for _ in range(12)]
    tokens = [t for d in docs for t in d]
    start = np.arange(12) * 40
    want = [(40 * i + a, length, q) for i, d in enumerate(docs) for a, length, q in brute_runs(d, 6)]
    for chunk in (1, 100, 1 << 15):
        monkeypatch.setattr(periodic_runs, "CHUNK", chunk)
        assert [tuple(r) for r in periodic_runs._runs_of(tokens, start, start + 40, 6).tolist()] == want


# Jaccard join


def shingle_set(t):
    w = re.findall(WORD, low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    near, root = defaultdict(set), list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                near[i].add(j)
                near[j].add(i)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen

    least = lambda ids: None if None in ids else min(ids)
    return Counter((rows[i][0], len(sets[i]), least([rows[j][0] for j in reach(i)])) for i in root)


def drifting(rng, n, step, length=120):
    """A chain of texts, each ``step`` words from the one before: neighbours are linked, distant ones are not."""
    w = [f"v{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        yield " ".join(w)
        for _ in range(step):
            w[rng.randrange(length)] = f"v{rng.randrange(10**6)}"


@pytest.mark.parametrize("percent", [80, 60])
def test_jaccard_join(spark, percent):
    rng = random.Random(8)
    rows = [(None, "a null id"), (1, None), (2, ""), (3, " \t "), (4, "three small words"), (5, "THREE small\nwords"), (6, "three small words."), (7, "z " * 400), (8, "z " * 300)]
    texts = [t for _ in range(6) for t in drifting(rng, 12, 2)] + list(drifting(rng, 25, 1, 60))
    shared = " ".join(f"notice{i}" for i in range(70))
    texts += [shared + " " + " ".join(f"own{d}x{i}" for i in range(rng.randint(3, 40))) for d in range(25)]
    rng.shuffle(texts)
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    rows += [rows[-1], (999, rows[-1][1]), (998, " ".join(f"long{i % 3001}" for i in range(40_000)))]
    want = brute_components(rows, percent)
    assert Counter(tuple(r) for r in ngram_join.components(table(spark, rows), percent).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert 3 < len({c for _, n, c in want if n}) < len(rows)
    if percent == 80:
        assert ngram_join.components(table(spark, rows).limit(0)).count() == 0


def test_prefixes_hold_enough_matches():
    """Of two sets over the threshold, the prefixes of either need share as many tokens as the smaller need says."""
    rng = np.random.default_rng(5)
    checked = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        universe = np.sort(rng.choice(10**6, 80, replace=False))
        classes = dict(zip(universe.tolist(), rng.integers(1, 60, 80).tolist(), strict=True))
        x = set(rng.choice(universe, min(n, 80), replace=False).tolist())
        y = set(x)
        for v in list(x)[: int(rng.integers(0, max(1, n // 5)))]:
            y.discard(v)
        y |= set(rng.choice(universe, int(rng.integers(0, 4))).tolist())
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        kept = []
        for s in (x, y):
            order = sorted(s, key=lambda t: (classes[t], t))
            length, base, need = ngram_join.prefix(np.array([classes[t] for t in order], np.uint8), 80)
            assert length == min(len(s), base + need - 1)
            kept.append(({t: max(1, i - base + 2) for i, t in enumerate(order[:length])}, need))
        (a, p), (b, q) = kept
        assert sum(max(a[t], b[t]) <= min(p, q) for t in a.keys() & b.keys()) >= min(p, q)
        checked += p > 1 and q > 1
    assert checked > 50


# main text of pages with parts in doubt

LONG = "One long sentence of the article, with commas, here. " * 4
OTHER = "A reader writes, at some length, about this and that, again. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article>" + f"<p>{LONG}</p>" * 2 + "</article><div class='comments'>" + f"<p>{OTHER}</p>" * 12 + "</div>", [LONG] * 2),
        ("<article>" + f"<p>{LONG}</p>" * 2 + "<section id='comments'>" + f"<p>{OTHER}</p>" * 12 + "</section></article>", [LONG] * 2),
        ("<article class='post'>" + f"<p>{LONG}</p>" + "</article><div id='comments'>" + f"<article class='comment-body' id='comment-5'><p>{OTHER}</p></article>" * 5 + "</div>", [LONG]),
        (f"<div class='cookie-notice'><p>{OTHER * 9}</p></div><article><p>{LONG}</p></article>", [LONG]),
        (f"<div class='cookie-notice'><p>{OTHER * 9}</p></div><div><p>{LONG}</p></div>", [LONG]),
        (f"<div class='cookie-notice'><p>{OTHER}</p></div>", []),
        (f"<article><p>{LONG}</p><p class='widget'>{OTHER}</p><div class='login-guide'><p>{OTHER}</p></div><div class='share-price-table'><p>{OTHER}</p></div></article>", [LONG] + [OTHER] * 3),
        (f"<article><p>{LONG}</p><div class='is-sponsored'><p>{OTHER}</p></div><div class='share-buttons'><p>Share this</p></div><p class='ad'>Buy, buy, buy.</p></article>", [LONG]),
        (f"<div><div class='col'><p>{LONG}</p></div><div class='col'><p>{LONG}</p><p>Short.</p></div></div>", [LONG, LONG, "Short."]),
        (f"<div><div class='col'><p>{LONG[:90]}</p></div><div class='col'><p>{LONG}</p><p>{LONG}</p></div></div>", [LONG[:90], LONG, LONG]),
        (f"<form id='aspnetForm'><div><p>{LONG}</p><p>{LONG}</p></div></form><div><p>Some words, at the foot.</p></div>", [LONG] * 2),
        (f"<div class='sidebar'><p>{OTHER}</p><p>{OTHER}</p></div><div><p>{LONG}</p></div>", [LONG]),
        (f"<div class='sidebar'><p>{OTHER}</p></div>", [OTHER]),
        (f"<div class='widget'><main><p>{LONG}</p></main></div><div class='banner'><p>{OTHER * 8}</p></div>", [LONG]),
    ],
)
def test_parts_in_doubt(page, want):
    got = html_extract.main_text(f"<html><body>{page}</body></html>")
    assert got.split("\n") == ([x.strip() for x in want] or [""])


def test_generated_pages_with_comments_notices_and_menus(spark):
    """Pages of known parts: what is expected is what was put into the article, whatever surrounds it, however long."""
    rng = random.Random(12)
    words = lambda k, n: ", ".join(f"{k}{rng.randrange(999)} and some more words" for _ in range(n)) + "."
    paragraph = lambda k: f"<p>{words(k, rng.randint(4, 9))}</p>"
    rows, want = [], {}
    for page in range(60):
        article = [paragraph("text") for _ in range(rng.randint(2, 7))]
        noise = lambda names: "".join(f"<div class='{rng.choice(names)}'>{''.join(paragraph('noise') for _ in range(rng.randint(1, 20)))}</div>" for _ in range(rng.randint(0, 2)))
        inside = [*article]
        for part in ("<div class='share-buttons'><a href=x>Share</a></div>", "<div class='advert'><p>Buy, now, please, all of you.</p></div>", "<form><p>Sign, up, here.</p></form>"):
            if rng.random() < 0.5:
                inside.insert(rng.randrange(1, len(inside) + 1), part)
        tag = rng.choice(["article", "main"])
        menu = "<nav><ul>" + "<li><a href=x>entry</a></li>" * rng.randint(1, 30) + "</ul></nav>"
        html = f"<body>{menu}{noise(['cookie-notice', 'ad-banner', 'consent'])}<{tag}><h1>Title {page}</h1>{''.join(inside)}{noise(['comments', 'comment-list'])}</{tag}>{noise(['comments', 'sidebar', 'related-posts', 'newsletter'])}<footer>Foot, of, page.</footer></body>"
        rows += [(page, "u", html, "x")] * (1 + (page == 3))
        want[page] = "\n".join([f"Title {page}", *(a[3:-4] for a in article)])
    long = "<article>" + "<p>A sentence, of a very long page.</p>" * 20_000 + "</article>" + "<div class='comments'>" + f"<p>{OTHER}</p>" * 20_000 + "</div>"
    rows.append((99, "u", long, "x"))
    want[99] = "\n".join(["A sentence, of a very long page."] * 20_000)
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
