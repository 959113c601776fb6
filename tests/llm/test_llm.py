"""Operators on a small fixture with nulls, empty and repeated texts, ties and extra columns, against brute force."""

import contextlib
import hashlib
import functools
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from macrotide.llm import chat, decontaminate, html_extract, line_dedup, minhash, packing, ppm, quality, substring_dedup, token_counts
from macrotide.llm.components import similar_components
from macrotide.llm.queries import tokenizer

BASE = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
OTHER = " ".join(f"other{i * 7 % 101}" for i in range(90))
DOCS = [
    (1, BASE), (2, BASE), (3, BASE.replace("word5x5", "Changed", 1)), (4, OTHER + "\n" + " ".join(BASE.split()[20:75])), (5, None), (6, ""), (7, " \t\n "), (8, "three small words"), (9, "three small words"),
    (10, "ünïcode déjà vu " * 12 + "\nline one is long enough to count\nline one is long enough to count!\n\n"), (11, OTHER.upper()), (None, "a null id " + OTHER), (12, "line one is long enough to count\n" + OTHER + "\nx"), (13, "z" * 50_000 + " end"), (14, "　wide space <|endoftext|> It's 3,000!"),
]
WORD = r"[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 2}", len(t or ""), d, "g") for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, g string").repartition(3, "n_chars")


def empty(docs):
    return docs.limit(0)


def test_substring_dedup(docs):
    seen, want = set(), {}
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = re.findall(WORD, t or "")
        gone = set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone.update(range(i, i + 20))
            seen.add(k)
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def test_decontamination(spark, docs):
    items = [(1, " ".join(BASE.split()[3:30])), (2, "small words"), (3, None), (4, ""), (10, "three small"), (5, "nothing like this appears in any of the texts at all, not even once here")]
    pattern, wins = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", defaultdict(set)
    for i, t in items:
        w = re.findall(pattern, low(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[a : a + n])].add(i)
    want = {}
    for d, t in DOCS:
        w, hit, found = re.findall(pattern, low(t)), set(), set()
        for k, v in wins.items():
            for a in range(len(w) - len(k) + 1):
                if tuple(w[a : a + len(k)]) == k:
                    hit.update(range(a, a + len(k)))
                    found |= v
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BENCHMARK_BLOCK_BYTES, 60):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.verdict(decontaminate.matches(docs, bench, block_bytes=size)).collect()}
        assert got == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]}
    assert decontaminate.clean(empty(docs), bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(DOCS)


def test_decontamination_judges_single_rows_in_blocks(spark):
    items = [(i, " ".join(f"item{i}w{j}" for j in range(15))) for i in range(6)]
    bad, clean = [f"{t} tail" for _, t in items[:3]], [" ".join(f"clean{i}w{j}" for j in range(16)) for i in range(3)]
    rows = [(None, bad[0]), (None, clean[0]), (None, clean[0]), (None, bad[0]), (5, clean[1]), (5, bad[1]), (5, bad[2]), (6, clean[2]), (None, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    results = []
    for size in (decontaminate.BENCHMARK_BLOCK_BYTES, 200):
        kept = decontaminate.clean(docs, bench, block_bytes=size).collect()
        assert Counter((r.doc_id, r.text) for r in kept) == Counter(r for r in rows if r[1] not in bad)
        results.append(Counter(tuple(r) for r in decontaminate.verdict(decontaminate.matches(docs, bench, block_bytes=size)).collect()))
    assert results[0] == results[1] and sum(results[0].values()) == len(rows)


def test_packing(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer())
    rows = packing.pack(docs, tokenizer(), capacity=64, with_ids=True).collect()
    ids = {d: model.encode(t or "", add_special_tokens=False).ids + [1] for d, t in DOCS}
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        got[r.doc_id] += list(r.ids)
        assert len(r.ids) == r.length <= 64 and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
    assert dict(got) == ids
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= 64
    assert len(bins) <= -(-sum(map(len, ids.values())) // 64) + 1
    assert packing.pack(empty(docs), tokenizer()).count() == 0


def test_word_ids_are_the_models(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    odd = ["H\u0331 h\u0331 A\u0301 \u0301x", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b", "\u03a3\u039f\u03a3 \u0130stanbul \u212a \ufb01n", "it's IT'S we'll... no?! a,b c, d,, .", "  two  spaces\n\n\ttab\r\n", "\u4eca\u65e5\u306f \u0e44\u0e17\u0e22 \U0001f600\U0001f600. x1y2 \u00b2 \u2160 \u00aa", "", None, "\u01c5 \u1e9e STRASSE stra\u00dfe \u00a0nbsp\u2003em"]
    letters = "aAbB\u00e9\u00c9 .,!?'-0\n\u0301\u03c3\u03a3\u0410"
    many = odd + [t for _, t in DOCS] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    for cache in (40, 500_000):
        monkeypatch.setattr(packing, "WORD_CACHE", cache)
        words = packing.WordIds(tokenizer())
        want = [words.model.encode(t or "", add_special_tokens=False).ids for t in many]
        for _ in range(2):
            got = []
            for lo in range(0, len(many), 7):
                ids, starts = words.texts(pa.array(many[lo : lo + 7], pa.string()))
                got += [ids[a:b].tolist() for a, b in itertools.pairwise(starts)]
            assert got == want


def test_fullest_is_optimal():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = np.bincount(rng.integers(1, 30, 6), minlength=41)
        longest = int(np.flatnonzero(counts).max())
        found = packing.fullest(counts, longest, 40)
        items = [n for n in range(41) for _ in range(int(counts[n]))]
        items.remove(longest)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c) + longest) <= 40)
        assert sum(n * k for n, k in found) == best and all(counts[n] >= k for n, k in found)


def test_ppm(docs):
    k = 3
    got = {r.doc_id: r for r in ppm.score(docs, order=k).collect()}
    counts, tokens = [defaultdict(Counter) for _ in range(k + 1)], Counter()
    for d, t in DOCS:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            b = b"\xff" * k + low(t).encode() + b"\xff"
            for i in range(k, len(b)):
                for n in range(k + 1):
                    counts[n][b[i - n : i]][b[i]] += 1
            tokens.update([*re.findall(WORD, low(t)), "\0"])
    total, kinds = sum(tokens.values()), len(tokens)
    for d, t in DOCS:
        b, score = b"\xff" * k + low(t).encode() + b"\xff", 0.0
        for i in range(k, len(b)):
            out = set()
            for n in range(k, -1, -1):
                c = {s: x for s, x in counts[n].get(b[i - n : i], {}).items() if s not in out}
                if b[i] in c:
                    score += math.log10((c[b[i]] - 0.5) / sum(c.values()))
                    break
                if c:
                    score += math.log10(len(c) / 2 / sum(c.values()))
                    out |= set(c)
            else:
                score -= math.log10(256 - len(out))
        w = [*re.findall(WORD, low(t)), "\0"]
        base = sum(math.log10((tokens[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        r = got[d]
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(tokens[x] > 0 for x in w), total)
    assert ppm.score(empty(docs)).count() == 0


def components(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def test_near_dedup(docs):
    sets = {}
    for d, t in DOCS:
        w = re.findall(WORD, low(t))
        d = -1 if d is None else d
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {("id", d)})
    got = {-1 if r.doc_id is None else r.doc_id: -1 if r.class_id is None else r.class_id for r in minhash.classes(docs).collect()}
    assert got == components(sets)
    kept = minhash.keep_first(docs.unionByName(docs))
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))
    assert minhash.classes(empty(docs)).count() == 0


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    near = text(1).replace("w1x0 ", "other ")
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(2)), (5, near), (5, text(4)), (5, text(4).upper()), (6, text(5)), (6, None), (None, None), (None, " "), (7, text(3)), (8, text(6)), (9, text(4))]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)
    kept = Counter((r.doc_id, (r.text or "").lower() if r.text is not None else None) for r in minhash.keep_first(docs).collect())
    assert kept == Counter([(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (6, text(5)), (6, None), (None, None), (None, " "), (8, text(6))])
    found = minhash.classes(docs).collect()
    assert len(found) == len(rows) and sorted(r.kept for r in found) == [False] * 4 + [True] * 10


def test_near_dedup_finds_copies_with_repeated_passages(spark):
    words = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    rows = [x for k in range(16) for x in ((2 * k, words(100, f"a{k}x")), (2 * k + 1, f"{words(100, f'a{k}x')} " + " ".join([words(19, f"b{k}x")] * 300)))]
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_line_dedup(docs):
    places = defaultdict(list)
    for d, t in DOCS:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            norm = re.sub("[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")
            if norm:
                places[norm].append((-(2**63) if d is None else d, i))
    sets = {n: {n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in places}
    groups = defaultdict(list)
    for n, r in components(sets).items():
        groups[r] += places[n]
    want = Counter(d for g in groups.values() for d, _ in sorted(g)[1:])
    got = {-(2**63) if r.doc_id is None else r.doc_id: r.n_removed for r in line_dedup.report(docs).collect()}
    assert {k: v for k, v in got.items() if v} == dict(want) and len(got) == len(DOCS)
    text = {r.doc_id: r.text for r in line_dedup.remove(docs).collect()}
    assert text[2] == "" and text[5] is None and "line one" in text[10] and "line one" not in text[12]
    assert line_dedup.report(empty(docs)).count() == 0


def normal(line):
    return re.sub("[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")


def test_line_dedup_sees_every_character(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    url = [f"https://{word(12)}.example/{word(20)}" for _ in range(6)]
    cjk = ["今日は天気がいい" + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(24)) for _ in range(4)]
    emoji = ["\U0001f600" * 8 + "".join(chr(0x1F300 + rng.randrange(200)) for _ in range(24)) for _ in range(3)]
    stamps = [f"2024-01-{d:02}t{word(24)}" for d in range(1, 5)]
    near = [u[:-1] + "#" for u in url[:2]] + ["x" + cjk[0], emoji[0] + "!", word(3) + stamps[0], url[2].upper()]
    spaced = ["a line with spaces and a long tail " + word(30) for _ in range(3)]
    split = ["tail\u2028" + word(30) + " " + word(9), "short one under twenty"]
    lines = url + cjk + emoji + stamps + spaced + split + near + [split[0] + "s"]
    norms = {i: normal(x) for i, x in enumerate(lines)}
    root = components({i: {n[j : j + 8] for j in range(max(1, len(n) - 7))} for i, n in norms.items()})
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.report(rows).collect()}
    assert got == {i: int(root[i] != i) for i in norms} and sum(got.values()) == 7
    sets = {r.node: len(r["items"]) for r in line_dedup.shingle_sets(rows.select(rows.doc_id.alias("node"), line_dedup.normal_form(rows.text).alias("norm"))).collect()}
    assert sets == {i: len({n[j : j + 8] for j in range(max(1, len(n) - 7))}) for i, n in norms.items()}


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    line = "this very line is found in more than one document"
    own = [f"a line that only document {w} has in this place" for w in ("one", "two", "three", "four")]
    texts = [(None, f"{own[0]}\n{line}"), (None, f"{own[1]}\nx\n{own[2]}\n{line}"), (None, f"x\n{own[3][::-1]}\ny\n{own[0][::-1]}"), (7, line), (7, f"{own[2][::-1]}\nzz"), (8, None), (None, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = [r.text for r in line_dedup.remove(rows, min_chars=20).collect()]
    assert len(kept) == len(texts) and sum((t or "").split("\n").count(line) for t in kept) == 1
    want = sorted(x for _, t in texts for x in (t or "").split("\n") if x != line and x)
    assert sorted(x for t in kept for x in (t or "").split("\n") if x != line and x) == want
    assert sum(r.n_removed for r in line_dedup.report(rows, min_chars=20).collect()) == 2


def test_line_dedup_takes_short_lines(spark):
    texts = ["Read more\nfirst text\n\nx", "read  MORE\nsecond\n\nx", "Read more\nReed more\nthird text", "Share this page!\nx", "Share this page\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.remove(rows).collect()}
    assert kept == {0: texts[0], 1: "second\n", 2: "Reed more\nthird text", 3: "Share this page!", 4: "\n"}


def test_quality(docs):
    rows = {r.doc_id: r for r in quality.assess(docs).collect()}
    for d, t in DOCS:
        w = re.findall(WORD, t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(repeated), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
    passed = quality.apply_rules(docs)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == {d for d, r in rows.items() if r.kept}
    strict = {r.doc_id: r for r in quality.assess(docs, min_docs=2, max_share=0.1).collect()}
    assert (strict[4].n_lines_removed, strict[12].n_lines_removed) == (1, 2) and not strict[4].kept and quality.assess(empty(docs)).count() == 0


def test_token_counts(docs):
    v = token_counts.Vocabulary(tokenizer("piece_bpe_32k.model"))

    @functools.lru_cache(None)
    def brute(word):
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for e in range(1, len(text) + 1):
            options = []
            for s in range(max(0, e - 40), e):
                node = v.root
                for c in text[s:e]:
                    node = node.get(c) if node is not None else None
                if node and "" in node:
                    options.append((best[s][0] + node[""], best[s][1] + 1))
                elif e - s == 1:
                    n = len(text[s:e].encode())
                    options.append((best[s][0] + n * v.unknown, best[s][1] + n))
            best.append(max(options, key=lambda x: x[0]))
        return best[-1][1]

    got = {r.doc_id: r for r in token_counts.counts(docs, tokenizer("piece_bpe_32k.model")).collect()}
    for d, t in DOCS:
        w = re.findall(WORD, t or "")
        assert (got[d].n_words, got[d].n_tokens) == (len(w), sum(map(brute, w)))
    assert token_counts.counts(empty(docs), tokenizer("piece_bpe_32k.model")).count() == 0


def test_chat_repair_is_cheapest(spark):
    chars = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "n": None}
    seqs = ["".join(p) for n in range(1, 5) for p in itertools.product("suax", repeat=n)][:200] + ["n", "uauaua", "aasu", "uuuuaaaa"]
    rows = [(c, t, chars[r], f"{t}") for c, s in enumerate(seqs) for t, r in enumerate(s)] + [(None, 0, "user", None), (None, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    price = {"keep": 0, "relabel": 2, "insert": 3, "insert_relabel": 5}
    for block in (4096, 2):
        got = defaultdict(list)
        for r in chat.format_chats(turns, block).orderBy("conv_id", "turn").collect():
            got[r.conv_id].append(r)
        for c, s in enumerate(seqs):
            cost, before = 0, None
            for r in got[c]:
                cost += price[r.action] if r.action != "merge" else 1 if chars[s[r.turn]] == before else 3
                before = r.role_out
            last = got[c][-1]
            cost += 3 * (last.n_inserted - last.action.startswith("insert"))
            now = [0] + [chat.NEVER] * 3
            for ch in s:
                now, _ = chat.advance(now, chat.role_of(chars[ch]))
            assert cost == min(n + 3 * len(chat.END[k]) for k, n in enumerate(now))
            text = "".join(r.rendered for r in got[c])
            roles = re.findall(r"<\|im_start\|>(\w+)", text)
            assert re.fullmatch(r"(system )?(user assistant )*", " ".join(roles) + " ") and text.count("<|im_end|>") == len(roles)
        assert len(got[None]) == 2
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>
    <header><h1>Site</h1></header><div class="cookie-notice">We use, cookies, a lot, really.</div><div id=content><h1>The title</h1><p>First &amp; long paragraph,
    with commas, and   <b>bold</b> text that goes on for a while.<p>Second paragraph, also, long enough to count as text.<br>after</div>
    <div class="comments"><p>A reader says, at length, many things, about this and that.</p></div><aside>Side</aside><form><input>Search</form><footer>&copy; Foot</footer>"""
    rows = spark.createDataFrame([(1, "u", page, "e"), (2, None, None, "e"), (3, "u", "", "e"), (4, "u", "<article><h1>Only</h1><p>Short &am", "e")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(rows).collect()}
    assert got[1].text == "The title\nFirst & long paragraph, with commas, and bold text that goes on for a while.\nSecond paragraph, also, long enough to count as text. after"
    assert got[2].text == "" == got[3].text and got[4].text == "Only\nShort &am" and got[1].n_chars == len(got[1].text)
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_groups_just_under_the_threshold_lose_no_link(spark):
    """One bucket of sets that are mostly a little less similar than asked for."""
    from macrotide.llm.components import parity_sketches, similar_components

    rng = random.Random(5)
    base = list(range(100))
    sets = {i: {x if rng.random() > 0.11 else rng.randrange(1000, 10**9) for x in base} for i in range(60)}
    sets[7] = set(sets[30]) | {-1}
    sets[59] = set(rng.sample(sorted(sets[12]), 85))
    features = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    sketch = {r["id"]: [r[f"s{k}"] for k in range(4)] for r in parity_sketches(features, 4).collect()}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in ((a, b) for a in sets for b in sets if a < b):
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sketch[a], sketch[b], strict=True))
        assert bits <= len(sets[a] ^ sets[b])
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {i: root[i] for link in links for i in link}
    assert len(set(linked.values())) > 1 or len(linked) < len(sets)
    buckets = spark.createDataFrame([(1, i) for i in sets], "bucket long, id long")
    found = similar_components(buckets, lambda ids: features.join(ids, "id", "left_semi"), 0.8, longs=4)
    assert {r["id"]: r["root"] for r in found.collect()} == linked


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _words string, _id string, row string, places string, id string, text_hash string, norm string"


def clashing(spark, texts):
    """Documents with further columns whose names operators might use themselves."""
    return spark.createDataFrame([(d, t, "xx", "h", -1, -5, "a", "b", "c", "d", "e", "f", "g") for d, t in texts], CLASHING)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_quality_counts_documents_not_rows(spark):
    rng = random.Random(6)
    text = "\n".join(prose(rng, 30) for _ in range(2))
    rows = clashing(spark, [(1, text)] * 6 + [(None, prose(rng, 60))] * 6 + [(k, "shared line of this host\n" + prose(rng, 60)) for k in range(2, 9)] + [(99, None), (98, "")])
    got = Counter((r.doc_id, r.kept, r.n_lines_removed) for r in quality.assess(rows).collect())
    assert got == Counter({(1, True, 0): 6, (None, True, 0): 6, (99, False, 0): 1, (98, False, 0): 1} | {(k, True, 1): 1 for k in range(2, 9)})
    passed = quality.apply_rules(rows).collect()
    assert len(passed) == 19 and all(r.n_words == -5 and r._words == "a" and r.n_chars == len(r.text) and "shared line" not in r.text for r in passed)


def test_dedups_keep_clashing_columns(spark):
    rng = random.Random(7)
    texts = [(None, prose(rng, 40)), (None, prose(rng, 40)), (3, prose(rng, 40)), (4, None), (5, "")]
    rows = clashing(spark, [*texts, texts[2]])
    kept = minhash.keep_first(rows)
    assert kept.columns == rows.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(texts)
    lines = line_dedup.remove(rows)
    assert lines.columns == rows.columns and Counter((r.doc_id, r.text) for r in lines.collect()) == Counter([*texts, texts[2]])
    assert {(r._id, r.row, r.places, r.id, r.text_hash, r.norm) for f in (kept, lines) for r in f.collect()} == {("b", "c", "d", "e", "f", "g")}


def brute_pipeline(docs, bench):
    """The stages up to packing, by hand; docs are (doc_id, source, text)."""
    docs = [list(x) for x in docs]
    blank = lambda t: not re.search(WORD, t)
    # quality
    holds, hosts = defaultdict(set), defaultdict(set)
    name = lambda d, t: (d, t if d is None else None)
    for d, s, t in docs:
        hosts[s].add(name(d, t))
        for x in (t or "").split("\n"):
            if normal(x):
                holds[s, normal(x)].add(name(d, t))
    much = {k for k, v in holds.items() if len(v) >= 5 and len(v) > 0.1 * len(hosts[k[0]])}
    passed = []
    for d, s, t in docs:
        w = re.findall(WORD, t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = (t or "").split("\n")
        cut = [x for x in lines if (s, normal(x)) in much]
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 2 * sum(map(len, cut)) <= len(t):
            passed.append((d, "\n".join(x for x in lines if (s, normal(x)) not in much)))
    # lines
    order = lambda d: -(2**63) if d is None else d
    places = defaultdict(set)
    for d, t in set(passed):
        for i, x in enumerate(t.split("\n")):
            if normal(x):
                places[normal(x)].add((order(d), t, i))
    groups = defaultdict(set)
    for n, r in components({n: {n[i : i + 8] for i in range(max(1, len(n) - 7))} for n in places}).items():
        groups[r] |= places[n]
    gone = {p for g in groups.values() for p in g - {min(g)}}
    passed = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (order(d), t, i) not in gone)) for d, t in passed]
    passed = sorted({(d, t) for d, t in passed if not blank(t)}, key=lambda x: (order(x[0]), x[1]))
    # near copies
    sets = {}
    for d, t in passed:
        w = re.findall(WORD, low(t))
        sets[order(d), t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    first = {}
    for k, r in components(sets).items():
        first[r] = min(first.get(r, k), k)
    passed = {(d if d != order(None) else None, t) for d, t in first.values()}
    # benchmark
    alnum = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = set()
    for t in bench:
        w = re.findall(alnum, low(t))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for d, t in passed:
        w = re.findall(alnum, low(t))
        hit = {i + k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append((d, t))
    return clean


@pytest.fixture(scope="module")
def small_corpus():
    rng = random.Random(8)
    bench = [prose(rng, 40) for _ in range(3)]
    shared, banner = prose(rng, 12), "the banner of host a"
    docs = []
    for k in range(14):
        lines = [prose(rng, rng.randrange(8, 25)) for _ in range(6)]
        if k % 3 == 0:
            lines.insert(rng.randrange(5), shared if k % 2 else shared + " x")
        if k < 7:
            lines.insert(0, banner)
        docs.append((k if k % 5 else None, "a" if k < 9 else None, "\n".join(lines)))
    docs.append((20, "b", docs[1][2]))  # a copy: line dedup leaves it no word
    docs.append((21, "b", "\n".join([*(prose(rng, 20) for _ in range(3)), bench[0]])))
    docs += [(22, "b", " ".join(["word"] * 80)), (23, None, None), (24, "b", ""), (25, "a", "too short"), docs[3], docs[3]]
    docs.append((26, "b", docs[2][2].replace("\n", " ") + " " + prose(rng, 3)))  # a near copy that shares no line
    docs.append((27, "b", prose(rng, 5000)))
    return docs, bench


def test_pipeline_against_brute_force(spark, small_corpus, tmp_path):
    import corpus_pipeline

    docs, bench = small_corpus
    extra = "doc_id long, source string, text string, lang string, n_chars long, n_words long, row string, _id string"
    rows = spark.createDataFrame([(*x, "en", 1, -5, "r", "i") for x in docs], extra).select("doc_id", "text", "lang", "source", "n_chars", "n_words", "row", "_id")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_pipeline(docs, bench)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == rows.columns
    assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter(want) and 8 < len(want) < len(docs) - 5
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = Counter()
    model = packing.WordIds(tokenizer()).model
    for _, t in want:
        lengths[len(model.encode(t, add_special_tokens=False).ids) + 1] += 1
    assert sum(r.length for r in packed) == sum(n * k for n, k in lengths.items()) and min(r.length for r in packed) > 1 and len(packed) >= len(want)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


LONG = "One long sentence of the article, with commas, here. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="layout no-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<div class="has-comments"><p>{LONG}</p></div>', LONG),
        (f'<form id="page"><div class="content-sidebar-wrap"><p>{LONG}</p></div><div class="sidebar"><p>Side.</p></div></form>', LONG),
        (f'<div class="widget"><article><h2>Title</h2><p>{LONG}</p></article></div><div class="comments"><p>{LONG}</p><p>{LONG}</p></div>', "Title\n" + LONG),
        ('<p class="lead>Broken quote, but text, all the same.</p><p>Second paragraph, long enough, to count.</p>', "Broken quote, but text, all the same.\nSecond paragraph, long enough, to count."),
        (f'<article><p>{LONG}</p><ul><li><a href="x">one</a></li><li><a href="y">two</a></li></ul><figure><img src=x><figcaption>A caption.</figcaption></figure></article>', LONG + "\none\ntwo\nA caption."),
        (f'<main><div><p>{LONG}</p></div><div><a href="x">{LONG}</a></div></main>', LONG),
        (f'<a title="a > b" href="x">Go</a><div><p>{LONG}</p></div>', LONG),
        ("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000, LONG),
        ("<" * 5000 + f"<p>{LONG}", None),
        ('<p class="' * 3000 + f">{LONG}", None),
    ],
)
def test_html_cases(page, want):
    got = html_extract.main_text(f"<html><body>{page}</body></html>")
    assert want is None or got == "\n".join(x.strip() for x in want.split("\n"))
    assert got == html_extract.main_text(f"<html><body>{page}</body></html>")


def test_html_scores_like_a_slow_scorer():
    """Divs of divs of paragraphs, scored by sums over all (paragraph, ancestor) pairs."""
    rng = random.Random(9)
    for _ in range(60):
        # boxes[k] is the path of indices of a div; its paragraphs are (text, link text)
        boxes = {(i, j): [(prose(rng, rng.randrange(1, 30)) + "," * rng.randrange(4), prose(rng, rng.randrange(1, 9)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(1, 5))] for i in range(3) for j in range(3)}
        page = "".join("<div>" + "".join("<div>" + "".join(f"<p>{t}<a href=x>{a}</a></p>" for t, a in boxes[i, j]) + "</div>" for j in range(3)) + "</div>" for i in range(3))
        points, size, links = Counter(), Counter(), Counter()
        for (i, j), ps in boxes.items():
            for t, a in ps:
                text = t + a
                p = (1.0 if len(text) >= 25 else 0.1) + 0.5 * text.count(",") + min(len(text) / 100, 3.0)
                for up, share in (((i, j), 1), ((i,), 0.5), ((), 0.25)):
                    size[up] += len(text)
                    links[up] += len(a)
                    if len(a) <= 0.5 * len(text):
                        points[up] += p * share
        final = {k: v * (1 - links[k] / size[k]) for k, v in points.items()}
        best = max(final, key=lambda k: final[k])
        near = [best] if best == () else [k for k in sorted(size) if len(k) == len(best) and k[:-1] == best[:-1] and (k == best or final.get(k, 0) >= max(2, 0.2 * final[best]))]
        want = [t + a for k in near for b in sorted(boxes) if b[: len(k)] == k for t, a in boxes[b]]
        got = html_extract.main_text(page).split("\n")
        assert got == want or best == () and set(got) <= set(want)


def test_chat_cost_against_all_repairs(spark):
    """Costs of the operator's repairs against an enumeration of everything a repair may do."""
    legal = re.compile("S?(UA)+")
    roles = {"S": "system", "U": "user", "A": "assistant"}

    def cheapest(turns):
        best = [10**9]

        def go(k, said, cost):
            if cost >= best[0] or not any(legal.fullmatch(said + end) for end in ("", "A", "UA")):
                return
            if k == len(turns):
                for end in ("", "A", "UA"):
                    if legal.fullmatch(said + end):
                        best[0] = min(best[0], cost + 3 * len(end))
                return
            if said:
                go(k + 1, said, cost + (1 if said[-1] == turns[k] else 3))
            for inserted in ("", "U", "A"):
                for r in "SUA":
                    go(k + 1, said + inserted + r, cost + 3 * len(inserted) + (0 if r == turns[k] else 2))

        go(0, "", 0)
        return best[0]

    seqs = ["".join(p) for n in range(1, 5) for p in itertools.product("SUAX", repeat=n)] + ["UUAXSAU", "AAAAAA", "SSUUAAUA"]
    rows = [(c, t, roles.get(r, "tool"), "same") for c, s in enumerate(seqs) for t, r in enumerate(s)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (4096, 3):
        got = defaultdict(list)
        for r in chat.format_chats(turns, block).orderBy("conv_id", "turn").collect():
            got[r.conv_id].append(r)
        for c, s in enumerate(seqs):
            cost, said = 0, ""
            for r in got[c]:
                now = r.role_out[0].upper()
                if r.action == "merge":
                    cost += 1 if said[-1] == s[r.turn] else 3
                    continue
                cost += 2 * (now != s[r.turn])
                if r.action.startswith("insert"):
                    said, cost = said + ("A" if said[-1:] == "U" else "U"), cost + 3
                said += now
            more = got[c][-1].n_inserted - got[c][-1].action.startswith("insert")
            said += {1: "A", 2: "UA"}.get(more, "")
            assert legal.fullmatch(said) and cost + 3 * more == cheapest(s), s
    repeated = spark.createDataFrame([(1, 0, "user", "hi")] * 5 + [(1, 0, "user", None)] * 2 + [(None, None, None, None)] * 3, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(repeated).collect()
    assert len(out) == 10 and sum(r.rendered.count("hi") for r in out) == 5


def test_packing_places_repeated_rows(spark):
    rng = random.Random(11)
    texts = [(1, prose(rng, 30))] * 4 + [(None, prose(rng, 50))] * 3 + [(2, prose(rng, 4000)), (3, None), (4, "")]
    rows = clashing(spark, texts)
    out = packing.pack(rows, tokenizer()).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(d for d, _ in texts)
    longest = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 2)
    assert all(n == 4096 for _, _, n in longest[:-1]) and [s for _, s, _ in longest] == [4096 * k for k in range(len(longest))]


def test_ppm_without_training_and_with_repeated_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    trained = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10)
    none = ppm.score(clashing(spark, [(held, "abc"), (held, "abc"), (None, None)])).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.base_score == 0 for r in none)
    assert sorted(r.score for r in none) == pytest.approx(sorted([-4 * math.log10(256)] * 2 + [-math.log10(256)]))
    twice = ppm.score(clashing(spark, [(trained, "ab ab"), (trained, "ab ab"), (held, "ab")])).collect()
    assert len(twice) == 3 and {r.train_tokens for r in twice} == {6} and len({r.score for r in twice if r.doc_id == trained}) == 1
    assert ppm.score(clashing(spark, [(1, "x")]).limit(0)).count() == 0


def test_line_dedup_bands_meet_short_lines(spark):
    """Of pairs of 10 shingles, 8 of them common, the bands find at least 99 of 100 (98 with 12 bands of 24 minima)."""
    pairs = 2000
    rows = spark.range(10 * pairs).select((F.col("id") / 10).cast("int").alias("pair"), (F.col("id") % 10 < 8).alias("common"), F.xxhash64("id").alias("h"))
    members = line_dedup.band_members()
    n = 1 + max(m for taken in members for m in taken)
    same = rows.groupBy("pair").agg(*(F.min_by("common", line_dedup._permuted(F.col("h"), m)).alias(f"m{m}") for m in range(n))).collect()
    met = sum(any(all(r[f"m{m}"] for m in taken) for taken in members) for r in same)
    assert len(same) == pairs and met >= 0.99 * pairs


def test_components_are_the_same_in_one_exchange(spark):
    sets = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (F.col("id") / 7).cast("int") * 100 + i + F.when(i > 17, F.col("id") % 7).otherwise(0)).alias("items"))
    buckets = sets.select(F.explode(F.array((F.col("id") / 7).cast("long"), -1 - (F.col("id") % 3), 1000 + F.col("id"))).alias("bucket"), "id")
    found = []
    for one_exchange in (False, True):
        roots = similar_components(buckets, lambda ids: sets.join(ids, "id"), 0.8, one_exchange=one_exchange)
        found.append(sorted(tuple(r) for r in roots.collect()))
    assert found[0] == found[1] == [(i, i - i % 7) for i in range(300)]


def test_components_compare_small_buckets_at_once(spark):
    """Linked to each other but not to the least id of their bucket, and in groups on either side of both limits."""
    def items(i):
        base = F.when(i % 40 == 0, -1).otherwise((i % 40 - 1) / 3).cast("long")
        return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: ((i / 40).cast("long") * 100 + base) * 100 + k + F.when(k > 18, i % 3).otherwise(0))

    sets = spark.range(240).select("id", items(F.col("id")).alias("items"))
    sizes = F.element_at(F.array(*map(F.lit, (2, 3, 8, 9, 25, 40))), (F.col("id") / 40).cast("int") + 1)
    buckets = sets.filter(F.col("id") % 40 < sizes).select(F.explode(F.array((F.col("id") / 40).cast("long"), 1000 + F.col("id"))).alias("bucket"), "id")
    want = sorted(tuple(r) for r in similar_components(buckets, lambda ids: sets.join(ids, "id"), 0.8).collect())
    got = similar_components(buckets, lambda ids: sets.join(ids, "id"), 0.8, one_exchange=True, paired=8, crowd=24).collect()
    assert sorted(tuple(r) for r in got) == want
    assert {i: r for i, r in want} == {40 * g + k: 40 * g + 1 + (k - 1) // 3 * 3 for g, n in enumerate((2, 3, 8, 9, 25, 40)) for k in range(1, n) if n - 1 - (k - 1) // 3 * 3 > 1}


def test_line_dedup_signs_in_compiled_code(spark):
    """The JVM leaves methods above 8,000 bytes interpreted; 16 shingles side by side halve the rows that reach the minima."""
    rows = spark.createDataFrame([(1, "a line of text")], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as said:
            line_dedup.signed_lines(rows).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
    assert sizes and max(sizes) < 8000 and line_dedup.STEP >= 16
