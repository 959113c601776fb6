"""Edge cases of single operators: repeated rows, one very long line, columns with clashing names."""

import random

from macrotide.llm import chat, line_dedup, substring_dedup, token_counts
from macrotide.llm.queries import tokenizer

WORDS = " ".join(f"word{i % 53}x{i % 17}" for i in range(90))


def test_substring_dedup_of_repeated_rows(spark):
    rows = [(1, WORDS), (1, WORDS), (2, WORDS), (None, WORDS), (3, "short text"), (3, "short text")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    n = len(WORDS.split())
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, n, 0), (1, n, n), (1, n, n), (2, n, n), (3, 2, 0), (3, 2, 0)]
    same = substring_dedup.remove_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in same) == [0, n]  # of rows in one place, the one stored first keeps its words


def test_token_counts_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, WORDS)] * 3 + [(None, "a b"), (None, "a b"), (2, None), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in token_counts.counts(rows, tokenizer("piece_bpe_32k.model")).collect()]
    assert len(got) == 7 and len(set(got)) == 3


def test_line_dedup_of_very_long_lines(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    long = line(300_000)
    near = long[:150_000] + "CHANGED" + long[150_000:]
    rows = [(1, f"{long}\nfirst"), (2, near), (3, line(300_000)), (4, None)]
    got = {r.doc_id: r.n_removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_chats_with_clashing_columns(spark):
    turns = [(c, t, r, f"{c}-{t}") for c in range(3) for t, r in enumerate(["user", "user", "assistant", "system", "tool"])]
    plain = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    names = "conv_id long, turn long, role string, text string, block long, conv string, cost long, rendered string, action string"
    more = spark.createDataFrame([(*t, 1, "x", 2, "y", "z") for t in turns], names)
    want, got = (sorted(tuple(r) for r in chat.format_chats(x).collect()) for x in (plain, more))
    assert got == want and len(got) == 15


def test_chats_of_one_turn_number(spark):
    """Thousands of rows under one turn number, and without one, are cut into blocks whose repairs cost no more than an uncut one."""
    big = 2**62 + 1
    roles = ["user", "assistant", "tool", "system", None]
    rows = [(big, 7, roles[i % 5], f"t{i % 1500:04d}") for i in range(6000)] + [(None, None, roles[i % 2], f"n{i}") for i in range(3000)]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(2000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    price = {"keep": 0, "relabel": 2, "insert": 3, "insert_relabel": 5, "merge": 0}

    def cost(found):
        # a merge's price depends on the role before, which follows from the order of rows
        total, before = {}, {}
        for r in sorted(found, key=lambda r: (str(r.conv_id), r.turn if r.turn is not None else -1, r.role is not None, r.role or "", r.rendered_text)):
            now = price[r.action] + 3 * (r.n_inserted - r.action.startswith("insert"))
            if r.action == "merge":
                now = 1 if chat.role_of(r.role) == chat.role_of(before[r.conv_id]) and r.role else 3
            total[r.conv_id] = total.get(r.conv_id, 0) + now
            before[r.conv_id] = r.role_out
        return total

    results = []
    for block in (100_000, 64):
        out = chat.format_chats(turns, block).selectExpr("*", "regexp_extract(rendered, '([tn][0-9]+|x)(<.im_end.>|$)', 1) AS rendered_text").collect()
        assert len(out) == len(rows)
        results.append(cost(out))
    assert results[0] == results[1] and results[0][3] == 0 and set(results[0]) == {big, None, 3}
