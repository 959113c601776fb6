"""Scans along an order, inference on them, and statistics from sums, against plain Python, numpy and pandas."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from macrotide.functions.steps import Ema
from macrotide.operators import hmm, inference, moments, report, scan, transitions, validate
from macrotide.operators import regimes as R
from macrotide.plans import chains as C

DAY = dt.date(2000, 1, 1)


@pytest.fixture
def small(monkeypatch):
    """Blocks of four rows, so that every sequence crosses blocks and ranges."""
    monkeypatch.setattr(scan, "BLOCK", 4)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def labelled(spark, labels, parts=5):
    return spark.createDataFrame(list(zip(days(len(labels)), labels, strict=True)), "date date, regime int").repartition(parts)


def test_runs_and_moves(spark, small):
    rng = random.Random(1)
    labels = [rng.choice([0, 0, 1, 2, None]) for _ in range(90)]
    labels[30:60] = [1] * 30
    df = labelled(spark, labels)
    want, at = [], 0
    for k, g in itertools.groupby(labels):
        n = len(list(g))
        want.append((k, days(90)[at], days(90)[at + n - 1], n))
        at += n
    assert sorted(tuple(r) for r in R.runs(df).select("start", "regime", "end", "length").collect()) == sorted((s, k, e, n) for k, s, e, n in want)
    moves = [(a, b) for a, b in itertools.pairwise(labels) if a is not None and b is not None]
    assert {(r.regime, r.next): r.n for r in R.transition_counts(df).collect()} == {m: moves.count(m) for m in moves}
    keyed = spark.createDataFrame([(u, d, x) for u in ("a", None, "b") for d, x in enumerate("ppqqqp" if u else "pp")], "u string, date int, regime string")
    assert sorted((r.u or "", r.start, r.regime, r.length) for r in R.runs(keyed, ("u",)).collect()) == [("", 0, "p", 2), *[(u, s, k, n) for u in "ab" for s, k, n in ((0, "p", 2), (2, "q", 3), (5, "p", 1))]]
    assert R.runs(df.limit(0)).count() == 0 and R.transition_counts(df.limit(1)).count() == 0


def test_carried_previous_and_drawdown(spark, small):
    rng = random.Random(2)
    values = [rng.choice([None, None, 3, 4]) for _ in range(50)]
    df = labelled(spark, values)
    want = pd.Series([np.nan if v is None else v for v in values]).ffill()
    got = [r.regime for r in scan.carried(df, ["date"], "regime").orderBy("date").collect()]
    assert got == [None if x != x else int(x) for x in want]
    assert [r.b for r in scan.previous(df, ["date"], "regime", "b").orderBy("date").collect()] == [None, *values[:-1]]

    labels, px = [rng.randrange(3) for _ in range(120)], [100.0]
    for _ in range(119):
        px.append(px[-1] * (1 + rng.uniform(-0.1, 0.1)))
    prices = spark.createDataFrame(list(zip(days(120), px, strict=True)), "date date, px double").repartition(3)
    worst = {}
    for k in range(3):
        wealth = np.cumprod([px[i] / px[i - 1] for i in range(1, 120) if labels[i] == k])
        worst[k] = float((wealth / np.maximum.accumulate(wealth) - 1).min())
    assert {r.regime: r.max_drawdown for r in R.drawdown_by_regime(prices, labelled(spark, labels)).collect()} == pytest.approx(worst)


def test_ranks(spark, small):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 60).astype(float), rng.normal(size=60)
    x[::7], y[5] = np.nan, np.nan
    none = lambda v: None if v != v else float(v)
    df = spark.createDataFrame([(f"m{i}", none(a), none(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "model_id string, x double, y double")
    got = {r.model_id: r for r in R.pct_ranks(df, "model_id", {"up": ("x", False), "down": ("y", True), "down_x": ("x", True)}).collect()}
    want = {"up": pd.Series(x).rank(pct=True), "down": pd.Series(y).rank(pct=True, ascending=False), "down_x": pd.Series(x).rank(pct=True, ascending=False)}
    for name, ranks in want.items():
        assert [got[f"m{i}"][name] for i in range(60)] == [None if v != v else pytest.approx(v) for v in ranks]


@pytest.mark.parametrize("step", [Ema(span=3), Ema(halflife=2), Ema(span=200)])
def test_exponential_mean(spark, small, step):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s, n in (("A", 70), ("B", 3), ("C", 1)):
        v = pd.Series(rng.normal(1e5, 1e4, n))
        v[v.index % 5 == 0] = np.nan
        rows += [(s, d, None if x != x else x) for d, x in zip(days(n), v, strict=True)]
        mean = v.ewm(span=step.span).mean() if step.span else v.ewm(halflife=step.halflife).mean()
        want |= {(s, d): None if x != x else pytest.approx(x, rel=1e-12) for d, x in zip(days(n), mean, strict=True)}
    df = spark.createDataFrame(rows, "series_code string, date date, value double").repartition(4)
    assert {(r.series_code, r.date): r.value for r in C.transform(df, [(step,)], C.IGNORE).collect()} == want


def model(k, d, seed):
    rng = np.random.default_rng(seed)
    pi, a = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k)
    if k > 2:
        a[0, 1] = 0  # an impossible move
        a[0] /= a[0].sum()
    half = rng.normal(size=(k, d, d))
    return hmm.Params(pi.tolist(), a.tolist(), rng.normal(size=(k, d)).tolist(), (half @ half.transpose(0, 2, 1) + np.eye(d)).tolist())


@pytest.mark.parametrize(("k", "d"), [(1, 1), (2, 1), (3, 2)])
def test_inference_of_sequences(spark, small, k, d):
    params, rng = model(k, d, 7), np.random.default_rng(8)
    names, rows, sequences = [f"x {i}" for i in range(d)], [], {}
    for entity, n in (("a", 41), (None, 9), ("one", 1)):
        x = rng.normal(size=(n, d)) * 2
        sequences[entity] = x
        rows += [(entity, day, *map(float, v)) for day, v in zip(days(n), x, strict=True)]
    rows += [("a", DAY + dt.timedelta(500), *[None] * d), ("only nulls", DAY, *[None] * d)]
    wide = spark.createDataFrame(rows, "entity string, date date, " + ", ".join(f"`{n}` double" for n in names)).repartition(3)
    seen = inference.observed(wide, names, params, "entity")
    pi, a, means, covars = params.arrays()
    want = {}
    for entity, x in sequences.items():
        logb = hmm.log_emissions(x, means, covars)
        f, post, _, total = hmm.smooth(logb, pi, a)
        want[entity] = (np.exp(f), np.exp(post), hmm.viterbi(logb, pi, a), total)
    both, path = inference.smooth(seen, params).collect(), inference.best_path(seen, params).collect()
    only, ahead = inference.filtered(seen, params).collect(), inference.forecast(seen, params, 4).collect()
    assert len(both) == len(path) == len(only) == 51
    for r, s, o, q in zip(*(sorted(x, key=lambda r: (r.entity or "", r.date)) for x in (both, path, only, ahead)), strict=True):
        f, post, states, _ = want[r.entity]
        t = (r.date - DAY).days
        assert r.filtered == pytest.approx(f[t], abs=1e-9) and o.filtered == pytest.approx(f[t], abs=1e-9) and r.smoothed == pytest.approx(post[t], abs=1e-9)
        assert s.state == states[t] and q.forecast == pytest.approx(f[t] @ np.linalg.matrix_power(a, 4), abs=1e-9)
    scores = {r.entity: (r.n_rows, r.log_likelihood) for r in inference.score(seen, params).collect()}
    assert scores == {e: (len(sequences[e]), pytest.approx(want[e][3], rel=1e-9)) for e in sequences}
    none = seen.limit(0)
    assert inference.smooth(none, params).count() == inference.best_path(none, params).count() == inference.score(none, params).count() == 0


def test_fit_over_blocks_equals_the_fit_of_one_task(spark, small):
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(c, 1, size=(30, 2)) for c in (0, 4, 0, 4)]) + 1000
    wide = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days(120), x, strict=True)] + [(DAY + dt.timedelta(400), None, 1.0)], "date date, a double, b double").repartition(3)
    start = hmm.Params([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [[1000.5, 1000.0], [1003.0, 1003.5]], [np.eye(2).tolist()] * 2)
    for diagonal in (False, True):
        want, seen = hmm.fit(x, start, n_iter=3, tol=-1, diag=diagonal)
        got, history = inference.fit(wide, ["a", "b"], start, n_iter=3, tol=-1, diagonal=diagonal)
        assert history == pytest.approx(seen, rel=1e-9)
        for mine, theirs in zip(got.arrays(), want.arrays(), strict=True):
            assert np.allclose(mine, theirs, rtol=1e-7, atol=1e-9)
    with pytest.raises(ValueError, match="no row"):
        inference.fit(wide.limit(0), ["a", "b"], start)


def test_one_long_sequence_is_many_blocks(spark):
    params = model(2, 1, 3)
    x = np.random.default_rng(1).normal(size=20_000)
    wide = spark.createDataFrame(pd.DataFrame({"date": np.arange(20_000), "x": x}))
    seen = inference.observed(wide, ["x"], params)
    cut = scan.blocks(seen, ["date"], ["entity"])
    sizes = cut.select(F.size("_rows").alias("n"), "_range").collect()
    assert max(r.n for r in sizes) <= scan.BLOCK and len({r["_range"] for r in sizes}) > 1 and len(sizes) >= 20
    logb = hmm.log_emissions(x[:, None], *params.arrays()[2:])
    f, total = hmm.forward(logb, *params.arrays()[:2])
    got = {r.date: r.filtered for r in inference.filtered(seen, params).collect()}
    assert np.allclose([got[t] for t in range(20_000)], np.exp(f), atol=1e-9)
    assert inference.score(seen, params).first().log_likelihood == pytest.approx(total, rel=1e-10)
    assert [r.state for r in inference.best_path(seen, params).orderBy("date").collect()] == hmm.viterbi(logb, *params.arrays()[:2]).tolist()


def test_separation_of_regimes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 3)) + 1000
    p = rng.dirichlet(np.ones(3), 80)
    wide = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(days(80), x, strict=True)] + [(DAY + dt.timedelta(99), None, 1.0, 1.0)], "date date, a double, `b c` double, z double")
    proba = spark.createDataFrame([(d, v.tolist()) for d, v in zip(days(80), p, strict=True)], "date date, proba array<double>")
    assert moments.macro_coherence(wide, ["a", "b c", "z"], proba).first().asDict() == pytest.approx(hmm.macro_coherence(x, p), rel=1e-6)
    got = {(r.a, r.b): (r.n, r.xy, r.xxyy) for r in moments.gram(wide, ["a", "b c", "z"]).collect()}
    c = x - x.mean(0)
    assert len(got) == 6 and got["a", "z"] == (80, pytest.approx((c[:, 0] * c[:, 2]).sum()), pytest.approx((c[:, 0] ** 2 * c[:, 2] ** 2).sum()))
    assert moments.macro_coherence(wide.limit(0), ["a", "z"], proba).first().maha_min is None


def brute_unit_root(x):
    """The test by whole design matrices."""
    n = len(x)
    most, d = moments.most_lags(n), np.diff(x)

    def fit(lags, start):
        y = d[start:]
        z = np.column_stack([x[start:-1], np.ones(len(y)), *(d[start - j : len(d) - j] for j in range(1, lags + 1))])
        b, *_ = np.linalg.lstsq(z, y, rcond=None)
        return y, z, b, ((y - z @ b) ** 2).sum()

    def aic(k):
        y, z, _, rest = fit(k, most)
        return len(y) * math.log(rest / len(y)) + 2 * z.shape[1]

    best = min(range(most + 1), key=aic)
    y, z, b, rest = fit(best, best)
    return b[0] / math.sqrt(rest / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0]), best


def test_unit_roots(spark):
    rng = np.random.default_rng(6)
    series = {"noise": rng.normal(size=300), "walk": 1e5 + np.cumsum(rng.normal(size=400)), "short": rng.normal(size=49), "least": rng.normal(size=50), "slow": np.zeros(250)}
    for t in range(2, 250):
        series["slow"][t] = 1.2 * series["slow"][t - 1] - 0.35 * series["slow"][t - 2] + rng.normal()
    rows = [(k, d, float(v)) for k, x in series.items() for d, v in zip(days(len(x)), x, strict=True)]
    rows += [("noise", DAY - dt.timedelta(1), None), ("noise", DAY - dt.timedelta(2), float("inf"))]
    df = spark.createDataFrame(rows, "feature string, date date, value double").repartition(4)
    got = {r.feature: r for r in moments.unit_roots(df).collect()}
    assert set(got) == set(series) - {"short"}
    for k, r in got.items():
        statistic, lags = brute_unit_root(series[k])
        assert (r.n, r.lags, r.statistic) == (len(series[k]), lags, pytest.approx(statistic, rel=1e-6))
    assert got["noise"].stationary and got["slow"].stationary and not got["walk"].stationary
    assert moments.p_value(3.0) == 1 and moments.p_value(-20.0) == 0 and 0.04 < moments.p_value(-2.86) < 0.06
    assert moments.unit_roots(df.limit(0)).count() == 0


def test_start_of_emissions(spark):
    rng = np.random.default_rng(9)
    parts = [rng.normal(c, 0.5, size=(60, 2)) for c in (-5, 0, 5)]
    wide = spark.createDataFrame([tuple(map(float, v)) for v in np.vstack(parts)] + [(None, 1.0)], "a double, b double")
    means, covars = moments.emission_start(wide, ["a", "b"], 3)
    for k, x in enumerate(parts):  # clusters come in order of their centres
        assert means[k] == pytest.approx(x.mean(0)) and np.allclose(covars[k], np.cov(x.T))
    flat = spark.createDataFrame([(1.0, 2.0)] * 5 + [(9.0, 9.0)], "a double, b double")
    _, covars = moments.emission_start(flat, ["a", "b"], 2, diagonal=True)
    assert np.allclose(covars, 1e-6 * np.eye(2))
    assert moments.emissions(wide, ["a", "b"], 3).count() == 12


def test_sanity_of_transitions(spark):
    rng = np.random.default_rng(10)
    held = {f"m{k}": rng.dirichlet(np.ones(k), k) for k in (2, 3, 5)} | {"cycle": np.array([[0, 1.0], [1, 0]]), "one": np.ones((1, 1))}
    rows = [(m, i, j, float(a[i, j])) for m, a in held.items() for i in range(len(a)) for j in range(len(a)) if a[i, j]]
    got = {r.model: r for r in transitions.sanity(transitions.matrices(spark.createDataFrame(rows, "model string, regime int, next int, share double"), "model")).collect()}
    for m, a in held.items():
        want = hmm.transmat_sanity(a)
        want["tv_20"] = want.pop("tv_distance")
        assert {k: getattr(got[m], k) for k in want} == pytest.approx(want, rel=1e-6, abs=1e-7)
    stuck = transitions.matrices(spark.createDataFrame([(0, 1, 1.0)], "regime int, next int, share double")).first()
    assert stuck.a == [[0.0, 1.0], [0.0, 1.0]]


def test_jumps_between_values(spark):
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=250) * 0.01)
    x[::100] += 50
    rows = [("holes", d, None) for d in days(300)] + [("holes", DAY + dt.timedelta(300 + i), float(v)) for i, v in enumerate(x)] + [("short", d, float(i % 2 * 100)) for i, d in enumerate(days(60))] + [("flat", d, 1.0) for d in days(150)]
    got = {r.feature: r for r in validate.jumps(spark.createDataFrame(rows, "feature string, date date, value double")).collect()}
    d = pd.Series(x).diff().abs()
    far = int((d > d.mean() + 5 * d.std()).sum())
    assert set(got) == {"holes", "flat"} and (got["holes"].jumps, got["holes"].share) == (far, pytest.approx(far / 250)) and far > 2 and got["holes"].failed
    assert got["flat"].jumps == 0 and not got["flat"].failed


def test_one_result_per_check(spark):
    calendar = spark.createDataFrame([(d,) for d in days(130)], "date date")
    rng = np.random.default_rng(12)
    z = rng.normal(size=130)
    rows = [(d, float(v), float(2 * v), float(i // 4), None if i < 40 else 1.0, float(11 + i % 2)) for i, (d, v) in enumerate(zip(days(130), z, strict=True))]
    names = ["VIXCLS_zscore_63", "DGS2_level", "NFCI_level", "CFNAI_level", "OTHER_level"]
    wide = spark.createDataFrame(rows[:50] + [rows[51], rows[50], *rows[52:]], "date date, " + ", ".join(f"{n} double" for n in names)).coalesce(1)
    long = wide.unpivot(["date"], names, "feature", "value")
    roots = spark.createDataFrame([("a", False), ("b", True)], "feature string, stationary boolean")
    got = [(r.check, r.severity, r.problems) for r in report.feature_checks(long, wide, names, calendar, None, roots).collect()]
    assert got == [
        ("index_type", "info", 0), ("duplicate_dates", "info", 0), ("sorted_dates", "warning", 1), ("calendar", "info", 0), ("missing", "error", 1), ("burn_in", "info", 0), ("zscore", "info", 0),
        ("outliers", "warning", 130 + sum(i // 4 > 10 for i in range(130))), ("weekly_changes", "info", 0), ("daily_changes", "info", 0), ("variance", "warning", 1), ("jumps", "info", 0), ("correlation", "warning", 1), ("stationarity", "warning", 1),
    ]
