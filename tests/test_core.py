"""Preparation, chains, regimes and models against pandas and brute force."""

import itertools
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from macrotide.functions.calendar import business_calendar
from macrotide.functions.steps import Diff, Ema, MovingAverage, PctChange, Returns, RollingStd, YoY, ZScore
from macrotide.operators import hmm, prepare
from macrotide.operators import regimes as R
from macrotide.plans import chains as C

RAW = "series_code string, date date, value double, series_name string, category string"


def raw(spark, rows):
    return spark.createDataFrame([(c, date.fromisoformat(d), v, c, "x") for c, d, v in rows], RAW)


def test_calendar_matches_pandas(spark):
    from pandas.tseries.holiday import USFederalHolidayCalendar

    mine = [r.date for r in business_calendar(spark, "2000-01-01", "2024-12-31").orderBy("date").collect()]
    free = USFederalHolidayCalendar().holidays("1999-12-01", "2025-01-31")
    theirs = [d.date() for d in pd.bdate_range("2000-01-01", "2024-12-31") if d not in free]
    assert mine == theirs and len(mine) == 6269


def test_weekend_collision_keeps_monday(spark):
    df = raw(spark, [("A", "2024-03-02", 1.0), ("A", "2024-03-03", 2.0), ("A", "2024-03-04", 3.0), ("A", "2024-03-05", 4.0)])
    assert [(r.date.day, r.value) for r in prepare.clean(df).orderBy("date").collect()] == [(4, 3.0), (5, 4.0)]


def test_alignment_drops_holiday_rows_and_carries_values(spark):
    df = raw(spark, [("A", "2024-01-01", 1.0), ("A", "2024-01-03", 2.0), ("A", "2024-01-05", 2.0)])
    calendar = business_calendar(spark, "2024-01-01", "2024-01-08")
    rows = prepare.align_calendar(prepare.annotate(prepare.clean(df)), calendar).orderBy("date").collect()
    assert [(r.date.day, r.value, r.is_new_data, r.days_since_update) for r in rows] == [(2, None, None, None), (3, 2.0, True, 0), (4, 2.0, None, 1), (5, 2.0, False, 2), (8, 2.0, None, 5)]
    asof = prepare.align_asof(prepare.clean(df), calendar).orderBy("date").collect()
    assert [r.value for r in asof] == [1.0, 2.0, 2.0, 2.0, 2.0]


def test_frequencies_and_types(spark):
    df = raw(spark, [("A", "2024-01-01", 1.0), *[("B", f"2024-01-{d:02}", 1.0) for d in (1, 2, 4)], *[("C", f"2024-{m:02}-01", 1.0) for m in range(1, 5)]])
    assert {r.series_code: r.native_freq for r in prepare.native_freq(df).collect()} == {"A": "unknown", "B": "daily", "C": "monthly"}
    odd = spark.createDataFrame([("A", "2024-01-02", "n/a"), ("A", "x", "NaN"), ("A", None, "3.5")], "series_code string, date string, value string")
    assert [(r.date, r.value) for r in prepare.coerce_types(odd).collect()] == [(date(2024, 1, 2), None), (None, None), (None, 3.5)]


def pandas_step(step, v):
    if isinstance(step, Diff):
        return v.diff(step.periods)
    if isinstance(step, PctChange | YoY):
        return v.pct_change(step.periods, fill_method=None)
    if isinstance(step, Returns):
        return np.log(v / v.shift(step.periods))
    if isinstance(step, Ema):
        return v.ewm(span=step.span).mean() if step.span else v.ewm(halflife=step.halflife).mean()
    r = v.replace([np.inf, -np.inf], np.nan).rolling(step.window)
    return {MovingAverage: r.mean, RollingStd: r.std}[type(step)]() if not isinstance(step, ZScore) else (v - r.mean()) / r.std().replace(0, np.nan)


@pytest.mark.parametrize("chain", [(Diff(2),), (PctChange(1),), (YoY(3),), (Returns("log"),), (MovingAverage(3),), (RollingStd(3),), (ZScore(4),), (Ema(span=3),), (Ema(halflife=2),), (MovingAverage(2), PctChange(1)), (PctChange(1), ZScore(3))])
def test_strict_chains_match_pandas(spark, chain):
    values = [5.0, 5.0, 0.0, 3.0, 3.0, 7.0, 7.0, 7.0, 2.0, 9.0, 4.0, 4.0, 6.0, 1.0]
    days = [date(2024, 1, 1) + timedelta(i) for i in range(len(values))]
    new = [i == 0 or values[i] != values[i - 1] for i in range(len(values))]
    df = spark.createDataFrame([("A", d, v, n) for d, v, n in zip(days, values, new, strict=True)], "series_code string, date date, value double, is_new_data boolean")
    got = [r.value for r in C.transform(df, [chain]).orderBy("date").collect()]
    v = pd.Series(values, index=days)
    for step in chain:
        v = pandas_step(step, v[new]).reindex(days).ffill() if True else v
    want = [None if x != x else x for x in v]
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (got, want)


def test_parser_names_and_errors():
    config = {"series": {"x": {"id": "ICSA", "frequency": "weekly", "transforms": [[{"ma": {"window": 4}}, {"pct": {"periods": 13}}, {"z-score": {"window": 50}}], ["level"]]}}}
    chains = C.parse_config(config)
    assert C.feature_names(chains) == ["ICSA_movingaverage_4_pctchange_13_zscore_50", "ICSA_level"]
    assert C.frequencies(config) == {"ICSA": "weekly"}
    for bad in ([], ["nope"], [{"ma": 3}], [{"a": None, "b": None}], [{"ma": {"window": 0}}]):
        with pytest.raises((ValueError, TypeError)):
            C.parse_chain(bad)
    with pytest.raises(ValueError):
        C.feature_names({"A": [(YoY(12),), (YoY(12, "diff"),)]})


def test_band_scores(spark):
    bands = spark.range(1).select(*(R.range_score(F.lit(float(x)), 20, 200, 0.5).alias(f"s{i}") for i, x in enumerate((20, 200, 245, 400, -25)))).first()
    assert list(bands) == [1.0, 1.0, 0.5, 0.0, 0.5]


def test_hmm_against_all_paths():
    rng = np.random.default_rng(1)
    x, params = rng.normal(size=(5, 2)), hmm.Params([0.6, 0.4], [[0.8, 0.2], [0.3, 0.7]], [[0, 0], [1, -1]], [np.eye(2).tolist(), [[1, 0.3], [0.3, 2]]])
    pi, a, means, covars = params.arrays()
    logb = hmm.log_emissions(x, means, covars)
    paths = list(itertools.product(range(2), repeat=5))
    score = [math.log(pi[p[0]]) + sum(math.log(a[i, j]) for i, j in itertools.pairwise(p)) + sum(logb[t, s] for t, s in enumerate(p)) for p in paths]
    weights = np.exp(np.array(score) - max(score))
    filtered, post, moves, total = hmm.smooth(logb, pi, a)
    assert math.isclose(total, math.log(weights.sum()) + max(score), rel_tol=1e-9)
    for t in range(5):
        want = sum(w for w, p in zip(weights, paths, strict=True) if p[t] == 0) / weights.sum()
        assert math.isclose(math.exp(post[t, 0]), want, rel_tol=1e-9)
    assert np.allclose(filtered[-1], post[-1]) and math.isclose(moves.sum(), 4)
    assert tuple(hmm.viterbi(logb, pi, a)) == paths[int(np.argmax(score))]
    _, history = hmm.fit(rng.normal(size=(200, 2)), params, n_iter=20, tol=-1)
    assert all(b >= a - 1e-2 for a, b in itertools.pairwise(history))


def test_stationary():
    a = hmm.transition_init(3, 0.9)
    assert np.allclose(hmm.stationary(a), 1 / 3) and hmm.transmat_sanity(a)["stationary_valid"]


def test_entry_imports_and_has_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "tx_zscore" in e.queries()
