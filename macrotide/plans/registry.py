"""The registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import Diff, Ema, Level, MovingAverage, PctChange, Returns, RollingStd, YoY, ZScore
from ..operators import hmm, inference, moments, prepare, transitions, validate
from ..operators import regimes as R
from . import fixtures as X
from .chains import IGNORE, STRICT, feature_matrix, transform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, minus zero as zero, NaN as null; whole numbers as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def add(name: str, query: Query, sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if sql:
        ORACLE_SQL[name] = sql


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


big = "CAST({} AS BIGINT)".format

# preparation
_ROW = "series_code, date, value, series_name, category"
add("select_series", lambda s, d: prepare.select_series(X.macro_raw(s, d), ["ORD1", "LIWA"]), X.with_views(f"SELECT {_ROW} FROM raw WHERE series_code IN ('ORD1', 'LIWA')", "raw"))
add("coerce_types", lambda s, d: prepare.coerce_types(X.macro_raw(s, d).withColumn("value", F.when(F.weekday("date") == 1, "n/a").otherwise(F.col("value").cast("string")))),
    X.with_views("SELECT series_code, date, CASE WHEN isodow(date) <> 2 THEN value END AS value, series_name, category FROM raw", "raw"))
add("roll_weekend", lambda s, d: prepare.roll_weekend(X.macro_raw(s, d)), X.with_views("SELECT series_code, rd AS date, value, series_name, category FROM rolled", "rolled"))
add("dedup_last", lambda s, d: prepare.dedup_last(X.macro_raw(s, d)), X.with_views(f"SELECT {_ROW} FROM clean", "clean"))
add("staleness_flags", lambda s, d: prepare.staleness_flags(X.cleaned(s, d)), X.with_views(f"SELECT {_ROW}, is_new_data, obs_number FROM stale", "stale"))
add("native_freq", lambda s, d: prepare.native_freq(X.cleaned(s, d)), X.with_views("SELECT * FROM freq", "freq"))
add("business_calendar", X.calendar, X.with_views("SELECT date FROM cal", "cal"))
add("align_calendar", X.aligned, X.with_views("SELECT * FROM aligned", "aligned"))
add("days_since_update", lambda s, d: X.aligned(s, d).select("series_code", "date", "days_since_update"), X.with_views("SELECT series_code, date, days_since_update FROM aligned", "aligned"))
add("align_nulls", lambda s, d: X.aligned(s, d).groupBy("series_code").agg(F.count_if(F.col("value").isNull()).alias("nulls")), X.with_views("SELECT series_code, count(*) FILTER (value IS NULL) AS nulls FROM aligned GROUP BY 1", "aligned"))
add("align_asof", lambda s, d: prepare.align_asof(X.cleaned(s, d), X.calendar(s, d)),
    X.with_views("SELECT k.series_code, k.date, c.value, c.series_name, c.category FROM (SELECT s.series_code, cal.date FROM (SELECT DISTINCT series_code FROM clean) s, cal) k ASOF LEFT JOIN clean c ON k.series_code = c.series_code AND k.date >= c.date", "clean", "cal"))
add("trim_common_start", X.processed, X.with_views("SELECT * FROM proc", "proc"))
add("days_per_year", lambda s, d: X.aligned(s, d).groupBy(F.year("date").alias("year")).agg((F.count("*") / F.countDistinct("series_code")).alias("days")), X.with_views("SELECT CAST(year(date) AS BIGINT) AS year, count(*) / count(DISTINCT series_code) AS days FROM aligned GROUP BY 1", "aligned"))

# steps and chains, over all series
for _name, _chain in {
    "tx_level": (Level(),), "tx_diff": (Diff(5),), "tx_pct_change": (PctChange(1),), "tx_yoy": (YoY(252),), "tx_yoy_diff": (YoY(12, "diff"),), "tx_returns_log": (Returns("log"),), "tx_returns_simple": (Returns("simple"),),
    "tx_moving_average": (MovingAverage(20),), "tx_rolling_std": (RollingStd(21),), "tx_zscore": (ZScore(63),), "tx_chain_ma_pct": (MovingAverage(20), PctChange(5)), "tx_chain_pct_std_zscore": (PctChange(1), RollingStd(21), ZScore(63)),
    "tx_chain_yoy_diff": (YoY(12), Diff(1)),
}.items():
    add(_name, lambda s, d, c=_chain: transform(X.processed(s, d), [c], STRICT).select("series_code", "date", "value"), X.with_views(f"SELECT series_code, date, {r('value')} AS value FROM ({X.chain_sql(_chain)})", "proc"))
add("tx_zscore_ignore", lambda s, d: transform(X.processed(s, d), [(ZScore(63),)], IGNORE).select("series_code", "date", F.col("value")), X.with_views(f"SELECT series_code, date, {r('value')} AS value FROM ({X.chain_sql((ZScore(63),), strict=False)})", "proc"))
for _name, _step in {"tx_ema_span": Ema(span=10), "tx_ema_halflife": Ema(halflife=5)}.items():
    _keep = 1 - _step.alpha()
    _ema = f"""
      SELECT a.series_code, a.date, sum(pow({_keep!r}, a.i - b.i) * b.v) / sum(pow({_keep!r}, a.i - b.i)) AS v FROM o a JOIN o b ON a.series_code = b.series_code AND b.i <= a.i GROUP BY 1, 2"""
    add(_name, lambda s, d, c=_step: transform(X.processed(s, d), [(c,)], STRICT).select("series_code", "date", "value"),
        X.with_views(f"SELECT series_code, date, {r(f'last_value(v IGNORE NULLS) OVER {X._U}', 5)} AS value FROM (SELECT series_code, date FROM proc) LEFT JOIN ({_ema}) USING (series_code, date)", "proc",
                     extra={"o": "SELECT series_code, date, value AS v, row_number() OVER (PARTITION BY series_code ORDER BY date) AS i FROM proc WHERE is_new_data"}), digits=5)

# features
_PIVOT = ", ".join(f"{r(f"any_value(value) FILTER (feature = '{n}')")} AS \"{n}\"" for n in X.NAMES)
add("feature_long", X.features, X.with_views(f"SELECT date, feature, {r('value')} AS value FROM feat", "feat"))
add("feature_matrix", X.wide, X.with_views(f"SELECT date, {_PIVOT} FROM feat GROUP BY date", "feat"))
add("drop_burn_in", lambda s, d: X.wide(s, d).dropna("any", subset=X.NAMES),
    X.with_views(f"SELECT * EXCLUDE n FROM (SELECT date, {_PIVOT}, count(value) AS n FROM feat GROUP BY date) WHERE n = {len(X.NAMES)}", "feat"))
add("top_features", lambda s, d: X.wide(s, d).select("date", *X.NAMES[:5]), X.with_views(f"SELECT date, {', '.join(chr(34) + n + chr(34) for n in X.NAMES[:5])} FROM (SELECT date, {_PIVOT} FROM feat GROUP BY date)", "feat"))
_META = f"""SELECT feature, split_part(feature, '_', 1) AS indicator, substr(feature, strpos(feature, '_') + 1) AS transforms, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std,
  {r('100 * avg(CAST(value IS NULL AS INT))')} AS missing_pct, count(*) FILTER (abs(value) > 5) AS n_outliers, any_value(native_freq) AS frequency FROM feat JOIN freq ON series_code = split_part(feature, '_', 1) GROUP BY feature"""
add("feature_metadata", lambda s, d: validate.feature_metadata(X.features(s, d), prepare.native_freq(X.cleaned(s, d))), X.with_views(_META, "feat", "freq"))
add("feature_groups", lambda s, d: prepare.feature_groups(X.features(s, d).select("feature").distinct(), X.macro_raw(s, d).select("series_code", "category").distinct(), ("LIMO",)),
    X.with_views("SELECT feature, CASE WHEN split_part(feature, '_', 1) = 'LIMO' THEN 'stress' ELSE coalesce(category, 'unknown') END AS \"group\" FROM (SELECT DISTINCT feature FROM feat) LEFT JOIN (SELECT series_code, max(category) AS category FROM raw GROUP BY 1) ON split_part(feature, '_', 1) = series_code", "feat"))
add("is_oos_split", lambda s, d: X.features(s, d).groupBy("feature", (F.col("date") <= F.lit("1999-12-31").cast("date")).alias("in_sample")).agg(F.count("value").alias("n")), X.with_views("SELECT feature, date <= DATE '1999-12-31' AS in_sample, count(value) AS n FROM feat GROUP BY 1, 2", "feat"))
add("standard_scale", lambda s, d: R.standard_scale(X.features(s, d), "1999-12-31"),
    X.with_views(f"SELECT date, feature, {r('(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value FROM feat JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM feat WHERE date <= DATE '1999-12-31' GROUP BY 1) USING (feature)", "feat"))

# validation
add("null_counts", lambda s, d: validate.null_counts(X.aligned(s, d).select("series_code", "date", "value", "is_new_data", "days_since_update")),
    X.with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM aligned" for c in ("series_code", "date", "value", "is_new_data", "days_since_update")), "aligned"))
add("duplicate_keys", lambda s, d: validate.duplicate_keys(prepare.roll_weekend(X.macro_raw(s, d))), X.with_views(f"SELECT {big('sum(n - 1)')} AS duplicates FROM (SELECT count(*) AS n FROM rolled GROUP BY series_code, rd)", "rolled"))
add("value_stats", lambda s, d: validate.value_stats(X.macro_raw(s, d)), X.with_views(f"SELECT count(value) AS n, count(*) FILTER (isinf(value)) AS infinite, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS low, {r('max(value)')} AS high, {r('median(value)')} AS median FROM raw", "raw"))
add("series_details", lambda s, d: validate.series_details(X.aligned(s, d)), X.with_views("SELECT series_code, count(value) AS observations, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (value IS NULL) AS nulls, min(value) AS low, max(value) AS high, count(*) FILTER (is_new_data) AS new_points FROM aligned GROUP BY 1", "aligned"))
_OUT = "SELECT series_code, max(s) AS std, count(*) FILTER (s > 0 AND abs(value - m) > 5 * s) AS outliers, max(s) = 0 AS zero_variance FROM clean JOIN (SELECT series_code, avg(value) AS m, stddev_samp(value) AS s FROM clean GROUP BY 1) USING (series_code) GROUP BY 1"
add("series_outliers", lambda s, d: validate.series_outliers(X.cleaned(s, d)), X.with_views(f"SELECT series_code, {r('std')} AS std, outliers, zero_variance FROM ({_OUT})", "clean"))
add("staleness_summary", lambda s, d: validate.staleness_summary(X.processed(s, d)), X.with_views("SELECT series_code, count(*) FILTER (is_new_data) AS new_rows, count(*) FILTER (NOT coalesce(is_new_data, FALSE)) AS carried_rows, max(days_since_update) AS max_days, count(*) FILTER (days_since_update < 0) AS negative_days FROM proc GROUP BY 1", "proc"))
_GAPS = "SELECT date, 'missing' AS problem FROM cal ANTI JOIN (SELECT DISTINCT date FROM clean) c USING (date) UNION ALL SELECT date, 'unexpected' FROM (SELECT DISTINCT date FROM clean) c ANTI JOIN cal USING (date)"
add("calendar_gaps", lambda s, d: validate.calendar_gaps(X.cleaned(s, d), X.calendar(s, d)), X.with_views(_GAPS, "clean", "cal"))


def _expected(s, d):
    return X.table(s, d, "orders").select(F.concat(F.lit("ORD"), F.substring("o_orderpriority", 1, 1)).alias("series_code")).distinct().unionByName(X.table(s, d, "region").select(F.concat(F.lit("REG"), "r_regionkey").alias("series_code")))


_EXPECTED = "SELECT DISTINCT 'ORD' || substr(o_orderpriority, 1, 1) AS series_code FROM orders UNION ALL SELECT 'REG' || r_regionkey FROM region"
_COVER = "SELECT series_code, 'missing' AS problem FROM e ANTI JOIN (SELECT DISTINCT series_code FROM raw) c USING (series_code) UNION ALL SELECT series_code, 'unexpected' FROM (SELECT DISTINCT series_code FROM raw) c ANTI JOIN e USING (series_code)"
add("series_coverage", lambda s, d: validate.series_coverage(X.macro_raw(s, d), _expected(s, d)), X.with_views(_COVER, "raw", extra={"e": _EXPECTED}))
add("validation_summary", lambda s, d: validate.validation_summary(X.cleaned(s, d), _expected(s, d), X.calendar(s, d)),
    X.with_views(f"""SELECT "check", severity, {big('problems')} AS problems FROM (
      SELECT 'critical_nulls' AS "check", 'error' AS severity, count(*) FILTER (series_code IS NULL OR date IS NULL OR value IS NULL) AS problems FROM clean
      UNION ALL SELECT 'duplicate_keys', 'error', coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM clean GROUP BY series_code, date)
      UNION ALL SELECT 'infinite_values', 'error', count(*) FILTER (isinf(value)) FROM clean
      UNION ALL SELECT 'series_coverage', 'warning', count(*) FROM ({_COVER})
      UNION ALL SELECT 'calendar_gaps', 'warning', count(*) FROM ({_GAPS})
      UNION ALL SELECT 'outliers', 'warning', sum(outliers) FROM ({_OUT})
      UNION ALL SELECT 'zero_variance', 'warning', count(*) FILTER (zero_variance) FROM ({_OUT}))""", "clean", "cal", extra={"e": _EXPECTED}))
add("fv_index", lambda s, d: validate.index_check(X.wide(s, d), X.calendar(s, d)),
    X.with_views("SELECT count(*) AS n_rows, count(*) - count(DISTINCT date) AS duplicate_dates, (SELECT count(*) FROM cal ANTI JOIN feat USING (date)) AS missing_dates, (SELECT count(DISTINCT date) FROM feat ANTI JOIN cal USING (date)) AS unexpected_dates FROM (SELECT date FROM feat GROUP BY date)", "feat"))
add("fv_missing", lambda s, d: validate.missing_share(X.features(s, d)), X.with_views(f"SELECT feature, {r('100 * avg(CAST(value IS NULL AS INT))')} AS missing_pct, 100 * avg(CAST(value IS NULL AS INT)) > 20 AS failed FROM feat GROUP BY 1", "feat"))
add("fv_zscore", lambda s, d: validate.zscore_shape(X.features(s, d)), X.with_views(f"SELECT feature, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, abs(avg(value)) > 0.5 OR abs(stddev_samp(value) - 1) > 0.5 AS failed FROM feat WHERE feature LIKE '%zscore%' AND value IS NOT NULL GROUP BY 1 HAVING count(*) >= 100", "feat"))
add("fv_outliers", lambda s, d: validate.extreme_values(X.features(s, d)), X.with_views(f"SELECT feature, count(*) FILTER (abs(value) > 10) AS extreme, {r('max(abs(value))')} AS largest FROM feat GROUP BY 1", "feat"))
_RATE = "SELECT feature, avg(CAST(b IS NULL OR b <> value AS INT)) AS rate FROM (SELECT feature, value, lag(value) OVER (PARTITION BY feature ORDER BY date) AS b FROM feat WHERE value IS NOT NULL) GROUP BY 1"
_JUDGED = f"({_RATE} HAVING count(*) >= 100)"
add("change_rate", lambda s, d: validate.change_rate(X.features(s, d)), X.with_views(f"SELECT feature, {r('rate')} AS rate FROM ({_RATE})", "feat"))
add("fv_change_rate", lambda s, d: validate.change_rate_check(X.features(s, d), prepare.native_freq(X.cleaned(s, d))),
    X.with_views(f"""SELECT feature, native_freq AS frequency, {r('rate')} AS rate, CASE WHEN NOT (CASE native_freq WHEN 'monthly' THEN rate > 0.15 WHEN 'weekly' THEN rate < 0.10 OR rate > 0.35 ELSE rate < 0.5 END) THEN 'info' WHEN native_freq = 'monthly' THEN 'error' ELSE 'warning' END AS severity
      FROM {_JUDGED} JOIN freq ON split_part(feature, '_', 1) = series_code""", "feat", "freq"))
add("fv_variance", lambda s, d: validate.low_variance(X.features(s, d)), X.with_views(f"SELECT feature, {r('var_samp(value)')} AS variance, var_samp(value) < 0.01 AS failed FROM feat GROUP BY 1", "feat"))
#: Changes between the values of a feature, missing ones left out, with the limit beyond which one is a jump.
_JUMP = """
  SELECT feature, d, avg(d) OVER f + 5 * stddev_samp(d) OVER f AS lim
  FROM (SELECT feature, abs(value - lag(value) OVER (PARTITION BY feature ORDER BY date)) AS d FROM feat WHERE value IS NOT NULL) WINDOW f AS (PARTITION BY feature)"""
_JUMPS = f"SELECT feature, count(*) FILTER (d > lim) AS jumps, count(*) FILTER (d > lim) / count(*) AS share FROM ({_JUMP}) GROUP BY feature HAVING count(*) >= 100"
add("fv_jumps", lambda s, d: validate.jumps(X.features(s, d)), X.with_views(f"SELECT feature, jumps, {r('share')} AS share, share > 0.01 AS failed FROM ({_JUMPS})", "feat"))
add("temporal_jumps", QUERIES["fv_jumps"], ORACLE_SQL["fv_jumps"])
_CORR = "SELECT x.feature AS a, y.feature AS b, corr(x.value, y.value) AS corr FROM feat x JOIN feat y ON x.date = y.date AND x.feature < y.feature GROUP BY 1, 2"
add("feature_correlations", lambda s, d: validate.correlations(X.wide(s, d), X.NAMES), X.with_views(f"SELECT a, b, {r('corr')} AS corr FROM ({_CORR}) WHERE abs(corr) > 0", "feat"))
add("adf_test", lambda s, d: moments.unit_roots(X.features(s, d)))
_STEP = "SELECT feature, value - lag(value) OVER w AS dy, lag(value) OVER w AS x FROM feat WHERE value IS NOT NULL AND NOT isinf(value) WINDOW w AS (PARTITION BY feature ORDER BY date)"
_SLOPE = f"SELECT feature, count(*) AS k, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) - regr_slope(dy, x) * regr_sxy(dy, x) AS rest FROM ({_STEP}) WHERE x IS NOT NULL GROUP BY feature HAVING count(*) >= 49"
add("unit_root_no_lags", lambda s, d: moments.unit_roots(X.features(s, d), lags=0).select("feature", "n", "statistic"), X.with_views(f"SELECT feature, k + 1 AS n, {r('b / sqrt(rest / (k - 2) / sxx)')} AS statistic FROM ({_SLOPE})", "feat"))

# regimes
_ISL = "SELECT regime, min(date) AS s, max(date) AS e, count(*) AS n FROM (SELECT date, regime, sum(c) OVER (ORDER BY date) AS i FROM (SELECT date, regime, CAST(lag(regime) OVER (ORDER BY date) IS DISTINCT FROM regime AS INT) AS c FROM regimes)) GROUP BY regime, i"
_SHARE = "SELECT regime, count(*) AS n, count(*) / (SELECT count(*) FROM regimes) AS share FROM regimes GROUP BY 1"
add("regime_shares", lambda s, d: R.regime_shares(X.regimes(s, d)), X.with_views(f"SELECT {big('regime')} AS regime, n, {r('share')} AS share FROM ({_SHARE})", "regimes"))
add("regime_stability", lambda s, d: R.regime_stability(X.regimes(s, d)),
    X.with_views(f"SELECT {r('avg(n)')} AS mean_run, {r('stddev_pop(n)')} AS std_run, count(*) - 1 AS n_transitions, (SELECT {r('min(share)')} FROM ({_SHARE})) AS min_share, (SELECT {r('max(share)')} FROM ({_SHARE})) AS max_share, (SELECT {r('-sum(share * log2(share))')} FROM ({_SHARE})) AS entropy FROM ({_ISL})", "regimes"))
add("regime_periods", lambda s, d: R.regime_periods(X.regimes(s, d), 5), X.with_views(f"SELECT {big('regime')} AS regime, s AS start, e AS \"end\", e - s AS days FROM ({_ISL}) WHERE e - s >= 5", "regimes"))
_UISL = "SELECT user_id, regime, min(date) AS start, max(date) AS \"end\", count(*) AS length FROM (SELECT user_id, date, regime, sum(c) OVER (PARTITION BY user_id ORDER BY date) AS i FROM (SELECT *, CAST(lag(regime) OVER (PARTITION BY user_id ORDER BY date) IS DISTINCT FROM regime AS INT) AS c FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS date, event_type AS regime FROM events))) GROUP BY user_id, regime, i"
add("entity_runs", lambda s, d: R.runs(X.event_runs(s, d), ("user_id",)), _UISL)
add("entropy_balance", lambda s, d: R.entropy_balance(X.proba(s, d)), X.with_views(f"SELECT {r('avg(h)')} AS mean_entropy, {r('stddev_pop(h)')} AS std_entropy FROM (SELECT date, -sum(p * log2(p)) AS h FROM proba GROUP BY 1)", "proba"))
add("argmax_regime", lambda s, d: R.argmax_regime(X.proba(s, d)), X.with_views(f"SELECT date, {big('k')} AS regime FROM (SELECT date, k, row_number() OVER (PARTITION BY date ORDER BY p DESC, k) AS i FROM proba) WHERE i = 1", "proba"))
add("low_confidence", lambda s, d: R.low_confidence(X.proba(s, d), 0.4), X.with_views(f"SELECT date, {r('max(p)')} AS confidence FROM proba GROUP BY 1 HAVING max(p) < 0.4", "proba"))
_MEANS = "SELECT k, feature, sum(p * value) / greatest(sum(p), 1e-12) AS mean, sum(p) AS weight FROM feat JOIN proba USING (date) WHERE value IS NOT NULL GROUP BY 1, 2"
add("regime_means", lambda s, d: R.weighted_means(X.features(s, d), X.proba(s, d)), X.with_views(f"SELECT {big('k')} AS k, feature, {r('mean')} AS mean, {r('weight')} AS weight FROM ({_MEANS})", "feat", "proba"))
add("anova_r2", lambda s, d: R.anova_r2(X.features(s, d), X.proba(s, d)),
    X.with_views(f"SELECT feature, {r('sum(w * (mean - mu) ** 2) / greatest(any_value(v), 1e-12)')} AS r2 FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY feature) AS w FROM ({_MEANS})) JOIN (SELECT feature, avg(value) AS mu, var_samp(value) AS v FROM feat GROUP BY 1) USING (feature) GROUP BY 1", "feat", "proba"))
add("transition_counts", lambda s, d: R.transition_counts(X.regimes(s, d)), X.with_views(f"SELECT {big('regime')} AS regime, {big('nx')} AS next, n, {r('n / sum(n) OVER (PARTITION BY regime)')} AS share FROM (SELECT regime, nx, count(*) AS n FROM (SELECT regime, lead(regime) OVER (ORDER BY date) AS nx FROM regimes) WHERE nx IS NOT NULL GROUP BY 1, 2)", "regimes"))
add("regime_summary", lambda s, d: R.regime_summary(X.regimes(s, d), X.features(s, d)),
    X.with_views(f"SELECT {big('regime')} AS regime, feature, {r('mean', 2)} AS mean, n AS observations, {r('100 * share', 2)} AS percentage, {r('dur', 2)} AS avg_duration FROM (SELECT regime, feature, avg(value) AS mean FROM feat JOIN regimes USING (date) GROUP BY 1, 2) JOIN ({_SHARE}) USING (regime) JOIN (SELECT regime, avg(n) AS dur FROM ({_ISL}) GROUP BY 1) USING (regime)", "feat", "regimes"))
add("regime_distributions", lambda s, d: R.regime_distributions(X.regimes(s, d), X.features(s, d)),
    X.with_views(f"SELECT {big('regime')} AS regime, feature, {r('min(value)')} AS low, {r('quantile_cont(value, 0.25)')} AS q1, {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.75)')} AS q3, {r('max(value)')} AS high FROM feat JOIN regimes USING (date) WHERE value IS NOT NULL GROUP BY 1, 2", "feat", "regimes"))
_RET = "SELECT * FROM (SELECT date, regime, px / lag(px) OVER (ORDER BY date) - 1 AS ret FROM px JOIN regimes USING (date)) WHERE ret IS NOT NULL"
_DD = f"SELECT regime, min(w / pk - 1) AS max_drawdown FROM (SELECT *, max(w) OVER (PARTITION BY regime ORDER BY date) AS pk FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY regime ORDER BY date)) AS w FROM ({_RET}))) GROUP BY 1"
add("drawdown_by_regime", lambda s, d: R.drawdown_by_regime(X.px(s, d), X.regimes(s, d)), X.with_views(f"SELECT {big('regime')} AS regime, {r('max_drawdown')} AS max_drawdown FROM ({_DD})", "px", "regimes"))
add("equity_by_regime", lambda s, d: R.equity_by_regime(X.px(s, d), X.regimes(s, d)),
    X.with_views(f"SELECT {big('regime')} AS regime, count(*) AS n_days, {r('avg(ret)')} AS mean_daily_ret, {r('pow(1 + avg(ret), 252) - 1')} AS ann_return, {r('stddev_samp(ret) * sqrt(252)')} AS ann_vol, {r('avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0)')} AS sharpe, {r('avg(CAST(ret > 0 AS INT))')} AS up_day_frac, {r('any_value(max_drawdown)')} AS max_drawdown FROM ({_RET}) JOIN ({_DD}) USING (regime) GROUP BY regime HAVING count(*) >= 2", "px", "regimes"))
add("ticker_regime_fill", lambda s, d: R.ticker_regime_fill(X.px(s, d), X.regimes(s, d)), X.with_views(f"SELECT date, px, {big('g')} AS regime FROM (SELECT date, px, last_value(regime IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM px LEFT JOIN regimes USING (date)) WHERE g IS NOT NULL", "px", "regimes"))

# labels, scores, selection
_GROUP = "CASE split_part(feature, '_', 1) WHEN 'ORD1' THEN 'stress' WHEN 'ORD2' THEN 'growth' WHEN 'ORD3' THEN 'inflation' WHEN 'ORD4' THEN 'rates' WHEN 'ORD5' THEN 'liquidity' WHEN 'LIWA' THEN 'rates' WHEN 'LIWN' THEN 'rates' WHEN 'LIWR' THEN 'rates' ELSE 'growth' END"


def _scores(s, d):
    groups = prepare.feature_groups(X.features(s, d).select("feature").distinct(), X.macro_raw(s, d).select("series_code", "category").distinct())
    return R.group_scores(R.weighted_means(R.standard_scale(X.features(s, d)), X.proba(s, d)), groups)


_SCALED = "SELECT date, feature, (value - avg(value) OVER f) / stddev_pop(value) OVER f AS value FROM feat WINDOW f AS (PARTITION BY feature)"
_SCORES = f"SELECT k, {_GROUP} AS g, avg(mean) AS score FROM ({_MEANS.replace('FROM feat', f'FROM ({_SCALED})')}) GROUP BY 1, 2"
add("regime_group_scores", _scores, X.with_views(f"SELECT {big('k')} AS k, g AS \"group\", {r('score')} AS score FROM ({_SCORES})", "feat", "proba"))
_Z = ", ".join(f"CASE WHEN stddev_pop({g}) OVER () < 1e-12 THEN 0 ELSE ({g} - avg({g}) OVER ()) / stddev_pop({g}) OVER () END AS {g}" for g in R.GROUPS)
_G = ", ".join(f"coalesce(any_value(score) FILTER (g = '{g}'), 0) AS {g}" for g in R.GROUPS)
_L = " UNION ALL ".join(f"SELECT k, {i} AS o, '{n}' AS label, " + " + ".join(f"({w}) * {g}" for w, g in zip(ws, R.GROUPS, strict=True)) + " AS score FROM z" for i, (n, *ws) in enumerate(R.LABEL_WEIGHTS))
add("label_regimes", lambda s, d: R.label_regimes(_scores(s, d)),
    X.with_views(f"SELECT {big('k')} AS k, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (' || row_number() OVER (PARTITION BY label ORDER BY k) || ')' ELSE label END AS label, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, o) AS i FROM l) WHERE i = 1", "feat", "proba",
                 extra={"z": f"SELECT k, {_Z} FROM (SELECT k, {_G} FROM ({_SCORES}) GROUP BY k)", "l": _L}))
_REASON = """SELECT *, CASE WHEN NOT stationary_valid THEN 'stationary_invalid' WHEN min_share < 0.03 THEN 'min_share' WHEN max_share > 0.80 THEN 'max_share' WHEN max_duration > 3000 THEN 'max_duration'
  WHEN maha_min < (SELECT quantile_cont(maha_min, 0.1) FROM models) THEN 'maha_min' WHEN oos_min_share < 0.02 THEN 'oos_min_share' WHEN oos_max_share > 0.85 THEN 'oos_max_share' END AS reason FROM models"""
add("rejected_models", lambda s, d: R.rejected(X.models(s, d)), X.with_views(f"SELECT model_id, reason FROM ({_REASON}) WHERE reason IS NOT NULL", "models"))


def _rank(c, desc=False):
    o = f"{c} {'DESC' if desc else 'ASC'} NULLS LAST"
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {o}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () END"


def _band(x, lo, hi, slack):
    return f"CASE WHEN {x} IS NULL THEN 0 ELSE greatest(0, 1 - greatest({lo} - {x}, {x} - {hi}, 0) / {slack * (hi - lo)}) END"


_SCORE = f"""SELECT model_id, 0.5 * {_rank('maha_median')} + 0.5 * {_rank('r2_mean')} AS a, 0.45 * {_band('median_duration', 20, 200, 0.75)} + 0.35 * {_band('tv20', 0.05, 0.30, 1.0)} + 0.20 * {_rank('max_offdiag', True)} AS b,
  0.45 * {_rank('n_transitions', True)} + 0.35 * {_band('persistence', 20, 200, 1.0)} + 0.20 * {_rank('entropy')} AS c, coalesce({_rank('oos_r2')}, 0) AS o FROM ({_REASON}) WHERE reason IS NULL"""
add("select_model", lambda s, d: R.select_model(X.models(s, d)), X.with_views(f"SELECT model_id, {r('a')} AS macro_score, {r('b')} AS transition_score, {r('c')} AS stability_score, {r('0.4 * a + 0.3 * b + 0.25 * c + 0.05 * o')} AS final_score FROM ({_SCORE}) ORDER BY 0.4 * a + 0.3 * b + 0.25 * c + 0.05 * o DESC, model_id LIMIT 10", "models"))
add("pct_rank_avg", lambda s, d: R.pct_ranks(X.models(s, d).select("model_id", "oos_r2"), "model_id", {"pct": ("oos_r2", False)}).select("model_id", "pct"), X.with_views(f"SELECT model_id, {r(_rank('oos_r2'))} AS pct FROM models", "models"))
add("range_score", lambda s, d: X.models(s, d).select("model_id", R.range_score(F.col("tv20"), 0.05, 0.30, 1.0).alias("score")), X.with_views(f"SELECT model_id, {r(_band('tv20', 0.05, 0.30, 1.0))} AS score FROM models", "models"))

# hidden-Markov models: fixed parameters on the z-score of ORD1
PARAMS = hmm.Params([0.6, 0.4], [[0.95, 0.05], [0.1, 0.9]], [[-0.5], [0.7]], [[[0.64]], [[1.0]]])
_B = "exp(-0.5 * pow((z + 0.5) / 0.8, 2)) / (0.8 * sqrt(2 * pi())) AS b0, exp(-0.5 * pow(z - 0.7, 2)) / sqrt(2 * pi()) AS b1"
_OBS = f"SELECT date, row_number() OVER (ORDER BY date) AS t, {_B} FROM z63"
_F = """SELECT t, date, 0.6 * b0 / (0.6 * b0 + 0.4 * b1) AS f0, ln(0.6 * b0 + 0.4 * b1) AS l FROM obs WHERE t = 1
  UNION ALL SELECT o.t, o.date, (0.95 * f0 + 0.1 * (1 - f0)) * b0 / ((0.95 * f0 + 0.1 * (1 - f0)) * b0 + (0.05 * f0 + 0.9 * (1 - f0)) * b1), ln((0.95 * f0 + 0.1 * (1 - f0)) * b0 + (0.05 * f0 + 0.9 * (1 - f0)) * b1)
  FROM f JOIN obs o ON o.t = f.t + 1"""
_V = """SELECT t, date, ln(0.6) + ln(b0) AS d0, ln(0.4) + ln(b1) AS d1, 0 AS p0, 0 AS p1 FROM obs WHERE t = 1
  UNION ALL SELECT o.t, o.date, greatest(d0 + ln(0.95), d1 + ln(0.1)) + ln(b0), greatest(d0 + ln(0.05), d1 + ln(0.9)) + ln(b1), CAST(d1 + ln(0.1) > d0 + ln(0.95) AS INT), CAST(d1 + ln(0.9) > d0 + ln(0.05) AS INT)
  FROM v JOIN obs o ON o.t = v.t + 1"""
_P = """SELECT t, date, CAST(d1 > d0 AS INT) AS s, CASE WHEN d1 > d0 THEN p1 ELSE p0 END AS p FROM v WHERE t = (SELECT max(t) FROM v)
  UNION ALL SELECT v.t, v.date, path.p, CASE path.p WHEN 1 THEN v.p1 ELSE v.p0 END FROM path JOIN v ON v.t = path.t - 1"""


#: What the later rows say of each regime, from the last row back.
_G = """SELECT t, CAST(1 AS DOUBLE) AS g0, CAST(1 AS DOUBLE) AS g1 FROM obs WHERE t = (SELECT max(t) FROM obs)
  UNION ALL SELECT t - 1, x / (x + y), y / (x + y) FROM (SELECT g.t, 0.95 * b0 * g0 + 0.05 * b1 * g1 AS x, 0.1 * b0 * g0 + 0.9 * b1 * g1 AS y FROM g JOIN obs USING (t) WHERE g.t > 1)"""


def _observed(s, d):
    return inference.observed(X.zscore_rows(s, d), ["z"], PARAMS)


def _each(rows, column):
    return rows.select("date", *(F.col(column)[i].alias(f"p{i}") for i in range(2)))


add("hmm_filter", lambda s, d: _each(inference.filtered(_observed(s, d), PARAMS), "filtered"), X.with_views(f"SELECT date, {r('f0')} AS p0, {r('1 - f0')} AS p1 FROM f", "z63", recursive=True, extra={"obs": _OBS, "f": _F}))
add("hmm_viterbi", lambda s, d: inference.best_path(_observed(s, d), PARAMS).select("date", "state"), X.with_views(f"SELECT date, {big('s')} AS state FROM path", "z63", recursive=True, extra={"obs": _OBS, "v": _V, "path": _P}))
_A5 = np.linalg.matrix_power(np.array(PARAMS.transmat), 5)
add("hmm_forecast", lambda s, d: inference.forecast(_observed(s, d), PARAMS, 5).select("date", F.col("forecast")[0].alias("p0")),
    X.with_views(f"SELECT date, {r(f'f0 * {float(_A5[0, 0])!r} + (1 - f0) * {float(_A5[1, 0])!r}')} AS p0 FROM f", "z63", recursive=True, extra={"obs": _OBS, "f": _F}))
_POST = r("f0 * g0 / (f0 * g0 + (1 - f0) * g1)")
add("hmm_smooth", lambda s, d: _each(inference.smooth(_observed(s, d), PARAMS), "smoothed"), X.with_views(f"SELECT date, {_POST} AS p0, {_POST.replace('f0 * g0 /', '(1 - f0) * g1 /')} AS p1 FROM f JOIN g USING (t)", "z63", recursive=True, extra={"obs": _OBS, "f": _F, "g": _G}))
add("hmm_score", lambda s, d: inference.score(_observed(s, d), PARAMS).select("n_rows", "log_likelihood"), X.with_views(f"SELECT count(*) AS n_rows, {r('sum(l)')} AS log_likelihood FROM f", "z63", recursive=True, extra={"obs": _OBS, "f": _F}))



def _em_round(s, d):
    found, history = inference.fit(X.zscore_rows(s, d), ["z"], PARAMS, n_iter=1)
    rows = [(k, found.startprob[k], found.means[k][0], found.covars[k][0][0], *found.transmat[k], history[0]) for k in range(2)]
    return s.createDataFrame(rows, "k int, startprob double, mean double, variance double, a0 double, a1 double, log_likelihood double")


_GAMMA = "SELECT t, z, f0 * g0 / (f0 * g0 + (1 - f0) * g1) AS p0, (1 - f0) * g1 / (f0 * g0 + (1 - f0) * g1) AS p1 FROM f JOIN g USING (t) JOIN z63 USING (date)"
_XI = """SELECT sum(x00 / s) AS m00, sum(x01 / s) AS m01, sum(x10 / s) AS m10, sum(x11 / s) AS m11 FROM (SELECT *, x00 + x01 + x10 + x11 AS s FROM (
  SELECT f0 * 0.95 * o.b0 * g0 AS x00, f0 * 0.05 * o.b1 * g1 AS x01, (1 - f0) * 0.1 * o.b0 * g0 AS x10, (1 - f0) * 0.9 * o.b1 * g1 AS x11 FROM f JOIN obs o ON o.t = f.t + 1 JOIN g ON g.t = o.t))"""
_EM = " UNION ALL ".join(
    f"""SELECT CAST({k} AS BIGINT) AS k, {r(f'(SELECT p{k} FROM post WHERE t = 1)')} AS startprob, {r('m')} AS mean, {r(f'(SELECT (0.01 + sum(p{k} * (z - m) * (z - m))) / sum(p{k}) FROM post)')} AS variance,
      {r(f'm{k}0 / (m{k}0 + m{k}1)')} AS a0, {r(f'm{k}1 / (m{k}0 + m{k}1)')} AS a1, {r('(SELECT sum(l) FROM f)')} AS log_likelihood FROM (SELECT sum(p{k} * z) / sum(p{k}) AS m FROM post), xi"""
    for k in range(2)
)
add("hmm_em_round", _em_round, X.with_views(_EM, "z63", recursive=True, extra={"obs": _OBS, "f": _F, "g": _G, "post": _GAMMA, "xi": _XI}))

# separation of regimes, start of emissions, sanity of transitions
_FULL = f"SELECT date FROM feat GROUP BY date HAVING count(value) = {len(X.NAMES)}"
_CENTRED = f"SELECT date, feature, value - avg(value) OVER (PARTITION BY feature) AS c FROM ({_SCALED}) WHERE date IN ({_FULL})"
add("gram_moments", lambda s, d: moments.gram(feature_matrix(R.standard_scale(X.features(s, d)), X.NAMES), sorted(X.NAMES)), X.with_views(f"SELECT x.feature AS a, y.feature AS b, count(*) AS n, {r('sum(x.c * y.c)')} AS xy, {r('sum(x.c * x.c * y.c * y.c)')} AS xxyy FROM c x JOIN c y ON x.date = y.date AND x.feature <= y.feature GROUP BY ALL", "feat", extra={"c": _CENTRED}))
add("macro_coherence", lambda s, d: moments.macro_coherence(X.wide(s, d), X.NAMES, X.proba(s, d)))
add("emission_start", lambda s, d: moments.emissions(X.wide(s, d), X.NAMES, 4), digits=4)
_MOVES = "SELECT regime, nx, count(*) / sum(count(*)) OVER (PARTITION BY regime) AS a FROM (SELECT regime, lead(regime) OVER (ORDER BY date) AS nx FROM regimes) WHERE nx IS NOT NULL GROUP BY 1, 2"
_CELLS = "SELECT i, j, coalesce(a, 0) AS a FROM range(4) x(i), range(4) y(j) LEFT JOIN moves ON regime = i AND nx = j"
_SQUARE = "list_transform(m, lambda q: list_transform(range(1, 5), lambda j: list_sum(list_transform(range(1, 5), lambda i: q[i] * {}[i][j]))))"
_POWERS = f"SELECT 0 AS k, a AS m FROM held UNION ALL SELECT k + 1, {_SQUARE.format('a')} FROM powers, held WHERE k < 19"
_LIMIT = f"SELECT 0 AS k, list_transform(range(1, 5), lambda i: list_transform(range(1, 5), lambda j: a[i][j] / 2 + CASE WHEN i = j THEN 0.5 ELSE 0 END)) AS m FROM held UNION ALL SELECT k + 1, list_transform(s, lambda q: list_transform(q, lambda v: v / list_sum(q))) FROM (SELECT k, {_SQUARE.format('m')} AS s FROM lim WHERE k < 40)"
_HELD = "SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(CAST(a AS DOUBLE) ORDER BY j) AS r FROM cells GROUP BY i)"
_SANE = f"""
  SELECT {r('(SELECT median(1 / (1 - a)) FROM cells WHERE i = j)')} AS median_duration, {r('(SELECT max(1 / (1 - a)) FROM cells WHERE i = j)')} AS max_duration, {r('(SELECT avg(a) FROM cells WHERE i = j)')} AS mean_self,
         {r('(SELECT max(a) FROM cells WHERE i <> j)')} AS max_offdiag, {r('(SELECT avg(h) FROM (SELECT -sum(greatest(a, 1e-12) * log2(greatest(a, 1e-12))) AS h FROM cells GROUP BY i))')} AS row_entropy, TRUE AS stationary_valid,
         {r('(SELECT avg(list_sum(list_transform(range(1, 5), lambda j: abs(p[j] - pi[j]))) / 2) FROM (SELECT unnest(m) AS p FROM powers WHERE k = 19), (SELECT m[1] AS pi FROM lim WHERE k = 40))')} AS tv_20"""
add("transition_sanity", lambda s, d: transitions.sanity(transitions.matrices(R.transition_counts(X.regimes(s, d)))), X.with_views(_SANE, "regimes", recursive=True, extra={"moves": _MOVES, "cells": _CELLS, "held": _HELD, "powers": _POWERS, "lim": _LIMIT}))
_USED = ["ORD1_zscore_63", "ORD3_zscore_63"]
#: All features in the order of the ranking; the grid takes its first 3, 5 and 9.
_GRID = {"n_features": (3, 5, 9), "n_regimes": (3, 4), "p_stay": (0.9, 0.95, 0.99)}
add("model_grid", lambda s, d: hmm.model_grid(X.wide(s, d), X.NAMES, ["1999-12-31"], **_GRID).select("model_id", "n_features", "n_regimes", "covariance_type", "p_stay", "log_likelihood", "rounds", "converged", "min_share", "max_share"))
add("compare_models", lambda s, d: hmm.model_grid(X.wide(s, d), _USED, ["1999-12-31"], p_stay=(0.95,)).drop("params"))
add("hmm_fit", lambda s, d: hmm.model_grid(X.wide(s, d), _USED, ["1999-12-31"], n_regimes=(2,), kinds=("full",), p_stay=(0.95,)).select("model_id", "params", "log_likelihood"))
