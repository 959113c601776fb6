"""Registered queries of whole reports, rankings and views behind figures, beside those of ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moments, prepare, report, selection, validate
from ..operators import regimes as R
from . import fixtures as X
from .registry import _CORR, _EXPECTED, _FULL, _GROUP, _JUMPS, _MEANS, _OUT, _RATE, ORACLE_SQL, QUERIES, _expected, add, big, r

__all__ = ["ORACLE_SQL", "QUERIES"]

TODAY = "2001-06-30"


def _days(x: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', {x})"


_PROBLEMS = "SELECT count(*) FILTER (problem = 'missing') AS missing, count(*) FILTER (problem = 'unexpected') AS unexpected FROM ({})"
_COVERED = "SELECT 'missing' AS problem FROM e ANTI JOIN proc USING (series_code) UNION ALL SELECT 'unexpected' FROM (SELECT DISTINCT series_code FROM proc) p ANTI JOIN e USING (series_code)"
_DATES = "SELECT 'missing' AS problem FROM cal ANTI JOIN proc USING (date) UNION ALL SELECT 'unexpected' FROM (SELECT DISTINCT date FROM proc) p ANTI JOIN cal USING (date)"
_ONE = f"""
  SELECT count(*) AS n, count(*) FILTER (series_code IS NULL) AS ns, count(*) FILTER (date IS NULL) AS nd, count(*) FILTER (value IS NULL) AS nv, count(DISTINCT series_code) AS series,
         min(date) AS lo, max(date) AS hi, count(*) FILTER (date > DATE '{TODAY}') AS future, count(*) - count(DISTINCT series_code || date) AS dup, count(*) FILTER (isinf(value)) AS inf,
         avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, max(value) AS high, median(value) AS median, count(*) FILTER (coalesce(is_new_data, FALSE)) AS new,
         count(*) FILTER (days_since_update < 0) AS negative, max(days_since_update) AS stalest
  FROM proc"""
_CHECKS = [
    ("completeness", "null_series_code", "error", "ns = 0", "ns"), ("completeness", "null_date", "error", "nd = 0", "nd"), ("completeness", "null_value", "error", "nv = 0", "nv"), ("completeness", "series_count", "info", "TRUE", "series"),
    ("temporal", "first_date", "info", "TRUE", _days("lo")), ("temporal", "last_date", "info", "TRUE", _days("hi")), ("temporal", "span_days", "info", "TRUE", "date_diff('day', lo, hi)"),
    ("temporal", "future_dates", "warning", "future = 0", "future"), ("temporal", "duplicate_keys", "error", "dup = 0", "dup"), ("values", "infinite", "error", "inf = 0", "inf"),
    *(("values", x, "info", "TRUE", x) for x in ("mean", "std", "low", "high", "median")),
    ("staleness", "new_rows", "info", "TRUE", "new"), ("staleness", "carried_pct", "info", "TRUE", "100 * (n - new) / n"), ("staleness", "negative_days", "error", "negative = 0", "negative"), ("staleness", "most_days", "info", "TRUE", "stalest"),
]


def _check_sql(section: str, check: str, severity: str, passed: str, value: str, of: str) -> str:
    return f"""SELECT '{section}' AS section, '{check}' AS "check", '{severity}' AS severity, {passed} AS passed, {r(f'CAST({value} AS DOUBLE)')} AS value FROM {of}"""


_DATA_REPORT = " UNION ALL ".join(
    [
        _check_sql("schema", "required_columns", "error", "TRUE", "0", "(SELECT 1)"), _check_sql("dtypes", "date_type", "error", "TRUE", "NULL", "(SELECT 1)"), _check_sql("dtypes", "value_type", "error", "TRUE", "NULL", "(SELECT 1)"),
        *(_check_sql(*c, "one") for c in _CHECKS),
        _check_sql("series", "outliers", "warning", "far = 0", "far", "far"), _check_sql("series", "zero_variance", "warning", "flat = 0", "flat", "far"),
        f"""SELECT 'staleness' AS section, 'most_days:' || series_code AS "check", 'info' AS severity, TRUE AS passed, {r('CAST(max(days_since_update) AS DOUBLE)')} AS value FROM proc GROUP BY series_code""",
        *(_check_sql("coverage", x, "warning", f"{x} = 0", x, "covered") for x in ("missing", "unexpected")),
        *(_check_sql("calendar", x, "warning", f"{x} = 0", x, "dated") for x in ("missing", "unexpected")),
    ]
)
_DATA_VIEWS = {
    "e": _EXPECTED, "one": _ONE, "covered": _PROBLEMS.format(_COVERED), "dated": _PROBLEMS.format(_DATES),
    "far": f"SELECT coalesce(sum(outliers), 0) AS far, count(*) FILTER (zero_variance) AS flat FROM ({_OUT.replace('FROM clean', 'FROM proc')})",
}


def _data_report(s, d):
    return report.data_report(X.processed(s, d), _expected(s, d), X.calendar(s, d), F.lit(TODAY).cast("date"))


def _counts(failed: str, of: str) -> str:
    return f"""SELECT count(*) FILTER (NOT ({failed})) AS passed, count(*) FILTER (({failed}) AND severity = 'warning') AS warnings, count(*) FILTER (({failed}) AND severity = 'error') AS errors,
      CASE WHEN count(*) FILTER (({failed}) AND severity = 'error') > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({of})"""


add("data_validation", _data_report, X.with_views(_DATA_REPORT, "proc", "cal", extra=_DATA_VIEWS))
add("data_validation_counts", lambda s, d: report.report_counts(_data_report(s, d)), X.with_views(_counts("NOT passed", _DATA_REPORT), "proc", "cal", extra=_DATA_VIEWS))

_BURN = f"SELECT a AS first_date, b AS complete_from, date_diff('day', a, b) / 365.25 AS years, coalesce(date_diff('day', a, b) / 365.25 > 10, TRUE) AS failed FROM (SELECT min(date) AS a, (SELECT min(date) FROM ({_FULL})) AS b FROM feat)"
add("burn_in", lambda s, d: report.burn_in(X.wide(s, d), X.NAMES), X.with_views(f"SELECT first_date, complete_from, {r('years')} AS years, failed FROM ({_BURN})", "feat"))


def _feature_sql(check: str, subject: str, severity: str, failed: str, of: str) -> str:
    return f"""SELECT '{check}' AS "check", {subject} AS subject, {severity} AS severity, coalesce({failed}, FALSE) AS failed FROM {of}"""


_FIGURES = """
  SELECT feature, count(*) AS n_rows, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s, var_samp(value) AS v, count(*) FILTER (abs(value) > 10) AS extreme, any_value(native_freq) AS often
  FROM feat LEFT JOIN freq ON split_part(feature, '_', 1) = series_code GROUP BY feature"""
#: (check, which features it applies to, severity, when it fails) over the figures of each feature.
_OF_FEATURE = [
    ("missing", "TRUE", "error", "100.0 * (n_rows - n) / n_rows > 20"),
    ("zscore", "feature LIKE '%zscore%' AND n >= 100", "warning", "abs(m) > 0.5 OR abs(s - 1) > 0.5"),
    ("outliers", "TRUE", "warning", "extreme > 0"),
    ("monthly_changes", "often = 'monthly' AND n >= 100", "error", "rate > 0.15"),
    ("weekly_changes", "often = 'weekly' AND n >= 100", "warning", "rate < 0.10 OR rate > 0.35"),
    ("daily_changes", "often = 'daily' AND n >= 100", "warning", "rate < 0.5"),
    ("variance", "TRUE", "warning", "v < 0.01"),
    ("jumps", "n >= 100", "warning", "share > 0.01"),
]
_FEATURE_VIEWS = {"figures": f"SELECT * FROM ({_FIGURES}) LEFT JOIN ({_RATE}) USING (feature) LEFT JOIN ({_JUMPS}) USING (feature)", "pairs": f"SELECT a, b FROM ({_CORR}) WHERE abs(corr) > 0.7", "burn": _BURN}
_GAP = "(SELECT (SELECT count(*) FROM cal ANTI JOIN feat USING (date)) + (SELECT count(DISTINCT date) FROM feat ANTI JOIN cal USING (date)) AS n)"
_FEATURE_REPORT = " UNION ALL ".join(
    [
        _feature_sql("duplicate_dates", "'all'", "'error'", "FALSE", "(SELECT 1)"),
        _feature_sql("calendar", "'all'", "'warning'", "n > 0", _GAP),
        _feature_sql("burn_in", "'all'", "'warning'", "failed", "burn"),
        *(_feature_sql(check, "feature", f"'{severity}'", failed, f"figures WHERE {applies}") for check, applies, severity, failed in _OF_FEATURE),
        _feature_sql("correlation", "a || ' / ' || b", "'warning'", "TRUE", "pairs"),
    ]
)
_RESULTS = [
    ("index_type", "error", "0", "(SELECT 1)"), ("duplicate_dates", "error", "0", "(SELECT 1)"), ("sorted_dates", "warning", "0", "(SELECT 1)"), ("calendar", "warning", "n", _GAP), ("missing", "error", None, None),
    ("burn_in", "warning", "CAST(failed AS INT)", "burn WHERE complete_from IS NOT NULL"), *((c, s, None, None) for c, _, s, _ in _OF_FEATURE if c != "missing"), ("correlation", "warning", "count(*)", "pairs"),
]


def _result_sql(place: int, check: str, severity: str, n: str | None, of: str | None) -> str:
    if n is None:
        _, applies, _, failed = next(x for x in _OF_FEATURE if x[0] == check)
        n, of = ("sum(extreme)" if check == "outliers" else f"count(*) FILTER ({failed})"), f"figures WHERE {applies} HAVING count(*) > 0"
    return f"""SELECT CAST({place} AS BIGINT) AS place, '{check}' AS "check", CASE WHEN n = 0 THEN 'info' ELSE '{severity}' END AS severity, n = 0 AS passed, CAST(n AS BIGINT) AS problems FROM (SELECT {n} AS n FROM {of})"""


_FEATURE_CHECKS = " UNION ALL ".join(_result_sql(i, *x) for i, x in enumerate(_RESULTS, 1))


def _feature_report(s, d):
    return report.feature_report(X.features(s, d), X.wide(s, d), X.NAMES, X.calendar(s, d), prepare.native_freq(X.cleaned(s, d)))


def _feature_checks(s, d, *more):
    wide = X.wide(s, d).repartitionByRange("date").sortWithinPartitions("date")
    return report.feature_checks(X.features(s, d), wide, X.NAMES, X.calendar(s, d), prepare.native_freq(X.cleaned(s, d)), *more)


_SEEN = ("feat", "cal", "freq")
add("feature_validation", _feature_report, X.with_views(_FEATURE_REPORT, *_SEEN, extra=_FEATURE_VIEWS))
add("feature_validation_counts", lambda s, d: report.report_counts(_feature_report(s, d)), X.with_views(_counts("failed", _FEATURE_REPORT), *_SEEN, extra=_FEATURE_VIEWS))
add("feature_checks", _feature_checks, X.with_views(_FEATURE_CHECKS, *_SEEN, extra=_FEATURE_VIEWS))
add("feature_checks_with_unit_roots", lambda s, d: _feature_checks(s, d, moments.unit_roots(X.features(s, d))))

_PLACED = "SELECT o_orderpriority AS c, CAST(o_orderdate AS DATE) AS d, row_number() OVER () AS i FROM orders"
_BEFORE = f"SELECT c, d, lag(c) OVER (ORDER BY i) AS pc, lag(d) OVER (ORDER BY i) AS pd FROM ({_PLACED})"
add("order_check", lambda s, d: report.order_violations(X.table(s, d, "orders").select(F.col("o_orderpriority").alias("series_code"), F.to_date("o_orderdate").alias("date"))),
    f"SELECT count(*) FILTER (c < pc OR c = pc AND d < pd) AS violations FROM ({_BEFORE})")
add("strong_correlations", lambda s, d: validate.correlations(X.wide(s, d), X.NAMES, 0.7), X.with_views(f"SELECT a, b, {r('corr')} AS corr FROM ({_CORR}) WHERE abs(corr) > 0.7", "feat"))
add("top_correlations", lambda s, d: selection.highest(validate.correlations(X.wide(s, d), X.NAMES).select("a", "b", F.abs("corr").alias("strength")), "strength", 5, "a", "b"),
    X.with_views(f"SELECT a, b, {r('strength')} AS strength FROM (SELECT a, b, abs(corr) AS strength FROM ({_CORR}) WHERE corr IS NOT NULL) ORDER BY strength DESC, a, b LIMIT 5", "feat"))

_R2 = f"SELECT feature, sum(w * (mean - mu) ** 2) / greatest(any_value(v), 1e-12) AS r2 FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY feature) AS w FROM ({_MEANS})) JOIN (SELECT feature, avg(value) AS mu, var_samp(value) AS v FROM feat GROUP BY 1) USING (feature) GROUP BY feature"


def _r2(s, d):
    return R.anova_r2(X.features(s, d), X.proba(s, d))


def _groups(s, d):
    return prepare.feature_groups(X.features(s, d).select("feature").distinct(), X.cleaned(s, d).select("series_code", "category").distinct())


add("top_r2", lambda s, d: selection.highest(_r2(s, d), "r2", 5, "feature"), X.with_views(f"SELECT feature, {r('r2')} AS r2 FROM ({_R2}) ORDER BY r2 DESC, feature LIMIT 5", "feat", "proba"))
add("r2_summary", lambda s, d: R.r2_summary(_r2(s, d), _groups(s, d)),
    X.with_views(f"SELECT g AS \"group\", {r('avg(r2)')} AS r2_mean, {r('median(r2)')} AS r2_median, count(r2) AS n FROM (SELECT {_GROUP} AS g, r2 FROM r2 UNION ALL SELECT 'all', r2 FROM r2) GROUP BY 1", "feat", "proba", extra={"r2": _R2}))

_NEXT = "SELECT regime, nx, count(*) AS n FROM (SELECT regime, lead(regime) OVER (ORDER BY date) AS nx FROM regimes) WHERE nx IS NOT NULL GROUP BY 1, 2"
_TO = ", ".join(f"round(coalesce(sum(n) FILTER (nx = {k}), 0) / sum(n), 3) + 0.0 AS to_{k}" for k in range(4))
add("transition_matrix", lambda s, d: R.transition_matrix(X.regimes(s, d), [0, 1, 2, 3]), X.with_views(f"SELECT {big('regime')} AS regime, {_TO} FROM ({_NEXT}) GROUP BY regime", "regimes"))

#: Names of two of the four regimes; the others keep their number.
_LABELS = {0: "low", 3: "high"}


def _named(s, d):
    return s.createDataFrame(list(_LABELS.items()), "regime int, label string")


_CASE = "CASE regime " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _LABELS.items()) + " ELSE 'Regime ' || regime END"
add("regime_timeseries", lambda s, d: R.time_series_view(X.regimes(s, d), X.proba(s, d), _named(s, d)), X.with_views(f"SELECT date, {big('regime')} AS regime, {_CASE} AS label, {big('k')} AS k, {r('p')} AS p FROM regimes JOIN proba USING (date)", "regimes", "proba"))
add("prices_on_feature_dates", lambda s, d: R.prices_on(X.features(s, d), X.px(s, d)), X.with_views("SELECT date, px FROM (SELECT DISTINCT date FROM feat) LEFT JOIN px USING (date)", "feat", "px"))


def _nested(s, d):
    parts = {"in_sample": ("min_share", "max_share", "n_transitions"), "out_of_sample": ("oos_r2",)}
    return X.models(s, d).select("model_id", *(F.struct(*names).alias(k) for k, names in parts.items()))


add("flat_metrics", lambda s, d: R.flat_metrics(_nested(s, d), "__"),
    X.with_views(f"SELECT model_id, {r('min_share')} AS in_sample__min_share, {r('max_share')} AS in_sample__max_share, n_transitions AS in_sample__n_transitions, {r('oos_r2')} AS out_of_sample__oos_r2 FROM models", "models"))
_PIVOT = ", ".join(f"{r(f"any_value(value) FILTER (feature = '{n}')")} AS \"{n}\"" for n in X.NAMES)
_RANKING = X.NAMES[::-1]
_BEST = ", ".join(f'"{n}"' for n in _RANKING[:5])
add("ready_features", lambda s, d: selection.ready_features(X.wide(s, d), X.NAMES, 5, ["not_in_the_table", *_RANKING]),
    X.with_views(f"SELECT date, {_BEST} FROM (SELECT date, {_PIVOT}, count(value) AS n FROM feat GROUP BY date) WHERE n = {len(X.NAMES)}", "feat"))
