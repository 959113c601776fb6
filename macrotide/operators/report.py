"""Validation reports of whole tables: one row per check, made of a few aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import validate
from .validate import REQUIRED

DATA_REPORT = "section string, check string, severity string, passed boolean, value double"


def _rows(one: DataFrame, checks: list[tuple[str, str, str, Column, Column]], more: Column | None = None) -> DataFrame:
    """The checks (section, check, severity, passed, value) of a table of one row, and an array of more, as rows."""
    each = [
        F.struct(F.lit(section).alias("section"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), passed.alias("passed"), value.cast("double").alias("value"))
        for section, check, severity, passed, value in checks
    ]
    every = F.array(*each) if more is None else F.concat(F.array(*each), more)
    return one.select(F.explode(every).alias("x")).select("x.*")


def row_figures(df: DataFrame, today: Column | None = None) -> dict[str, Column]:
    """The aggregates of a processed table that need no grouping, so that they can be observed while it is written."""
    v, flagged, dated = F.col("value"), "is_new_data" in df.columns, "days_since_update" in df.columns
    none = F.lit(None).cast("long")
    return {
        "n": F.count("*"), **{f"null_{c}": F.count_if(F.col(c).isNull()) for c in ("series_code", "date", "value")}, "keyed": F.count_if(F.col("series_code").isNotNull() & F.col("date").isNotNull()),
        "first": F.min("date"), "last": F.max("date"), "future": F.count_if(F.col("date") > (F.current_date() if today is None else today)),
        "infinite": F.count_if(F.abs(v) == float("inf")), "mean": F.avg(v), "std": F.stddev_samp(v), "low": F.min(v), "high": F.max(v), "median": F.median(v),
        "new": F.count_if(F.coalesce(F.col("is_new_data"), F.lit(False))) if flagged else F.max(none), "negative": F.count_if(F.col("days_since_update") < 0) if dated else F.max(none), "stalest": F.max("days_since_update") if dated else F.max(none),
    }


def series_figures(df: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """Per series: rows, distinct dates, values beyond ``sigmas`` deviations, whether it never varies, and its greatest staleness; from one shuffle."""
    of = Window.partitionBy("series_code")
    std = F.stddev_samp("value").over(of)
    rows = df.withColumn("_std", std).withColumn("_far", (std > 0) & (F.abs(F.col("value") - F.avg("value").over(of)) > sigmas * std))
    stalest = F.max("days_since_update") if "days_since_update" in df.columns else F.max(F.lit(None).cast("int"))
    return rows.groupBy("series_code").agg(F.count("date").alias("dated"), F.count_distinct("date").alias("dates"), F.count_if("_far").alias("outliers"), (F.max("_std") == 0).alias("zero_variance"), stalest.alias("most_days"))


def data_report(df: DataFrame, expected: DataFrame, calendar: DataFrame, today: Column | None = None, observed: dict | None = None) -> DataFrame:
    """(section, check, severity, passed, value) of a processed table; severity info only states a figure.

    Missing columns end the report. Dates are stated as days since 1970-01-01. Rows are summed up once, unless their figures were
    observed while the table was written (see ``row_figures``), and so are series; the calendar and the expected series are compared by anti-joins.
    The section staleness has each series' greatest staleness as most_days:<series>.
    """
    spark = df.sparkSession
    missing = [c for c in REQUIRED if c not in df.columns]
    kinds = dict(df.dtypes)
    schema = [("schema", "required_columns", "error", not missing, float(len(missing)))]
    if missing:
        return spark.createDataFrame(schema, DATA_REPORT)
    schema.append(("dtypes", "date_type", "error", kinds["date"] in ("date", "timestamp", "timestamp_ntz"), None))
    schema.append(("dtypes", "value_type", "error", kinds["value"] in ("double", "float", "int", "bigint") or kinds["value"].startswith("decimal"), None))
    flagged, dated = "is_new_data" in df.columns, "days_since_update" in df.columns
    figures = row_figures(df, today)
    shape = df.agg(*(c.alias(name) for name, c in figures.items()))
    by_series = series_figures(df)
    of_all = by_series.agg(
        F.count("series_code").alias("series"), F.coalesce(F.sum(F.when(F.col("series_code").isNotNull(), F.col("dated") - F.col("dates"))), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("series_code").isNotNull(), F.col("outliers"))), F.lit(0)).alias("far"), F.count_if(F.col("series_code").isNotNull() & F.col("zero_variance")).alias("flat"),
        F.sort_array(F.collect_list(F.struct("series_code", "most_days"))).alias("each"),  # a row per series
    )
    rows = (shape if observed is None else spark.createDataFrame([tuple(observed[name] for name in figures)], shape.schema)).crossJoin(of_all)
    c, yes = F.col, F.lit(True)
    none = lambda name: c(name) == 0
    of_rows = [
        *(("completeness", f"null_{x}", "error", none(f"null_{x}"), c(f"null_{x}")) for x in ("series_code", "date", "value")),
        ("completeness", "series_count", "info", yes, c("series")),
        ("temporal", "first_date", "info", yes, F.unix_date(c("first").cast("date"))),
        ("temporal", "last_date", "info", yes, F.unix_date(c("last").cast("date"))),
        ("temporal", "span_days", "info", yes, F.datediff("last", "first")),
        ("temporal", "future_dates", "warning", none("future"), c("future")),
        ("temporal", "duplicate_keys", "error", none("duplicates"), c("duplicates")),
        ("values", "infinite", "error", none("infinite"), c("infinite")),
        *(("values", x, "info", yes, c(x)) for x in ("mean", "std", "low", "high", "median")),
    ]
    if flagged:
        of_rows += [("staleness", "new_rows", "info", yes, c("new")), ("staleness", "carried_pct", "info", yes, 100 * (c("n") - c("new")) / F.when(c("n") > 0, c("n")))]
    if dated:
        of_rows += [("staleness", "negative_days", "error", none("negative"), c("negative")), ("staleness", "most_days", "info", yes, c("stalest"))]
    of_rows += [("series", "outliers", "warning", none("far"), c("far")), ("series", "zero_variance", "warning", none("flat"), c("flat"))]

    def problems(gaps: DataFrame, section: str) -> DataFrame:
        one = gaps.agg(F.count_if(c("problem") == "missing").alias("missing"), F.count_if(c("problem") == "unexpected").alias("unexpected"))
        return _rows(one, [(section, x, "warning", none(x), c(x)) for x in ("missing", "unexpected")])

    stale = F.transform("each", lambda x: F.struct(F.lit("staleness").alias("section"), F.concat(F.lit("most_days:"), x["series_code"]).alias("check"), F.lit("info").alias("severity"), yes.alias("passed"), x["most_days"].cast("double").alias("value")))
    more = F.filter(stale, lambda x: x["check"].isNotNull()) if dated else None
    parts = [spark.createDataFrame(schema, DATA_REPORT), _rows(rows, of_rows, more), problems(validate.series_coverage(df, expected), "coverage"), problems(validate.calendar_gaps(df, calendar), "calendar")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_counts(report: DataFrame) -> DataFrame:
    """One row: checks passed, warnings and errors, and the status FAIL if there is any error. The column failed or passed says which failed."""
    failed = F.col("failed") if "failed" in report.columns else ~F.col("passed")
    errors = F.count_if(failed & (F.col("severity") == "error"))
    return report.agg(F.count_if(~failed).alias("passed"), F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"), errors.alias("errors"), F.when(errors > 0, "FAIL").otherwise("PASS").alias("status"))


def report_text(report: DataFrame) -> str:
    """The report of a table as lines of text; a report has some dozens of rows."""
    rows = report.orderBy("section", "check").collect()
    bad = [r for r in rows if not r["passed"]]
    lines = [f"status: {'FAIL' if any(r['severity'] == 'error' for r in bad) else 'PASS'}"]
    for section in dict.fromkeys(r["section"] for r in rows):
        lines.append(f"{section}:")
        lines += [f"  {'ok' if r['passed'] else r['severity']:8}{r['check']}" + ("" if r["value"] is None else f" {r['value']:g}") for r in rows if r["section"] == section]
    return "\n".join(lines)


def order_violations(df: DataFrame) -> DataFrame:
    """One row, violations: rows that stand before the one ahead of them in the files, by (series_code, date).

    Rows are compared within each scan task, and each task's first row with the last of the task before.
    """
    key = F.struct("series_code", F.col("date").cast("date").alias("date"))
    placed = df.select(key.alias("key"), F.monotonically_increasing_id().alias("at")).withColumn("task", F.shiftright("at", 33))
    before = F.lag("key").over(Window.partitionBy("task").orderBy("at"))
    inside = placed.withColumn("before", before).agg(F.count_if(F.col("key") < F.col("before")).alias("n"))
    ends = placed.groupBy("task").agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))  # a row per task
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("task"))).agg(F.count_if(F.col("first") < F.col("before")).alias("n"))
    return inside.unionByName(across).agg(F.sum("n").alias("violations"))


def burn_in(wide: DataFrame, names: list[str], limit_years: float = 10.0) -> DataFrame:
    """One row: first date, first date on which no feature is missing, years between, failed (over the limit, or never complete)."""
    full = F.lit(True)
    for n in names:
        full = full & F.col(f"`{n}`").isNotNull()
    one = wide.agg(F.min("date").alias("first_date"), F.min(F.when(full, F.col("date"))).alias("complete_from"))
    years = F.datediff("complete_from", "first_date") / 365.25
    return one.withColumn("years", years).withColumn("failed", F.coalesce(F.col("years") > limit_years, F.lit(True)))


def _judged(features: DataFrame, frequency: DataFrame) -> DataFrame:
    """Figures of each feature with the frequency of its series; one that frequency does not name has none."""
    often = frequency.select(F.col("series_code").alias("_series"), F.col("native_freq").alias("frequency"))
    return validate.feature_figures(features).withColumn("_series", F.split("feature", "_")[0]).join(F.broadcast(often), "_series", "left")  # a row per series


def _of_feature() -> list[tuple[str, Column, Column, Column]]:
    """(check, whether it applies to a feature, its severity, whether it fails) over ``_judged``."""
    c, enough, rate = F.col, F.col("n") >= validate.JUDGED, F.col("changes") / F.col("n")
    warning, error = F.lit("warning"), F.lit("error")
    rates = (("monthly", error, rate > 0.15), ("weekly", warning, (rate < 0.10) | (rate > 0.35)), ("daily", warning, rate < 0.5))
    return [
        ("missing", F.lit(True), error, 100 * c("nulls") / c("n_rows") > 20),
        ("zscore", c("feature").contains("zscore") & enough, warning, (F.abs("mean") > 0.5) | (F.abs(c("std") - 1) > 0.5)),
        ("outliers", F.lit(True), warning, c("extreme") > 0),
        *((f"{often}_changes", (c("frequency") == often) & enough, level, failed) for often, level, failed in rates),
        ("variance", F.lit(True), warning, c("variance") < 0.01),
        ("jumps", enough, warning, c("jumps") / c("n") > 0.01),
    ]


FEATURE_REPORT = "check string, subject string, severity string, failed boolean"


def feature_report(features: DataFrame, wide: DataFrame, names: list[str], calendar: DataFrame, frequency: DataFrame, stationarity: DataFrame | None = None) -> DataFrame:
    """(check, subject, severity, failed): all checks of features in order; severity is that of a failure.

    features: (date, feature, value); wide: the same, a column per feature; frequency: (series_code,
    native_freq). stationarity, if wanted: (feature, stationary). One pass over the long rows, one over the wide ones for each of
    dates and correlations.
    """
    yes = F.lit(True)

    def row(check: str, subject: Column, severity: Column, failed: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), subject.alias("subject"), severity.alias("severity"), F.coalesce(failed, F.lit(False)).alias("failed"))

    def rows(table: DataFrame, *each: Column) -> DataFrame:
        return table.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("x.*")

    every, warning, error = F.lit("all"), F.lit("warning"), F.lit("error")
    index = validate.index_check(wide, calendar).crossJoin(burn_in(wide, names).select("failed"))  # a row each
    parts = [
        rows(index, row("duplicate_dates", every, error, F.col("duplicate_dates") > 0), row("calendar", every, warning, F.col("missing_dates") + F.col("unexpected_dates") > 0), row("burn_in", every, warning, F.col("failed"))),
        rows(_judged(features, frequency), *(F.when(applies, row(check, F.col("feature"), severity, failed)) for check, applies, severity, failed in _of_feature())),
        rows(validate.correlations(wide, names, 0.7), row("correlation", F.concat_ws(" / ", "a", "b"), warning, yes)),
    ]
    if stationarity is not None:
        parts.append(rows(stationarity, row("stationarity", F.col("feature"), warning, ~F.col("stationary"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The frequencies that series have where none are given.
DEFAULT_FREQUENCIES = {"VIXCLS": "daily", "DGS2": "daily", "DGS10": "daily", "T10Y3M": "daily", "NFCI": "weekly", "ICSA": "weekly", "CFNAI": "monthly", "INDPRO": "monthly", "PCEPILFE": "monthly"}

FEATURE_CHECKS = "place int, check string, severity string, passed boolean, problems long"


def feature_checks(features: DataFrame, wide: DataFrame, names: list[str], calendar: DataFrame, frequency: DataFrame | None = None, stationarity: DataFrame | None = None) -> DataFrame:
    """(place, check, severity, passed, problems): one result per check, in the order of the checks; severity is info where it passed.

    Inputs are those of ``feature_report``; without frequency the ``DEFAULT_FREQUENCIES`` hold. Checks that apply to no feature have no result, nor has the burn-in
    if no row is complete; the unit-root check has one if stationarity is given. The order of dates is that in which the rows of wide
    stand (see ``order_violations``), extreme values count one by one, all else by feature, pair or date.
    """
    spark = wide.sparkSession
    if frequency is None:
        frequency = spark.createDataFrame(list(DEFAULT_FREQUENCIES.items()), "series_code string, native_freq string")
    dated = dict(wide.dtypes)["date"] in ("date", "timestamp", "timestamp_ntz")
    order = order_violations(wide.select(F.lit("").alias("series_code"), "date"))
    index = validate.index_check(wide, calendar).crossJoin(burn_in(wide, names).select("complete_from", "failed")).crossJoin(order)  # a row each
    sums = []
    for check, applies, _, failed in _of_feature():
        n = F.sum(F.when(applies, F.col("extreme"))) if check == "outliers" else F.count_if(applies & F.coalesce(failed, F.lit(False)))
        sums.append(F.when(F.count_if(applies) > 0, n).alias(check))
    of_features = _judged(features, frequency).agg(*sums)
    pairs = validate.correlations(wide, names, 0.7).agg(F.count("*").alias("correlation"))
    one = index.crossJoin(of_features).crossJoin(pairs)
    if stationarity is not None:
        one = one.crossJoin(stationarity.agg(F.count_if(~F.col("stationary")).alias("stationarity")))
    results = [
        ("index_type", "error", F.lit(int(not dated))),
        ("duplicate_dates", "error", F.col("duplicate_dates")),
        ("sorted_dates", "warning", F.col("violations")),
        ("calendar", "warning", F.col("missing_dates") + F.col("unexpected_dates")),
        ("missing", "error", F.col("missing")),
        ("burn_in", "warning", F.when(F.col("complete_from").isNotNull(), F.col("failed").cast("long"))),
        *((check, "error" if check == "monthly_changes" else "warning", F.col(check)) for check in ("zscore", "outliers", "monthly_changes", "weekly_changes", "daily_changes", "variance", "jumps", "correlation")),
    ]
    if stationarity is not None:
        results.append(("stationarity", "warning", F.col("stationarity")))
    each = [
        F.struct(F.lit(i).alias("place"), F.lit(check).alias("check"), F.when(n == 0, "info").otherwise(level).alias("severity"), (n == 0).alias("passed"), n.cast("long").alias("problems"))
        for i, (check, level, n) in enumerate(results, 1)
    ]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*").filter(F.col("problems").isNotNull()).orderBy("place")
