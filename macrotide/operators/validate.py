"""Checks of data and features, each a DataFrame."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for all columns, NaN counted as null."""
    kinds = dict(df.dtypes)
    one = df.agg(*(F.count_if(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "nulls")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each (series_code, date)."""
    return df.groupBy("series_code", "date").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def value_stats(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return df.agg(F.count(v).alias("n"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.median(v).alias("median"))


def series_details(df: DataFrame) -> DataFrame:
    return df.groupBy("series_code").agg(
        F.count("value").alias("observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if("is_new_data").alias("new_points")
    )


def series_outliers(df: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """(series_code, std, outliers, zero_variance)."""
    fit = df.groupBy("series_code").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("std"))
    far = (F.col("std") > 0) & (F.abs(F.col("value") - F.col("m")) > sigmas * F.col("std"))
    return df.join(fit, "series_code").groupBy("series_code").agg(F.max("std").alias("std"), F.count_if(far).alias("outliers"), (F.max("std") == 0).alias("zero_variance"))


def staleness_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("series_code").agg(F.count_if("is_new_data").alias("new_rows"), F.count_if(~F.coalesce("is_new_data", F.lit(False))).alias("carried_rows"), F.max("days_since_update").alias("max_days"), F.count_if(F.col("days_since_update") < 0).alias("negative_days"))


def calendar_gaps(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """(date, problem): business days without any row, and dates that are none."""
    have = df.select("date").distinct()
    return calendar.join(have, "date", "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(calendar, "date", "left_anti").withColumn("problem", F.lit("unexpected")))


def series_coverage(df: DataFrame, expected: DataFrame) -> DataFrame:
    """(series_code, problem) of series that are missing or unexpected."""
    have = df.select("series_code").distinct()
    return expected.join(have, "series_code", "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(expected, "series_code", "left_anti").withColumn("problem", F.lit("unexpected")))


REQUIRED = ("series_code", "date", "value", "series_name", "category")


def validation_summary(df: DataFrame, expected: DataFrame, calendar: DataFrame) -> DataFrame:
    """(check, severity, problems): a severity per check, problems counted; a missing column is reported and ends the report."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([("required_columns", "error", len(missing))], "check string, severity string, problems long")
    missing_key = F.col("series_code").isNull() | F.col("date").isNull() | F.col("value").isNull()
    rows = df.agg(F.count_if(missing_key).alias("critical_nulls"), F.count_if(F.abs("value") == float("inf")).alias("infinite_values"))
    far = series_outliers(df).agg(F.sum("outliers").alias("outliers"), F.count_if("zero_variance").alias("zero_variance"))
    uncovered, gaps = (x.agg(F.count("*").alias(name)) for name, x in (("series_coverage", series_coverage(df, expected)), ("calendar_gaps", calendar_gaps(df, calendar))))
    one = rows.crossJoin(duplicate_keys(df).withColumnRenamed("duplicates", "duplicate_keys")).crossJoin(far).crossJoin(uncovered).crossJoin(gaps)  # a row each
    checks = [("critical_nulls", "error"), ("duplicate_keys", "error"), ("infinite_values", "error"), ("series_coverage", "warning"), ("calendar_gaps", "warning"), ("outliers", "warning"), ("zero_variance", "warning")]
    each = (F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.coalesce(name, F.lit(0)).cast("long").alias("problems")) for name, severity in checks)
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def feature_metadata(features: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Figures of long features (date, feature, value); with frequency (series_code, native_freq) also that of each series."""
    parts = F.split("feature", "_", 2)
    v = F.col("value")
    one = features.groupBy("feature").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), (100 * F.avg(v.isNull().cast("double"))).alias("missing_pct"), F.count_if(F.abs(v) > 5).alias("n_outliers"))
    named = one.select("feature", parts[0].alias("indicator"), parts[1].alias("transforms"), "mean", "std", "missing_pct", "n_outliers")
    if frequency is None:
        return named
    often = frequency.select(F.col("series_code").alias("indicator"), F.col("native_freq").alias("frequency"))
    return named.join(often, "indicator", "left").withColumn("frequency", F.coalesce("frequency", F.lit("unknown")))


#: Features of fewer values are not judged by their distribution, changes or jumps.
JUDGED = 100


def feature_figures(features: DataFrame) -> DataFrame:
    """One row per feature: rows, values (n), nulls, mean, std, variance, extreme values, largest, changes of value (the first one is one) and jumps.

    Changes and jumps are between values, missing ones left out. Every figure comes from one shuffle by feature.
    """
    of = Window.partitionBy("feature")
    held = F.col("value").isNotNull()
    earlier = of.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    rows = features.withColumn("_before", F.last("value", ignorenulls=True).over(earlier))
    rows = rows.withColumn("_d", F.when(held, F.abs(F.col("value") - F.col("_before"))))
    limit = F.avg("_d").over(of) + 5 * F.stddev_samp("_d").over(of)
    rows = rows.withColumn("_far", (F.col("_d") > limit) & (F.stddev_samp("_d").over(of) > 0))
    return rows.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n"), F.count_if(~held).alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("variance"),
        F.count_if(F.abs("value") > 10).alias("extreme"), F.max(F.abs("value")).alias("largest"), F.count_if(held & (F.col("_before").isNull() | (F.col("_before") != F.col("value")))).alias("changes"), F.count_if("_far").alias("jumps"),
    )


def missing_share(features: DataFrame, limit: float = 20.0) -> DataFrame:
    pct = 100 * F.avg(F.col("value").isNull().cast("double"))
    return features.groupBy("feature").agg(pct.alias("missing_pct")).withColumn("failed", F.col("missing_pct") > limit)


def zscore_shape(features: DataFrame) -> DataFrame:
    fit = features.filter(F.col("feature").contains("zscore") & F.col("value").isNotNull()).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return fit.filter("n >= 100").withColumn("failed", (F.abs("mean") > 0.5) | (F.abs(F.col("std") - 1) > 0.5))


def extreme_values(features: DataFrame, limit: float = 10.0) -> DataFrame:
    return features.groupBy("feature").agg(F.count_if(F.abs("value") > limit).alias("extreme"), F.max(F.abs("value")).alias("largest"))


def _feature_window() -> Window:
    return Window.partitionBy("feature").orderBy("date")


def change_rate(features: DataFrame) -> DataFrame:
    """(feature, rate): share of non-null rows that differ from the one before; the first one differs."""
    rows = features.filter(F.col("value").isNotNull()).withColumn("_before", F.lag("value").over(_feature_window()))
    return rows.groupBy("feature").agg(F.avg((F.col("_before").isNull() | (F.col("_before") != F.col("value"))).cast("double")).alias("rate"))


def change_rate_check(features: DataFrame, frequency: DataFrame) -> DataFrame:
    """change_rate of features with ``JUDGED`` values or more against what the frequency of the series allows; frequency: (series_code, native_freq)."""
    rate = feature_figures(features).filter(F.col("n") >= JUDGED).select("feature", (F.col("changes") / F.col("n")).alias("rate"))
    rate = rate.withColumn("series_code", F.split("feature", "_")[0]).join(frequency, "series_code", "left")
    kind = F.coalesce("native_freq", F.lit("daily"))
    failed = F.when(kind == "monthly", F.col("rate") > 0.15).when(kind == "weekly", (F.col("rate") < 0.10) | (F.col("rate") > 0.35)).otherwise(F.col("rate") < 0.5)
    severity = F.when(~failed, "info").when(kind == "monthly", "error").otherwise("warning")
    return rate.select("feature", kind.alias("frequency"), "rate", severity.alias("severity"))


def low_variance(features: DataFrame, limit: float = 0.01) -> DataFrame:
    return features.groupBy("feature").agg(F.var_samp("value").alias("variance")).withColumn("failed", F.col("variance") < limit)


def jumps(features: DataFrame) -> DataFrame:
    """(feature, jumps, share, failed) of features with ``JUDGED`` values or more: changes between values beyond mean + 5 deviations; failed if over 1 % of the values."""
    rows = feature_figures(features).filter(F.col("n") >= JUDGED)
    return rows.select("feature", "jumps", (F.col("jumps") / F.col("n")).alias("share")).withColumn("failed", F.col("share") > 0.01)


def correlations(wide: DataFrame, names: list[str], limit: float = 0.0) -> DataFrame:
    """(a, b, corr) of all pairs of feature columns with \\|corr\\| above the limit, from one pass."""
    pairs = list(combinations(sorted(names), 2))

    def corr(a: str, b: str):
        both = lambda x, y: F.when(F.col(f"`{y}`").isNotNull(), F.col(f"`{x}`"))
        return F.try_divide(F.covar_pop(f"`{a}`", f"`{b}`"), F.stddev_pop(both(a, b)) * F.stddev_pop(both(b, a)))  # null where one does not vary

    one = wide.agg(*(corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.*").filter(F.abs("corr") > limit)


def index_check(wide: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: dates, duplicate dates, missing and unexpected dates."""
    gaps = calendar_gaps(wide, calendar)
    return wide.agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("date")).alias("duplicate_dates")).crossJoin(gaps.agg(F.count_if(F.col("problem") == "missing").alias("missing_dates"), F.count_if(F.col("problem") == "unexpected").alias("unexpected_dates")))


