"""From raw observations to a dense table on the business calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import series_window

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def select_series(raw: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the wanted series; the condition reaches the scan."""
    return raw.filter(F.col("series_code").isin(ids))


def coerce_types(raw: DataFrame) -> DataFrame:
    """Dates and numbers; what can't be read, and NaN, is null."""
    value = F.col("value").try_cast("double")
    return raw.withColumns({"date": F.col("date").try_cast("date"), "value": F.when(~F.isnan(value), value)})


def roll_weekend(df: DataFrame, column: str = "date") -> DataFrame:
    """Saturdays and Sundays become the next Monday."""
    day = F.col(column)
    return df.withColumn(column, F.when(F.weekday(day) == 5, F.date_add(day, 2)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day))


def dedup_last(df: DataFrame) -> DataFrame:
    """One row per (series_code, rolled date): that of the latest original date."""
    rolled = roll_weekend(df.withColumn("_original", F.col("date")))
    w = Window.partitionBy("series_code", "date").orderBy(F.desc("_original"), F.desc("value"))
    return rolled.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_original")


def clean(raw: DataFrame) -> DataFrame:
    return dedup_last(coerce_types(raw))


def staleness_flags(df: DataFrame, mode: str = "changed") -> DataFrame:
    """is_new_data (value changed; in mode ``observed`` any value) and obs_number."""
    w = series_window()
    before = F.lag("value").over(w)
    new = before.isNull() | F.col("value").isNull() | (F.col("value") != before) if mode == "changed" else F.col("value").isNotNull()
    return df.withColumns({"is_new_data": new, "obs_number": F.row_number().over(w)})


def _frequency(middle, n):
    return F.when(n < 2, "unknown").when(middle <= 1, "daily").when(middle <= 7, "weekly").when(middle <= 31, "monthly").otherwise("irregular")


def _with_gaps(df: DataFrame) -> DataFrame:
    return df.withColumn("_gap", F.datediff("date", F.lag("date").over(series_window())))


def native_freq(df: DataFrame) -> DataFrame:
    """(series_code, native_freq) by the median gap in whole days."""
    return _with_gaps(df).groupBy("series_code").agg(_frequency(F.floor(F.median("_gap")), F.count("*")).alias("native_freq"))


def annotate(df: DataFrame) -> DataFrame:
    """is_new_data, obs_number and native_freq, all over one partitioning by series."""
    w = Window.partitionBy("series_code")
    gaps = _with_gaps(staleness_flags(df))
    return gaps.withColumn("native_freq", _frequency(F.floor(F.median("_gap").over(w)), F.count("*").over(w))).drop("_gap")


def align_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every series on every business day, by exact date; values and labels carried forward, flags not."""
    grid = df.select("series_code").distinct().crossJoin(F.broadcast(calendar))  # the calendar is days: some thousands of rows
    w = series_window().rowsBetween(*_SO_FAR)
    carried = [c for c in ("value", "series_name", "category", "native_freq", "obs_number") if c in df.columns]
    joined = grid.join(df, ["series_code", "date"], "left")
    since = F.last(F.when(F.col("is_new_data"), F.col("date")), ignorenulls=True).over(w)
    return joined.select("series_code", "date", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in carried), "is_new_data", F.datediff("date", since).alias("days_since_update"))


def align_asof(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every series on every business day, by the last row on or before it, the whole row carried."""
    others = [c for c in df.columns if c not in ("series_code", "date")]
    grid = df.select("series_code").distinct().crossJoin(F.broadcast(calendar)).select("series_code", "date", F.lit(1).alias("_day"), F.lit(None).cast(df.select(F.struct(*others)).schema[0].dataType).alias("_row"))
    rows = df.select("series_code", "date", F.lit(0).alias("_day"), F.struct(*others).alias("_row"))
    w = Window.partitionBy("series_code").orderBy("date", "_day").rowsBetween(*_SO_FAR)
    both = rows.unionByName(grid).withColumn("_row", F.last("_row", ignorenulls=True).over(w))
    return both.filter("_day = 1").select("series_code", "date", "_row.*")


def trim_common_start(df: DataFrame) -> DataFrame:
    """Rows from the day on which every series has had a value."""
    start = df.filter(F.col("value").isNotNull()).groupBy("series_code").agg(F.min("date").alias("d")).agg(F.max("d").alias("_start"))
    return df.crossJoin(F.broadcast(start)).filter(F.col("date") >= F.col("_start")).drop("_start")


def feature_groups(names: DataFrame, categories: DataFrame, stress: tuple[str, ...] = ("VIXCLS",)) -> DataFrame:
    """(feature, group): the category of the series before the first underscore."""
    named = names.withColumn("series_code", F.split("feature", "_")[0])
    group = F.when(F.col("series_code").isin(*stress), "stress").otherwise(F.coalesce("category", F.lit("unknown")))
    return named.join(categories.groupBy("series_code").agg(F.max("category").alias("category")), "series_code", "left").select("feature", group.alias("group"))
