"""The two pipelines from a configuration: raw files to the processed table, processed table to features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import business_days
from ..operators import prepare, report, selection, validate
from ..sources import io
from .chains import feature_matrix, feature_names, frequencies, parse_config, transform


@dataclass
class Result:
    """What a pipeline wrote, read back, and its validation report."""

    table: DataFrame
    report: DataFrame


def _universe(config: dict) -> dict:
    return config.get("regime_universe", config)


def calendar_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    return business_days(spark.range(1).select(F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last")))


def prepared(raw: DataFrame, ids: list[str], calendar: DataFrame) -> DataFrame:
    """Selected, cleaned, annotated, aligned and trimmed rows."""
    return prepare.trim_common_start(prepare.align_calendar(prepare.annotate(prepare.clean(prepare.select_series(raw, ids))), calendar))


def run_data_pipeline(spark: SparkSession, config: dict) -> Result:
    """Load, select and clean, align, validate and save, with the paths, series and dates of the configuration.

    A failed validation does not stop it. The raw collection and the processed table are
    written, each step reads what the one before has written.
    """
    c = _universe(config)
    io.save(io.load_raw(spark, c["data_path"]), c["raw_path"], order=("series_code", "date"))
    ids = sorted(set(frequencies(c)))
    selected = prepare.select_series(spark.read.parquet(c["raw_path"]), ids)
    if selected.isEmpty():
        raise ValueError(f"none of the series {', '.join(ids)} is in {c['data_path']}")
    days = calendar_between(spark, str(c["lookback"]["start"]), str(c["lookback"]["end"]))
    rows = prepared(selected, ids, days)
    observed = io.save(rows, c["processed_path"], order=("series_code", "date"), observed=report.row_figures(rows))
    table = spark.read.parquet(c["processed_path"])
    expected = spark.createDataFrame([(i,) for i in ids], "series_code string")
    return Result(table, report.data_report(table, expected, days, observed=observed))


def run_feature_pipeline(spark: SparkSession, config: dict, metadata_path: str | None = None, top: int = 8) -> Result:
    """Features by the configuration's chains; all of them, the best of the complete rows, and metadata are written."""
    c = _universe(config)
    chains = parse_config(c)
    names = feature_names(chains)
    processed = spark.read.parquet(c["processed_path"])
    unknown = [r[0] for r in processed.select("series_code").distinct().collect() if r[0] not in chains]  # a row per series
    if unknown:
        raise KeyError(f"series without configuration: {', '.join(sorted(unknown))}")
    io.save(feature_matrix(transform(processed, chains), names), c["raw_features_path"], order=("date",))
    wide = spark.read.parquet(c["raw_features_path"])
    io.save(selection.ready_features(wide, names, top), c["ready_features_path"], order=("date",))
    long = wide.unpivot(["date"], names, "feature", "value")
    often = spark.createDataFrame(list(frequencies(c).items()), "series_code string, native_freq string")
    if metadata_path:
        ready = spark.read.parquet(c["ready_features_path"])
        kept = [x for x in ready.columns if x != "date"]
        io.save_metadata(validate.feature_metadata(ready.unpivot(["date"], kept, "feature", "value"), often), metadata_path)
    days = processed.select("date").distinct()
    return Result(wide, report.feature_report(long, wide, names, days, often))
