"""Readers and writers by file kind, raw collections, features, metadata, configurations and model parameters."""

from __future__ import annotations

import json
import warnings
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.hmm import Params

#: The configuration files below the folder of configurations.
CONFIGS = {"macro_data": "data/regime_universe.yaml", "equity_data": "data/equities_universe.yaml", "regimes": "regimes/regime_config.yaml", "models": "models/model_config.yaml"}


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its suffix: parquet/pq, csv, json, orc; feather through Arrow; xlsx through pandas-on-Spark.

    Pickle is refused: reading it runs code.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "pq"):
        return spark.read.options(**options).parquet(path)
    if kind == "csv":
        return spark.read.options(header=True, **options).csv(path)
    if kind == "json":
        return spark.read.options(**options).json(path)
    if kind == "orc":
        return spark.read.options(**options).orc(path)
    if kind in ("feather", "ftr"):  # a format of single files; each is read by one task
        return _read_feather(spark, path)
    if kind in ("xlsx", "xls"):
        import pyspark.pandas as ps

        return ps.read_excel(path, **options).to_spark()
    if kind in ("pkl", "pickle"):
        raise ValueError("pickle files run code when read and are not supported")
    raise ValueError(f"no reader for .{kind}")


def _read_feather(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_file(pa.BufferReader(content.as_buffer())) as file:
                    yield from (file.get_batch(i) for i in range(file.num_record_batches))

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).toArrow().column(0)[0].as_buffer()
    schema = spark.createDataFrame(pa.ipc.open_file(pa.BufferReader(first)).schema.empty_table()).schema
    return files.mapInArrow(run, schema)


def raw_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, rows, rows_read, readable) of each Parquet file below a folder.

    ``rows`` is what a file's footer states (null if it has none), ``rows_read`` what comes out when every column is read. A file is
    readable if both agree, so one that breaks off in the middle is not. Only files that yield no row at all are
    opened as a whole, to tell those that hold none from those without a footer.
    """
    listed = _listed(spark, folder).select("path", F.col("length").alias("bytes"))
    nothing = F.lit(None).cast("long")
    try:
        every = _lenient(spark, folder)
    except AnalysisException:
        return listed.select("path", "bytes", nothing.alias("rows"), nothing.alias("rows_read"), F.lit(False).alias("readable"))
    path = F.col("_metadata.file_path").alias("path")
    # without a column of its own a scan takes its row counts from the footers; a hash of all columns makes it read them
    stated = every.groupBy(path).agg(F.count("*").alias("rows"))
    read = every.groupBy(path).agg(F.when(F.bit_xor(F.hash(*(F.col(f"`{c}`") for c in every.columns))).isNotNull(), F.count("*")).alias("rows_read"))
    silent = _listed(spark, folder).join(stated, "path", "left_anti").select("path", "content").mapInArrow(_without_rows, "path string, none long")
    both = listed.join(stated, "path", "left").join(read, "path", "left").join(silent, "path", "left")
    rows = both.select("path", "bytes", *(F.coalesce(c, "none").alias(c) for c in ("rows", "rows_read")))
    return rows.withColumn("readable", F.coalesce(F.col("rows") == F.col("rows_read"), F.lit(False)))


def _without_rows(batches):
    """0 for files whose footer says so, null for those that have none."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        none = []
        for content in batch.column(1):
            try:
                none.append(0 if pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows == 0 else None)
            except (pa.ArrowException, OSError):
                none.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(none, pa.int64())], ["path", "none"])


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)


def _lenient(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(folder)


def load_raw(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder as one table, by column name.

    Unreadable files are named in a warning and left out whole (see ``raw_manifest``), never half read. A folder that is
    missing or holds no readable file is an error.
    """
    try:
        files = raw_manifest(spark, folder).select("path", "readable").collect()  # names of files, which the reader lists anyway
    except AnalysisException as error:
        raise FileNotFoundError(f"no folder {folder}") from error
    good, bad = [r["path"] for r in files if r["readable"]], sorted(r["path"] for r in files if not r["readable"])
    if bad:
        warnings.warn(f"unreadable files left out: {', '.join(bad)}", stacklevel=2)
    if not good:
        raise FileNotFoundError(f"no readable Parquet file below {folder}")
    return spark.read.option("mergeSchema", True).parquet(*good)


def save(df: DataFrame, path: str, *partition_by: str, order: tuple[str, ...] = (), observed: dict[str, Column] | None = None) -> dict:
    """Writes Parquet; with an order, files hold ranges of it and rows are sorted within them, file by file.

    Returns the values of the aggregates ``observed``, which are taken from the rows as they are written.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    watch = Observation()
    if observed:  # after the exchange, so that the sampling of its ranges isn't counted
        df = df.observe(watch, *(c.alias(name) for name, c in observed.items()))
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return watch.get if observed else {}


def save_features(wide: DataFrame, raw_path: str, ready_path: str, names: list[str], top: list[str]) -> None:
    """All features as they are, and the top ones of the rows in which no feature is missing."""
    save(wide, raw_path, order=("date",))
    save(wide.dropna("any", subset=names).select("date", *top), ready_path, order=("date",))


def save_metadata(metadata: DataFrame, path: str) -> None:
    """One JSON object per feature (as many rows as features)."""
    put_text(metadata.sparkSession, path, json.dumps({r["feature"]: r.asDict() for r in metadata.collect()}, indent=1))


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file to any store that Spark writes to; folders above it are made."""
    where, files = _file(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """A small text file from any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0]


def load_configs(folder: str) -> dict[str, dict]:
    """The four configuration files; a missing one is empty, with a warning."""
    import yaml

    out = {}
    for name, file in CONFIGS.items():
        path = Path(folder) / file
        if path.exists():
            out[name] = yaml.safe_load(path.read_text()) or {}
        else:
            warnings.warn(f"no configuration {path}", stacklevel=2)
            out[name] = {}
    return out


def save_model(params: Params | None, path: str, spark: SparkSession | None = None) -> None:
    """A model's parameters as JSON, where Spark writes to."""
    if params is None:
        raise ValueError("the model is not fitted")
    put_text(spark or SparkSession.getActiveSession(), path, params.to_json())


def load_model(path: str, spark: SparkSession | None = None) -> Params:
    return Params.from_json(get_text(spark or SparkSession.getActiveSession(), path))


def price_series(df: DataFrame, date: str = "date", columns: tuple[str, ...] = ("Adj Close", "adj_close", "Close", "close", "px")) -> DataFrame:
    """(date, px) from the first price column there is."""
    found = next((c for c in columns if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(columns)}")
    return df.select(F.col(date).cast("date").alias("date"), F.col(f"`{found}`").cast("double").alias("px"))
