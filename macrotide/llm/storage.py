"""Shared intermediate storage: written tables cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import utf8

#: Rows whose id is null take this place in every order and in every key.
NULL_ID = -(2**63)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where tests leave it unset, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="macrotide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def lean_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go as soon as the query has written its result."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/macrotide/{uuid.uuid4().hex}"
    with lean_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` or ``blocked_table`` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "table_name"):
            spark.sql(f"DROP TABLE IF EXISTS {table.table_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finished(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """The written result; the tables that it was made of are deleted."""
    written = materialise(result)
    discard(*tables)
    return written


def text_bytes(docs: DataFrame) -> int:
    """Total UTF-8 bytes of the texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def blocked_table(docs: DataFrame, total_bytes: int, block_bytes: int = 6 << 20) -> DataFrame:
    """The documents as a bucketed table of blocks, column ``g`` numbering the blocks.

    A block holds the documents one scan task met in a row, about ``block_bytes``
    of text (one longer document is a block of its own). Blocks are formed while
    scanning, so no text is shuffled; the table is bucketed by ``g``, so that
    grouping by ``g`` later needs no shuffle either, however often it is read.
    """
    spark = docs.sparkSession
    names = docs.columns

    def number(batches):
        task = TaskContext.get().partitionId() << 32
        block, held = 0, 0
        for batch in batches:
            lengths = np.diff(utf8(batch.column(names.index("text")))[1]).tolist()
            ids = []
            for n in lengths:
                if held and held + n > block_bytes:
                    block, held = block + 1, 0
                held += n
                ids.append(task + block)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *batch.columns], ["g", *names])

    schema = "g long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    buckets = max(12, min(100_000, total_bytes // (12 << 20)))
    name = f"macrotide_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/macrotide/{name}"
    docs.mapInArrow(number, schema).write.option("path", path).option("compression", "zstd").bucketBy(int(buckets), "g").saveAsTable(name)
    table = spark.table(name)
    table.table_name, table.table_path = name, path
    return table


def slices(total_bytes: int, each: int = 8 << 20) -> int:
    """How many hash slices keep one slice of an exchange at about ``each`` bytes, as a power of two."""
    return 1 << max(4, (max(1, total_bytes // each) - 1).bit_length())
