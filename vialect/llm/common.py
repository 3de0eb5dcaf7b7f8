"""What the operators share: the shared folder, Arrow buffers as numpy arrays, and span hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vialect.operators import graph

#: Rows and bytes of an Arrow batch: a Python worker holds a few of these at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are the driver, gets a folder of its own; on a cluster that fails.
    """
    return graph.shared_dir(spark)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


#: Folders that this process has written to the shared one, and tables of the catalog over them.
_MADE: list[str] = []
_TABLES: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/vialect/{uuid.uuid4().hex}")
    return f"{_MADE[-1]}/{name}"


def named_table(name: str) -> str:
    _TABLES.append(name)
    return name


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this process has written; frames that read them can't be used any more."""
    for name in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for folder in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.clear()
    _TABLES.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null where the key is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(mod)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each span of ``values``; 0 for an empty span."""
    run = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=run[1:])
    return run[offsets[1:]] - run[offsets[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), vectorized."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
