"""What the operators share: reading tables, and cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new local one if all of Spark
    runs in this process, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trajmill-"))
    return context.getCheckpointDir()


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, wherever Spark's file systems keep it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "written_at", None):
            remove(table.sparkSession, path)


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts (in one column) have about `size` bytes, so that few are Python objects at a time."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def tidy() -> None:
    """Gives memory that a finished task no longer needs back to the system, as Python workers live on from task to task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """From here on Arrow batches end at `size` bytes too, not only at a number of rows, unless the session says otherwise:
    a batch of long texts is held by the JVM, by the worker, and once more while it grows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, size)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def range_of(key: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted `bounds` are at most `key`; looks at about 2 * sqrt(len(bounds)) of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    among = lambda items: F.aggregate(items, F.lit(0), lambda acc, b: acc + (b <= key).cast("int"))
    lit = lambda items: F.array(*[F.lit(b).cast(kind) for b in items])
    chunk = among(lit([c[0] for c in chunks]))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * step + among(F.element_at(F.array(*[lit(c) for c in chunks]), F.greatest(chunk, F.lit(1)))))
