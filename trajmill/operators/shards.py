"""Runs of a grid of shards (task, trial) that go on where they stopped.

Protocol: a wave of shards writes its rows to their partitions of `data`, which replaces what was there, under the wave's own commit
id; then a row a shard goes to `manifest`. A shard is done if the manifest calls it ok and its partition holds the rows of that
commit, so what dies between the two writes, or while one is under way, is as if it had not run. Nothing else is state.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "task_id string, trial int, seed int, commit string, tries int, status string, error string, duration_seconds double, at double"
OK, FAILED, TIMEOUT, EMPTY = "ok", "failed", "timeout", "empty"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All that was tried, a row a shard and try."""
    path = f"{folder}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if _there(spark, path) else spark.createDataFrame([], MANIFEST)


def _append(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _data(spark: SparkSession, folder: str) -> DataFrame | None:
    path = f"{folder}/data"
    return spark.read.parquet(path).drop("__task", "__trial") if _there(spark, path) else None


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, trial, commit) of the shards that are done."""
    done = manifest(spark, folder).where(F.col("status") == OK).select("task_id", "trial", "commit").distinct()
    data = _data(spark, folder)
    return done.limit(0) if data is None else done.join(data.select("task_id", "trial", F.col("__commit").alias("commit")).distinct(), ["task_id", "trial", "commit"], "left_semi")


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all shards that are done; an error if there is none."""
    data = _data(spark, folder)
    if data is None:
        raise ValueError(f"{folder}: no shard is done")
    return data.join(committed(spark, folder).withColumnRenamed("commit", "__commit"), ["task_id", "trial", "__commit"], "left_semi").drop("__commit")


def pending(spark: SparkSession, tasks: DataFrame, trials: int, folder: str, seed: int = 300, most_tries: int = 3) -> DataFrame:
    """(task_id, trial, seed, tries) of the shards to run, in order: those of the grid that are neither done nor tried `most_tries` times."""
    grid = tasks.select(F.col("task_id").cast("string").alias("task_id")).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    tries = manifest(spark, folder).groupBy("task_id", "trial").agg(F.count("*").cast("int").alias("tries"))
    left = grid.join(committed(spark, folder), ["task_id", "trial"], "left_anti").join(tries, ["task_id", "trial"], "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    order = [F.coalesce(F.col("task_id").try_cast("bigint"), F.lit(10**9)), "task_id", "trial"]
    return left.where(F.col("tries") < most_tries).select("task_id", "trial", (F.lit(seed) + F.col("trial")).cast("int").alias("seed"), "tries").orderBy("tries", *order)


def _wave(spark: SparkSession, cells: list, work: Callable[[DataFrame], DataFrame], folder: str, timeout: float | None) -> None:
    commit, began, fired = uuid.uuid4().hex, time.time(), threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        fired.set()
        context.cancelJobsWithTag(commit)

    clock = threading.Timer(timeout, stop) if timeout is not None else None
    error, found = "", set()
    context.addJobTag(commit)
    try:
        if clock is not None:
            clock.start()
        asked = spark.createDataFrame([tuple(c)[:3] for c in cells], "task_id string, trial int, seed int")
        rows = work(asked).withColumns({"task_id": F.col("task_id").cast("string"), "trial": F.col("trial").cast("int"), "__commit": F.lit(commit)})
        rows = rows.join(asked.select("task_id", "trial"), ["task_id", "trial"], "left_semi").withColumns({"__task": F.col("task_id"), "__trial": F.col("trial")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__task", "__trial").parquet(f"{folder}/data")
        found = {(r.task_id, r.trial) for r in _data(spark, folder).where(F.col("__commit") == commit).select("task_id", "trial").distinct().collect()}
    except Exception as e:  # a shard that fails is a row of the manifest; the others go on
        error = str(e)[:500]
    finally:
        if clock is not None:
            clock.cancel()
        context.removeJobTag(commit)
    status = lambda c: TIMEOUT if fired.is_set() else FAILED if error else OK if (c.task_id, c.trial) in found else EMPTY
    _append(spark, folder, [(c.task_id, c.trial, c.seed, commit, c.tries + 1, status(c), error, time.time() - began, time.time()) for c in cells])


def run(spark: SparkSession, tasks: DataFrame, trials: int, work: Callable[[DataFrame], DataFrame], folder: str, seed: int = 300, timeout: float | None = None, most_tries: int = 3, at_once: int = 64) -> DataFrame:
    """Runs what is pending, in waves of `at_once` shards, and returns merged(). work: (task_id, trial, seed) to rows with task_id and
    trial. A wave that takes `timeout` seconds or fails is not done; its shards are tried again alone."""
    while True:
        cells = pending(spark, tasks, trials, folder, seed, most_tries).limit(at_once).collect()
        if not cells:
            return merged(spark, folder)
        first = [c for c in cells if not c.tries]  # shards that failed together may not be to blame
        for wave in [first] if first else [[c] for c in cells]:
            _wave(spark, wave, work, folder, timeout)
