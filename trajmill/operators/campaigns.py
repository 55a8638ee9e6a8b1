"""Runs of many shards, arms and iterations: what is left to do, with which settings, and what came of it.

The work itself (a simulator, a model) is a function that the caller passes; here is what decides when it is called and how
its tables are chained. Loops are over iterations and arms, never over rows, and every iteration's table is written, so a
broken run goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.operators.datasets import missing_cells
from trajmill.operators.groups import success_at_least
from trajmill.operators.selection import first_wins_capped


@dataclass(frozen=True)
class Arm:
    """Settings of one arm of an experiment."""

    name: str
    reward: str = "em"
    length_aware: bool = False
    discount: float = 0.0
    seed: int = 0

    @property
    def gate(self) -> str:
        """Exact match has two outcomes, anything shaped has many."""
        return "binary" if self.reward == "em" else "continuous"


def matrix(spark: SparkSession, arms: list[Arm], seeds: list[int]) -> DataFrame:
    """A row an arm and seed offset."""
    rows = [(a.name, a.reward, a.gate, a.length_aware, a.discount, a.seed + s) for a in arms for s in seeds]
    return spark.createDataFrame(rows, "arm string, reward string, gate string, length_aware boolean, discount double, seed int")


def run_matrix(arms: list[Arm], seeds: list[int], work: Callable[[Arm], DataFrame]) -> DataFrame:
    """The rows of every arm and seed under one schema, with arm and seed."""
    out = None
    for arm in arms:
        for s in seeds:
            own = replace(arm, seed=arm.seed + s)
            rows = work(own).withColumn("arm", F.lit(arm.name)).withColumn("seed", F.lit(own.seed))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def with_retry(work: Callable[[str], DataFrame], name: str) -> tuple[str, DataFrame]:
    """What `work` makes under `name`; if that has no row, once more under `name`_retry."""
    found = work(name)
    if not found.isEmpty():
        return name, found
    return f"{name}_retry", work(f"{name}_retry")


def iterate(spark: SparkSession, folder: str, n: int, collect: Callable[[int, DataFrame | None], DataFrame], update: Callable[[int, DataFrame], DataFrame]) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(iteration, rollouts, artifact) of an on-policy loop: collect with the artifact of the iteration before, then update.

    Both tables of an iteration are written below `folder`; iterations that are there are read, so a loop resumes."""
    artifact = None
    for i in range(n):
        tables = []
        for name, make in (("rollouts", lambda: collect(i, artifact)), ("artifact", lambda: update(i, tables[0]))):  # noqa: B023
            path = f"{folder}/{i:04d}/{name}"
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
                make().write.mode("overwrite").parquet(path)
            tables.append(spark.read.parquet(path))
        artifact = tables[1]
        yield i, tables[0], artifact


def pending(tasks: DataFrame, trials: int, manifest: DataFrame, timeout: float | None = None) -> DataFrame:
    """The (task_id, trial) cells without a finished shard, in order. manifest: task_id, trial, status, duration_seconds; a shard
    that took `timeout` seconds or more is not finished, whatever it says."""
    done = manifest.where("status = 'completed'")
    if timeout is not None:
        done = done.where(F.coalesce("duration_seconds", F.lit(0.0)) < timeout)
    order = F.coalesce(F.col("task_id").try_cast("bigint"), F.lit(10**9))
    return missing_cells(tasks, trials, done, "task_id", "trial").orderBy(order, "task_id", "trial")


def merged(shards: list[DataFrame]) -> DataFrame:
    """The simulations of several reads of shards: of one task and trial the last read wins."""
    out = None
    for i, df in enumerate(shards):
        df = df.withColumn("__read", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    newest = out.groupBy("task_id", "trial").agg(F.max("__read").alias("__read"))
    return out.join(newest, ["task_id", "trial", "__read"], "left_semi").drop("__read")


def success_dataset(rollouts: DataFrame, signature: str, cap: int) -> DataFrame:
    """The training rows of a success-only round: successes, one of each signature, at most `cap` a task."""
    return first_wins_capped(rollouts.where(success_at_least(F.col("reward"))), ["task_id", signature], ["task_id"], ["trial"], cap)


def completions(prompts: DataFrame, ask: Callable[[list[str]], list[list[str]]], prompt: str, at_once: int = 32) -> DataFrame:
    """prompts with a row for each completion (n, completion), asked for in batches by every task.

    `ask` is the connector to a model server: it gets prompts and returns their completions. The result should be written before
    it is used, as a plan that is run twice asks twice."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("completion", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), at_once):
                some = part.iloc[i : i + at_once]
                rows = [(*row, n, text) for row, texts in zip(some.itertuples(index=False, name=None), ask(some[prompt].tolist()), strict=True) for n, text in enumerate(texts)]
                yield pd.DataFrame(rows, columns=[*some.columns, "n", "completion"])

    return prompts.mapInPandas(run, schema)


def agent_loop_rows(outputs: DataFrame) -> DataFrame:
    """What an agent loop lands (response_ids, response_mask, outcome_binary, termination) as rollouts for groups.py: lengths,
    trained tokens, and reward 0 for an invalid end."""
    trained = F.aggregate("response_mask", F.lit(0), lambda a, x: a + x)
    return outputs.withColumns({"response_length": F.size("response_ids"), "trained_tokens": trained, "reward": F.when(F.col("termination") == "invalid", 0.0).otherwise(F.coalesce("outcome_binary", F.lit(0.0)))})
