"""Live groups gathered from a stream of rollouts until there are enough."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajmill.streaming.agent_loop import with_state_store


def live_rows(batch: DataFrame, key: str, outcome: str) -> DataFrame:
    w = Window.partitionBy(key)
    return batch.withColumn("__live", (F.count("*").over(w) >= 2) & (F.min(outcome).over(w) < F.max(outcome).over(w))).where("__live").drop("__live")


class Group(StatefulProcessor):
    """Holds a group's rows until it has `size` of them; then gives them out if their outcomes differ, and forgets all but that it is over."""

    def __init__(self, columns: list[str], outcome: str, size: int, schema: str):
        self.columns, self.outcome, self.size, self.schema = columns, outcome, size, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.over = handle.getValueState("over", "over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        came = [tuple(r[c] for c in self.columns) for r in rows]
        if self.over.exists():
            return
        held = [*(tuple(r) for r in self.rows.get()), *came] if self.rows.exists() else came
        if len(held) < self.size:
            self.rows.appendList(came)
            return
        self.rows.clear()
        self.over.update((True,))
        outcomes = [r[self.columns.index(self.outcome)] for r in held if r[self.columns.index(self.outcome)] is not None]
        if len(held) >= 2 and outcomes and min(outcomes) < max(outcomes):
            for r in held:
                yield Row(**dict(zip(self.columns, r, strict=True)))

    def close(self) -> None:
        pass


def whole_groups(stream: DataFrame, key: str, outcome: str, size: int) -> DataFrame:
    """The rows of live groups of `size` rows (or more, if more come at once), given out in the batch that brings the last of them, whatever
    batches brought the others."""
    with_state_store(stream.sparkSession)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in stream.dtypes)
    return stream.groupBy(key).transformWithState(Group(stream.columns, outcome, size, schema), schema, "Append", "None")


def accumulate(stream: DataFrame, key: str, row: str, outcome: str, target: int, most_batches: int, path: str, checkpoint: str, group_size: int | None = None) -> StreamingQuery:
    """Writes the rows of the first `target` live groups to `path`, a folder a micro-batch.

    With `group_size` a group is that many rows of a key, whichever batches bring them; else the rows of a key within one micro-batch. Each
    batch overwrites its own folder and number of groups, so a repeated batch changes nothing, and reads the earlier batches' numbers. Fails
    when `most_batches` did not bring enough groups.
    """
    if group_size is not None:
        stream = whole_groups(stream, key, outcome, group_size)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = lambda i: f"{path}_groups/batch={i}"
        have = 0
        if number:
            have = spark.read.schema("n bigint").option("ignoreMissingFiles", True).parquet(*[counts(i) for i in range(number)]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        batch = batch.persist()
        batch.count()  # all of a stateful batch is processed, also where no more groups are wanted
        live = live_rows(batch, key, outcome)
        first = live.groupBy(key).agg(F.min(row).alias("__first")).orderBy("__first").limit(max(0, target - have)).select(key)
        live.join(first, key, "left_semi").write.mode("overwrite").parquet(f"{path}/batch={number}")
        found = first.count()
        spark.createDataFrame([(found,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(counts(number))
        batch.unpersist()
        if number + 1 >= most_batches and have + found < target:
            raise RuntimeError(f"{most_batches} batches brought {have + found} of {target} live groups")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
