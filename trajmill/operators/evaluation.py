"""Paired evaluation statistics over tables of rollouts (task, trial, reward)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.functions.stats import binomial_two_sided, pass_hat
from trajmill.operators.ranges import ranked_all
from trajmill.sinks.tables import partitions, written


def task_rates(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Mean of `value` a task: rate, and the number of trials."""
    return df.groupBy(*keys).agg(F.avg(value.cast("double")).alias("rate"), F.count("*").alias("trials"))


def mcnemar(base: DataFrame, cand: DataFrame, task: str = "task_id", solved_at: float = 0.5) -> DataFrame:
    """Tasks of both arms (columns task, rate): flips up and down, both rates, and the exact McNemar p."""
    both = base.select(task, F.col("rate").alias("b")).join(cand.select(task, F.col("rate").alias("c")), task)
    up, down = F.count_if((F.col("b") < solved_at) & (F.col("c") >= solved_at)), F.count_if((F.col("b") >= solved_at) & (F.col("c") < solved_at))
    df = both.agg(F.count("*").alias("tasks"), F.avg("b").alias("base_rate"), F.avg("c").alias("cand_rate"), up.alias("up"), down.alias("down"))
    return df.withColumn("p_value", binomial_two_sided(F.col("up"), F.col("down")))


def outer_flips(base: DataFrame, cand: DataFrame, task: str = "task_id", solved_at: float = 0.5) -> DataFrame:
    """Flips over the tasks of either arm; one that an arm lacks has rate 0 there."""
    both = base.select(task, F.col("rate").alias("b")).join(cand.select(task, F.col("rate").alias("c")), task, "full")
    both = both.select(task, F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("c", F.lit(0.0)).alias("c"))
    up, down = F.count_if((F.col("b") < solved_at) & (F.col("c") >= solved_at)), F.count_if((F.col("b") >= solved_at) & (F.col("c") < solved_at))
    df = both.agg(F.count("*").alias("tasks"), up.alias("up"), down.alias("down"))
    return df.withColumn("p_value", binomial_two_sided(F.col("up"), F.col("down")))


def deltas(base: DataFrame, cand: DataFrame, task: str = "task_id") -> DataFrame:
    return base.select(task, F.col("rate").alias("__b")).join(cand.select(task, F.col("rate").alias("__c")), task).select(task, (F.col("__c") - F.col("__b")).alias("delta"))


def sign_test(df: DataFrame, tie: float = 1e-9) -> DataFrame:
    df = df.agg(F.count_if(F.col("delta") > tie).alias("positive"), F.count_if(F.col("delta") < -tie).alias("negative"))
    return df.withColumn("p_value", binomial_two_sided(F.col("positive"), F.col("negative")))


def micro_macro(df: DataFrame, value: Column, task: str = "task_id") -> DataFrame:
    """The mean over rows, the mean over task means, and the latter's Bernoulli standard error."""
    tasks = df.groupBy(task).agg(F.avg(value.cast("double")).alias("m"), F.sum(value.cast("double")).alias("s"), F.count("*").alias("n"))
    macro = F.avg("m")
    return tasks.agg((F.sum("s") / F.sum("n")).alias("micro"), macro.alias("macro"), F.sqrt(macro * (1 - macro) / F.count("*")).alias("se"), F.count("*").alias("tasks"))


def pass_hat_k(df: DataFrame, success: Column, task: str = "task_id") -> DataFrame:
    """Mean over tasks of C(s, k) / C(n, k), for k up to the least number of trials of a task."""
    tasks = df.groupBy(task).agg(F.count("*").alias("n"), F.count_if(success).alias("s"))
    most = tasks.agg(F.min("n").alias("most"))
    ks = most.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))).alias("k")).repartition(partitions(df.sparkSession), "k")
    counts = tasks.groupBy("n", "s").agg(F.count("*").alias("tasks"))  # as few rows as there are pairs of counts
    return ks.join(F.broadcast(counts)).groupBy("k").agg((F.sum(pass_hat(F.col("n"), F.col("s"), F.col("k")) * F.col("tasks")) / F.sum("tasks")).alias("pass_hat_k"), F.sum("tasks").alias("tasks"))


def split_stats(df: DataFrame, success: Column, label: Column, task: str = "task_id") -> DataFrame:
    """Tasks, trials, successes and macro pass^1 for every label and for all."""
    tasks = df.groupBy(task, label.alias("label")).agg(F.count("*").alias("n"), F.count_if(success).alias("s"))
    out = tasks.rollup("label").agg(F.count("*").alias("tasks"), F.sum("n").alias("trials"), F.sum("s").alias("successes"), F.avg(F.col("s") / F.col("n")).alias("pass_1"))
    return out.withColumn("label", F.coalesce("label", F.lit("overall")))


#: The generator of the reproducible bootstrap.
LCG_A, LCG_C, LCG_MASK, LCG_SEED = 1103515245, 12345, 0x7FFFFFFF, 12345
#: Draws of the congruential generator from one skipped-ahead state, and numbers of the Mersenne Twister between two of its stored states.
_RUN, _NUMBERS = 1 << 16, 1 << 20
#: Values of a block, and the parts in which the replicates' draws meet it.
_BLOCK, _PARTS = 8192, 16
#: Draws that a task meets, about; more make more tasks.
_TASK_DRAWS = 1 << 24
_DRAWN = "block bigint, part int, replicate bigint, at array<int>"


def lcg_after(steps: Column, seed: int = LCG_SEED, then=lambda state: state) -> Column:  # noqa: ANN001
    """`then` of the congruential generator's state after so many steps (under 2**62): its map is affine, so 2**k steps are one map."""

    def step(acc: Column, bit: Column) -> Column:
        ahead = (acc["a"] * acc["s"] + acc["c"]).bitwiseAND(F.lit(LCG_MASK))
        return F.struct(
            F.when(F.getbit(steps, bit) == 1, ahead).otherwise(acc["s"]).alias("s"),
            (acc["a"] * acc["a"]).bitwiseAND(F.lit(LCG_MASK)).alias("a"), (acc["a"] * acc["c"] + acc["c"]).bitwiseAND(F.lit(LCG_MASK)).alias("c"),
        )

    long = lambda x: F.lit(x).cast("bigint")
    first = F.struct(long(seed).alias("s"), long(LCG_A).alias("a"), long(LCG_C).alias("c"))
    bits = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(F.bin(steps)) - 1))
    return F.aggregate(bits, first, step, lambda acc: then(acc["s"]))


def _by_block(key, replicate, i):  # noqa: ANN001, ANN202
    """(by, block, part, replicate, at) of a run of draws: a row for each replicate and block of values, with the places in it."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((i // _BLOCK, replicate))
    replicate, i = replicate[order], i[order]
    block = i // _BLOCK
    first = np.flatnonzero(np.append(True, (replicate[1:] != replicate[:-1]) | (block[1:] != block[:-1]))) if len(i) else np.zeros(0, np.int64)
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(i)).astype(np.int32)), pa.array((i % _BLOCK).astype(np.int32)))
    columns = [pa.array(block[first]), pa.array((replicate[first] % _PARTS).astype(np.int32)), pa.array(replicate[first]), at]
    return pa.RecordBatch.from_arrays([pa.repeat(key, len(first)), *columns], ["by", "block", "part", "replicate", "at"])


def _lcg_draws(arms: DataFrame, by: str, n: int) -> DataFrame:
    """_by_block() of every draw: runs of _RUN draws start at skipped-ahead states, in any task."""

    def draws(batches):  # noqa: ANN001, ANN202
        import numpy as np

        mul, add = np.empty(_RUN, np.int64), np.empty(_RUN, np.int64)
        a, c = 1, 0
        for j in range(_RUN):  # j + 1 steps at once
            a, c = a * LCG_A & LCG_MASK, (c * LCG_A + LCG_C) & LCG_MASK
            mul[j], add[j] = a, c
        for batch in batches:
            for k, (m, replicate, start, state) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                size = min(_RUN, m - start)
                i = (mul[:size] * state + add[:size] & LCG_MASK) % m
                yield _by_block(batch.column(0)[k], np.full(size, replicate), i)

    long = lambda x: F.lit(x).cast("bigint")
    runs = arms.withColumn("replicate", F.explode(F.sequence(long(0), long(n - 1)))).withColumn("__at", F.explode(F.sequence(long(0), F.col("m") - 1, long(_RUN))))
    runs = runs.repartition(partitions(arms.sparkSession), by, "replicate", "__at")
    runs = runs.select(by, "m", "replicate", "__at", lcg_after(F.col("replicate") * F.col("m") + F.col("__at")).alias("state"))
    return runs.mapInArrow(draws, f"by {dict(arms.dtypes)[by]}, {_DRAWN}")


def _twister(state: tuple | bytes):  # noqa: ANN202
    """numpy's Mersenne Twister at a state: Python's (a tuple), or 624 words and the place as 32-bit numbers."""
    import numpy as np

    words = np.frombuffer(state, np.uint32) if isinstance(state, bytes) else np.array(state, np.uint32)
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": words[:624], "pos": int(words[624])}}
    return bits


def _twister_draws(arms: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    """_by_block() of what Python's randrange(m) draws, one after the other. A number is used if its first bits are below m,
    so where a draw begins is known only to one pass over the generator, which keeps its states; a second pass draws from them in
    any task."""
    kind = dict(arms.dtypes)[by]

    def states(batches):  # noqa: ANN001, ANN202
        import random

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                m, before, bits = row["m"], 0, _twister(random.Random(seed).getstate()[1])
                shift = np.uint64(32 - m.bit_length())
                while before < n * m:
                    at = bits.state["state"]
                    state = np.append(at["key"], np.uint32(at["pos"])).astype(np.uint32).tobytes()
                    used = int(np.count_nonzero(bits.random_raw(_NUMBERS) >> shift < m))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([batch.column(0).to_pylist().index(row[by])])), pa.array([m], pa.int64()), pa.array([before], pa.int64()), pa.array([state], pa.binary())], [by, "m", "before", "state"])
                    before += used

    def draws(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                m, total = row["m"], n * row["m"]
                i = _twister(row["state"]).random_raw(_NUMBERS) >> np.uint64(32 - m.bit_length())
                i = i[i < m][: total - row["before"]].astype(np.int64)
                at = row["before"] + np.arange(len(i))
                yield _by_block(batch.column(0)[k], at // m, i)

    kept = written(arms.mapInArrow(states, f"{by} {kind}, m bigint, before bigint, state binary"))
    return kept.repartition(partitions(arms.sparkSession), by, "before").mapInArrow(draws, f"by {kind}, {_DRAWN}")


def _drawn_sums(drawn: DataFrame, values: DataFrame, total: int) -> DataFrame:
    """(by, replicate, mean): the draws' values, summed. values: by, i (from 0), v. A block's values go ahead of the draws of it, and a
    task holds one block at a time."""
    kind = dict(values.dtypes)["by"]
    blocks = values.groupBy("by", F.floor(F.col("i") / _BLOCK).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("values"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    none = lambda t: F.lit(None).cast(t)
    both = blocks.select("by", "block", "part", none("bigint").alias("replicate"), none("array<int>").alias("at"), "values").unionByName(drawn.withColumn("values", none("array<double>")))
    size = max(partitions(values.sparkSession), total // _TASK_DRAWS)
    met = both.repartition(size, "by", "block", "part").sortWithinPartitions("by", "block", "part", F.col("replicate").asc_nulls_first())

    def sums(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        block = valid = None
        for batch in batches:
            replicates = batch.column(3)
            edges = [*np.flatnonzero(np.asarray(replicates.is_null())).tolist(), len(batch)]  # where blocks begin
            for a, b in zip([0, *edges[:-1]] if edges[0] else edges[:-1], edges if edges[0] else edges[1:], strict=True):
                if not replicates[a].is_valid:
                    own = batch.column(5)[a].values
                    block, valid = own.to_numpy(zero_copy_only=False), np.asarray(own.is_valid())
                    block = np.where(valid, block, 0.0)
                    a += 1
                rows = batch.slice(a, b - a)
                if not len(rows):
                    continue
                ends = np.cumsum(np.asarray(rows.column(4).value_lengths()).astype(np.int64))
                at = np.asarray(rows.column(4).flatten())
                first = np.append(0, ends[:-1])
                s, c = np.add.reduceat(block[at], first), np.add.reduceat(valid[at].astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(3), pa.array(s), pa.array(c)], ["by", "replicate", "s", "c"])

    summed = met.mapInArrow(sums, f"by {kind}, replicate bigint, s double, c bigint").groupBy("by", "replicate").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return summed.select("by", "replicate", F.try_divide(F.col("s"), F.col("c")).alias("mean"))


def bootstrap_interval(df: DataFrame, by: str, order: str, value: str, n: int = 10_000, generator: str = "lcg", seed: int = 0) -> DataFrame:
    """95 % bootstrap interval of the mean of `value` for each `by`, over its rows sorted by `order`: (by, n, low, high).

    `lcg` draws by a 31-bit congruential generator, `mt` by Python's (with `seed`); both give the draws of one generator that is run
    from replicate to replicate, but in many tasks. The draws, four bytes each, go to blocks of the values and are summed a replicate.
    """
    rows = ranked_all(df.select(by, order, value), [by, order, value], "__n")
    arms = written(rows.groupBy(by).agg(F.count("*").alias("m"), F.min("__n").alias("__first")))
    values = rows.join(arms, by).select(F.col(by).alias("by"), (F.col("__n") - F.col("__first")).alias("i"), F.col(value).cast("double").alias("v"))
    pairs = arms.select(by, "m")
    drawn = _lcg_draws(pairs, by, n) if generator == "lcg" else _twister_draws(pairs, by, n, seed)
    total = n * (arms.agg(F.sum("m")).first()[0] or 0)
    means = _drawn_sums(drawn, values, total).withColumnRenamed("by", by)
    place = F.row_number().over(Window.partitionBy(by).orderBy("mean")) - 1  # n rows
    ends = means.withColumn("__at", place).groupBy(by).agg(*[F.max(F.when(F.col("__at") == int(q * n), F.col("mean"))).alias(c) for c, q in (("low", 0.025), ("high", 0.975))])
    return ends.join(pairs, by).select(by, F.col("m").alias("n"), "low", "high")


def numeric_order(task: str = "task_id") -> list[Column]:
    """Ids that are integers by value, the others after 10**9 by text."""
    return [F.coalesce(F.col(task).try_cast("bigint"), F.lit(1_000_000_000)), F.col(task)]
