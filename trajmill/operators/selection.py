"""Choosing rows: duplicates, caps, best of n, splits, samples and copies. Every tie-break is in the order by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.operators.ranges import ranked_all, sum_before


def ranked(df: DataFrame, keys: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    return ranked(df, keys, order, "__n").where("__n = 1").drop("__n")


def split_duplicates(df: DataFrame, keys: list, order: list) -> DataFrame:
    """df with duplicate: all but the first row of its keys."""
    return ranked(df, keys, order, "__n").withColumn("duplicate", F.col("__n") > 1).drop("__n")


def first_wins_capped(df: DataFrame, keys: list, group: list, order: list, cap: int) -> DataFrame:
    """The first row of each of `keys`, then at most `cap` of a group."""
    return ranked(first_wins(df, keys, order), group, order, "__n").where(F.col("__n") <= cap).drop("__n")


def preferred_in_place(df: DataFrame, keys: list, later: Column, order: str) -> DataFrame:
    """One row a key: the first that is not `later`, else the first; slot is the place of the key's first row."""
    w = Window.partitionBy(*keys)
    return first_wins(df.withColumn("slot", F.min(order).over(w)), keys, [later.cast("int"), order])


def unique_ids(df: DataFrame, id_col: str, order: list) -> DataFrame:
    """Repeated ids get _dup1, _dup2 and so on."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1
    return df.withColumn("__n", n).withColumn("unique_id", F.when(F.col("__n") == 0, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("_dup"), F.col("__n").cast("string")))).drop("__n")


def best_of(df: DataFrame, task: str, score: str, normal: str, n_tags: str, trial: str, ordinal: str) -> DataFrame:
    """The best candidate a task: score, normalised score, fewer tags, earlier trial (none is last), earlier row."""
    return first_wins(df, [task], [F.desc(score), F.desc(normal), F.asc(n_tags), F.asc_nulls_last(trial), F.asc(ordinal)])


def first_trial(df: DataFrame, task: str, trial: str, ordinal: str) -> DataFrame:
    return first_wins(df, [task], [F.coalesce(F.col(trial), F.lit(0)), F.col(ordinal)])


def rerank_summary(df: DataFrame, task: str, success: Column, score: str, normal: str, n_tags: str, trial: str, ordinal: str) -> DataFrame:
    """Pass rates of the first trial, of a sample, of the oracle and of the chosen candidate, and accuracy where solvable."""
    df = df.withColumn("__ok", success)
    tasks = df.groupBy(task).agg(F.avg(F.col("__ok").cast("int")).alias("sample"), F.max("__ok").alias("oracle"))
    first = first_trial(df, task, trial, ordinal).select(task, F.col("__ok").alias("first"))
    best = best_of(df, task, score, normal, n_tags, trial, ordinal).select(task, F.col("__ok").alias("chosen"))
    one = tasks.join(first, task).join(best, task)
    n, rate = F.count("*"), lambda c: F.avg(F.col(c).cast("int"))
    return one.agg(
        n.alias("tasks"), rate("first").alias("first_rate"), F.avg("sample").alias("sample_rate"), rate("oracle").alias("oracle_rate"), rate("chosen").alias("chosen_rate"),
        (rate("chosen") - rate("first")).alias("gain"), (rate("oracle") - rate("chosen")).alias("gap"),
        F.coalesce(F.count_if(F.col("chosen") & F.col("oracle")) / F.nullif(F.count_if("oracle"), F.lit(0)), F.lit(0.0)).alias("solvable_accuracy"),
    )


def preference_pairs(df: DataFrame, task: str, success: Column, order_success: list, order_failure: list, k: int) -> DataFrame:
    """A task's best success (chosen_*) with each of its first k failures (rejected_*)."""
    named = lambda part, name: part.select(task, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != task])
    best = named(first_wins(df.where(success), [task], order_success), "chosen")
    worst = ranked(df.where(~success), [task], order_failure, "__n").where(F.col("__n") <= k).drop("__n")
    return best.join(named(worst, "rejected"), task)


def _ranged(df: DataFrame, order: list, bucket: Column, value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before in `order`, whose first key `bucket` follows: sums of buckets, which are as
    many as RANGES at most, and a window inside each."""
    df = df.withColumns({"__bucket": bucket, "__v": value})
    sums = df.groupBy("__bucket").agg(F.sum("__v").alias("__s"))
    earlier = sums.select("__bucket", F.coalesce(F.sum("__s").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return df.join(earlier, "__bucket").withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__in", "__before", "__bucket")


def stable_sample(df: DataFrame, id_col: str, ratio: float, seed: int, group: list | None = None) -> DataFrame:
    """Exactly int(n * ratio + 0.5) rows: those with the smallest first 16 hex digits of sha1(seed:id)."""
    df = df.withColumn("__h", F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 16))
    if group:
        n = F.floor(F.count("*").over(Window.partitionBy(*group)) * ratio + 0.5)
        return ranked(df, group, ["__h", id_col], "__n").withColumn("__k", n).where("__n <= __k").drop("__h", "__n", "__k")
    wanted = df.agg(F.floor(F.count("*") * ratio + 0.5).alias("__k"))
    bucket = F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")  # follows the digits' order
    return _ranged(df, ["__h", id_col], bucket, F.lit(1), "__n").join(F.broadcast(wanted)).where("__n < __k").drop("__h", "__n", "__k")


def greedy_tasks(df: DataFrame, task: str, tokens: str, ratio: float, least: int) -> DataFrame:
    """Tasks by falling maximum of tokens (ties: by id) until their rows reach max(least, round(rows * ratio))."""
    tasks = df.groupBy(task).agg(F.max(tokens).alias("most"), F.count("*").alias("n"))
    want = tasks.agg(F.greatest(F.lit(least), F.bround(F.sum("n") * F.lit(ratio), 0)).alias("want"))
    both = tasks.join(F.broadcast(want))  # one row
    return sum_before(both, [F.desc("most"), task], "n", "before").where("before < want").select(task)


def copies(df: DataFrame, id_col: str, n: int, label: str = "repeat") -> DataFrame:
    """Every row and n - 1 more (one row at least): copy 0 keeps its id."""
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))))
    return df.withColumn("copy_id", F.when(F.col("copy") == 0, F.col(id_col).cast("string")).otherwise(F.concat(F.col(id_col).cast("string"), F.lit(f"_{label}"), F.col("copy").cast("string"))))


def length_batches(df: DataFrame, length: str, tie: str, size: int, group: list | None = None) -> DataFrame:
    """Batches of `size` rows by length, within each group."""
    if group:
        return ranked(df, group, [length, tie], "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")
    return ranked_all(df, [length, tie], "__n").withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")
