"""Ordered windows over a trajectory's steps (columns traj, idx, tool, args, is_error, ...).

All rules share the partitioning by trajectory and its order, so a plan that uses several of them sorts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Taxonomy:
    read: frozenset[str]
    write: frozenset[str]
    escalation: frozenset[str]
    think: frozenset[str]

    def has(self, tool: Column, kind: str) -> Column:
        return tool.isin(sorted(getattr(self, kind)))


def _w(traj: str, idx: str) -> Window:
    return Window.partitionBy(traj).orderBy(idx)


def signature(tool: Column, args: Column) -> Column:
    return F.concat_ws("\x1f", F.coalesce(tool, F.lit("")), F.lower(F.coalesce(args, F.lit(""))))


def redundant(tool: Column, args: Column, thinks: Column, traj: str = "traj", idx: str = "idx", window: int = 3) -> Column:
    """Whether one of the `window` steps before, thoughts aside, was the same call."""
    sig = signature(tool, args)
    before = F.collect_list(F.when(~thinks, sig)).over(_w(traj, idx).rowsBetween(-window, -1))
    return ~thinks & F.array_contains(before, sig)


def after_error(tool: Column, args: Column, error: Column, thinks: Column, traj: str = "traj", idx: str = "idx") -> Column:
    """`repeated` or `recovered` for a call right after a failed step, else null."""
    w, sig = _w(traj, idx), signature(tool, args)
    failed = F.coalesce(F.lag(error).over(w), F.lit(False)) & ~thinks
    return F.when(failed & (F.lag(sig).over(w) == sig), "repeated").when(failed, "recovered")


def before_any(condition: Column, traj: str = "traj", idx: str = "idx") -> Column:
    """Whether the condition held in some earlier step."""
    return F.coalesce(F.max(condition.cast("int")).over(_w(traj, idx).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1


def first_of_its_kind(tool: Column, condition: Column, traj: str = "traj", idx: str = "idx") -> Column:
    return condition & (F.row_number().over(Window.partitionBy(traj, tool).orderBy(idx)) == 1)


def rolling_mean(value: Column, window: int, traj: str = "traj", idx: str = "idx") -> Column:
    return value if window <= 1 else F.avg(value).over(_w(traj, idx).rowsBetween(-(window - 1), 0))


def as_of_before(value: Column, traj: str = "traj", idx: str = "idx", *also: str) -> Column:
    """The last value that is not null strictly before a step (of the same further keys)."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(traj, *also).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1))


def next_after(value: Column, traj: str = "traj", idx: str = "idx") -> Column:
    """The first value that is not null strictly after a step."""
    return F.first(value, ignorenulls=True).over(_w(traj, idx).rowsBetween(1, Window.unboundedFollowing))


def own_result(steps: DataFrame, results: DataFrame, traj: str, call_id: str, idx: str, content: str) -> DataFrame:
    """steps (calls, with idx) with `content`, the reply of their id (the last of several), else the first reply after them.

    results: traj, idx, reply_to, content. The second half is one window over calls and replies together, not a range join."""
    by_id = results.where("reply_to != ''").groupBy(traj, F.col("reply_to").alias(call_id)).agg(F.max_by(content, idx).alias("__own"))
    marks = results.select(traj, F.col(idx).alias("__at"), F.lit(0).alias("__call"), F.struct(F.col(content).alias("c")).alias("__reply")).unionByName(steps.select(traj, F.col(idx).alias("__at")).distinct().withColumn("__call", F.lit(1)).withColumn("__reply", F.lit(None).cast(f"struct<c:{dict(results.dtypes)[content]}>")))
    after = F.first("__reply", ignorenulls=True).over(Window.partitionBy(traj).orderBy("__at").rangeBetween(1, Window.unboundedFollowing))
    following = marks.withColumn("__next", after).where("__call = 1").select(traj, F.col("__at").alias(idx), "__next")
    both = steps.join(by_id, [traj, call_id], "left").join(following, [traj, idx], "left")
    return both.withColumn(content, F.coalesce("__own", F.col("__next.c"), F.lit(""))).drop("__own", "__next")


def seen_before(value: Column, traj: str = "traj", idx: str = "idx") -> Column:
    """The sorted distinct values of the steps before."""
    return F.array_sort(F.collect_set(value).over(_w(traj, idx).rowsBetween(Window.unboundedPreceding, -1)))


def chained(df: DataFrame, asked: Column, found: Column, traj: str = "traj", idx: str = "idx", name: str = "chained") -> DataFrame:
    """df with `name`: whether one of a step's texts `asked` (array) is among those `found` (array) at earlier steps of its trajectory.

    Each text's first step is known from one window over (trajectory, text), so nothing is gathered and a long trajectory is linear work."""
    said = lambda texts, kind: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(kind).alias("found")))
    long = df.select(traj, idx, F.explode(F.array_distinct(F.concat(said(asked, False), said(found, True)))).alias("__s"))
    first = F.min(F.when(F.col("__s.found"), F.col(idx))).over(Window.partitionBy(traj, "__s.t"))
    hits = long.withColumn("__first", first).where(~F.col("__s.found") & (F.col("__first") < F.col(idx))).select(traj, idx).distinct()
    return df.join(hits.withColumn(name, F.lit(True)), [traj, idx], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def offsets(length: Column, traj: str = "traj", idx: str = "idx") -> Column:
    """Where a segment starts when the trajectory's segments are laid end to end."""
    return F.coalesce(F.sum(length).over(_w(traj, idx).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def island(breaks: Column, traj: str = "traj", idx: str = "idx") -> Column:
    """The number of the stretch of steps between breaks; a break starts one."""
    return F.sum(breaks.cast("int")).over(_w(traj, idx))


def turn_weights(df: DataFrame, alpha: float, traj: str = "traj", idx: str = "idx", name: str = "weight") -> DataFrame:
    """alpha ** (steps to the last one), divided by the trajectory's mean weight."""
    every = Window.partitionBy(traj)
    raw = F.pow(F.lit(alpha), F.count("*").over(every) - F.row_number().over(_w(traj, idx)))
    return df.withColumn("__raw", raw).withColumn(name, F.col("__raw") / F.avg("__raw").over(every)).drop("__raw")


def trimmed_to_budget(df: DataFrame, tokens: str, budget: int, role: str, traj: str = "traj", idx: str = "idx") -> DataFrame:
    """The longest suffix whose tokens fit the budget, and the last message in any case; tool replies at its head go."""
    after = F.sum(tokens).over(_w(traj, idx).rowsBetween(0, Window.unboundedFollowing))
    last = F.max(idx).over(Window.partitionBy(traj))
    kept = df.withColumn("__last", F.col(idx) == last).withColumn("__kept", (after <= budget) | (F.col(idx) == last)).where("__kept")
    start = F.min(F.when((F.col(role) != "tool") | F.col("__last"), F.col(idx))).over(Window.partitionBy(traj))
    return kept.withColumn("__start", start).where(F.col(idx) >= F.col("__start")).drop("__last", "__kept", "__start")


#: What the rules of the dense step score are worth.
PLACEHOLDER_WRITE, PLACEHOLDER, REDUNDANT, REPEATED, RECOVERED = -0.05, -0.03, -0.03, -0.04, 0.05
BLIND_ESCALATION, ESCALATION, CHAIN_WRITE, CHAIN, FIRST_READ, THOUGHT, TERSE = -0.10, -0.05, 0.08, 0.04, 0.01, 0.01, -0.02
NO_THOUGHT, WIDE_READS, LONG_STEP, LONG_AFTER, CLAMP, TERSE_CHARS = -0.05, 0.01, -0.01, 16, 0.5, 30


def step_scores(df: DataFrame, tax: Taxonomy, traj: str = "traj", idx: str = "idx") -> DataFrame:
    """df (tool, args, is_error, content, placeholder, chained) with step_score.

    placeholder: whether the arguments hold one; chained: whether one occurs in an earlier result.
    """
    tool, args = F.col("tool"), F.col("args")
    kind = {k: tax.has(tool, k) for k in ("read", "write", "escalation", "think")}
    w = _w(traj, idx)
    call = ~kind["think"]
    base = {
        "__redundant": redundant(tool, args, kind["think"], traj, idx), "__after": after_error(tool, args, F.col("is_error"), kind["think"], traj, idx),
        "__read": before_any(kind["read"], traj, idx), "__first": first_of_its_kind(tool, kind["read"], traj, idx),
        "__lag": F.coalesce(F.lag(kind["think"]).over(w), F.lit(False)), "__last": F.lead(tool).over(w).isNull(), "__at": F.row_number().over(w),
        # the next call's redundancy counts the thought's own place in the window
        "__next_bad": F.coalesce(F.lead("placeholder").over(w), F.lit(False)),
    }
    df = df.withColumns(base)
    df = df.withColumn("__next_redundant", F.coalesce(F.lead("__redundant").over(w), F.lit(False)))
    some = lambda condition, value: F.when(condition, value).otherwise(0.0)
    length = F.length(F.coalesce(F.col("content"), F.lit("")))
    score = (
        some(call & F.col("placeholder"), F.when(kind["write"], PLACEHOLDER_WRITE).otherwise(PLACEHOLDER))
        + some(F.col("__redundant"), F.lit(REDUNDANT))
        + F.when(F.col("__after") == "repeated", REPEATED).when(F.col("__after") == "recovered", RECOVERED).otherwise(0.0)
        + some(kind["escalation"], F.when(F.col("__read"), ESCALATION).otherwise(BLIND_ESCALATION))
        + some(call & F.col("chained") & (F.col("__at") > 1), F.when(kind["write"], CHAIN_WRITE).otherwise(CHAIN))
        + some(F.col("__first"), F.lit(FIRST_READ))
        + some(kind["think"] & ~F.col("__lag") & ~F.col("__last") & ~F.col("__next_bad") & ~F.col("__next_redundant"), F.lit(THOUGHT))
        + some(call & (length > 0) & (length < TERSE_CHARS), F.lit(TERSE))
    )
    return df.withColumn("step_score", score).drop(*base, "__next_redundant")


def process_scores(df: DataFrame, tax: Taxonomy, traj: str = "traj", idx: str = "idx") -> DataFrame:
    """(traj, process_score): the mean step score with what is counted a trajectory, within CLAMP of 0."""
    scored = step_scores(df, tax, traj, idx)
    n, tool = F.count("*"), F.col("tool")
    out = scored.groupBy(traj).agg(
        F.avg("step_score").alias("m"), n.alias("n"), F.count_if(tax.has(tool, "think")).alias("thoughts"), F.countDistinct(F.when(tax.has(tool, "read"), tool)).alias("reads")
    )
    total = (
        F.col("m") + F.when((F.col("thoughts") == 0) & (F.col("n") >= 3), NO_THOUGHT).otherwise(0.0) + F.when(F.col("reads") >= 3, WIDE_READS).otherwise(0.0)
        + F.greatest(F.lit(0), F.col("n") - LONG_AFTER) * LONG_STEP
    )
    return out.select(traj, F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), total)).alias("process_score"))
