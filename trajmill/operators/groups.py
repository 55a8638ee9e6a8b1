"""Group-relative analytics: advantages, gates, and what dead groups cost.

A group is the rows of one key. All of these are one window (or one aggregate) over the key, so a plan has one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How near to 1 a reward must come to be a success.
TOLERANCE = 1e-6


def success_at_least(reward: Column) -> Column:
    return reward >= 1.0 - TOLERANCE


def success_in_band(reward: Column) -> Column:
    """Shaped rewards above 1 are not successes here."""
    return (reward >= 1.0 - TOLERANCE) & (reward <= 1.0 + TOLERANCE)


def success_strict(reward: Column) -> Column:
    """A reward that can't be read as a number is a failure."""
    return F.coalesce(reward.try_cast("double") >= 1.0, F.lit(False))


def _contrast(window: Window, outcome: str) -> Column:
    """Whether a group has two rows and two outcomes."""
    return (F.count("*").over(window) >= 2) & (F.min(outcome).over(window) < F.max(outcome).over(window))


def _clipped(value: Column, clip: float | None) -> Column:
    return value if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), value))


def population_advantage(df: DataFrame, key: str, value: str, gate_on: str | None, floor: float = 0.25, clip: float | None = 3.0, name: str = "advantage") -> DataFrame:
    """(value - mean) / (population deviation + floor), clipped; 0 in groups without contrast in `gate_on`."""
    w = Window.partitionBy(key)
    spread = F.when(F.min(value).over(w) == F.max(value).over(w), 0.0).otherwise(F.stddev_pop(value).over(w))
    raw = _clipped((F.col(value) - F.avg(value).over(w)) / (spread + floor), clip)
    return df.withColumn(name, raw if gate_on is None else F.when(_contrast(w, gate_on), raw).otherwise(0.0))


def sample_advantage(df: DataFrame, key: str, value: str, epsilon: float = 1e-6, name: str = "advantage") -> DataFrame:
    """(value - mean) / (sample deviation + epsilon); the only row of a group keeps its value."""
    w = Window.partitionBy(key)
    spread = F.when(F.min(value).over(w) == F.max(value).over(w), 0.0).otherwise(F.stddev_samp(value).over(w))
    one = F.count("*").over(w) == 1
    return df.withColumn(name, F.when(one, F.col(value) / (1.0 + epsilon)).otherwise((F.col(value) - F.avg(value).over(w)) / (spread + epsilon)))


def gated_advantage(df: DataFrame, key: str, value: str, outcome: str, epsilon: float = 1e-6, floor: float = 0.0, clip: float | None = None, name: str = "advantage", keep: str = "keep") -> DataFrame:
    """sample_advantage of groups with contrast in `outcome`; the others have advantage 0 and are not kept."""
    w = Window.partitionBy(key)
    live = _contrast(w, outcome)
    spread = F.when(F.min(value).over(w) == F.max(value).over(w), 0.0).otherwise(F.stddev_samp(value).over(w))
    raw = _clipped((F.col(value) - F.avg(value).over(w)) / (spread + floor + epsilon), clip)
    return df.withColumn(name, F.when(live, raw).otherwise(0.0)).withColumn(keep, live)


def group_state(df: DataFrame, key: str, outcome: str, score: str, std_eps: float = 1e-8) -> DataFrame:
    """A row a group: its size, and whether it is dead by each of the rules in use."""
    agg = df.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct(score).alias("raw"), F.countDistinct(F.round(F.col(outcome), 6)).alias("rounded"),
        F.countDistinct(success_at_least(F.col(outcome))).alias("binary"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("sd"),
    )
    return agg.select(
        key, "n", (F.col("raw") <= 1).alias("dead_raw"), (F.col("binary") <= 1).alias("dead_binary"),
        ((F.col("n") < 2) | (F.col("rounded") < 2)).alias("dead_outcome"), ((F.col("n") < 2) | (F.col("sd") <= std_eps)).alias("dead_std"),
    )


def group_stats(states: DataFrame, dead: str) -> DataFrame:
    """Kept and dropped rows and groups, the live share and its inverse (4 digits), for one rule."""
    rows, groups = F.sum("n"), F.count("*")
    kept = F.coalesce(F.sum(F.when(~F.col(dead), F.col("n"))), F.lit(0))
    live = F.count_if(~F.col(dead))
    return states.agg(
        kept.alias("kept_rows"), (F.coalesce(rows, F.lit(0)) - kept).alias("dropped_rows"), live.alias("kept_groups"), (groups - live).alias("dropped_groups"),
        F.coalesce(F.round(kept / rows, 4), F.lit(1.0)).alias("live_frac"), F.when(kept > 0, F.round(rows / kept, 4)).otherwise(F.lit(float("inf"))).alias("loss_scale"),
    )


def dead_weight(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """The share of rows in groups without contrast."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"), ((F.count("*") < 2) | (F.min(outcome) == F.max(outcome))).alias("dead"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("dead"), F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("dead_weight"))


def mask_dead(df: DataFrame, key: str, outcome: str, mask: str) -> DataFrame:
    """`mask` (an array) is all zeros in groups without contrast; nothing happens where there is no outcome column."""
    if outcome not in df.columns:
        return df
    w = Window.partitionBy(key)
    return df.withColumn(mask, F.when(_contrast(w, outcome), F.col(mask)).otherwise(F.transform(mask, lambda _: F.lit(0))))


def without_signal(df: DataFrame, advantage: str = "advantage", eps: float = 1e-8) -> DataFrame:
    return df.where(F.abs(F.col(advantage)) >= eps)


def batch_summary(df: DataFrame, advantage: str = "advantage") -> DataFrame:
    a = F.col(advantage)
    return df.agg(F.count("*").alias("usable"), F.coalesce(F.avg(F.abs(a)), F.lit(0.0)).alias("mean_abs_advantage"), F.count_if(a > 0).alias("positive"), F.count_if(a < 0).alias("negative"))


def accumulate_live(df: DataFrame, batch: str, key: str, row: str, outcome: str, target: int) -> DataFrame:
    """The rows of the first `target` live groups, in order of batch and first row."""
    groups = df.groupBy(batch, key).agg(F.min(row).alias("__first"), ((F.count("*") >= 2) & (F.min(outcome) < F.max(outcome))).alias("__live"))
    first = groups.where("__live").orderBy(batch, "__first").limit(target)
    return df.join(first.select(batch, key), [batch, key], "left_semi")
