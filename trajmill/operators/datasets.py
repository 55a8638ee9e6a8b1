"""Training samples from ordered messages, their checks and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collected(messages: DataFrame, conv: str, idx: str, fields: list[str]) -> DataFrame:
    """One row a conversation with its messages in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), *fields)))
    return messages.groupBy(conv).agg(rows.alias("messages"))


def prefix_samples(convs: DataFrame, conv: str, target_role: str = "assistant") -> DataFrame:
    """A sample for each message of the role: all before it and itself, with the mask that trains on it alone."""
    df = convs.select(conv, "messages", F.posexplode("messages").alias("turn", "target")).where(F.col("target.role") == target_role)
    df = df.withColumn("messages", F.slice("messages", F.lit(1), F.col("turn") + 1))
    return df.withColumn("loss_mask", last_only_mask(F.col("messages"))).withColumn("id", F.concat_ws("_", F.col(conv).cast("string"), F.lit("t"), F.col("turn").cast("string")))


def last_only_mask(messages: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(False), F.greatest(F.size(messages) - 1, F.lit(0))), F.array(F.lit(True)))


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.bround(chars / 4, 0).cast("bigint"))


def structure_errors(messages: Column, mask: Column, roles: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> Column:
    """Codes of what is wrong with a sample, in a fixed order."""
    wrong = {
        "empty": F.size(messages) == 0,
        "unknown_role": F.exists(messages, lambda m: ~m["role"].isin(*roles)),
        "mask_length": F.size(mask) != F.size(messages),
        "last_not_assistant": F.coalesce(F.get(messages, F.size(messages) - 1)["role"] != "assistant", F.lit(False)),
        "target_not_assistant": F.exists(F.arrays_zip(messages.alias("m"), mask.alias("k")), lambda z: F.coalesce(z["k"], F.lit(False)) & (z["m"]["role"] != "assistant")),
        "no_target": ~F.exists(mask, lambda k: k),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in wrong.items()]), lambda x: x.isNotNull())


def first_reason(checks: dict[str, Column]) -> Column:
    """The first check that fails, in order; null for a clean row."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in checks.items()], F.lit(None).cast("string"))


def profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, mean, maximum, and nearest-rank p50 and p90 of `value` for each key: ranks by a window over (key, value) counts."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(key))
    ranks = counts.withColumns({"__upto": upto, "__n": total})
    at = lambda q: F.bround((F.col("__n") - 1) * F.lit(q), 0)
    pick = lambda q: F.min(F.when(F.col("__upto") > at(q), F.col(value)))
    return ranks.groupBy(key).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max(value).alias("max"), pick(0.5).alias("p50"), pick(0.9).alias("p90"))


def confusion(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Counts a (target, prediction) with the target's recall."""
    cells = df.groupBy(target, pred).agg(F.count("*").alias("n"))
    w = Window.partitionBy(target)
    return cells.withColumn("recall", F.coalesce(F.sum(F.when(F.col(target) == F.col(pred), F.col("n"))).over(w), F.lit(0)) / F.sum("n").over(w))


def guarded_rate(hit: Column, within: Column) -> Column:
    """The share of hits in a subset; 0 if that is empty."""
    return F.coalesce(F.count_if(hit & within) / F.nullif(F.count_if(within), F.lit(0)), F.lit(0.0))


def padded(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether a half-open interval that isn't empty meets one of the spans."""
    return (end > start) & F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def masked_loss(df: DataFrame, key: str, logp: str, mask: str, length_aware: bool = False) -> DataFrame:
    """The negative log likelihood a masked token, or a square root of the number of masked tokens."""
    n = F.sum(F.col(mask).cast("double"))
    scale = F.sqrt(n) if length_aware else n
    return df.groupBy(key).agg(F.coalesce(F.sum(-F.col(logp) * F.col(mask)) / F.nullif(scale, F.lit(0.0)), F.lit(0.0)).alias("loss"), n.cast("bigint").alias("tokens"))


def token_weighted(df: DataFrame, nll: str, tokens: str) -> DataFrame:
    loss = F.sum(nll) / F.sum(tokens)
    return df.agg(loss.alias("loss"), F.avg(F.col(nll) / F.col(tokens)).alias("mean_loss"), F.exp(F.least(loss, F.lit(20.0))).alias("perplexity"))


def missing_cells(tasks: DataFrame, trials: int, done: DataFrame, task: str, trial: str) -> DataFrame:
    """The (task, trial) pairs of the grid that are not done."""
    grid = tasks.select(task).distinct().withColumn(trial, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return grid.join(done.select(task, trial), [task, trial], "left_anti")


def composed(gate: DataFrame, tools: DataFrame, probe: str, decision: str, call: str) -> DataFrame:
    """Gate decisions of one model with the tool fields of another; without a tool decision there is no call."""
    both = gate.select(probe, decision).join(tools.select(probe, call), probe)
    return both.withColumn(call, F.when(F.col(decision) == "tool_call", F.col(call)))


def bucket(tokens: Column) -> Column:
    """The sequence length to train with."""
    return F.when(tokens <= 4096, 4096).when(tokens <= 8192, 8192).when(tokens <= 16384, 16384).otherwise(32768)
