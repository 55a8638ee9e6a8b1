"""Losses of token tables and of evaluated rows; forward passes happen elsewhere and land as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.operators.guards import require

IGNORED = -100
LARGEST, KL_CLAMP = 20.0, 10.0


def target_count(labels: Column) -> Column:
    """How many labels count once they are shifted by one."""
    return F.size(F.filter(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != IGNORED))


def evaluated(rows: DataFrame, loss: str = "loss", labels: str = "labels") -> DataFrame:
    """rows with target_tokens, nll_sum and perplexity."""
    n = target_count(F.col(labels))
    return rows.withColumns({"target_tokens": n, "nll_sum": F.col(loss) * n, "perplexity": F.exp(F.least(F.col(loss), F.lit(LARGEST)))})


def finite_mean(batches: DataFrame, order: str, loss: str, most: int) -> DataFrame:
    """The mean of the finite losses among the first `most` batches; NaN if there is none."""
    x = F.col(loss)
    return batches.orderBy(order).limit(most).agg(F.coalesce(F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)), F.lit(float("nan"))).alias("loss"))


def summarised(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, weighted_loss, mean_loss, perplexity, target_tokens and truncated for each of `keys`; NaN losses without targets."""
    loss = F.coalesce(F.try_divide(F.sum("nll_sum"), F.sum("target_tokens")), F.lit(float("nan")))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), loss.alias("weighted_loss"), F.avg("loss").alias("mean_loss"), F.exp(F.least(loss, F.lit(LARGEST))).alias("perplexity"),
        F.sum("target_tokens").cast("bigint").alias("target_tokens"), F.count_if("truncated").alias("truncated"),
    )


def loss_changes(summaries: DataFrame, model: str, base: str, split: str = "split") -> DataFrame:
    """(model, split, weighted_loss_delta, relative_change_pct) of every other model against the base."""
    b = summaries.where(F.col(model) == base).select(split, F.col("weighted_loss").alias("__base"))
    both = summaries.where(F.col(model) != base).join(b, split)
    delta = F.col("weighted_loss") - F.col("__base")
    return both.select(model, split, delta.alias("weighted_loss_delta"), F.coalesce(F.try_divide(delta, F.col("__base")) * 100, F.lit(float("nan"))).alias("relative_change_pct"))


def row_deltas(base: DataFrame, other: DataFrame, id_col: str = "id", loss: str = "loss") -> DataFrame:
    """(id, base_loss, loss, delta) of the other's rows, by rising delta; a row that the base lacks is an error."""
    b = base.select(id_col, F.col(loss).alias("base_loss"), F.lit(True).alias("__there"))
    both = require(other.join(b, id_col, "left"), F.col("__there"), F.concat(F.lit("a row without a base: "), F.col(id_col).cast("string")))
    return both.select(id_col, "base_loss", F.col(loss).alias("loss"), (F.col(loss) - F.col("base_loss")).alias("delta")).orderBy("delta", id_col)


def policy_loss(tokens: DataFrame, rollout: str, idx: str, advantage: str, length_aware: bool = False, discount: float = 0.0, beta: float = 0.0) -> DataFrame:
    """(rollout, loss, kl): minus advantage times the masked log probabilities, over the number of masked tokens or its root.

    tokens: logp, ref_logp (of the reference policy), mask. discount > 1: a token is weighted by discount ** (masked tokens after
    it), over the mean weight. beta > 0 adds beta times the mean of exp(r) - r - 1 with r = ref_logp - logp within KL_CLAMP.
    Rollouts without a masked token have no row.
    """
    on = tokens.where("mask = 1")
    if discount > 1:
        after = F.count("*").over(Window.partitionBy(rollout)) - F.row_number().over(Window.partitionBy(rollout).orderBy(idx))
        on = on.withColumn("__raw", F.pow(F.lit(discount), after))
        on = on.withColumn("__w", F.col("__raw") / F.avg("__raw").over(Window.partitionBy(rollout)))
    else:
        on = on.withColumn("__w", F.lit(1.0))
    n = F.count("*").cast("double")
    r = F.greatest(F.lit(-KL_CLAMP), F.least(F.lit(KL_CLAMP), F.col("ref_logp") - F.col("logp")))
    kl = F.avg(F.exp(r) - r - 1)
    loss = -F.first(advantage) * F.sum(F.col("logp") * F.col("__w")) / (F.sqrt(n) if length_aware else n)
    return on.groupBy(rollout).agg((loss + beta * kl if beta else loss).alias("loss"), kl.alias("kl"))


def batch_mean(losses: DataFrame) -> DataFrame:
    return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"), F.count("*").alias("rollouts"))


# --- composition of two models ---------------------------------------------------------------------------------------

_OUTCOME = ("action_type_match", "tool_probe_has_tool", "has_protocol_wrapper", "tool_name_match", "arg_exact_match")


def oracle_gate(tools: DataFrame, texts: DataFrame, probe: str = "probe_id") -> DataFrame:
    """Probes as an oracle would gate them: a text probe is answered with text, a tool probe as the tool model does it.

    A tool probe that the tool model lacks is an error where it is read: its fields are null."""
    of = tools.select(probe, *[F.col(c).alias(f"__{c}") for c in ("predicted_action", *_OUTCOME)])
    text = F.col("target_action") == "assistant_text"
    fixed = {"predicted_action": F.lit("assistant_text"), "action_type_match": F.lit(True), **{c: F.lit(False) for c in _OUTCOME[1:]}}
    both = texts.join(of, probe, "left").withColumns({c: F.when(text, v).otherwise(F.col(f"__{c}")) for c, v in fixed.items()})
    return both.withColumns({c: F.when(text, True).otherwise(F.col(c)) for c in ("text_probe_no_tool", "text_probe_nonempty") if c in texts.columns}).drop(*[f"__{c}" for c in fixed])


def gated_tools(gate: DataFrame, tools: DataFrame, probe: str = "probe_id") -> DataFrame:
    """Probes with one model's gate and another's calls: text probes stay, tool probes that the gate misses fail, the others are
    as the tool model does them."""
    of = tools.select(probe, *[F.col(c).alias(f"__{c}") for c in ("predicted_action", *_OUTCOME)])
    text, through = F.col("target_action") == "assistant_text", F.col("predicted_action") == "tool_call"
    new = {c: F.when(text, F.col(c)).when(~through, False).otherwise(F.col("__tool_probe_has_tool" if c == "action_type_match" else f"__{c}")) for c in _OUTCOME}
    new["predicted_action"] = F.when(text | ~through, F.col("predicted_action")).otherwise(F.col("__predicted_action"))
    both = gate.join(of, probe, "left").withColumns({f"__new_{c}": v for c, v in new.items()})
    return both.select(*[F.col(f"__new_{c}").alias(c) if c in new else F.col(c) for c in gate.columns])
