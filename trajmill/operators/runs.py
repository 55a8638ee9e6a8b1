"""Outcomes of simulations, summaries of runs and their comparison, and the samples that are made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.operators import groups
from trajmill.operators.selection import stable_sample
from trajmill.operators.guards import require_all, require_unique

# Fixed value: the tools that write.
WRITE_TOOLS = ("book_reservation", "cancel_reservation", "send_certificate", "update_reservation_baggages", "update_reservation_flights", "update_reservation_passengers")


def outcomes(sims: DataFrame, missing_is_zero: bool = False) -> DataFrame:
    """sims with reward (null where it is missing, or 0), db_match (null: not checked) and communicate (null: not checked)."""
    info = F.col("reward_info")
    reward = info["reward"]
    return sims.withColumns({"reward": F.coalesce(reward, F.lit(0.0)) if missing_is_zero else reward, "db_match": F.when(info["db_check"].isNotNull(), F.coalesce(info["db_check"]["db_match"], F.lit(False))), "communicate": F.try_element_at(info["reward_breakdown"], F.lit("COMMUNICATE"))})


def fallback_key(*keys: str) -> Column:
    """The first key that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys])


def run_counters(df: DataFrame, run: str | None = None) -> DataFrame:
    """(run, counter, value, n): how often simulations ended in each way, and what their checks found. One pass: each row counts
    three times before the shuffle."""
    db = F.when(F.col("db_match").isNull(), "not_checked").when(F.col("db_match"), "match").otherwise("mismatch")
    cell = lambda name, value: F.struct(F.lit(name).alias("counter"), value.alias("value"))
    cells = F.array(cell("termination", F.coalesce("termination_reason", F.lit("None"))), cell("db", db), cell("communicate", F.coalesce(F.col("communicate").cast("string"), F.lit("not_checked"))))
    keys = [F.col(run).alias("run")] if run else []
    return df.select(*keys, F.explode(cells).alias("c")).groupBy(*(["run"] if run else []), "c.counter", "c.value").agg(F.count("*").alias("n"))


def run_summary(df: DataFrame, run: str) -> DataFrame:
    """A row a run: tasks, sims, avg_reward (of rewards that are there; 0 if none) and success_count."""
    return df.groupBy(run).agg(F.countDistinct("task_id").alias("tasks"), F.count("*").alias("sims"), F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"), F.count_if(groups.success_in_band(F.col("reward"))).alias("success_count"))


def compared(df: DataFrame, run: str, ks: tuple[int, ...] = (1, 2, 3, 4), scores: DataFrame | None = None) -> DataFrame:
    """A row a run for a comparison table: run_summary, pass^k, what the database and communication checks found, and (scores:
    run and more columns) its process scores. pass^k is null where a task of the run has fewer trials."""
    base = run_summary(df, run)
    db = df.groupBy(run).agg(F.count_if(F.col("db_match")).alias("db_match"), F.count_if(~F.col("db_match")).alias("db_mismatch"), F.count_if(F.col("communicate") == 1.0).alias("communicate_full"))
    tasks = df.groupBy(run, "task_id").agg(F.count("*").alias("n"), F.count_if(groups.success_in_band(F.col("reward"))).alias("s"))
    chance = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.col("s") - i, F.lit(0)) / F.nullif(F.col("n") - i, F.lit(0)))
    rates = tasks.groupBy(run).agg(*[F.when(F.min("n") >= k, F.avg(F.when(F.col("n") >= k, chance(k)))).alias(f"pass_{k}") for k in ks])
    out = base.join(rates, run).join(db, run)
    return out.join(scores, run, "left") if scores is not None else out


def score_summary(df: DataFrame, score: str = "process_score") -> DataFrame:
    """Means of the process score: of all, of successes, of the rest (a missing reward is no success); null where there is none."""
    ok = F.coalesce(groups.success_in_band(F.col("reward")), F.lit(False))
    return df.agg(
        F.count("*").alias("num_simulations"), F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"), F.count_if(ok).alias("success_count"), F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score"),
        F.avg(F.when(ok, F.col(score))).alias("avg_score_success"), F.avg(F.when(~ok, F.col(score))).alias("avg_score_failure"),
    )


def tag_counts(df: DataFrame, tags: str = "risk_tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def evaluator_tags(reward: Column, score: Column, tags: Column, low: float = 0.0) -> Column:
    """The risk tags with those of the evaluator: `evaluator_gap` (a failure that the process score does not explain) and
    `unclassified_failure` (a failure without any tag)."""
    failed = ~F.coalesce(groups.success_in_band(reward), F.lit(False))
    more = F.array(F.when(failed & (score >= low), F.lit("evaluator_gap")), F.when(failed & (F.size(tags) == 0), F.lit("unclassified_failure")))
    return F.array_sort(F.array_distinct(F.concat(tags, F.filter(more, lambda t: t.isNotNull()))))


def top_values(df: DataFrame, value: str, order: str, n: int = 12) -> DataFrame:
    """The n most frequent values with their counts; of equal counts the first seen."""
    found = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return found.orderBy(F.desc("n"), "__first").limit(n).drop("__first")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """(slot, values, trajectories) over grounding.evidence() rows."""
    return evidence.groupBy("slot").agg(F.count("*").alias("n"))


def accumulator_efficiency(states: DataFrame, batch: str, live: str, rows: str, target: int) -> DataFrame:
    """What a gate cost: batches and rows generated, groups generated and kept, the share kept and groups per wanted group.

    states: a row a group, with its batch, whether it is live and its rows."""
    groups_, kept = F.count("*"), F.count_if(live)
    return states.agg(
        F.countDistinct(batch).alias("gen_batches"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows_generated"), groups_.alias("groups_generated"), kept.alias("groups_kept"),
        F.coalesce(F.round(F.try_divide(kept, groups_), 4), F.lit(0.0)).alias("group_yield"), (F.round(groups_ / F.lit(target), 4) if target else F.lit(0.0)).alias("generation_overhead"),
    )


# --- samples ---------------------------------------------------------------------------------------------------------


def call_counts(messages: Column, writes: tuple[str, ...] = WRITE_TOOLS) -> Column:
    """struct(tool_calls, write_calls) of canonical messages."""
    names = F.flatten(F.transform(messages, lambda m: F.transform(m["calls"], lambda c: c["name"])))
    return F.struct(F.size(names).alias("tool_calls"), F.size(F.filter(names, lambda n: n.isin(*writes))).alias("write_calls"))


def success_samples(sims: DataFrame, tasks: DataFrame, scores: DataFrame, splits: DataFrame, version: str, domain: str) -> DataFrame:
    """A training sample of each successful simulation with its lineage.

    sims: outcomes() rows with canonical messages and simulation_id; tasks: task_id and more; scores: simulation_id,
    process_score, risk_tags; splits: task_id, official_split. What a dimension lacks is `unknown` or null. Dimensions are
    joined after the filter; Spark broadcasts those that are small.
    """
    good = sims.where(groups.success_in_band(F.col("reward")))
    df = good.join(scores, "simulation_id", "left").join(splits, "task_id", "left").join(tasks.select("task_id", F.struct(*[c for c in tasks.columns if c != "task_id"]).alias("task")), "task_id", "left")
    split = F.coalesce("official_split", F.lit("unknown"))
    chars = F.aggregate("messages", F.lit(0), lambda acc, m: acc + F.length(F.to_json(m)))
    counts = call_counts(F.col("messages"))
    return df.select(
        F.concat(F.lit("sft_success_task"), F.col("task_id"), F.lit("_trial"), F.coalesce(F.col("trial").cast("string"), F.lit("None"))).alias("id"), F.lit("success_imitation").alias("sample_type"),
        F.lit(version).alias("format_version"), F.lit(domain).alias("domain"), "messages", F.transform("messages", lambda m: m["role"] == "assistant").alias("loss_mask"),
        F.greatest(F.lit(1).cast("bigint"), F.bround(chars / 4, 0).cast("bigint")).alias("estimated_tokens"), counts["tool_calls"].alias("tool_calls"), counts["write_calls"].alias("write_calls"),
        F.struct("simulation_id", "task_id", "trial", split.alias("official_split"), (split == "train").alias("trainable"), "reward", "process_score", F.coalesce("risk_tags", F.array().cast("array<string>")).alias("risk_tags"), "task").alias("metadata"),
    )


def row_tokens(rows: DataFrame, stats: DataFrame, id_col: str, estimate: str) -> DataFrame:
    """rows with tokens: as rendered (stats: id, tokens), else as estimated, else 0; a count of 0 is none."""
    known = stats.select(F.col(id_col), F.col("tokens").alias("__rendered"))
    zero = lambda c: F.nullif(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    return rows.join(known, id_col, "left").withColumn("tokens", F.coalesce(zero("__rendered"), zero(estimate), F.lit(0).cast("bigint"))).drop("__rendered")


def three_way(rows: DataFrame, valid_tasks: DataFrame, trainable: str, task: str) -> DataFrame:
    """rows with split: heldout where not trainable, valid where the task is chosen, else train."""
    chosen = valid_tasks.select(F.col(task)).distinct().withColumn("__valid", F.lit(True))
    split = F.when(~F.coalesce(F.col(trainable), F.lit(False)), "heldout").when(F.col("__valid"), "valid").otherwise("train")
    return rows.join(chosen, task, "left").withColumn("split", split).drop("__valid")


# --- balance ---------------------------------------------------------------------------------------------------------


def is_text_row(action: Column) -> Column:
    return F.coalesce(action == "assistant_text", F.lit(False))


def is_protocol_row(action: Column, protocol_only: Column) -> Column:
    return F.coalesce((action == "tool_call") & protocol_only, F.lit(False))


def balanced(rows: DataFrame, text_repeat: int, keep_ratio: float, seed: int, id_col: str = "id", action: str = "target_action", protocol: str = "protocol_only", check: bool = True) -> DataFrame:
    """rows with balance_role, original_id and repeat_index: texts `text_repeat` times, a stable sample of the protocol rows (the
    others stay, with role protocol_tool_downsampled), the rest once. Ids of what is kept must be unique."""
    if text_repeat < 1 or not 0 <= keep_ratio <= 1:
        raise ValueError("text_repeat is at least 1 and keep_ratio between 0 and 1")
    a, is_protocol = F.col(action), is_protocol_row(F.col(action), F.col(protocol))
    rest = rows.where(~is_protocol).withColumn("repeat_index", F.explode(F.when(is_text_row(a), F.sequence(F.lit(0), F.lit(text_repeat - 1))).otherwise(F.array(F.lit(0)))))
    role = F.when(~is_text_row(a), "tool_original").when(F.col("repeat_index") == 0, "assistant_text_original").otherwise("assistant_text_repeat")
    rest = rest.withColumn("balance_role", role)
    kept = stable_sample(rows.where(is_protocol), id_col, keep_ratio, seed).select(F.col(id_col).alias("__kept"))
    protocol_rows = rows.where(is_protocol).join(kept, F.col(id_col) == F.col("__kept"), "left")
    protocol_rows = protocol_rows.withColumn("repeat_index", F.lit(0)).withColumn("balance_role", F.when(F.col("__kept").isNotNull(), "protocol_tool_kept").otherwise("protocol_tool_downsampled")).drop("__kept")
    out = rest.unionByName(protocol_rows).withColumn("original_id", F.col(id_col))
    out = out.withColumn(id_col, F.when(F.col("repeat_index") > 0, F.concat(F.col(id_col).cast("string"), F.lit("__text_repeat"), F.col("repeat_index").cast("string"))).otherwise(F.col(id_col).cast("string")))
    if check:
        out = require_unique(out, id_col, F.col("balance_role") != "protocol_tool_downsampled")
    return out


def decision_mix(rows: DataFrame, action: str = "target_action") -> DataFrame:
    """assistant_text, tool_call, total and their shares (0 of nothing)."""
    text, tools = F.count_if(F.col(action) == "assistant_text"), F.count_if(F.col(action) == "tool_call")
    share = lambda n: F.coalesce(F.try_divide(n, text + tools), F.lit(0.0))
    return rows.agg(text.alias("assistant_text"), tools.alias("tool_call"), (text + tools).alias("total"), share(text).alias("text_share"), share(tools).alias("tool_share"))


def repeat_id(id_col: Column, old: str, new: Column) -> Column:
    """The id with the first occurrence of `old` replaced."""
    at = F.locate(old, id_col)
    return F.when(at > 0, F.concat(F.substring(id_col, F.lit(1), at - 1), new, F.substring(id_col, at + len(old), F.length(id_col)))).otherwise(id_col)


def reason_summary(clean: DataFrame, rejected: DataFrame, reason: str) -> DataFrame:
    """(reason, n, share) of rejected rows and of the clean ones (`clean`); shares of all rows."""
    both = clean.select(F.lit("clean").alias("reason")).union(rejected.select(F.col(reason)))
    return both.groupBy("reason").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


# --- lookups ---------------------------------------------------------------------------------------------------------


def broken_calls(messages: Column, content: str = "content", calls: str = "calls") -> Column:
    """How many assistant messages open a call that they never close, and hold no parsed call."""
    text = lambda m: F.coalesce(m[content], F.lit(""))
    cut = lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(m[calls]), F.lit(0)) == 0) & F.contains(text(m), F.lit("<tool_call>")) & ~F.contains(text(m), F.lit("</tool_call>"))
    return F.size(F.filter(messages, cut))


def picked(sims: DataFrame, order: str, task_id: str | None = None, trial: int | None = None, index: int = 0) -> DataFrame:
    """The index-th simulation (from 0) of a task and trial, in order."""
    if task_id is not None:
        sims = sims.where(F.col("task_id") == task_id)
    if trial is not None:
        sims = sims.where(F.col("trial") == trial)
    return sims.orderBy(order).limit(index + 1).orderBy(F.desc(order)).limit(1) if index else sims.orderBy(order).limit(1)


def expected_actions(sims: DataFrame, name: str | None = None) -> Column:
    """The reference actions of a simulation, of one name if given, in order."""
    actions = F.transform(F.coalesce(F.col("reward_info.action_checks"), F.array()), lambda c: c["action"])
    return actions if name is None else F.filter(actions, lambda a: a["name"] == name)


def of_tasks(df: DataFrame, tasks: list[str], task: str = "task_id") -> DataFrame:
    return df.where(F.col(task).cast("string").isin(*tasks))


def shortest_first(df: DataFrame, length: str, id_col: str, n: int, ids: DataFrame | None = None) -> DataFrame:
    """The n shortest rows, ties by id; of `ids`, if given, all of which must be there."""
    if ids is not None:
        df = require_all(ids, df, id_col, "missing id")
    return df.orderBy(length, id_col).limit(n)


def shuffled_first(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that only the seed and the ids decide."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), id_col).limit(n)


def first_probes(df: DataFrame, order: list[str], n: int, wanted: Column | None = None) -> DataFrame:
    """The first n rows that are wanted, in order."""
    return (df if wanted is None else df.where(wanted)).orderBy(*order).limit(n)


def catalogue_rows(tasks: DataFrame, suite: str, domain: str, prompt: str) -> DataFrame:
    """A task registry as rows for reinforcement learning: data_source, prompt, ability, reward_model, extra_info."""
    return tasks.select(
        F.lit(f"{suite}/{domain}").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("prompt"), F.lit(f"{suite}-{domain}").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"), F.struct(F.col("task_id").cast("string").alias("task_id"), F.col("ordinal").alias("index"), F.lit(domain).alias("domain")).alias("extra_info"),
    )


def union_runs(parts: list[DataFrame], run: str = "run") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


