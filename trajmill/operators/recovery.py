"""Samples that show what an agent should have done, made of failed trajectories.

A rule is a condition on a message and what is around it (the next message, what came before), and the answer or call that
would have been right there. Conditions are columns over `context()` rows, so all rules of a trajectory share one sort; a
sample's prefix is sliced from the conversation, which is joined once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajmill.operators.datasets import last_only_mask

LOOKBACK = 3


@dataclass(frozen=True)
class Rule:
    """family: its name; when: a condition over context(); text or tool and arguments (JSON text): the target; keep: whether the
    message itself belongs to the prefix."""

    family: str
    when: Column
    text: Column | None = None
    tool: str | None = None
    arguments: Column | None = None
    keep: bool = True


def context(messages: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """messages (role, content, tools: the names of the calls, ...) with next_role, next_tools, user_before (the users' words
    before, in lower case) and assistant_before (the assistant's texts among the LOOKBACK messages before)."""
    w = Window.partitionBy(key).orderBy(idx)
    said = F.collect_list(F.when(F.col("role") == "user", F.lower(F.coalesce("content", F.lit(""))))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    recent = F.collect_list(F.when(F.col("role") == "assistant", F.coalesce("content", F.lit("")))).over(w.rowsBetween(-LOOKBACK, -1))
    return messages.withColumns({"next_role": F.lead("role").over(w), "next_tools": F.coalesce(F.lead("tools").over(w), F.array().cast("array<string>")), "user_before": F.array_join(said, "\n"), "assistant_before": recent})


def online_rules(has_identifier: Column) -> list[Rule]:
    """What holds for every task: ask who it is before looking up, do not call while asking, do not guess after a not-found."""
    content = F.coalesce(F.col("content"), F.lit(""))
    asks = F.contains(content, F.lit("?")) | F.exists(F.array(*map(F.lit, ("would you", "could you", "what would"))), lambda p: F.contains(F.lower(content), p))
    failed = (F.col("role") == "tool") & F.startswith(F.lower(F.trim(content)), F.lit("error:")) & F.contains(content, F.lit(" not found"))
    user = failed & F.contains(content, F.lit("User "))
    return [
        Rule("ask_identity_before_tool", (F.col("role") == "user") & (F.col("next_role") == "assistant") & F.array_contains("next_tools", "get_user_details") & ~has_identifier,
             F.lit("Before I look anything up I have to know whose booking it is. What is your user ID, or your reservation ID?")),
        Rule("no_tool_while_asking", (F.col("role") == "assistant") & (F.size("tools") > 0) & (F.trim(content) != "") & asks, F.trim(content), keep=False),
        Rule("user_not_found_stop_guessing", user, F.lit("There is no user with that ID, and I will not try others at random. Please check your user ID, or give me a reservation ID.")),
        Rule("reservation_not_found_stop_guessing", failed & ~user & F.contains(content, F.lit("Reservation ")), F.lit("There is no reservation with that ID, and I will not try others at random. Please give me the right one.")),
    ]


def remaining_candidates(messages: DataFrame, key: str, listed: str, looked_up: str, idx: str = "idx") -> DataFrame:
    """messages with candidate: of the ids in the last list seen so far (array column `listed`, null elsewhere) the first that no
    earlier message has looked up (`looked_up`, an id or null)."""
    w = Window.partitionBy(key).orderBy(idx)
    known = F.last(listed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    done = F.collect_set(looked_up).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = messages.withColumns({"__known": known, "__done": done})
    return df.withColumn("candidate", F.get(F.filter("__known", lambda x: ~F.array_contains("__done", x)), F.lit(0))).drop("__known", "__done")


def task_rule(family: str, task: str, when: Column, **target: object) -> Rule:
    """A rule for one task (column task_id) alone."""
    return Rule(family, (F.col("task_id") == task) & when, **target)


def corrections(contexts: DataFrame, convs: DataFrame, key: str, rules: list[Rule], idx: str = "idx") -> DataFrame:
    """A sample for every message and rule that holds: id, key, family, turn, messages (the prefix and the target) and loss_mask.

    convs: key and canonical `messages`. A rule holds once a message; of equal ids the first in order of the rules stays."""
    none = F.lit(None).cast("string")
    found = F.array(*[F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(i).alias("n"), F.lit(r.family).alias("family"), (r.text if r.text is not None else none).alias("text"), F.lit(r.tool).cast("string").alias("tool"), (r.arguments if r.arguments is not None else none).alias("arguments"), F.lit(r.keep).alias("keep"))) for i, r in enumerate(rules)])
    hits = contexts.select(key, F.col(idx).alias("turn"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("r")).select(key, "turn", "r.*")
    ident = F.concat(F.lit("recovery_"), F.col(key).cast("string"), F.lit("_turn"), F.col("turn").cast("string"), F.lit("_"), F.col("family"))
    first = Window.partitionBy("id").orderBy("n")
    hits = hits.withColumn("id", ident).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    call = F.struct(F.concat(F.lit("call_"), F.substring(F.sha1("id"), 1, 16)).alias("id"), F.col("tool").alias("name"), F.coalesce("arguments", F.lit("{}")).alias("arguments"))
    calls = F.when(F.col("tool").isNotNull(), F.array(call)).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    target = F.struct(F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("content"), F.lit("").alias("name"), F.lit("").alias("tool_call_id"), calls.alias("calls"))
    both = hits.join(convs.select(key, "messages"), key)
    prefix = F.slice("messages", F.lit(1), (F.col("turn") + F.col("keep").cast("int")).cast("int"))
    return both.withColumn("messages", F.concat(prefix, F.array(target))).withColumn("loss_mask", last_only_mask(F.col("messages"))).select("id", key, "family", "turn", "messages", "loss_mask")


def progressive(steps: DataFrame, chain: str, idx: str, message: list[str]) -> DataFrame:
    """Every prefix of a gold chain that ends with the assistant: chain, turn, messages, loss_mask.

    steps: the chain's messages in order, with the columns `message` (role first); chains come as rows, so one that is made of
    an entity table is a join away."""
    w = Window.partitionBy(chain).orderBy(idx)
    so_far = F.collect_list(F.struct(*message)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = steps.withColumns({"messages": so_far, "turn": F.row_number().over(w) - 1}).where(F.col(message[0]) == "assistant")
    return df.withColumn("loss_mask", last_only_mask(F.col("messages"))).select(chain, "turn", "messages", "loss_mask")


def flights_on(flights: DataFrame, date: str | None = None, origin: str | None = None, destination: str | None = None) -> DataFrame:
    """Flights (flight_number, origin, destination, dates: map of a struct) as a row a date, of one date and route if given; a
    flight that doesn't go on the date has no row."""
    if origin is not None:
        flights = flights.where(F.col("origin") == origin)
    if destination is not None:
        flights = flights.where(F.col("destination") == destination)
    if date is not None:
        flights = flights.withColumn("dates", F.map_filter("dates", lambda k, _: k == date))
    rest = [c for c in flights.columns if c != "dates"]
    return flights.select(*rest, F.explode("dates").alias("date", "on_date")).select(*rest, "date", "on_date.*")


def looked_up_before(events: DataFrame, key: str, idx: str, by: list[str], value: str) -> DataFrame:
    """events with last_<value>: the last value of the same `by` in an earlier event that has one (later writes win)."""
    w = Window.partitionBy(key, *by).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(f"last_{value}", F.last(value, ignorenulls=True).over(w))


def blueprints(spark: SparkSession, rows: list[tuple[str, str, str]], tasks: DataFrame, splits: DataFrame, version: str, domain: str) -> DataFrame:
    """Correction plans that someone wrote (task_id, failure, plan), with the task and its split (else `unknown`)."""
    own = spark.createDataFrame(rows, "task_id string, failure string, plan string")
    task = tasks.select("task_id", F.struct(*[c for c in tasks.columns if c != "task_id"]).alias("task"))
    df = own.join(splits.select("task_id", "official_split"), "task_id", "left").join(task, "task_id", "left")
    split = F.coalesce("official_split", F.lit("unknown"))
    return df.select(
        F.concat(F.lit("correction_blueprint_task"), "task_id").alias("id"), F.lit("targeted_correction_blueprint").alias("sample_type"), F.lit(version).alias("format_version"), F.lit(domain).alias("domain"),
        "task_id", split.alias("official_split"), (split == "train").alias("trainable"), F.lit("blueprint_only_not_imitation").alias("synthetic_status"), "task", "failure", "plan",
    )
