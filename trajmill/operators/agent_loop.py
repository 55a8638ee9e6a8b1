"""The agent loop's states over recorded events, with caps on turns, tokens and errors.

An event is one turn of a trajectory: the assistant's (with or without calls), the tools' replies to it, or the user's. The
loop goes from pending or generating over processing_tools or processing_user back to generating until it is terminated, and
what comes after counts for nothing. The fold has two forms with equal results: `fold` over a table, where all counters are running
sums and the end is the first event that a cap or a stop ends, and `streaming.agent_loop` over a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ends of a trajectory and states.
MAX_STEPS, TOO_MANY_ERRORS, USER_STOP = "max_steps", "too_many_errors", "user_stop"
PENDING, GENERATING, TOOLS, USER, TERMINATED = "pending", "generating", "processing_tools", "processing_user", "terminated"
COLUMNS = ["state", "termination", "events", "assistant_turns", "user_turns", "errors", "response_length", "trained_tokens"]


@dataclass(frozen=True)
class Caps:
    """Tokens of a response, turns of either side, errors of tools; a trajectory that reaches one ends."""

    response: int = 8192
    assistant_turns: int = 30
    user_turns: int = 30
    errors: int = 10


def fold(events: DataFrame, key: str, order: str, caps: Caps = Caps()) -> DataFrame:
    """A row a trajectory: key and COLUMNS. events: kind (assistant, tool, user), calls and stop (booleans), tokens, errors.

    A turn of the assistant is always part of the response and trained. A reply that would reach the response cap is left out and ends
    the trajectory, as does a stop; errors are counted before their cap is looked at. A turn that the state does not wait for ends
    the trajectory as max_steps, as does a null or unknown kind. One window over the key.
    """
    w = Window.partitionBy("__key").orderBy("__order")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, n = F.col("kind"), F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint")
    is_ = lambda k: F.coalesce(kind == k, F.lit(False))
    calls, stop = F.coalesce(F.col("calls"), F.lit(False)), F.coalesce(F.col("stop"), F.lit(False))
    rows = events.select(F.col(key).alias("__key"), F.col(order).alias("__order"), is_("assistant").alias("a"), is_("tool").alias("t"), is_("user").alias("u"), calls.alias("calls"), (is_("user") & stop).alias("stop"), n.alias("n"), F.when(is_("tool"), F.coalesce(F.col("errors"), F.lit(0))).otherwise(0).cast("bigint").alias("e"))
    total = lambda c: F.sum(c).over(upto)
    rows = rows.withColumns({
        "i": F.row_number().over(w), "before": F.coalesce(F.lag(F.when(F.col("a"), F.when(F.col("calls"), TOOLS).otherwise(USER)).otherwise(GENERATING)).over(w), F.lit(PENDING)),
        "turns": total(F.col("a").cast("bigint")), "users": total((F.col("u") & ~F.col("stop")).cast("bigint")), "failed": total("e"), "length": total("n"), "trained": total(F.when(F.col("a"), F.col("n")).otherwise(0)),
    })
    unexpected = ~((F.col("a") & F.col("before").isin(PENDING, GENERATING)) | (F.col("t") & (F.col("before") == TOOLS)) | (F.col("u") & (F.col("before") == USER)))
    full = F.col("length") >= caps.response
    # a reply that ends the trajectory before it is appended, and ends after the turn
    refused = unexpected | F.col("stop") | (~F.col("a") & full)
    ended = F.when(unexpected, MAX_STEPS).when(F.col("stop"), USER_STOP).when(full, MAX_STEPS).when(F.col("t") & (F.col("failed") >= caps.errors), TOO_MANY_ERRORS).when(F.col("a") & (F.col("turns") >= caps.assistant_turns), MAX_STEPS).when(F.col("u") & (F.col("users") >= caps.user_turns), MAX_STEPS)
    rows = rows.withColumns({"refused": refused, "unexpected": unexpected, "ended": ended})
    # the last event that counts: the first that ends, or the last at all
    counted = F.struct(
        F.when(F.col("ended").isNotNull(), TERMINATED).when(F.col("a"), F.when(F.col("calls"), TOOLS).otherwise(USER)).otherwise(GENERATING).alias("state"), F.coalesce("ended", F.lit(MAX_STEPS)).alias("termination"), F.col("i").cast("bigint").alias("events"),
        (F.col("turns") - F.when(F.col("unexpected") & F.col("a"), 1).otherwise(0)).alias("assistant_turns"), (F.col("users") - F.when(F.col("refused") & F.col("u") & ~F.col("stop"), 1).otherwise(0)).alias("user_turns"),
        (F.col("failed") - F.when(F.col("unexpected"), F.col("e")).otherwise(0)).alias("errors"), (F.col("length") - F.when(F.col("refused"), F.col("n")).otherwise(0)).alias("response_length"), (F.col("trained") - F.when(F.col("unexpected") & F.col("a"), F.col("n")).otherwise(0)).alias("trained_tokens"),
    )
    first = F.min_by(counted, F.when(F.col("ended").isNotNull(), F.col("i")))
    return rows.groupBy("__key").agg(F.coalesce(first, F.max_by(counted, F.col("i"))).alias("last")).select(F.col("__key").alias(key), *[F.col(f"last.{c}") for c in COLUMNS])
