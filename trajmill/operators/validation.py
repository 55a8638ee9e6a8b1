"""What is wrong with training samples: row by row, and over whole datasets and their splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.operators.rendering import ROLES


def structure_report(messages: Column, mask: Column) -> Column:
    """struct(errors, warnings) of canonical messages and their loss mask, as texts in order of the messages.

    A tool reply needs a call of its id in an earlier message."""
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    at = lambda i: i.cast("string")
    some = lambda checks: F.filter(F.array(*[F.when(c, t) for c, t in checks]), lambda x: x.isNotNull())
    role = lambda m: F.coalesce(m["role"], F.lit("None"))
    target = lambda i: F.coalesce(F.get(mask, i), F.lit(False))
    ids = lambda ms: F.flatten(F.transform(ms, lambda m: F.transform(m["calls"], lambda c: c["id"])))
    before = lambda i: ids(F.filter(F.slice(messages, F.lit(1), i), lambda m: m["role"] == "assistant"))

    def errors(m: Column, i: Column) -> Column:
        reply = F.coalesce(m["tool_call_id"], F.lit(""))
        own = some([(~role(m).isin(*ROLES), text("invalid_role:", at(i), ":", role(m))), (role(m).isin("user", "tool") & target(i), text("non_assistant_target:", at(i), ":", role(m)))])
        call = lambda c: some([(F.coalesce(c["id"], F.lit("")) == "", text("tool_call_missing_id:", at(i))), (F.coalesce(c["name"], F.lit("")) == "", text("tool_call_missing_name:", at(i), ":", F.coalesce(c["id"], F.lit(""))))])
        calls = F.flatten(F.transform(F.filter(m["calls"], lambda _: role(m) == "assistant"), call))
        replies = some([((role(m) == "tool") & (reply == ""), text("tool_message_missing_call_id:", at(i))), ((role(m) == "tool") & (reply != "") & ~F.array_contains(before(i), reply), text("tool_message_without_prior_call:", at(i), ":", reply))])
        return F.concat(own, calls, replies)

    def warnings(m: Column, i: Column) -> Column:
        assistant = role(m) == "assistant"
        bare = (F.coalesce(m["content"], F.lit("")) == "") & (F.size(m["calls"]) == 0)
        return some([
            (assistant & ~target(i), text("assistant_not_targeted:", at(i))), (assistant & target(i) & bare, text("empty_target_assistant:", at(i))),
            ((role(m) == "tool") & (F.coalesce(m["name"], F.lit("")) == ""), text("tool_message_missing_name:", at(i), ":", F.coalesce(m["tool_call_id"], F.lit("")))),
        ])

    called = F.array_distinct(F.filter(ids(F.filter(messages, lambda m: m["role"] == "assistant")), lambda x: x != ""))
    answered = F.transform(F.filter(messages, lambda m: m["role"] == "tool"), lambda m: m["tool_call_id"])
    open_ = F.array_sort(F.array_except(called, answered))
    first = F.get(messages, F.lit(0))["role"] == "assistant"
    whole = some([(F.size(messages) == 0, F.lit("empty_messages")), (F.size(messages) != F.size(mask), F.lit("messages_loss_mask_length_mismatch"))])
    rest = some([(F.size(open_) > 0, text("tool_calls_without_response:", F.array_join(F.slice(open_, 1, 5), ","))), (F.coalesce(first, F.lit(False)), F.lit("conversation_starts_with_assistant"))])
    return F.struct(F.concat(whole, F.flatten(F.transform(messages, errors))).alias("errors"), F.concat(F.flatten(F.transform(messages, warnings)), rest).alias("warnings"))


def sample_errors(df: DataFrame, id_col: str, order: list, messages: str = "messages", mask: str = "loss_mask", one_call: bool = False) -> DataFrame:
    """(id, error): repeated ids (all but the first in `order`), samples whose last message is not the assistant's, masks that
    are not on the last message alone, and (one_call) targets with another number of calls than one."""
    last = F.get(messages, F.size(messages) - 1)
    want = F.concat(F.array_repeat(F.lit(False), F.greatest(F.size(messages) - 1, F.lit(0))), F.array(F.lit(True)))
    repeated = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) > 1
    checks = {"duplicate_id": F.col("__repeated"), "last_not_assistant": F.coalesce(last["role"] != "assistant", F.lit(True)), "loss_mask_not_last_only": F.col(mask) != want}
    if one_call:
        checks["target_call_count"] = F.coalesce(F.size(last["calls"]), F.lit(0)) != 1
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("__repeated", repeated).select(F.col(id_col).alias("id"), F.explode(found).alias("error"))


def split_leaks(df: DataFrame, task: str, split: str) -> DataFrame:
    """(task, splits): tasks with rows in more than one split."""
    found = df.groupBy(F.col(task).alias("task")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def leak_errors(df: DataFrame, task: str, split: str, pairs: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(error, tasks): for each named pair of groups of splits the sorted tasks that are in both; no row if there is none."""
    leaks = split_leaks(df, task, split)
    has = lambda names: F.exists("splits", lambda s: s.isin(*names))
    parts = [leaks.where(has(a) & has(b)).agg(F.array_sort(F.collect_list("task")).alias("tasks")).where(F.size("tasks") > 0).select(F.lit(k).alias("error"), "tasks") for k, (a, b) in pairs.items()]
    return reduce(DataFrame.union, parts)
