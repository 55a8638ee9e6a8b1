"""Slot grounding: whether a call's identifiers had been seen before it.

Evidence is a relation (trajectory, slot, value, first message): identifiers in the user's words, and those in successful
tool replies and in the arguments of the calls they answer. A call's argument is grounded if its evidence comes from an
earlier message. All calls of one message see the same evidence. Aggregates over first messages take the place of a walk
through each trajectory, so a long trajectory is spread like any other rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.operators.messages import calls_of, is_error, replies_with_calls

# What identifiers look like, which tools need which, phrases that ask for one, and what an issue weighs.
PATTERNS = {
    "user_id": r"\b[a-z][a-z0-9]*_[a-z][a-z0-9]*_\d+\b",
    "payment_id": r"\b(?:credit_card|gift_card|certificate)_\d+\b",
    "flight_number": r"\bHAT\d{3}\b",
    "reservation_id": r"\b(?=[A-Z0-9]{6}\b)(?=.*[A-Z])(?=.*\d)[A-Z0-9]{6}\b",
}
NEEDS = {
    "get_user_details": ["user_id"], "get_reservation_details": ["reservation_id"], "cancel_reservation": ["reservation_id"],
    "update_reservation_flights": ["reservation_id", "payment_id"], "update_reservation_baggages": ["reservation_id", "payment_id"],
    "update_reservation_passengers": ["reservation_id", "payment_id"], "book_reservation": ["user_id", "payment_id"], "send_certificate": ["user_id"],
}
ASKING = ["provide your user id", "provide your user_id", "could you please provide your user id", "send your reservation id", "provide your reservation id", "double-check your user id"]
WEIGHT = {"user_id": 3.0, "reservation_id": 2.0, "payment_id": 1.5, "flight_number": 1.5}
ASKED_AND_CALLED, TRANSFERRED = 2.0, 2.5
FLIGHT_PREFIX = "HAT"

_SLOTS = T.ArrayType(T.StructType([T.StructField("slot", T.StringType()), T.StructField("value", T.StringType())]))


def slots_in_text(text: Column) -> Column:
    """Every identifier in a text."""
    text = F.coalesce(text, F.lit(""))

    def of(slot: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(slot).alias("slot"), v.alias("value")))

    found = [of(slot, pattern) for slot, pattern in PATTERNS.items()]
    return F.filter(F.concat(*found), lambda x: ~((x["slot"] == "reservation_id") & F.startswith(x["value"], F.lit(FLIGHT_PREFIX))))


def _text(value: Any) -> str:
    return "" if value is None else str(value).strip()


def _argument_slots(value: Any) -> Iterator[tuple[str, str]]:
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, list):
            yield from _argument_slots(item)
        elif isinstance(item, dict):
            for k, v in item.items():
                if k in PATTERNS:
                    if text := _text(v):
                        yield k, text
                else:
                    yield from _argument_slots(v)


def _all_dicts(value: Any) -> Iterator[dict]:
    if isinstance(value, dict):
        yield value
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _all_dicts(child)


def _result_slots(tool: str, result: Any) -> Iterator[tuple[str, Any]]:
    """What a successful reply of each tool attests."""
    dicts = lambda x: [d for d in x or [] if isinstance(d, dict)]
    if tool == "get_user_details" and isinstance(result, dict):
        yield "user_id", result.get("user_id")
        yield from (("reservation_id", r) for r in result.get("reservations") or [])
        methods = result.get("payment_methods")
        for key, method in methods.items() if isinstance(methods, dict) else ():
            yield "payment_id", key
            if isinstance(method, dict):
                yield "payment_id", method.get("id")
    elif tool == "get_reservation_details" and isinstance(result, dict):
        yield from ((k, result.get(k)) for k in ("reservation_id", "user_id"))
        yield from (("flight_number", f.get("flight_number")) for f in dicts(result.get("flights")))
        yield from (("payment_id", p.get("payment_id")) for p in dicts(result.get("payment_history")))
    elif tool in ("search_direct_flight", "search_onestop_flight"):
        yield from (("flight_number", d.get("flight_number")) for d in _all_dicts(result))


def _json(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(_SLOTS)
def argument_slots(arguments: pd.Series) -> pd.Series:
    """The identifiers in a call's arguments, at any depth."""
    return arguments.map(lambda a: [{"slot": k, "value": v} for k, v in _argument_slots(x)] if isinstance(x := _json(a), dict) else [])


@F.pandas_udf(_SLOTS)
def result_slots(tool: pd.Series, content: pd.Series) -> pd.Series:
    """The identifiers that a successful reply attests."""
    return pd.Series([[{"slot": k, "value": t} for k, v in _result_slots(n, _json(c)) if (t := _text(v)) and not (k == "reservation_id" and t.startswith(FLIGHT_PREFIX))] for n, c in zip(tool, content, strict=True)])


def _needs(tool: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, slots in NEEDS.items():
        out = F.when(tool == name, F.array(*map(F.lit, slots))).otherwise(out)
    return out


def evidence(messages: DataFrame, key: list[str]) -> DataFrame:
    """(key, slot, value, first): the first message that attests an identifier."""
    said = messages.where("role = 'user'").select(*key, "idx", F.explode(slots_in_text(F.col("content"))).alias("s"))
    good = replies_with_calls(messages, key, empty_ids=False).where(~is_error(F.col("error"), F.col("content")))
    seen = good.select(*key, "idx", F.explode(F.concat(result_slots("tool", "content"), argument_slots("arguments"))).alias("s"))
    both = said.unionByName(seen).select(*key, "idx", "s.slot", "s.value")
    both = both.where(~((F.col("slot") == "reservation_id") & F.startswith("value", F.lit(FLIGHT_PREFIX))))
    return both.groupBy(*key, "slot", "value").agg(F.min("idx").alias("first"))


def issues(messages: DataFrame, key: list[str]) -> DataFrame:
    """A row an issue: key, idx, pos, call_id, tool, component, slot, value, severity, tags.

    messages: exploded() rows. Three kinds: an argument without earlier evidence; asking for an identifier while looking the
    user up; handing over to a human after a not-found error about an identifier that had been made up.
    """
    calls = calls_of(messages, key)
    place = [*key, "idx", "pos", "call_id", "tool"]
    known = evidence(messages, key)
    used = calls.select(*place, F.posexplode(argument_slots("arguments")).alias("n", "s"), _needs(F.col("tool")).alias("needs")).select(*place, "n", "s.slot", "s.value", "needs")
    used = used.where(F.array_contains("needs", F.col("slot"))).drop("needs")
    made_up = used.join(known, [*key, "slot", "value"], "left").where(F.col("first").isNull() | (F.col("first") >= F.col("idx")))
    weight = F.lit(None).cast("double")
    for slot, w in WEIGHT.items():
        weight = F.when(F.col("slot") == slot, w).otherwise(weight)
    tags = lambda component, more: F.array_sort(F.array(F.lit("slot_grounding_error"), component, F.lit(more)))
    component = F.concat(F.lit("ungrounded_"), F.col("slot"))
    out = made_up.select(*place, component.alias("component"), "slot", "value", weight.alias("severity"), tags(component, "argument_hallucination").alias("tags"))

    asks = F.exists(F.array(*map(F.lit, ASKING)), lambda p: F.contains(F.lower(F.col("said")), p))
    users = F.filter(argument_slots("arguments"), lambda s: s["slot"] == "user_id")
    name = F.lit("ask_identifier_and_call_tool_same_turn")
    value = F.coalesce(F.get(users, F.size(users) - 1)["value"], F.lit(""))
    out = out.unionByName(calls.where((F.col("tool") == "get_user_details") & asks).select(*place, name.alias("component"), F.lit("user_id").alias("slot"), value.alias("value"), F.lit(ASKED_AND_CALLED).alias("severity"), tags(name, "ask_then_tool_same_turn").alias("tags")))

    failed = replies_with_calls(messages, key, empty_ids=False).where(is_error(F.col("error"), F.col("content")))
    missing = failed.select(*key, "idx", F.explode(slots_in_text(F.col("content"))).alias("s")).select(*key, "s.slot", "s.value", "idx").groupBy(*key, "slot", "value").agg(F.min("idx").alias("missing"))
    bad = made_up.groupBy(*key, "slot", "value").agg(F.min(F.struct("idx", "pos")).alias("used")).join(missing, [*key, "slot", "value"])
    name = F.lit("transfer_after_ungrounded_slot_error")
    moved = calls.where("tool = 'transfer_to_human_agents'").join(bad, key).where((F.col("missing") < F.col("idx")) & (F.col("used") < F.struct("idx", "pos")))
    moved = moved.groupBy(*place).agg(F.min(F.struct("slot", "value")).alias("s"))
    return out.unionByName(moved.select(*place, name.alias("component"), "s.slot", "s.value", F.lit(TRANSFERRED).alias("severity"), tags(name, "premature_deferral").alias("tags")))


def components(messages: DataFrame, key: list[str]) -> DataFrame:
    """(key, components): the issues as negative components; +1 for a trajectory with calls and without issues."""
    bad = issues(messages, key).select(*key, "idx", "pos", F.col("component").alias("name"), (-F.col("severity")).alias("value"), "tags")
    with_calls = calls_of(messages, key).select(*key).distinct()
    clean = with_calls.join(bad.select(*key).distinct(), key, "left_anti")
    good = clean.select(*key, F.lit(0).alias("idx"), F.lit(0).alias("pos"), F.lit("slot_grounding_clean").alias("name"), F.lit(1.0).alias("value"), F.array().cast("array<string>").alias("tags"))
    rows = bad.unionByName(good)
    ordered = F.array_sort(F.collect_list(F.struct("idx", "pos", "name", "value", "tags")))
    return rows.groupBy(*key).agg(F.transform(ordered, lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"), c["tags"].alias("tags"))).alias("components"))


def target_grounding(messages: DataFrame, key: list[str]) -> DataFrame:
    """(key, is_grounded, issue_count, issues): whether the calls of a trajectory's last message with calls stand on what came
    before it. Trajectories without a call have no row."""
    calls = calls_of(messages, key)
    last = calls.groupBy(*key).agg(F.max("idx").alias("idx"))
    bad = issues(messages, key).where(F.startswith("component", F.lit("ungrounded_"))).groupBy(*key, "idx").agg(F.array_sort(F.collect_list("component")).alias("issues"))
    out = last.join(bad, [*key, "idx"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    return out.select(*key, (F.size("issues") == 0).alias("is_grounded"), F.size("issues").alias("issue_count"), "issues")
