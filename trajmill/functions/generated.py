"""Reading what a model generated: calls, labels, stops and how calls match."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

END_MARK = "<|im_end|>"
LABELS = ("assistant_text", "tool_call")
_WRAPPED = re.compile(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", re.S)
#: A string (the last one may lack its end) or a brace: all that matters for the nesting of objects.
_NESTING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)
_CALLS = T.StructType([
    T.StructField("calls", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))), T.StructField("parse_failed", T.BooleanType()),
])


def json_objects(text: str) -> Iterator[str]:
    """The outermost balanced {...} stretches, blind to braces in strings."""
    depth = start = 0
    for m in _NESTING.finditer(text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : m.end()]


def objects(text: Column) -> Column:
    """json_objects() as a column: one pass over a text's quotes, braces and escapes that keeps the place, whether it is in a string, the
    depth, and where the object began; an array grows only where an object ends."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'(?s)\\.|[^"\\{}]+|.'), F.lit(0))
    places = "array<struct<begin:int,size:int>>"
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit(0).alias("depth"), F.lit(0).alias("begin"), F.array().cast(places).alias("found"))

    def step(acc: Column, token: Column) -> Column:
        sign = F.when(acc["inside"], token).otherwise(F.right(token, F.lit(1)))  # a backslash escapes in strings alone
        opens, closes = ~acc["inside"] & (sign == "{"), ~acc["inside"] & (sign == "}") & (acc["depth"] > 0)
        end = acc["at"] + F.length(token)
        return F.struct(
            end.alias("at"), F.when(sign == '"', ~acc["inside"]).otherwise(acc["inside"]).alias("inside"), (acc["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when(opens & (acc["depth"] == 0), end - 1).otherwise(acc["begin"]).alias("begin"),
            F.when(closes & (acc["depth"] == 1), F.concat(acc["found"], F.array(F.struct(acc["begin"].alias("begin"), (end - acc["begin"]).alias("size"))).cast(places))).otherwise(acc["found"]).alias("found"),
        )

    found = F.aggregate(tokens, first, step, lambda acc: acc["found"])
    return F.transform(found, lambda x: F.substring(text, x["begin"] + 1, x["size"]))


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _first(source: dict, *names: str) -> Any:
    return next((source[n] for n in names if source.get(n) is not None), None)


def read_call(text: str) -> tuple[str, Any] | None:
    """(name, arguments) of a call's JSON, flat or nested; None if it is none."""
    try:
        source = json.loads(text)
    except ValueError:
        return None
    if not isinstance(source, dict):
        return None
    name, arguments = source.get("name"), _first(source, "arguments", "params")
    if name is None and isinstance(source.get("function"), dict):
        name, arguments = source["function"].get("name"), _first(source["function"], "arguments", "params")
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except ValueError:
            pass
    return str(name or ""), {} if arguments is None else arguments


def calls_in(text: str) -> tuple[list[tuple[str, str]], bool]:
    """Calls in wrapper tags, then loose objects that look like calls and were not among these; whether any failed to parse."""
    body = text.split(END_MARK, 1)[0].strip()
    tagged = [read_call(m[1]) for m in _WRAPPED.finditer(body)]
    found = [(c[0], canonical(c[1])) for c in tagged if c]
    failed = None in tagged
    for candidate in json_objects(body):
        if '"name"' in candidate or '"function"' in candidate:
            c = read_call(candidate)
            if c is None:
                failed = True
            elif (one := (c[0], canonical(c[1]))) not in found:
                found.append(one)
    return found, failed


@F.pandas_udf(_CALLS)
def generated_calls(text: pd.Series) -> pd.DataFrame:
    got = [calls_in(t or "") for t in text]
    return pd.DataFrame({"calls": [[{"name": n, "arguments": a} for n, a in calls] for calls, _ in got], "parse_failed": [f for _, f in got]})


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces; other text as it is."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return t

    return text.map(one)


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """The text up to the end of the stop that comes first (of those at one place the first in the list)."""
    places = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(s)), F.struct(F.locate(s, text).alias("at"), F.lit(i).alias("i"), F.lit(len(s)).alias("n"))) for i, s in enumerate(stops) if s]))
    best = F.array_min(places)
    return F.when(best.isNull(), text).otherwise(F.substring(text, F.lit(1), best["at"] + best["n"] - 1))


def cut_at_stop_by_ends(text: Column, stops: list[str]) -> Column:
    """The variant that holds each stop's start against the END of the best one so far, in the order of the list."""
    end = F.lit(None).cast("int")
    for s in [s for s in stops if s]:
        at = F.locate(s, text) - 1
        end = F.when((at >= 0) & (end.isNull() | (at < end)), at + len(s)).otherwise(end)
    return F.when(end.isNull(), text).otherwise(F.substring(text, F.lit(1), end))


def gate_label(text: Column) -> Column:
    """The label that a text starts with, else the one that comes first in it, else by the marks of a call, else unknown."""
    body = F.trim(F.element_at(F.split(text, r"<\|im_end\|>", 2), 1))
    plain = F.regexp_replace(F.lower(body), r"(?U)\s+", "")
    places = F.array_min(F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(x)), F.struct(F.locate(x, plain).alias("at"), F.lit(i).alias("i"), F.lit(x).alias("label"))) for i, x in enumerate(LABELS)])))
    marks = F.contains(body, F.lit("<tool_call>")) | F.contains(body, F.lit('"name"'))
    return F.coalesce(places["label"], F.when(marks, "tool_call"), F.lit("unknown"))


def call_match(reference: Column, predicted: Column) -> Column:
    """struct(name_match, key_recall, key_precision, exact) of two structs (name, arguments as canonical JSON)."""
    keys = lambda c: F.coalesce(F.json_object_keys(c["arguments"]), F.array().cast("array<string>"))
    want, got = keys(reference), keys(predicted)
    both = F.size(F.array_intersect(want, got)).cast("double")
    name = F.coalesce(predicted["name"] == reference["name"], F.lit(False))
    return F.struct(
        name.alias("name_match"), F.when(F.size(want) > 0, both / F.size(want)).otherwise(1.0).alias("key_recall"),
        F.when(F.size(got) > 0, both / F.size(got)).when(F.size(want) > 0, 0.0).otherwise(1.0).alias("key_precision"), (name & F.coalesce(predicted["arguments"] == reference["arguments"], F.lit(False))).alias("exact"),
    )


def trajectory_signature(messages: Column, flat: bool = False) -> Column:
    """Assistant turns as names of called tools or the first 40 characters; flat calls' names count only if asked for."""
    name = lambda c: F.coalesce(c["function"]["name"], c["name"] if flat else F.lit(None), F.lit(""))
    turn = lambda m: F.when(F.size(m["tool_calls"]) > 0, F.concat(F.lit("T:"), F.array_join(F.transform(m["tool_calls"], name), ","))).otherwise(F.concat(F.lit("S:"), F.substring(F.coalesce(m["content"], F.lit("")), 1, 40)))
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), turn), "|")
