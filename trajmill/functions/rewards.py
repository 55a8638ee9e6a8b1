"""Rewards of answers and of tool use, as columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.functions import text as tx

# What a well-formed value of a field looks like, and words that stand in for one.
FIELD_PATTERNS = {"reservation_id": r"^[A-Z0-9]{6}$", "user_id": r"^[a-z]+_[a-z]+_[0-9]+$", "order_id": r"^#?W[0-9]+$", "flight_number": r"^[A-Z]{3}[0-9]{3}$", "date": r"^\d{4}-\d{2}-\d{2}$"}
PLACEHOLDERS = ("previous", "unknown", "placeholder", "none", "null", "n/a", "any", "some", "first", "last", "default", "example", "sample", "test", "dummy", "temp")
ENTITY_CHARS = 4


def qa_reward(prediction: Column, golds: Column, mode: str = "em") -> Column:
    """The best score over the golds (array; null and blank ones don't count, none left is 0) of the prediction's answer.

    em: exact match; f1: token F1; em_or_f1half: 1 for an exact match, else half the F1."""
    golds = F.filter(golds, lambda g: F.trim(F.coalesce(g, F.lit(""))) != "")
    answer = tx.answer_of(prediction)
    best = lambda score: F.coalesce(F.array_max(F.transform(golds, score)), F.lit(0.0))
    em = best(lambda g: tx.exact_match(answer, g))
    f1 = best(lambda g: tx.token_f1(tx.tokens_of(tx.normalized(answer)), tx.tokens_of(tx.normalized(g))))
    if mode == "em":
        return em
    if mode == "f1":
        return f1
    if mode == "em_or_f1half":
        return F.when(em > 0, em).otherwise(0.5 * f1)
    raise ValueError(f"unknown mode {mode}")


def placeholder(field: Column, value: Column) -> Column:
    """Whether a field's text stands in for a value: it holds one of the words, or isn't what the first known part of the
    field's name asks for."""
    low = F.lower(value)
    wrong = F.lit(False)
    for part, pattern in reversed(FIELD_PATTERNS.items()):
        wrong = F.when(F.contains(F.lower(field), F.lit(part)), ~F.regexp_like(value, F.lit(pattern))).otherwise(wrong)
    word = F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda w: F.contains(low, w))
    return F.coalesce(word | wrong, F.lit(False))


def has_placeholder(parameters: Column) -> Column:
    """Whether one of the parameters (map of text; null: no text) is a placeholder."""
    return F.coalesce(F.exists(F.map_entries(parameters), lambda e: placeholder(e["key"], e["value"])), F.lit(False))


def _entities(value: Any) -> Iterator[str]:
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield from (k for k in x if len(k) >= ENTITY_CHARS)
            stack += x.values()
        elif isinstance(x, list):
            stack += x
        elif isinstance(x, (str, int, float)) and not isinstance(x, bool) and len(text := str(x)) >= ENTITY_CHARS:
            yield text


def _loaded(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _entity_strings(content: pd.Series) -> pd.Series:
    return content.map(lambda c: sorted(set(_entities(_loaded(c)))))


def entity_strings(content: Column | str) -> Column:
    """The sorted names, texts and numbers of ENTITY_CHARS characters and more in a JSON text, at any depth, keys included;
    none if it is no JSON. Depth is unbounded, hence no chain of built-in functions; texts that don't begin as JSON aren't looked at."""
    content = F.col(content) if isinstance(content, str) else content
    return _entity_strings(F.when(content.rlike(r'^\s*[\[{"0-9\-]'), content))


def text_parameters(arguments: Column | str) -> Column:
    """The parameters of a call (JSON object) whose values are texts; none of what is no object."""
    arguments = F.col(arguments) if isinstance(arguments, str) else arguments
    found = F.from_json(arguments, T.MapType(T.StringType(), T.VariantType()))
    texts = F.map_filter(found, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform_values(texts, lambda k, v: F.variant_get(v, "$", "string")), F.create_map().cast("map<string,string>"))


def chained(parameters: Column, seen: Column) -> Column:
    """Whether one of the parameters' texts (of ENTITY_CHARS characters and more) is among the entities seen before."""
    texts = F.filter(F.map_values(parameters), lambda v: F.length(v) >= ENTITY_CHARS)
    return F.coalesce(F.arrays_overlap(texts, seen), F.lit(False))


def loose_error(content: Column) -> Column:
    """Whether a reply speaks of an error anywhere."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.contains(low, F.lit("error")) | F.contains(low, F.lit("not found")) | F.contains(low, F.lit("invalid"))


def shaped(outcome: Column, process: Column, beta: float = 0.3) -> Column:
    """struct(reward, outcome, process): outcome + beta * process."""
    return F.struct((outcome.cast("double") + beta * process).alias("reward"), outcome.cast("double").alias("outcome"), process.alias("process"))


def task_text(*maps: Column, lists: tuple[Column, ...] = ()) -> Column:
    """All values of a task's descriptions, instructions and so on, a line each."""
    values = [F.map_values(m) for m in maps] + list(lists)
    return F.array_join(F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<string>")) for v in values])), "\n")


def optional(value: Column, digits: int = 4, missing: str = "n/a") -> Column:
    return F.when(value.isNull(), missing).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def percent(value: Column, digits: int = 1, missing: str = "n/a") -> Column:
    return F.when(value.isNull(), missing).otherwise(F.concat(F.format_string(f"%.{digits}f", value.cast("double") * 100), F.lit("%")))


def softmax(logits: Column) -> Column:
    """The softmax of an array, shifted by its largest value."""
    raised = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def best_index(values: Column) -> Column:
    """The place (from 0) of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def sparkline(values: Column) -> Column:
    """Values between 0 and 1 as bars of eight heights."""
    bars = F.array(*map(F.lit, "▁▂▃▄▅▆▇█"))
    return F.array_join(F.transform(values, lambda v: F.get(bars, F.least(F.lit(7), F.greatest(F.lit(0), F.floor(v * 8))).cast("int"))), "")
