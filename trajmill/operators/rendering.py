"""Conversations as one text with the spans that are trained on, and what a tokeniser makes of them.

Messages are arrays of struct(role, content, name, tool_call_id, calls) (`normalized`); a conversation is rendered in one
projection: no shuffle, and no message leaves its row.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajmill.operators.datasets import overlaps
from trajmill.operators.messages import canonical_call
from trajmill.sinks.tables import bounded_batches

ROLES = ("system", "user", "assistant", "tool")
# How messages, calls and marked spans are written.
OPEN, CLOSE, CALL_OPEN, CALL_CLOSE = "<|im_start|>", "\n<|im_end|>\n", "<tool_call>\n", "\n</tool_call>"
MARK = "@@TARGET_%s_%s@@"
_SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class LossPolicy:
    """Which parts of a targeted assistant message are trained on."""

    content: bool = True
    calls: bool = True
    wrappers: bool = False


def normalized(df: DataFrame, messages: str = "messages") -> DataFrame:
    """df with `messages` as canonical structs and `loss_mask` (the assistant's): messages of other roles go, null content is
    empty, and a tool reply without a name has that of the last call of its id."""
    blank = lambda c: F.nullif(c, F.lit(""))
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    calls = lambda m: F.coalesce(F.transform(m["tool_calls"], canonical_call), none)
    df = df.withColumn("__calls", F.flatten(F.transform(messages, calls)))

    def one(m: Column) -> Column:
        answers = F.coalesce(blank(m["tool_call_id"]), blank(m["id"]), F.lit(""))
        known = F.filter("__calls", lambda c: c["id"] == answers)
        name = F.coalesce(blank(m["name"]), F.get(known, F.size(known) - 1)["name"], F.lit(""))
        tool = m["role"] == "tool"
        return F.struct(
            m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), F.when(tool, name).otherwise("").alias("name"),
            F.when(tool, answers).otherwise("").alias("tool_call_id"), calls(m).alias("calls"),
        )

    kept = F.transform(F.filter(messages, lambda m: m["role"].isin(*ROLES)), one)
    return df.withColumn(messages, kept).drop("__calls").withColumn("loss_mask", F.transform(messages, lambda m: m["role"] == "assistant"))


def json_text(arguments: Column) -> Column:
    """JSON text with sorted keys and no spaces; text that is no JSON as a JSON string."""
    quoted = F.to_json(F.array(arguments))
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def parts(message: Column, target: Column, policy: LossPolicy) -> Column:
    """A message's pieces in order: array of struct(text, target)."""
    piece = lambda text, on: F.struct(text.alias("text"), on.alias("target"))
    role = F.coalesce(message["role"], F.lit("unknown"))
    off, assistant = F.lit(False), role == "assistant"
    tool = F.concat(F.lit(" name="), F.coalesce(F.nullif(message["name"], F.lit("")), F.lit("tool")), F.lit(" tool_call_id="), F.coalesce(message["tool_call_id"], F.lit("")))
    header = F.concat(F.lit(OPEN), role, F.when(role == "tool", tool).otherwise(""), F.lit("\n"))
    content = F.coalesce(message["content"], F.lit(""))
    on = assistant & F.coalesce(target, off)

    def call(c: Column) -> Column:
        payload = F.concat(F.lit('{"arguments":'), json_text(F.coalesce(c["arguments"], F.lit("{}"))), F.lit(',"name":'), json_text(F.to_json(F.array(F.coalesce(c["name"], F.lit(""))))), F.lit("}"))
        payload = F.regexp_replace(payload, r'"name":\[(".*")\]\}$', r'"name":$1}')
        wrapper = on & F.lit(policy.calls and policy.wrappers)
        return F.array(piece(F.lit("\n"), off), piece(F.lit(CALL_OPEN), wrapper), piece(payload, on & F.lit(policy.calls)), piece(F.lit(CALL_CLOSE), wrapper))

    calls = F.flatten(F.transform(F.when(assistant, message["calls"]).otherwise(F.filter(message["calls"], lambda _: F.lit(False))), call))
    return F.concat(F.array(piece(header, off), piece(content, on & F.lit(policy.content))), calls, F.array(piece(F.lit(CLOSE), off)))


def rendered(df: DataFrame, messages: str = "messages", mask: str = "loss_mask", policy: LossPolicy = LossPolicy()) -> DataFrame:
    """df with `text` and `spans` (half-open, in characters) of its messages; a mask that is too short targets nothing more."""
    each = F.transform(F.col(messages), lambda m, i: parts(m, F.get(mask, i), policy))
    df = df.withColumn("__parts", F.flatten(each))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["text"])).alias("at"),
        F.when(p["target"] & (F.length(p["text"]) > 0), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    spans = F.aggregate("__parts", F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")), step)["spans"]
    return df.withColumns({"text": F.array_join(F.transform("__parts", lambda p: p["text"]), ""), "spans": spans}).drop("__parts")


def marked(text: Column, spans: Column) -> Column:
    """The text with numbered marks around the spans (in order, apart from each other)."""
    def piece(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        n = (i + 1).cast("string")
        name = lambda side: F.concat(*[F.lit(x) if x is not None else n for x in (MARK.split("%s")[0], None, f"_{side}@@")])
        return F.concat(F.substring(text, before + 1, s["start"] - before), name("START"), F.substring(text, s["start"] + 1, s["end"] - s["start"]), name("END"))

    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, r"@@TARGET_\d+_(?:START|END)@@", "")


_WORD = re.compile(r"\S+")


_PLACES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.arrow_udf(_PLACES)
def word_offsets(text: pa.Array) -> pa.Array:
    """The default tokeniser: words, by their places in characters. Any Arrow function of this type may stand in for it."""
    starts, ends, cuts = array("i"), array("i"), array("i", [0])
    for i in range(len(text)):  # one text is a Python object at a time, and a word is eight bytes
        for m in _WORD.finditer(text[i].as_py() or ""):
            starts.append(m.start())
            ends.append(m.end())
        cuts.append(len(starts))
    ints = lambda a: pa.array(np.frombuffer(a, np.int32), pa.int32())
    places = pa.StructArray.from_arrays([ints(starts), ints(ends)], fields=[pa.field("start", pa.int32()), pa.field("end", pa.int32())])
    return pa.ListArray.from_arrays(ints(cuts), places)


def with_token_stats(df: DataFrame, offsets: Column | None = None, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with tokens, target_tokens (those that meet a span) and target_token_ratio."""
    bounded_batches(df.sparkSession)  # conversations are long
    df = df.withColumn("__offsets", word_offsets(text) if offsets is None else offsets)
    hit = F.size(F.filter("__offsets", lambda o: overlaps(o["start"], o["end"], F.col(spans))))
    df = df.withColumns({"tokens": F.size("__offsets"), "target_tokens": hit}).drop("__offsets")
    return df.withColumn("target_token_ratio", F.coalesce(F.try_divide(F.col("target_tokens"), F.col("tokens")), F.lit(0.0)))


def with_budget(df: DataFrame, budget: int, id_col: str, tokens: str = "tokens") -> DataFrame:
    """df with truncated, and over_budget: an error text for rows with more tokens than the budget."""
    over = F.col(tokens) > budget
    said = F.concat(F.lit("token_count_exceeds_max:"), F.col(id_col).cast("string"), F.lit(":"), F.col(tokens).cast("string"), F.lit(f">{budget}"))
    return df.withColumns({"truncated": over, "over_budget": F.when(over, said)})


def assistant_token_mask(messages: Column, head: Column, body: Column) -> Column:
    """1 for every token that an assistant message adds after its header. head and body: the tokens of each message's header
    and of the rest (arrays), so a message's tokens are those between the lengths of two prefixes of the conversation."""
    mine = lambda m, i: F.concat(F.array_repeat(F.lit(0), F.get(head, i)), F.array_repeat((m["role"] == "assistant").cast("int"), F.get(body, i)))
    return F.flatten(F.transform(messages, mine))


def check_record(df: DataFrame, messages: str = "messages", mask: str = "loss_mask") -> DataFrame:
    """rendered() rows with message_count, roles (a sorted `role:n` list), target_messages, render_chars, target_spans,
    target_chars and target_char_ratio."""
    names = F.array_sort(F.array_distinct(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit("None")))))
    count = lambda r: F.size(F.filter(messages, lambda m: F.coalesce(m["role"], F.lit("None")) == r))
    chars = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return df.withColumns({
        "message_count": F.size(messages), "roles": F.transform(names, lambda r: F.concat(r, F.lit(":"), count(r).cast("string"))), "target_messages": F.size(F.filter(mask, lambda k: k)),
        "render_chars": F.length("text"), "target_spans": F.size("spans"), "target_chars": chars, "target_char_ratio": F.coalesce(F.try_divide(chars, F.length("text")), F.lit(0.0)),
    })


def reference_body(df: DataFrame, messages: str = "messages") -> DataFrame:
    """df with prompt (the conversation up to its last message, and the opening of an answer) and reference (the last message's
    body): what a behaviour probe generates from and is held against."""
    last = F.get(messages, F.size(messages) - 1)
    before = F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    off = LossPolicy(False, False)
    text = lambda ms: F.array_join(F.transform(F.flatten(F.transform(ms, lambda m: parts(m, F.lit(False), off))), lambda p: p["text"]), "")
    whole = F.transform(parts(last, F.lit(False), off), lambda p: p["text"])
    return df.withColumns({"prompt": F.concat(text(before), F.lit(f"{OPEN}assistant\n")), "reference": F.array_join(F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 2, F.lit(0))), "")})
