"""Text normalisation, answers and numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMBER = r"-?\d[\d,]*\.?\d*"
MONEY = r"-?\$?\d[\d,]*\.?\d*"
_LAST_CHARS = 8000


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalized(s: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces; null is empty."""
    bare = F.translate(F.lower(F.coalesce(s, F.lit(""))), PUNCTUATION, "")
    return squeezed(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def tokens_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalized(pred) == normalized(gold)).cast("double")


def bag_overlap(p: Column, g: Column) -> Column:
    """The size of the intersection of two bags of tokens."""
    count = lambda bag, t: F.size(F.filter(bag, lambda x: x == t))
    return F.aggregate(F.array_intersect(p, g), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))


def token_f1(p: Column, g: Column) -> Column:
    """F1 of two token arrays; 1 if both are empty, 0 if one is."""
    both = bag_overlap(p, g).cast("double")
    precision, recall = both / F.size(p), both / F.size(g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).when(both == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def last_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), -1)


def _has(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) > 0


def answer_of(text: Column) -> Column:
    """The last answer tag's text, else what follows the last `answer`, else the last line that is not blank."""
    tag, phrase = r"(?is)<answer>\s*(.*?)\s*</answer>", r"(?i)(?:the\s+)?answer(?:\s+is)?\s*:?\s*(.+)"
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.when(_has(text, tag), F.trim(last_of(text, tag))).when(_has(text, phrase), F.trim(F.regexp_replace(F.trim(last_of(text, phrase)), r"\.+$", "")))
    return F.when(text.isNull(), "").otherwise(F.coalesce(found, F.get(lines, F.size(lines) - 1), F.lit("")))


def canonical_number(s: Column) -> Column:
    """A number as text: no thousands separators, no trailing dot, integers without a fraction; null if it is none."""
    value = F.rtrim(F.trim(F.translate(s, ",$", "")), F.lit(".")).try_cast("double")
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def numeric_answer(text: Column) -> Column:
    """The first number after the last `####`, else the last number."""
    tail = F.regexp_extract(F.element_at(F.split(text, "####"), -1), NUMBER, 0)
    hashed = F.when(F.contains(text, F.lit("####")) & (tail != ""), tail)
    return canonical_number(F.coalesce(hashed, F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1))))


def money_value(s: Column) -> Column:
    return F.translate(F.rtrim(F.trim(s), F.lit(".")), ",$%", "").try_cast("double")


def flexible_answer(text: Column) -> Column:
    """struct(value, rule): the last number after `####`, in a box, after a phrase, or at all, by the first rule that has one."""
    text = F.when(F.length(text) > _LAST_CHARS, F.substring(text, -_LAST_CHARS, _LAST_CHARS)).otherwise(text)
    rules = {"hash": rf"####\s*({MONEY})", "boxed": rf"\\boxed\{{\s*({MONEY})\s*\}}", "phrase": rf"(?i)(?:answer|result|total|equals?)\s*(?:is|:|=)?\s*[\*\s\$]*({MONEY})", "last_number": f"({MONEY})"}
    last = {k: money_value(F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1))) for k, p in rules.items()}
    options = [F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(k).alias("rule"))) for k, v in last.items()]
    none = F.struct(F.lit(None).cast("double").alias("value"), F.when(F.coalesce(text, F.lit("")) == "", "empty").otherwise("none").alias("rule"))
    return F.coalesce(*options, none)


def number_score(pred: Column, gold: Column, tolerance: float = 1e-4) -> Column:
    return F.coalesce((F.abs(pred - gold) < tolerance).cast("double"), F.lit(0.0))


def terms(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def preview(s: Column, limit: int) -> Column:
    one = squeezed(F.coalesce(s, F.lit("")))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit - 3), F.lit("..."))).otherwise(one)
