"""Language identification as a mixture: how much of a document is in which language.

Each language has smoothed frequencies of hashed letter trigrams (words in lower case, with their edges). A word's
likelihood in a language is the product over its trigrams. Expectation-maximisation finds the languages' proportions of a
document's words; languages are added to the set, the most probable first, while the log likelihood grows by more than the
penalty. The prediction is the language with the largest proportion, the score that proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajmill.llm.common import slices, tidy

#: Trigrams are hashed to so many bins; the model has a row of them for each language.
BINS = 1 << 15
#: What a further language must add to the log likelihood, times log(words).
PENALTY = 3.0
SMOOTH = 0.5
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
_CHARS_AT_ONCE = 1 << 20
#: From so many rows on, equal words are held as one with their number.
_ROWS = 1 << 16
#: EM ends when no proportion moves by more.
_CLOSE = 1e-4


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bin of each letter's trigram, where words start among them), for stretches of a text that end with a word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _CHARS_AT_ONCE)
        while end < len(text) and text[end].isalpha():
            end += 1
        code = np.frombuffer(text[at:end].lower().encode("utf-32-le", "replace"), np.uint32)
        at = end
        letter = _letters()[code]
        if not letter.any():
            continue
        c = np.zeros(len(code) + 2, np.uint64)
        c[1:-1] = np.where(letter, code, 0)
        with np.errstate(over="ignore"):
            h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        first = letter & ~np.append(False, letter[:-1])
        yield (h >> np.uint64(64 - 15)).astype(np.int64)[letter], np.flatnonzero(first[letter])


def count(docs: DataFrame, label: str = "lang") -> dict[str, np.ndarray]:
    """The trigram counts of every language in all of docs (columns text and label); null labels and texts are left out.

    As many rows as languages times BINS reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for bins, _ in trigrams(text):
                    if lang not in own:
                        own[lang] = np.zeros(BINS, np.int64)
                    own[lang] += np.bincount(bins, minlength=BINS)
        for lang, n in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n.tolist()], pa.list_(pa.int64()))], ["lang", "n"])
        tidy()

    found = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("text", F.col(label).alias("lang")).mapInArrow(run, "lang string, n array<bigint>")
    sums = found.select("lang", F.posexplode("n").alias("bin", "n")).where("n > 0").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("all")).collect():
        out[r.lang] = np.zeros(BINS, np.int64)
        for b, n in r["all"]:
            out[r.lang][b] = n
    return out


def model(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The languages, and the log probability of each trigram bin in each: an array BINS x languages."""
    langs = sorted(counts)
    table = np.zeros((BINS, len(langs)), np.float32)
    for i, lang in enumerate(langs):
        n = counts[lang] + SMOOTH
        table[:, i] = np.log(n / n.sum())
    return langs, table


def proportions(like: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """EM on the log likelihoods of words in languages, each word so many times: (proportions, log likelihood)."""
    top = like.max(1)
    p = np.exp(like - top[:, None])
    total = times.sum()
    share = np.full(like.shape[1], 1 / like.shape[1])
    while True:
        weight = p * share
        new = times @ (weight / weight.sum(1)[:, None]) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < _CLOSE:
            return share, float(times @ (np.log(np.maximum(p @ share, 1e-300)) + top))


def words(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the log likelihood of each word in each language, how often it occurs); equal rows are made one in long texts."""
    like, times = np.zeros((0, table.shape[1])), np.zeros(0)
    for bins, starts in trigrams(text):
        like = np.concatenate([like, np.add.reduceat(table[bins].astype(np.float64), starts, axis=0)])
        times = np.append(times, np.ones(len(starts)))
        if len(like) > _ROWS:
            like, at = np.unique(like, axis=0, return_inverse=True)
            times = np.bincount(at.ravel(), times)
    return like, times


def identify(text: str, table: np.ndarray) -> dict[int, float]:
    """The languages (by index) of a text with their proportions, the largest first, of equal ones the lower index first;
    empty if the text has no letter."""
    like, times = words(text, table)
    if not len(like) or not table.shape[1]:
        return {}
    total = times @ like
    best, value = [int(total.argmax())], float(total.max())
    chosen, cost = {best[0]: 1.0}, PENALTY * log(times.sum() + 1)
    if like.shape[1] == 1 or times @ like.max(1) - value <= cost:  # no mixture can pay for a second language
        return chosen
    order = [int(i) for i in np.argsort(-proportions(like, times)[0], kind="stable")]
    while len(best) < len(order):
        best.append(next(i for i in order if i not in best))
        share, new = proportions(like[:, best], times)
        if new - value <= cost:
            break
        value, chosen = new, dict(sorted(zip(best, share.tolist(), strict=True), key=lambda x: (-x[1], x[0])))
    return chosen


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, text: str, drop: str | None = None) -> DataFrame:
    """docs, without the column `drop`, with lang_pred, score and lang_set (the languages found, with their proportions)."""

    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, where):
                found = [identify(t or "", table) for t in batch.column(where).to_pylist()]
                first = [next(iter(x.items()), None) for x in found]
                pred = pa.array([langs[x[0]] if x else UNKNOWN for x in first], pa.string())
                score = pa.array([min(1.0, x[1]) if x else 0.0 for x in first], pa.float64())
                sets = pa.array([[(langs[i], p) for i, p in x.items()] for x in found], pa.map_(pa.string(), pa.float64()))
                kept = [i for i, n in enumerate(batch.schema.names) if n != drop]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pred, score, sets], [*[batch.schema.names[i] for i in kept], "lang_pred", "score", "lang_set"])
        tidy()

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != drop)
    return docs.mapInArrow(run, f"{rest}, lang_pred string, score double, lang_set map<string,double>")


def identify_documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), held_out, lang_pred, score and lang_set for every row.

    Learned from text and non-null lang of the rows whose crc32(doc_id) leaves another remainder than HELD_OUT; a
    prediction sees the text alone. Null texts, texts without a letter, and any text if nothing can be learned: `und` with
    score 0. Of languages of one proportion (or likelihood) the first by code point is predicted. Every word of a text
    counts, however long it is. Rows that share a doc_id have a result each. Other columns are ignored. No rows: no rows.
    """
    langs, table = model(count(docs.where(~F.coalesce(held_out(), F.lit(False)))))
    own, held = keep or ["doc_id"], F.coalesce(held_out(), F.lit(False)).alias("held_out")
    if "text" in own:
        return predict(docs.select(*own, held), langs, table, "text")
    return predict(docs.select(*own, held, F.col("text").alias("__text")), langs, table, "__text", "__text")
