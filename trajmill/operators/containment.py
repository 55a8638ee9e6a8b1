"""Which of many patterns lie in which texts: an Aho-Corasick automaton that reads every text once.

Patterns go to shards of bounded size. A shard's automaton is a table of next states by state and class of byte, so reading a
byte is one lookup; it is sent to the tasks once. In a task texts are cut into lanes of equal length, which overlap by the longest
pattern, and all lanes take a step at a time in numpy. No text is repeated or shuffled; of the patterns no pairs with texts are formed but
those that are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns of a shard (so many states at most, times classes of bytes), of a lane, and of texts that are read together.
SHARD_BYTES, LANE, TEXT_BYTES = 128 << 10, 2048, 8 << 20


@dataclass
class Automaton:
    """step[state, class of byte]: the next state; ends[state]: the pattern that ends there, or -1; link[state]: the longest
    proper suffix at which one ends, or 0."""

    classes: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    link: np.ndarray
    longest: int

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (text, pattern)."""
        blob = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        lanes = np.maximum(1, -(-size // LANE))
        text = np.repeat(np.arange(len(texts)), lanes)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        left = np.minimum(size[text] - at, LANE + self.longest - 1)  # a pattern that begins in a lane ends in it
        order = np.argsort(-left, kind="stable")  # lanes that are still read come first
        text, place, left = text[order], (begin[text] + at)[order], left[order]
        state, some, hit = np.zeros(len(text), np.int32), self.ends >= 0, []
        some |= self.link > 0
        running = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")  # lanes longer than s
        for s, n in enumerate(running.tolist()):
            state[:n] = self.step[state[:n], blob[place[:n] + s]]
            if len(found := np.flatnonzero(some[state[:n]])):
                hit.append((text[found], state[found]))
        if not hit:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, states = (np.concatenate(x) for x in zip(*hit, strict=True))
        pairs = []
        while len(states):  # a state's own pattern, then those of its suffixes
            own = self.ends[states] >= 0
            pairs.append(np.unique(owner[own] * len(self.ends) + self.ends[states[own]]))
            states, owner = self.link[states], owner
            states, owner = states[states > 0], owner[states > 0]
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ends), both % len(self.ends)


def automaton(patterns: list[bytes]) -> Automaton:
    """Of distinct patterns that are not empty."""
    classes = np.zeros(256, np.uint8)
    used = sorted({c for p in patterns for c in p})
    classes[used] = np.arange(1, len(used) + 1) if len(used) < 256 else np.arange(256)
    width = len(used) + (len(used) < 256)
    children: list[dict[int, int]] = [{}]
    depth, ends = [0], [-1]
    for i, p in enumerate(patterns):
        state = 0
        for c in classes[np.frombuffer(p, np.uint8)].tolist():
            if (to := children[state].get(c)) is None:
                to = children[state][c] = len(children)
                children.append({})
                depth.append(depth[state] + 1)
                ends.append(-1)
            state = to
        ends[state] = i
    step, fail, link = np.zeros((len(children), width), np.int32), [0] * len(children), [0] * len(children)
    for state in sorted(range(len(children)), key=depth.__getitem__):  # suffixes are shallower
        suffix = fail[state]
        if state:
            link[state] = suffix if ends[suffix] >= 0 else link[suffix]
            step[state] = step[suffix]
        for c, to in children[state].items():
            fail[to] = int(step[suffix, c]) if state else 0
            step[state, c] = to
    return Automaton(classes, step, np.array(ends, np.int64), np.array(link, np.int32), max(map(len, patterns), default=1))


def contained(corpus: DataFrame, golds: DataFrame, doc: str, text: str, gold: str, gold_text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, gold): which gold texts (blank and null ones never) lie in which texts, each pair once a row of the corpus and of the golds.

    Golds with one text are looked for once. Shards are runs of the golds' hashes; each comes to the driver by itself, and the corpus is read once a shard.
    """
    spark = corpus.sparkSession
    wanted = golds.where(F.col(gold_text) != "").select(F.col(gold_text).alias("__p"), F.octet_length(gold_text).alias("__n")).distinct()
    total = wanted.agg(F.sum("__n")).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes)) if total > shard_bytes else 1
    wanted = wanted.withColumn("__shard", F.pmod(F.xxhash64("__p"), F.lit(shards)))
    kind = dict(corpus.dtypes)[doc]
    parts = []
    for shard in range(shards):
        patterns = [r[0] for r in wanted.where(F.col("__shard") == shard).select("__p").collect()]
        if not patterns:
            continue
        sent = spark.sparkContext.broadcast((automaton([p.encode() for p in patterns]), patterns))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own, names = sent.value
            names = pa.array(names, pa.string())
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                ends, at = np.cumsum([len(t) for t in texts]), 0
                while at < len(texts):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
                    row, pattern = own.find(texts[at:to])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), names.take(pa.array(pattern))], [doc, "__p"])
                    at = to

        parts.append(corpus.select(doc, text).mapInArrow(run, f"{doc} {kind}, __p string"))
    if not parts:
        return spark.createDataFrame([], f"{doc} {kind}, {gold} {dict(golds.dtypes)[gold]}")
    found = reduce(DataFrame.unionByName, parts)
    return found.join(golds.select(gold, F.col(gold_text).alias("__p")), "__p").select(doc, gold)
