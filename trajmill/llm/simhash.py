"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `distance` bits of each other are linked. The 64 bits are grouped into m partitions, correlated bits
together; partition i has a threshold t_i (-1: never looked at) and the thresholds sum to distance - m + 1, so two
fingerprints within the distance differ by at most t_i bits in some partition. m and the thresholds are chosen by dynamic
programming on estimated costs: signature rows to shuffle, and candidate pairs by the bits' frequencies in all
fingerprints. A fingerprint probes with one signature for each way to mask t_i bits of partition i; those that share a
signature are verified bit by bit, hence no pair within the distance is lost and no other is linked.

Equal fingerprints are one node. A bucket of signatures yields a spanning forest of its links, not its pairs; a bucket of
more than RUN fingerprints is cut into blocks and compared block against block in separate tasks. Components are found by
alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill.llm.common import partitions, release, slices, written

BITS = 64
RUN = 2048
SHINGLE = 4
DISTANCE = 4
_SHINGLES_AT_ONCE = 1 << 18
#: Estimated seconds: to shuffle and sort a signature row; to verify a candidate pair.
_ROW_S, _PAIR_S = 2e-6, 2e-7
#: Signatures of a fingerprint: plans with more are taken only if every plan has more.
MOST_MASKS = 4096
#: A node's links are dealt to so many tasks.
_SALTS = 8


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: A-Z in lower case, shingles of words with repeats, XXH64 with seed 42; a bit is 1 if set
    in over half of the hashes. Fewer words than a shingle: one shingle of all; none: 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts, ends = (ends - sizes + 1)[: max(1, len(words) - shingle + 1)].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = slice(i, i + _SHINGLES_AT_ONCE)
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[part], ends[part], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def with_simhash(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint `fp` of every row's text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            prints = [simhash(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    found = prints.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in found:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal width, each grown from the bit most correlated with the rest."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        group: list[int] = []
        for _ in range((len(left) + len(group)) // (m - k)):
            score = corr[left][:, group].sum(1) if group else corr[left][:, left].sum(1)
            group.append(left.pop(int(np.argmax(score))))
        groups.append(sorted(group))
    return groups


def thresholds(n: int, together: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """(estimated cost, thresholds) of the cheapest allocation for these groups."""
    p = np.diag(together) / max(n, 1)
    cost = []
    for group in groups:
        near = np.zeros(distance + 2)  # the chance of d differing bits
        near[0] = 1
        for q in 2 * p[group] * (1 - p[group]):
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
        cost.append([0.0, *(n * comb(len(group), t) * _ROW_S + n * n / 2 * near[: t + 1].sum() * _PAIR_S for t in range(min(distance, len(group) - 1) + 1))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (so_far, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                if (key := total + t) not in step or so_far + c[t + 1] < step[key][0]:
                    step[key] = (so_far + c[t + 1], [*chosen, t])
        best = step
    return best[distance - len(groups) + 1]


def plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The partitions that are looked at, each with its threshold; of plans of one cost that with the fewest signatures."""
    options = []
    for m in range(1, distance + 3):
        groups = correlated_groups(n, together, m)
        cost, chosen = thresholds(n, together, groups, distance)
        parts = [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
        size = sum(comb(len(g), t) for g, t in parts)
        options.append((max(size, MOST_MASKS), cost, size, parts))
    return min(options, key=lambda x: x[:3])[3]


def masks(partitions_: list[tuple[list[int], int]]) -> np.ndarray:
    """The bits that each signature keeps."""
    kept = []
    for group, t in partitions_:
        full = sum(1 << b for b in group)
        kept += [full ^ sum(1 << b for b in gone) for gone in combinations(group, t)]
    return np.array(kept, np.uint64)


def _mixed(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit hash; equal ones of different values only add candidates."""
    with np.errstate(over="ignore"):
        x = (x ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def signatures(prints: DataFrame, kept: np.ndarray) -> DataFrame:
    salts = np.arange(1, len(kept) + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for i in range(0, len(fp), step := max(1, 500_000 // len(kept))):
                part = fp[i : i + step]
                keys = _mixed(part[:, None] & kept, salts).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(kept)).view(np.int64))], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key bigint, fp bigint")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest node of its component, without the loops."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of all links between rows of one key; rows are sorted by key."""
    last = np.append(key[1:] != key[:-1], True)
    ends = np.flatnonzero(last)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(key))  # rows of the key after this one
    at = np.flatnonzero(left > 0)
    a, b, held, d = [], [], 0, 1
    while len(at):
        close = np.bitwise_count(fp[at] ^ fp[at + d]) <= distance
        a.append(fp[at[close]])
        b.append(fp[at[close] + d])
        held += len(a[-1])
        if held > 2_000_000:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
        d += 1
        at = at[left[at] >= d]
    return forest(np.concatenate(a), np.concatenate(b)) if held else (fp[:0], fp[:0])


def compare(signed: DataFrame, distance: int, limit: int | None) -> DataFrame:
    """Links (kind 0: a to b) among rows (key, fp) of one key; rows of keys with more than `limit` come back as kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

        def work(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if limit is not None:
                ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
                sizes = np.diff(ends, prepend=-1)
                hot = np.repeat((sizes > limit) | (key[ends] == passing), sizes)
                if hot.any():
                    yield out(1, key[hot], fp[hot])
                    key, fp = key[~hot], fp[~hot]
            if len(key):
                yield out(0, *_links(key, fp, distance))

        keys, prints, held, passing = [], [], 0, None  # passing: a hot key, part of whose rows has gone out
        for batch in batches:
            keys.append(np.asarray(batch.column(0)).view(np.uint64))
            prints.append(np.asarray(batch.column(1)).view(np.uint64))
            held += len(keys[-1])
            if held < 500_000 or (keys[0][0] == keys[-1][-1] and limit is None):  # without a limit a key has two runs at most
                continue
            key, fp = np.concatenate(keys), np.concatenate(prints)
            if key[0] == key[-1]:
                passing = key[0]
                yield out(1, key, fp)
                keys, prints, held = [], [], 0
                continue
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last key may go on
            yield from work(key[:cut], fp[:cut])
            keys, prints, held = [key[cut:]], [fp[cut:]], len(key) - cut
        if held:
            yield from work(np.concatenate(keys), np.concatenate(prints))

    dealt = signed.repartition(partitions(signed.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "kind int, a bigint, b bigint")


def link(prints: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """Edges (a, b) that connect exactly what links of distinct fingerprints (column fp) within the distance connect."""
    n, together = bit_statistics(prints)
    if n < 2:
        return prints.sparkSession.createDataFrame([], "a bigint, b bigint")
    kept = masks(plan(n, together, distance))
    found = written(compare(signatures(prints, kept), distance, run))
    hot = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / run).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = hot.join(blocks, "key").withColumn("__mine", mine).withColumn("__other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = pairs.select(F.xxhash64("key", F.least("__mine", "__other"), F.greatest("__mine", "__other")).alias("key"), "fp")
    edges = found.where("kind = 0").select("a", "b")
    if not hot.isEmpty():
        edges = edges.union(compare(pairs, distance, None).select("a", "b"))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge, with its component's smallest node, by large and small stars in turn."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        sides = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a hub's links meet its least neighbour in several tasks
        both = sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS))).join(least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))), ["u", "salt"])
        moved = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.where("u != v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct())
    was, is_ = None, state(now)
    while is_[0] and is_ != was:
        old, now = now, written(stars(stars(now, True), False))
        release(old)
        was, is_ = is_, state(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots.written_at = now.written_at
    return roots


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, run: int = RUN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, for every row.

    A null or empty text has the fingerprint zero, which links like any other. Equal texts are always in one component.
    Rows that share a doc_id have a result each; a null doc_id is never a component_id unless no other can be. Other
    columns are ignored. No rows: no rows.
    """
    rows = written(with_simhash(docs, shingle))
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link(firsts, distance, run))
    nodes = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = written(nodes.join(least, "root").select("fp", "component_id"))
    return rows.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
