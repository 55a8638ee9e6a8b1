"""Operator 3 with a verified similarity: near-duplicates whose sets of word shingles have a Jaccard similarity of 0.8.

SimHash proposes and whole texts decide. Fingerprints of word pairs within DISTANCE bits (`simhash.link`) are the first
candidates. SimHash alone can't reach a similarity of 0.8 (such texts differ by 10 bits and more, where signatures no longer
tell texts apart), so prefix filtering finds the rest: two sets with a similarity of 0.8 or more share a token among the
first |A| - ceil(0.8 |A|) + 1 of each, in any order of all tokens. Tokens that a sample of the texts shows often come last
in the order, which only keeps the groups of a token small.

Equal texts are one node. First each text of a token is compared with a few others, in an order of the token's own, and
with what SimHash proposes; of these candidates each text's likeliest is verified. Then all pairs follow whose ends the
links found so far do not connect, those candidates among them. What is left out is connected already, so components are
those of all links. Before texts are fetched, pairs are dropped that can't be similar: a text's bitmap holds the parity of
its tokens in each of 1,024 bins, and sets whose bitmaps differ in d bits differ in d tokens or more; what passes meets the
texts' wide bitmaps, of as many bins as tokens at least. A pair that shares several tokens is emitted for the first of a run
of them alone. Texts and shingles are told apart by 64-bit hashes.

Texts themselves move only where a candidate pair needs them; the rest works on a text's prefix, size and bitmap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajmill.llm import simhash
from trajmill.llm.common import partitions, release, slices, tidy, written
from trajmill.llm.simhash import components

SHINGLE = 5
#: The least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: SimHash's own candidates: shingles of so many words, fingerprints within so many bits.
PAIRS, DISTANCE = 2, 4
#: With how many texts of a token each is compared at first.
PARTNERS = 3
#: Texts looked at for frequent tokens, in how many of them a token is frequent, and how many such tokens are kept.
_SAMPLE, _OFTEN, _MOST = 20_000, 3, 200_000
_AT_ONCE, _ROWS = 1 << 18, 1 << 18
_WORDS, _FEW = 16, 4  # of 64 bits in a bitmap, and in one that is folded for the first look at a pair
BITMAP = [f"b{i}" for i in range(_WORDS)]
FOLDED = {f"f{i}": " ^ ".join(BITMAP[i::_FEW]) for i in range(_FEW)}
#: Up to so many names of texts (8 bytes each) are sent to the texts; more are joined.
_SENT = 1_000_000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: A-Z in lower case, XXH64. Fewer words than a shingle: one of all."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined)], np.uint64)
    starts, ends = (ends - sizes + 1)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DENOMINATOR >= NUMERATOR * (len(a) + len(b) - both)


def node(text: str = "text") -> Column:
    """What names a text: equal texts have the same, null is empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each of 64 * _WORDS bins."""
    bins = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % (64 * _WORDS), minlength=64 * _WORDS) & 1
    return np.packbits(bins.astype(np.uint8), bitorder="little").view(np.int64)


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """bitmap() with a power of two of bins, as many as tokens at least; halves that are added (xor) are that of half the bins."""
    n = 64 * _FEW << max(0, (len(tokens) - 1).bit_length() - (64 * _FEW).bit_length() + 1)
    bins = np.bincount((tokens >> np.uint64(16)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(bins.astype(np.uint8), bitorder="little").view(np.int64)


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted tokens that are frequent in a sample of the texts (columns node and text), chosen by the texts' hashes."""
    share = max(1, docs.count() // _SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or b"").view(np.int64))], ["token"])

    sample = docs.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).dropDuplicates(["node"]).select("text").mapInArrow(run, "token bigint")
    found = sample.groupBy("token").count().where(f"count >= {_OFTEN}").orderBy(F.desc("count"), "token").limit(_MOST).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def prepared(docs: DataFrame) -> DataFrame:
    """A written table with a row for each distinct text (columns node and text): node, fp (SimHash), size (tokens), bitmaps and prefix."""
    often = frequent(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            prints, sizes, maps, wide, prefixes = [], [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                tokens = shingles(t or b"")
                common = often[np.searchsorted(often[:-1], tokens)] == tokens if len(often) else np.zeros(len(tokens), bool)
                n = len(tokens) + (-len(tokens) * NUMERATOR) // DENOMINATOR + 1
                prefixes.append(np.concatenate([tokens[~common], tokens[common]])[:n].view(np.int64))
                prints.append(simhash.simhash(t or b"", PAIRS))
                sizes.append(len(tokens))
                maps.append(bitmap(tokens))
                wide.append(wide_bitmap(tokens))
            if sizes:
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in rows])), pa.int32()), pa.array(np.concatenate(rows))) for rows in (wide, prefixes)]
                columns = [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *[pa.array(c) for c in np.ascontiguousarray(np.array(maps).T)], *lists]
                yield pa.RecordBatch.from_arrays(columns, ["node", "fp", "size", *BITMAP, "wide", "prefix"])
        tidy()

    return written(docs.mapInArrow(run, f"node bigint, fp bigint, size bigint, {', '.join(f'{b} bigint' for b in BITMAP)}, wide array<bigint>, prefix array<bigint>").dropDuplicates(["node"]))


def _by_token(rows: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(token, size, node, ...) over rows of whole tokens, in order of token, size and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append([np.asarray(c) for c in batch.columns])
            held += batch.num_rows
            if held < _ROWS or parts[0][0][0] == parts[-1][0][-1]:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1  # the last token may go on
            yield from work(*[c[:cut] for c in columns])
            parts = [[c[cut:] for c in columns]]
            held -= cut
        if held:
            yield from work(*[np.concatenate(c) for c in zip(*parts, strict=True)])
        tidy()

    return rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "size", "node").mapInArrow(run, schema)


def _batch(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *[pa.array(c) for c in columns]], ["kind", "a", "b", "size"])


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of different nodes, the smaller first."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])) if len(low) else np.zeros(0, bool)
    new &= low != high
    return low[new], high[new]


def partners(token: np.ndarray, size: np.ndarray, name: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kind 0: pairs (a, b) of each text with the PARTNERS before it, in an order that differs from token to token; kind 1:
    rows (token, node, size) of tokens with more texts, for which these are not all pairs."""
    first = np.append(True, token[1:] != token[:-1])
    begins = np.flatnonzero(first)
    counts = np.diff(begins, append=len(token))
    many = np.repeat(counts > 1, counts)
    token, size, name = token[many], size[many], name[many]
    # rows come in order of size: if the next sizes don't allow a link, none does
    after = (token[1:] == token[:-1]) & (DENOMINATOR * size[:-1] >= NUMERATOR * size[1:])
    some = np.append(after, False) | np.append(False, after) if len(token) else many[:0]
    token, size, name = token[some], size[some], name[some]
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    counts = np.diff(begins, append=len(token))
    more = np.repeat(counts > PARTNERS + 1, counts)
    yield _batch(1, token[more], name[more], size[more])
    with np.errstate(over="ignore"):
        order = np.lexsort(((name ^ token) * np.int64(-7046029254386353131), token))
    token, size, name = token[order], size[order], name[order]
    found = []
    for d in range(1, PARTNERS + 1):
        at = np.flatnonzero(token[d:] == token[:-d])
        fits = DENOMINATOR * np.minimum(size[at], size[at + d]) >= NUMERATOR * np.maximum(size[at], size[at + d])
        found.append((name[at[fits]], name[at[fits] + d]))
    a, b = _pairs(*[np.concatenate(x) for x in zip(*found, strict=True)])
    yield _batch(0, a, b, np.zeros(len(a), np.int64))


def across(token: np.ndarray, size: np.ndarray, name: np.ndarray, root: np.ndarray, before: np.ndarray, *maps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """kind 0: all pairs of texts of one token whose sizes and bitmaps allow a link and whose roots differ. before: the text's
    token before this one among its rows (0: none); texts with the same one meet there."""
    ends = np.flatnonzero(np.append(token[1:] != token[:-1], True))
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(token))  # rows of the token after this one
    maps = [m.view(np.uint64) for m in maps]
    a, b, held, d, at = [], [], 0, 1, np.flatnonzero(left > 0)
    while len(at) or held:
        at = at[DENOMINATOR * size[at] >= NUMERATOR * size[at + d]] if len(at) else at  # sizes grow with d
        apart = at[(root[at] != root[at + d]) & ((before[at] != before[at + d]) | (before[at] == 0))] if len(at) else at
        if len(apart):
            differ = sum(np.bitwise_count(m[apart] ^ m[apart + d]).astype(np.int64) for m in maps)
            apart = apart[differ * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * (size[apart] + size[apart + d])]
        a.append(name[apart])
        b.append(name[apart + d] if len(apart) else name[:0])
        held += len(apart)
        d += 1
        at = at[left[at] >= d]
        if held > _AT_ONCE or (held and not len(at)):
            x, y = _pairs(np.concatenate(a), np.concatenate(b))
            yield _batch(0, x, y, np.zeros(len(x), np.int64))
            a, b, held = [], [], 0


def possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sizes and bitmaps allow a link, with the bits that differ."""
    def side(end: str, size: str, columns: dict[str, str]) -> DataFrame:
        return texts.select(F.col("node").alias(end), F.col("size").alias(size), *[F.expr(x).alias(f"{end}_{c}") for c, x in columns.items()]).hint("merge")

    limit = f"<= {DENOMINATOR - NUMERATOR} * (n + m)"
    both = pairs.distinct().join(side("a", "n", FOLDED), "a").join(side("b", "m", FOLDED), "b")
    differ = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in FOLDED)
    near = both.where(f"{DENOMINATOR} * least(n, m) >= {NUMERATOR} * greatest(n, m) and {DENOMINATOR + NUMERATOR} * ({differ}) {limit}").select("a", "b")
    # sizes that allow a link make widths that are equal or twice as large
    half = lambda c: f"transform(sequence(1, size({c}) div 2), i -> {c}[i - 1] ^ {c}[i - 1 + size({c}) div 2])"
    wide = near.join(side("a", "n", {"wide": "wide"}), "a").join(side("b", "m", {"wide": "wide"}), "b")
    x, y = f"if(size(a_wide) > size(b_wide), {half('a_wide')}, a_wide)", f"if(size(b_wide) > size(a_wide), {half('b_wide')}, b_wide)"
    wide = wide.withColumn("differ", F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"))
    return wide.where(f"{DENOMINATOR + NUMERATOR} * differ {limit}").select("a", "b", "differ")


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of every text's pairs (a, b, differ) that of the fewest differing bits."""
    ends = pairs.select(F.col("a").alias("x"), F.struct("differ", F.col("b").alias("y")).alias("to")).union(pairs.select(F.col("b").alias("x"), F.struct("differ", F.col("a").alias("y")).alias("to")))
    best = ends.groupBy("x").agg(F.min("to").alias("to"))
    return best.select(F.least("x", "to.y").alias("a"), F.greatest("x", "to.y").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """A written table of those of the distinct pairs (a, b) of nodes whose texts (in docs: node, text) are similar."""
    pairs = written(pairs.select("a", "b"))
    ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    few = ends.count() <= _SENT
    own = written(docs.join(F.broadcast(ends) if few else ends.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))
    one = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = one.join(own.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, sets = None, None
        for batch in (part for whole in batches for part in slices(whole, 2)):
            keep = []
            for x, b, y in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if b != was:  # rows come sorted by b
                    was, sets = b, shingles(y or b"")
                keep.append(similar(shingles(x or b""), sets))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    links = written(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
    release(pairs, ends, own)
    return links


def proposed(texts: DataFrame) -> DataFrame:
    """SimHash's candidates: of texts of one fingerprint each with the least, and the least of linked fingerprints."""
    least = written(texts.groupBy("fp").agg(F.min("node").alias("least")))
    linked = simhash.link(least, DISTANCE).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    alike = texts.select("fp", "node").join(least, "fp").where("node != least")
    pairs = linked.select("x", "y").union(alike.select("node", "least")).toDF("x", "y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(node, root): every text that has a similar one, with the least node of those it reaches over links.

    A null text is empty; empty texts are one node, and a text of fewer words than a shingle has all its words as the only
    one. Only column `text` is looked at; repeated rows are one node. No rows: no rows."""
    docs = docs.select(node().alias("node"), "text")
    texts = prepared(docs)
    schema = "kind int, a bigint, b bigint, size bigint"
    found = written(_by_token(texts.select(F.explode("prefix").alias("token"), "size", "node"), partners, schema))
    first = written(possible(proposed(texts).union(found.where("kind = 0").select("a", "b")), texts))
    nearest = links = verified(likeliest(first), docs)
    roots = components(links)
    # pairs that are there already, a few a text, make one component of a group of copies before its tokens' texts are compared all with all
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    open_ = first.join(end("a"), "a", "left").join(end("b"), "b", "left").where("coalesce(a_root, a) != coalesce(b_root, b)").select("a", "b")
    further = verified(open_, docs)
    release(roots)
    links = links.union(further)
    roots = components(links)
    rows = found.where("kind = 1").select(F.col("a").alias("token"), "size", F.col("b").alias("node"))
    known = texts.select("node", *BITMAP).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *BITMAP)
    rows = rows.join(known.hint("merge"), "node").withColumn("before", F.coalesce(F.lag("token").over(Window.partitionBy("node").orderBy("token")), F.lit(0).cast("long")))
    rows = rows.select("token", "size", "node", "root", "before", *BITMAP)
    more = verified(possible(_by_token(rows, across, schema).select("a", "b"), texts), docs)
    release(found, first, roots, texts)
    result = components(links.union(more))
    release(nearest, further, more)
    return result
