"""A trigram language model in an Elias-Fano trie.

The first level holds the words (sorted 64-bit hashes; a word's id is its rank), the second the words seen after each word,
the third the words seen after each pair. Below the first, a level has for each context (an entry of the level above, by
its rank) a range of entries, in order of their last word. Where the ranges begin is a monotone sequence of pointers; the
last words are made monotone by adding to each range what the ranges before it end with. Both are Elias-Fano sequences (low
bits packed, high bits in unary). In the third level a last word is not named by its id but by its rank among the
successors of the word before it, which is smaller: (u, v, w) is stored under (u, v) as w's rank after v.

An entry is found by the successor of its word relative to its context: the pointers give the range and the entry before
it what was added; two selects give the bucket of the high bits, a binary search over the low bits the position.

p1(w) = (c(w) + 1/2) / (N + (V + 1)/2);  p(w | x) = (c(x w) + K p(w | x')) / (c(x) + K), x' without the first word of x.
K of a level is the value of GRID that gives the training text the best leave-one-out likelihood. Of each entry log10 p is
kept and, above the last level, log10 of what its context leaves to the lower level, K / (c(x) + K), in 8 bits each.

Levels are cut into shards by ranges of (context, word) that hold about SHARD_KEYS tokens, whose bounds come from the counts
of the level above; a frequent context is cut into several. So their number grows with the text and their size does not.
A shard is a few flat files in the shared folder that every scoring process maps into memory: what it holds grows with the
pages it touches. Counting and encoding are Spark stages; tokens are hashed once and kept as a table.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajmill.llm.common import partitions, remove, shared_folder, written

FOLDS, HELD_OUT = 5, 1
SHARD_KEYS = 2_000_000
#: Candidates for K.
GRID = (0.25, 1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0, 1e6, 1e9)
CODES = 256
#: Shards that a process keeps open.
OPEN_SHARDS = 256
_TOKENS_AT_ONCE = 1_000_000
_BYTES_AT_ONCE = 8 << 20
#: The hash that stands for the end of a text (and for what precedes its first word).
END = 0
#: The levels' counts are summed up in so many pieces a shard, from which the next level's bounds are taken.
_MARKS = 16
_FOLD = 4_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# --- integers as they are shuffled -----------------------------------------------------------------------------------


def _packed(values: np.ndarray, kind: type = np.uint64) -> bytes:
    """Compressed, with the values' bytes in lanes."""
    import zstandard

    lanes = np.ascontiguousarray(values.astype(kind, copy=False)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(lanes).tobytes())


def _unpacked(data: bytes, kind: type = np.uint64) -> np.ndarray:
    import zstandard

    lanes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(lanes.T).view(kind).ravel()


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return list(zip(edges, [*edges[1:], len(values)], strict=True))


# --- Elias-Fano ------------------------------------------------------------------------------------------------------


def encode(keys: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low bits, packed low parts, high words, zeros and ones before each high word) of sorted keys below universe."""
    n = len(keys)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    parts = np.zeros((-(-n * low // 64) + 2) * 8, np.uint8)  # two words may be read from any place up to the end
    if low:
        bits = np.arange(low, dtype=np.uint64)
        for i in range(0, n, step := 8 * 65536):
            some = ((keys[i : i + step, None] >> bits) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(some.ravel(), bitorder="little")
            parts[i * low // 8 : i * low // 8 + len(packed)] = packed
    at = (keys >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(-(-((universe >> low) + n + 2) // 64) * 64, bool)
    high[at] = True
    words = np.packbits(high, bitorder="little").view(np.uint64)
    ones = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])
    return low, parts.view(np.uint64), words, (np.arange(len(words)) * 64 - ones).astype(np.int32), ones.astype(np.int32)


def _select_table() -> np.ndarray:
    """The place of the r-th one of byte b, at 8 * b + r."""
    out = np.zeros((256, 8), np.int64)
    for b in range(256):
        places = [i for i in range(8) if b >> i & 1]
        out[b, : len(places)] = places
    return out.ravel()


_SELECT = _select_table()
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_TWOS, _FOURS, _EIGHTS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th (from 0) one in each word: the ones up to each of its bytes' ends are summed up side by side."""
    sums = word - ((word >> np.uint64(1)) & _TWOS)
    sums = (sums & _FOURS) + ((sums >> np.uint64(2)) & _FOURS)
    sums = ((sums + (sums >> np.uint64(4))) & _EIGHTS) * _EACH
    rank = rank.astype(np.uint64)
    place = np.bitwise_count(((rank * _EACH | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)  # bytes that end with at most rank ones
    rank = rank - (((sums << np.uint64(8)) >> place) & np.uint64(255))
    return place.astype(np.int64) + _SELECT[((((word >> place) & np.uint64(255)) << np.uint64(3)) + rank).astype(np.int64)]


@dataclass
class Sequence:
    """A monotone sequence."""

    n: int
    low: int
    parts: np.ndarray
    words: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        before = self.zeros if flip else self.ones
        k = k.astype(before.dtype)  # or before would be copied
        word = np.searchsorted(before, k, "right") - 1
        bits = self.words[word]
        return (word << 6) + select_in_word(~bits if flip else bits, k - before[word])

    def select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) zero of the high bits."""
        return self._select(k, True)

    def select1(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) one of the high bits."""
        return self._select(k, False)

    def _next(self, place: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the k-th one (zero), of which the one before is at `place` (-1: none is): most often in the same word."""
        word = place >> 6
        bits = self.words[word]
        bits = (~bits if flip else bits) & (np.uint64(2**64 - 2) << (place & 63).astype(np.uint64))
        out = (word << 6) + np.bitwise_count(~bits & (bits - np.uint64(1)))
        far = np.flatnonzero(bits == 0)
        out[far] = self._select(k[far], flip)
        return out

    def low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        at, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = self.parts[at] >> shift
        both |= (self.parts[at + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return both & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self.select1(i) - i).astype(np.uint64) << np.uint64(self.low)) | self.low_part(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those after them."""
        place = self.select1(i)
        after = self._next(place, i + 1, False)
        low = np.uint64(self.low)
        return ((place - i).astype(np.uint64) << low) | self.low_part(i), ((after - i - 1).astype(np.uint64) << low) | self.low_part(i + 1)

    def find(self, keys: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The position of each key between begin and end, or -1."""
        high = (keys >> np.uint64(self.low)).astype(np.int64)
        known = high < len(self.words) * 64 - self.n - 1
        high = np.where(known, high, 0)
        place = self.select0(np.maximum(high - 1, 0))
        place[high == 0] = -1
        lo = np.maximum(place + 1 - high, begin)
        hi = np.where(known, np.minimum(self._next(place, high, True) - high, self.n if end is None else end), 0)
        want = keys & np.uint64((1 << self.low) - 1)
        todo = np.flatnonzero(hi - lo > 1)
        left, right, low = lo[todo], hi[todo], want[todo]
        while len(todo):  # the last entry whose low part is at most the key's
            mid = (left + right) >> 1
            less = self.low_part(mid) <= low
            left, right = np.where(less, mid, left), np.where(less, right, mid)
            lo[todo] = left
            more = right - left > 1
            todo, left, right, low = todo[more], left[more], right[more], low[more]
        there = lo < hi
        there &= self.low_part(np.minimum(lo, self.n)) == want
        return np.where(there, lo, -1)


# --- files -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _place(folder: str) -> tuple:
    """(the folder's file system, its path there), which takes longer to find out than a file takes to open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """A flat file in the shared folder; a repeated task writes the same bytes, and the last step is a rename."""
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(array).view(np.uint8).data)
    system.move(part, f"{path}/{name}")


def _get(folder: str, name: str, kind: type) -> np.ndarray:
    """The file's array: mapped into memory where the shared folder is a file system, else read."""
    from pyarrow import fs

    system, path = _place(folder)
    if isinstance(system, fs.LocalFileSystem):
        if not os.path.getsize(f"{path}/{name}"):
            return np.zeros(0, kind)
        return np.memmap(f"{path}/{name}", kind, "r")
    with system.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def _put_sequences(folder: str, name: str, *sequences: tuple[np.ndarray, int]) -> list[int]:
    """Sequences of (keys, universe) in one file, as opening one costs as much as many lookups: the lengths of their arrays, then
    these, in 64-bit words. Gives the sequences' low bits."""
    lows, arrays = [], []
    for keys, universe in sequences:
        low, *own = encode(keys, universe)
        lows.append(low)
        arrays += [np.append(x, np.zeros(-len(x) % (8 // x.itemsize), x.dtype)).view(np.uint64) for x in own]
    _put(folder, name, np.concatenate([np.array([len(x) for x in arrays], np.uint64), *arrays]))
    return lows


def _get_sequences(folder: str, name: str, *sizes: tuple[int, int]) -> list[Sequence]:
    """The file's sequences, whose n and low bits are given."""
    data = np.asarray(_get(folder, name, np.uint64))
    ends = np.cumsum(np.append(4 * len(sizes), data[: 4 * len(sizes)].astype(np.int64))).tolist()
    out = []
    for i, (n, low) in enumerate(sizes):
        parts, words, zeros, ones = (data[ends[j] : ends[j + 1]] for j in range(4 * i, 4 * i + 4))
        out.append(Sequence(n, low, parts, words, zeros.view(np.int32)[: len(words)], ones.view(np.int32)[: len(words)]))
    return out


class Shards:
    """What levels have in common: shards that are opened when they are needed, the latest OPEN_SHARDS of which stay open."""

    folder: str

    def shard(self, s: int) -> tuple:
        if s not in self.open:
            self.open[s] = self.load(s)
            if len(self.open) > OPEN_SHARDS:
                self.open.popitem(last=False)
        self.open.move_to_end(s)
        return self.open[s]

    def __getstate__(self):
        return {**self.__dict__, "open": OrderedDict()}


@dataclass
class Words(Shards):
    """The first level: shard s has the hashes from bounds[s] up to bounds[s + 1]; offsets[s] is its first word's id."""

    folder: str
    bounds: list[int]
    metas: dict[int, tuple[int, int]]  # shard: (n, low)
    open: OrderedDict = field(default_factory=OrderedDict)

    def __post_init__(self):
        self.offsets = np.append(0, np.cumsum([self.metas.get(s, (0, 0))[0] for s in range(len(self.bounds))]))

    @property
    def n(self) -> int:
        return int(self.offsets[-1])

    def load(self, s: int) -> tuple[Sequence, np.ndarray]:
        return *_get_sequences(self.folder, f"{s}", self.metas[s]), _get(self.folder, f"{s}.counts", np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each of some hashes in order."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        ends = [*np.searchsorted(hashes, np.array(self.bounds[1:], np.uint64)).tolist(), len(hashes)]
        start = 0
        for s, end in enumerate(ends):
            if end > start and s in self.metas:
                sequence, values = self.shard(s)
                found = sequence.find(hashes[start:end] - np.uint64(self.bounds[s]))
                hit = np.flatnonzero(found >= 0)
                found = found[hit]
                ids[start + hit] = found + self.offsets[s]
                counts[start + hit] = values[found]
            start = end
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        shard, out = np.searchsorted(self.offsets, ids, "right") - 1, np.zeros(len(ids), np.int64)
        for s in np.unique(shard):
            at = shard == s
            out[at] = self.shard(int(s))[1][ids[at] - self.offsets[s]]
        return out


@dataclass
class Grams(Shards):
    """A level below the first: shard s has the entries from (context, word) bounds[s] up to bounds[s + 1].

    metas: n, low and the pointers' low bits, number of contexts, entries of the first shard's context in shards before
    (carry). Codes: log10 p and, if `inner`, log10 of what the entry as a context leaves to the lower level."""

    folder: str
    bounds: list[tuple[int, int]]
    metas: dict[int, dict]
    inner: bool
    open: OrderedDict = field(default_factory=OrderedDict)

    def __post_init__(self):
        self.offsets = np.append(0, np.cumsum([self.metas[s]["n"] if s in self.metas else 0 for s in range(len(self.bounds))]))
        self.starts = np.array(self.bounds, np.int64).reshape(-1, 2)

    def load(self, s: int) -> tuple:
        m = self.metas[s]
        codes = [np.asarray(_get(self.folder, f"{s}.{name}", np.uint8)) for name in (("p", "rest") if self.inner else ("p",))]
        return *_get_sequences(self.folder, f"{s}", (m["n"], m["low"]), (m["contexts"] + 1, m["pointer_low"])), *codes

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(index or -1, rank in the context, codes) of each of some pairs of a context and a word, which are in order."""
        out = [np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64), *[np.zeros(len(context), np.uint8) for _ in range(1 + self.inner)]]
        shard = shards_of(context, word, self.starts)
        for a, b in runs(shard):
            s = int(shard[a])
            if s not in self.metas:
                continue
            words, pointers, *codes = self.shard(s)
            own = context[a:b] - self.starts[s, 0]
            first = np.append(True, own[1:] != own[:-1])
            distinct, back = own[first], np.cumsum(first) - 1
            begin, end = (x.astype(np.int64) for x in pointers.access_two(distinct))
            base = np.where(begin > 0, words.access(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))
            begin = begin[back]
            at = words.find(base[back] + word[a:b].astype(np.uint64), begin, end[back])
            some = np.flatnonzero(at >= 0)
            at, to = at[some], a + some
            out[0][to] = at + self.offsets[s]
            out[1][to] = at - begin[some] + np.where(own[some] == 0, self.metas[s]["carry"], 0)
            for i, c in enumerate(codes):
                out[2 + i][to] = c[at]
        return tuple(out)


def ordered(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What sorts by (context, word), neither below 0 unless all contexts are 0: as one number where both fit in, which is sorted
    several times faster."""
    bits = int(word.max()).bit_length() if len(word) else 0
    if len(word) and int(context.max()).bit_length() + bits < 64:
        return np.argsort((context << bits) | word)
    return np.lexsort((word, context))


def shards_of(context: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The last shard that starts at or before each (context, word)."""
    s = np.searchsorted(starts[:, 0], context, "right") - 1
    while len(back := np.flatnonzero((starts[s, 0] == context) & (starts[s, 1] > word))):
        s[back] -= 1
    return s


# --- tokens ----------------------------------------------------------------------------------------------------------


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the texts' words' hashes, one text after the other; the number of words of each): A-Z in lower case, ASCII white space."""
    from xxhash import xxh64_intdigest

    own = texts.take(pa.array(np.arange(len(texts))))  # the cast of a slice begins within its bytes, where ascii_lower reads from their start
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own.fill_null("").cast(pa.large_string())))
    counts, coded = np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().dictionary_encode()
    numbers = np.asarray(coded.indices)
    found = coded.dictionary.cast(pa.large_binary())
    real = (np.asarray(pc.binary_length(found)) > 0)[numbers]
    table = np.fromiter(map(xxh64_intdigest, found.to_numpy(zero_copy_only=False)), np.uint64, len(found))  # to_pylist is slower
    table[table == END] = 1
    text = np.repeat(np.arange(len(counts)), counts)[real]
    return table[numbers[real]], np.bincount(text, minlength=len(counts))


def tokenized(docs: DataFrame) -> DataFrame:
    """A written table of docs with `words`, the text's words as hashes, instead of the column __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("__text")
            texts = batch.column(where)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // _BYTES_AT_ONCE
            for a, b in runs(part):
                words, counts = hashes_of(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(words.view(np.int64)))
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns) if i != where]
                yield pa.RecordBatch.from_arrays([*rest, lists], [*[n for n in batch.schema.names if n != "__text"], "words"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__text")
    return written(docs.mapInArrow(run, f"{rest}, words array<bigint>"))


class Stretch:
    """Some texts' tokens, each text's end among them: distinct words, pairs and triples, and which of them each token is.

    Words are in order of their hashes, pairs and triples in order of their words. So are ids, contexts and ranks in the trie:
    what is looked up or counted there is in order without a sort of its own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.lengths = counts + 1
        self.ends = np.cumsum(self.lengths) - 1
        self.starts = self.ends - counts
        tokens = np.zeros(len(words) + len(counts), np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[self.ends] = False
        tokens[inside] = words
        self.hashes, self.number = np.unique(np.append(np.uint64(END), tokens), return_inverse=True)  # the end's number is 0
        self.number = self.number[1:]
        before = np.append(0, self.number[:-1])
        before[self.starts] = 0
        n = len(self.hashes)
        pairs, self.pair = np.unique(before * n + self.number, return_inverse=True)
        self.pair_before, self.pair_word = pairs // n, pairs % n

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the tokens that have two words before them, or the start and one; which triple each is; the triples' first and last pairs)."""
        at = np.ones(len(self.number), bool)
        at[self.starts] = False
        at = np.flatnonzero(at)
        n = len(self.pair_before)
        triples, which = np.unique(self.pair[at - 1] * n + self.pair[at], return_inverse=True)
        return at, which, triples // n, triples % n


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stretch]]:
    """Runs of rows with about _TOKENS_AT_ONCE tokens; the last column holds the words."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        counts = np.asarray(lists.value_lengths()).astype(np.int64)
        part = np.cumsum(counts + 1) // _TOKENS_AT_ONCE
        for a, b in runs(part):
            yield batch.slice(a, b - a), Stretch(np.asarray(lists.slice(a, b - a).flatten()).view(np.uint64), counts[a:b])


# --- counting --------------------------------------------------------------------------------------------------------

_COUNTED = "shard int, context binary, word binary, counts binary, lower binary"


def _rows(shard: np.ndarray, context: np.ndarray, word: np.ndarray, counts: np.ndarray, lower: np.ndarray | None) -> pa.RecordBatch:
    """A row for each shard of entries in order of (context, word); lower: a code that goes with the entry."""
    cells: list[list] = [[], [], [], [], []]
    for a, b in runs(shard):
        for cell, x in zip(cells, (int(shard[a]), _packed(np.diff(context[a:b], prepend=0)), _packed(word[a:b]), _packed(counts[a:b]), _packed(lower[a:b], np.uint8) if lower is not None else None), strict=True):
            cell.append(x)
    return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cells[1:]]], ["shard", "context", "word", "counts", "lower"])


def _folded(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The entries of all parts in order, equal ones added up."""
    context, word, counts, lower = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = ordered(context, word)
    context, word, lower = context[order], word[order], lower[order]
    starts = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
    return context[starts], word[starts], np.add.reduceat(counts[order], starts), lower[starts]


def _by_shard(counted: DataFrame, build: Callable[..., dict], schema: str) -> DataFrame:
    """build(shard, context, word, counts, lower) for every shard, whose rows are added up as they come."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0

        def done() -> pa.RecordBatch:
            row = build(now, *_folded(parts))
            return pa.RecordBatch.from_pylist([{n: row[n] for n in names}], pa.schema([(n, kinds[n]) for n in names]))

        kinds = {f.split()[0]: pa.list_(pa.float64()) if f.endswith("array<double>") else pa.list_(pa.int64()) if f.endswith("array<bigint>") else pa.int64() for f in schema.split(", ")}
        for batch in batches:
            for shard, *cells in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    if parts:
                        yield done()
                    now, parts, held = shard, [], 0
                word = _unpacked(cells[1]).view(np.int64)
                lower = _unpacked(cells[3], np.uint8) if cells[3] is not None else np.zeros(len(word), np.uint8)
                parts.append((np.cumsum(_unpacked(cells[0]).view(np.int64)), word, _unpacked(cells[2]).view(np.int64), lower))
                held += len(word)
                if held > _FOLD:
                    parts = [_folded(parts)]
                    held = len(parts[0][0]) if len(parts[0][0]) < _FOLD // 2 else 0  # not again for every row
        if parts:
            yield done()

    return counted.repartition(partitions(counted.sparkSession), "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _marks(index: np.ndarray, counts: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """(the last of some entries, the tokens up to it since the one before), every `least` tokens; an entry with more stands alone."""
    out, total = [], np.cumsum(counts)
    at, before = 0, 0
    heavy = np.flatnonzero(counts >= least).tolist()
    while at < len(counts):
        to = int(np.searchsorted(total, before + least))
        while heavy and heavy[0] < at:
            heavy.pop(0)
        if heavy and at < heavy[0] <= to:
            to = heavy[0] - 1
        to = min(to, len(counts) - 1)
        out.append((int(index[to]), int(total[to]) - before))
        at, before = to + 1, int(total[to])
    return [i for i, _ in out], [n for _, n in out]


def bounds_of(marks: list[tuple[int, int]], words: Callable[[int], int]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(the first (context, word) of each shard, the tokens of contexts that several shards share). words: how many words may
    follow a context."""
    bounds, shared, filled = [(0, 0)], {}, 0
    last = -1
    for index, n in sorted(marks):
        if filled and filled + n > SHARD_KEYS:
            bounds.append((last + 1, 0))
            filled = 0
        filled += n
        if n > SHARD_KEYS:  # one context, as lighter ones are grouped up to a smaller sum
            if bounds[-1] != (index, 0):
                bounds.append((index, 0))
            size, parts = max(1, words(index)), -(-n // SHARD_KEYS)
            bounds += sorted({(index, w) for i in range(1, parts) if (w := size * i // parts)})
            shared[index] = n
            bounds.append((index + 1, 0))
            filled = 0
        last = index
    return [b for i, b in enumerate(bounds) if not i or b > bounds[i - 1]], shared


def words_level(tokens: DataFrame, folder: str, n_tokens: int) -> tuple[Words, int, int, list[tuple[int, int]]]:
    """(the first level, N, the number of texts, marks by id)."""
    universe, least = 1 << 64, max(1, SHARD_KEYS // _MARKS)
    shards = max(1, -(-(n_tokens // 8) // SHARD_KEYS))
    bounds = [universe * s // shards for s in range(shards)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stretch in stretches(batches):
            counts = np.bincount(stretch.number, minlength=len(stretch.hashes))
            hashes, counts = stretch.hashes[counts > 0], counts[counts > 0]
            shard = np.searchsorted(np.array(bounds, np.uint64), hashes, "right") - 1
            yield _rows(shard, np.zeros(len(hashes), np.int64), (hashes - np.array(bounds, np.uint64)[shard]).view(np.int64), counts, None)

    def build(shard: int, _: np.ndarray, word: np.ndarray, counts: np.ndarray, __: np.ndarray) -> dict:
        keys = word.view(np.uint64)
        order = np.argsort(keys, kind="stable")  # as unsigned numbers
        keys, counts = keys[order], counts[order]
        end = bounds[shard + 1] if shard + 1 < len(bounds) else universe
        (low,) = _put_sequences(folder, f"{shard}", (keys, end - bounds[shard]))
        _put(folder, f"{shard}.counts", counts)
        at, sums = _marks(np.arange(len(keys)), counts, least)
        return {"shard": shard, "n": len(keys), "low": low, "tokens": int(counts.sum()), "texts": int(counts[0]) if bounds[shard] + int(keys[0]) == END else 0, "at": at, "sums": sums}

    built = _by_shard(tokens.select("words").mapInArrow(count, _COUNTED), build, "shard bigint, n bigint, low bigint, tokens bigint, texts bigint, at array<bigint>, sums array<bigint>").collect()
    level = Words(folder, bounds, {r.shard: (r.n, r.low) for r in built})
    marks = [(int(level.offsets[r.shard]) + i, n) for r in built for i, n in zip(r["at"], r["sums"], strict=True)]
    return level, sum(r.tokens for r in built), sum(r.texts for r in built), marks


def grams_level(counted: DataFrame, folder: str, bounds: list[tuple[int, int]], shared: dict[int, int], p_lower: Callable[[np.ndarray, np.ndarray], np.ndarray], contexts: int, inner: bool, floor: float) -> tuple[Grams, float, list[tuple[int, int]]]:
    """(a level below the first, its K, marks by index). p_lower(word, code): the lower level's probability of an entry's word."""
    grid, least = np.array(GRID), max(1, SHARD_KEYS // _MARKS)

    def totals(context: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The tokens after each entry's context."""
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        sums = np.add.reduceat(counts, starts)
        sums = np.array([shared.get(int(c), int(n)) for c, n in zip(context[starts], sums, strict=True)]) if shared else sums
        return np.repeat(sums, np.diff(starts, append=len(context)))

    def build(shard: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> dict:
        first = bounds[shard][0]
        until = bounds[shard + 1] if shard + 1 < len(bounds) else (contexts, 0)
        n_contexts = until[0] - first + (until[1] > 0)
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        ends = np.append(starts[1:], len(context))
        added = np.append(0, np.cumsum(word[ends - 1] + 1))
        keys = (np.repeat(added[:-1], ends - starts) + word).astype(np.uint64)
        pointers = np.cumsum(np.bincount(context[starts] - first + 1, weights=ends - starts, minlength=n_contexts + 1)).astype(np.uint64)
        low, pointer_low = _put_sequences(folder, f"{shard}", (keys, int(added[-1]) + 1), (pointers, len(keys) + 1))
        total, p = totals(context, counts), p_lower(word, lower)
        _put(f"{folder}/raw", f"{shard}.counts", np.frombuffer(_packed(counts), np.uint8))
        _put(f"{folder}/raw", f"{shard}.total", np.frombuffer(_packed(total), np.uint8))
        _put(f"{folder}/raw", f"{shard}.lower", np.frombuffer(_packed(p.astype(np.float32), np.float32), np.uint8))
        fit = [float((counts * np.log((counts - 1 + k * p) / (total - 1 + k))).sum()) for k in grid]
        at, sums = _marks(np.arange(len(keys)), counts, least) if inner else ([], [])
        return {"shard": shard, "n": len(keys), "low": low, "pointer_low": pointer_low, "contexts": n_contexts, "first": int(ends[0] - starts[0]) if context[0] == first else 0, "last": int(ends[-1] - starts[-1]), "last_context": int(context[-1]), "at": at, "sums": sums, "fit": fit}

    schema = "shard bigint, n bigint, low bigint, pointer_low bigint, contexts bigint, first bigint, last bigint, last_context bigint, at array<bigint>, sums array<bigint>, fit array<double>"
    built = {r.shard: r.asDict() for r in _by_shard(counted, build, schema).collect()}
    prior = float(GRID[int(np.argmax(np.sum([r["fit"] for r in built.values()], axis=0)))]) if built else 1.0
    carry = 0
    for s in range(len(bounds)):  # entries of the shard's first context in shards before it
        carry = carry if bounds[s][1] else 0
        if s in built:
            built[s]["carry"] = carry
            carry = built[s]["last"] + (carry if built[s]["last_context"] == bounds[s][0] else 0)
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                counts, total = (_unpacked(_get(f"{folder}/raw", f"{s}.{name}", np.uint8).tobytes()).astype(np.float64) for name in ("counts", "total"))
                p = (counts + prior * _unpacked(_get(f"{folder}/raw", f"{s}.lower", np.uint8).tobytes(), np.float32)) / (total + prior)
                _put(folder, f"{s}.p", quantised(np.log10(p), floor))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["shard"])

    spark = counted.sparkSession
    if built:
        spark.createDataFrame([(s,) for s in built], "shard bigint").repartition(len(built), "shard").mapInArrow(codes, "shard bigint").count()
    level = Grams(folder, bounds, built, False)
    marks = [(int(level.offsets[s]) + i, n) for s, r in built.items() for i, n in zip(r["at"], r["sums"], strict=True)]
    return level, prior, marks


def quantised(logs: np.ndarray, least: float) -> np.ndarray:
    return np.clip(np.rint((1 - logs / least) * (CODES - 1)), 0, CODES - 1).astype(np.uint8)


def with_rests(spark: SparkSession, level: Grams, prior: float, least: float) -> Grams:
    """The level with each entry's code of K / (c + K), which the K of the level below it decides."""
    folder = level.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                counts = _unpacked(_get(f"{folder}/raw", f"{s}.counts", np.uint8).tobytes()).astype(np.float64)
                _put(folder, f"{s}.rest", quantised(np.log10(prior / (counts + prior)), least))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64())], ["shard"])

    if level.metas:
        spark.createDataFrame([(s,) for s in level.metas], "shard bigint").repartition(len(level.metas), "shard").mapInArrow(run, "shard bigint").count()
    return Grams(folder, level.bounds, level.metas, True)


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    words: Words
    tokens: int  # N
    pairs: Grams | None = None
    triples: Grams | None = None
    priors: tuple[float, ...] = ()  # K of pairs and of triples
    least: float = -1.0  # the log10 of code 0

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words.n + 1))

    def logs(self, codes: np.ndarray) -> np.ndarray:
        return self.least * (1 - codes / (CODES - 1))

    def ids(self, s: Stretch) -> tuple[np.ndarray, np.ndarray]:
        return self.words.find(s.hashes)

    def find_pairs(self, s: Stretch, ids: np.ndarray) -> list[np.ndarray]:
        """Index (or -1), rank and codes of the stretch's distinct pairs."""
        u, w = ids[s.pair_before], ids[s.pair_word]
        known = np.flatnonzero((u >= 0) & (w >= 0))
        found = self.pairs.find(u[known], w[known])
        out = [np.full(len(u), -1, np.int64), *[np.zeros(len(u), x.dtype) for x in found[1:]]]
        for to, x in zip(out, found, strict=True):
            to[known] = x
        return out

    def score(self, s: Stretch) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of every text."""
        ids, counts = self.ids(s)
        p1 = np.log10(self.p1(counts.astype(np.float64)))
        base = p1[s.number]
        if self.pairs is None:
            out = base
        else:
            index, rank, p, rest = self.find_pairs(s, ids)
            context = counts[s.pair_before].astype(np.float64)
            two = np.where(index >= 0, self.logs(p), np.log10(np.where(context > 0, self.priors[0] / (context + self.priors[0]), 1.0)) + p1[s.pair_word])
            at, which, first, last = s.triples()
            three = two[last] + np.where(index[first] >= 0, self.logs(rest[first]), 0.0)
            seen = np.flatnonzero((index[first] >= 0) & (index[last] >= 0))
            found, _, code = self.triples.find(index[first[seen]], rank[last[seen]])
            three[seen[found >= 0]] = self.logs(code[found >= 0])
            out = two[s.pair]
            out[at] = three[which]
        total = lambda x: np.add.reduceat(x, s.starts) if len(s.starts) else x
        return s.lengths, total((counts > 0)[s.number].astype(np.int64)), total(base), total(out)


def train(tokens: DataFrame) -> Model:
    """The model of a table with column `words`."""
    spark = tokens.sparkSession
    root = f"{shared_folder(spark)}/ngrams/{uuid.uuid4().hex}"
    n_tokens = tokens.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    words, n, _, marks = words_level(tokens, f"{root}/1", n_tokens)
    if not words.n:
        return Model(words, 0)
    model = Model(words, n)
    v = words.n

    least = -(log10(n + max(GRID)) + 1)
    # pairs: contexts are words
    bounds, shared = bounds_of(marks, lambda _: v)
    starts = np.array(bounds, np.int64)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in stretches(batches):
            ids, _ = model.ids(s)
            u, w = ids[s.pair_before], ids[s.pair_word]
            yield _rows(shards_of(u, w, starts), u, w, np.bincount(s.pair), None)

    counted = tokens.select("words").mapInArrow(pairs_of, _COUNTED)
    pairs, prior, marks = grams_level(counted, f"{root}/2", bounds, shared, lambda w, _: model.p1(words.counts(w).astype(np.float64)), v, True, least)
    model = Model(words, n, pairs, None, (prior,), least)

    # triples: contexts are pairs, a word's name its rank among the successors of the word before it
    bounds3, shared3 = bounds_of(marks, lambda _: v)
    starts3 = np.array(bounds3, np.int64)
    contexts = int(pairs.offsets[-1])

    def triples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in stretches(batches):
            index, rank, code, *_ = model.find_pairs(s, model.ids(s)[0])
            _, which, first, last = s.triples()
            u, w = index[first], rank[last]
            yield _rows(shards_of(u, w, starts3), u, w, np.bincount(which, minlength=len(first)), code[last])

    counted = tokens.select("words").mapInArrow(triples_of, _COUNTED)
    triples, prior3, _ = grams_level(counted, f"{root}/3", bounds3, shared3, lambda _, code: 10 ** model.logs(code), contexts, False, least)
    pairs = with_rests(spark, pairs, prior3, least)
    for level in (2, 3):
        remove(spark, f"{root}/{level}/raw")
    return Model(words, n, pairs, triples, (prior, prior3), least)


def score(tokens: DataFrame, model: Model) -> DataFrame:
    """A tokenized() table with n_tokens, n_known, base_score and score instead of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stretch in stretches(batches):
            found = [pa.array(x) for x in model.score(stretch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "words")
    return tokens.mapInArrow(run, f"{rest}, n_tokens bigint, n_known bigint, base_score double, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and priors for every row.

    The model learns from the rows whose crc32(doc_id) leaves another remainder than HELD_OUT and scores all. A null text
    is empty: one token, its end. Repeated rows count as often as they occur and have a result each; a null doc_id is not
    held out. Other columns are ignored. Nothing to learn from: every token has the base's probability. No rows: no rows.
    Words are told apart by 64-bit hashes.
    """
    tokens = tokenized(docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("__text")))
    model = train(tokens.where("not held_out"))
    return score(tokens, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.array(*[F.lit(float(p)) for p in model.priors]).cast("array<double>").alias("priors"))
