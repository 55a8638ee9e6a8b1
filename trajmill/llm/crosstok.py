"""Alignment of two tokenizers over one corpus, with corpus counts of linked token ids.

A text is encoded by a byte-level BPE (A, after a space) and a piece model (B, which adds the space); the offsets at which
tokens of both end cut them into groups, and the tokens of a group are linked all with all. A linked pair of ids is one
int64: A's id above B's. A text's pairs are sorted and distinct (np.unique) with their numbers of occurrences; a large group
is reduced to its distinct ids before it is multiplied out.

Counts of texts that have a pair: every partition's texts are counted by np.unique, the partial counts go by ranges of the
key to sorted partitions, equal neighbours are summed, and the sums are written as flat sorted files (shards). A later pass
maps the shards into memory and finds the pairs of a batch of texts by searchsorted. Shards are few: at most the product of
the vocabularies over SHARD_KEYS. Texts are encoded once; what the second pass needs is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill.llm.common import release, remove, shared_folder, slices, tidy, written
from trajmill.llm.ngramtrie import _get, _put

#: Keys of a file; keys that a task gathers before it sums them, and sums that it holds before it hands them on.
SHARD_KEYS, GATHERED, HELD = 1 << 20, 1 << 21, 1 << 22
#: Pairs of a group from which its distinct ids are counted first; bytes of text that are aligned together; keys looked up together.
LARGE, TEXT_BYTES, LOOKED_UP = 1 << 12, 1 << 20, 1 << 20
#: Bytes of shards that a worker holds where the shared folder can't be mapped.
HELD_BYTES = 128 << 20
#: How the byte-level vocabulary's words are cut (fixed: the pattern of the tokenizers library's ByteLevel).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# --- tokens ----------------------------------------------------------------------------------------------------------


@dataclass
class Spelling:
    """The bytes of every token id of a vocabulary, one after the other."""

    tokens: list[bytes]

    def __post_init__(self):
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        at = np.cumsum(sizes) - sizes
        return self.blob[np.arange(sizes.sum()) + np.repeat(self.begins[ids] - at, sizes)]


class ByteLevel:
    """Encoding by a tokenizers JSON file of byte-level BPE, special tokens' strings being plain text.

    Where the ranks of the merges are the order of the ids, the file's vocabulary is run by tiktoken, which gives the same ids
    faster; the tokenizers library is the way for other files, and for texts that tiktoken's pattern can't get through."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        special = {x["content"] for x in data["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the other bytes follow from 256 on, in order
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        tokens = [b""] * (max([*vocab.values(), *(x["id"] for x in data["added_tokens"])]) + 1)
        for token, i in vocab.items():
            tokens[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        self.spelling, self.ranked = Spelling(tokens), None
        made = [vocab["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in merges]
        plain = {t: i for t, i in vocab.items() if t not in special}
        if made == sorted(set(made)) and len(plain) == 256 + len(made) and data["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and data["normalizer"] is None:
            import tiktoken

            self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for i in plain.values()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranked is not None:
            try:
                return self.ranked.encode_ordinary(text)
            except BaseException as e:  # its pattern matcher panics on very long runs
                if type(e).__name__ != "PanicException":
                    raise
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Encoding by a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.spelling = Spelling([bytes([int(t[3:5], 16)]) if m.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# --- alignment -------------------------------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Texts' tokens (flat), how many each text has, and the groups of all texts: their text and sizes."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    text: np.ndarray  # of every group
    size_a: np.ndarray
    size_b: np.ndarray


class Pair:
    """Two tokenizers and the packing of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.bytes, self.pieces = ByteLevel(byte_path), Pieces(piece_path)
        self.low = (len(self.pieces.spelling.tokens) - 1).bit_length()
        self.high = (len(self.bytes.spelling.tokens) - 1).bit_length()
        most = max(len(self.pieces.spelling.tokens), len(self.bytes.spelling.tokens))
        self.names = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def align(self, texts: list[str | None]) -> Aligned:
        """Texts that are null, empty, or not what their tokens spell have no tokens."""
        some = [i for i, t in enumerate(texts) if t]
        ids = [self.bytes.encode(" " + texts[i]) for i in some], self.pieces.encode([texts[i] for i in some]) if some else []
        raw = [(" " + texts[i]).encode() for i in some]
        spellings = self.bytes.spelling, self.pieces.spelling
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in ids]
        counts = [np.array([len(x) for x in side], np.int64) for side in ids]
        length = np.array([len(r) for r in raw], np.int64)
        owner = [np.repeat(np.arange(len(some)), n) for n in counts]
        fine = np.ones(len(some), bool)
        for s, tokens, own in zip(spellings, flat, owner, strict=True):
            fine &= np.bincount(own, s.sizes[tokens], len(some)).astype(np.int64) == length
        want = np.frombuffer(b"".join(r for r, ok in zip(raw, fine, strict=True) if ok), np.uint8)
        whole, ends = np.flatnonzero(fine), np.cumsum(length[fine])
        for s, tokens, own in zip(spellings, flat, owner, strict=True):
            wrong = np.flatnonzero(s.spell(tokens[fine[own]]) != want) if len(whole) else np.zeros(0, np.int64)
            if len(wrong):
                fine = fine.copy()
                fine[whole[np.unique(np.searchsorted(ends, wrong, "right"))]] = False
                return self.align([t if i in set(np.array(some)[fine].tolist()) else None for i, t in enumerate(texts)])
        flat = [tokens[fine[own]] for tokens, own in zip(flat, owner, strict=True)]
        at = [np.cumsum(s.sizes[tokens]) for s, tokens in zip(spellings, flat, strict=True)]
        ends_of = [np.zeros(len(want) + 1, bool) for _ in range(2)]
        for marks, e in zip(ends_of, at, strict=True):
            marks[e] = True
        last = [np.flatnonzero(ends_of[1 - k][at[k]]) for k in range(2)]  # the tokens that end a group
        sizes = [np.diff(x, prepend=-1) for x in last]
        places = np.array(some, np.int64)
        n = [np.zeros(len(texts), np.int64) for _ in range(2)]
        for k in range(2):
            n[k][places[fine]] = counts[k][fine]
        text = np.repeat(np.arange(len(texts)), n[0])[last[0]]
        return Aligned(*flat, *n, text, *sizes)

    def groups(self, x: Aligned) -> list[str]:
        """Every text's groups: ids of A, a bar, ids of B; semicolons between groups."""
        if not len(x.text):
            return [""] * len(x.n_a)
        end_a, end_b = np.cumsum(x.size_a), np.cumsum(x.size_b)
        code_a, code_b = x.a * 3, x.b * 3
        code_a[end_a - 1] += 1
        code_b[end_b - 1] += 2
        both = np.empty(len(x.a) + len(x.b), np.int64)
        both[np.arange(len(x.a)) + np.repeat(end_b - x.size_b, x.size_a)] = code_a
        both[np.arange(len(x.b)) + np.repeat(end_a, x.size_b)] = code_b
        to = np.cumsum(x.n_a + x.n_b)
        names = self.names
        return ["".join([names[c] for c in both[i:j].tolist()])[:-1] for i, j in zip((to - x.n_a - x.n_b).tolist(), to.tolist(), strict=True)]

    def links(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, times): every text's distinct linked pairs, sorted, and how often it has them."""
        size, begin_a, begin_b = x.size_a * x.size_b, np.cumsum(x.size_a) - x.size_a, np.cumsum(x.size_b) - x.size_b
        bits, few = self.low + self.high, size <= LARGE
        group = np.repeat(np.flatnonzero(few), size[few])
        within = np.arange(len(group)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        a, b = x.a[begin_a[group] + within // x.size_b[group]], x.b[begin_b[group] + within % x.size_b[group]]
        keys, times = np.unique(x.text[group] << bits | a << self.low | b, return_counts=True)
        large = np.flatnonzero(~few)
        if len(large):
            more = [(keys, times)]
            for g in large.tolist():
                a, n = np.unique(x.a[begin_a[g] : begin_a[g] + x.size_a[g]], return_counts=True)
                b, m = np.unique(x.b[begin_b[g] : begin_b[g] + x.size_b[g]], return_counts=True)
                more.append((((x.text[g] << bits) + (a << self.low)[:, None] + b).ravel(), (n[:, None] * m).ravel()))
            keys, times = summed(*(np.concatenate(part) for part in zip(*more, strict=True)))
        return keys >> bits, keys & (1 << bits) - 1, times


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_LOADED: dict[tuple[str, str], Pair] = {}


def _pair(*paths: str) -> Pair:
    if paths not in _LOADED:
        _LOADED[paths] = Pair(*paths)
    return _LOADED[paths]


def links(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the text's distinct pairs: keys (int64) and times (int64) as
    bytes. The paths are where each machine has the tokenizers' files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pair(byte_path, piece_path)
        for whole in batches:
            for batch in slices(whole, 1, TEXT_BYTES):
                x = own.align(batch.column(1).to_pylist())
                d = len(batch)
                text, keys, times = own.links(x)
                to = np.searchsorted(text, np.arange(d + 1))
                cut = lambda v, to=to: [v[i:j].tobytes() for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
                of = np.append(0, np.cumsum(x.size_a * x.size_b))[np.searchsorted(x.text, np.arange(d + 1))]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in own.groups(x)]
                numbers = [x.n_a, x.n_b, np.bincount(x.text, minlength=d), np.diff(of)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(v, pa.int64()) for v in numbers], pa.array(digests, pa.string()), pa.array(cut(keys), pa.binary()), pa.array(cut(times), pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"],
                )
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys binary, times binary")


# --- counts ----------------------------------------------------------------------------------------------------------


def _flat(column: pa.Array) -> np.ndarray:
    """The int64s of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def partial_counts(linked: DataFrame) -> DataFrame:
    """(key, n): a partition's texts with a pair, in as few rows as HELD allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size, held = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def folded() -> tuple[np.ndarray, np.ndarray]:
            keys, n = np.unique(np.concatenate(gathered), return_counts=True)
            return summed(np.concatenate([held[0], keys]), np.concatenate([held[1], n]))

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)], pa.int64())], ["key", "n"])

        for whole in batches:
            for batch in slices(whole, 0, 8 * GATHERED):
                gathered.append(_flat(batch.column(0)))
                size += len(gathered[-1])
                if size >= GATHERED:
                    held, gathered, size = folded(), [], 0
                    if len(held[0]) >= HELD:
                        yield from out(*held)
                        held = held[0][:0], held[1][:0]
        if gathered:
            held = folded()
        yield from out(*held)
        tidy()

    return linked.select("keys").where("octet_length(keys) > 0").mapInArrow(run, "key bigint, n bigint")


def write_counts(partials: DataFrame, folder: str, low: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The shards' manifest, a written table: name, first and last key, number of keys, and of every A id in it the highest
    count. `partials`, a written table, is sorted by ranges of the key; equal neighbours are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sums that are not written yet; the last may go on

        def shard(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            _put(folder, f"{name}.keys", keys)
            _put(folder, f"{name}.counts", n)
            a = keys >> low
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            return pa.RecordBatch.from_pylist([{"name": name, "first": int(keys[0]), "last": int(keys[-1]), "size": len(keys), "ids": a[first].tolist(), "best": np.maximum.reduceat(n, first).tolist()}])

        for batch in batches:
            keys, n = (np.concatenate([r, np.asarray(batch.column(i))]) for i, r in enumerate(rest))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            rest = keys[first], np.add.reduceat(n, first)
            while len(rest[0]) > shard_keys:
                yield shard(rest[0][:shard_keys], rest[1][:shard_keys])
                rest = rest[0][shard_keys:], rest[1][shard_keys:]
        if len(rest[0]):
            yield shard(*rest)
        tidy()

    ranges = partials.repartitionByRange(partials.count() // shard_keys + 1, "key").sortWithinPartitions("key")
    return written(ranges.mapInArrow(run, "name string, first bigint, last bigint, size bigint, ids array<bigint>, best array<bigint>"))


@dataclass
class Counts:
    """Shards by their first keys, and every A id's highest count; opened where they are used."""

    folder: str
    names: list[str]
    firsts: list[int]
    sizes: list[int]
    best: np.ndarray
    open: OrderedDict = field(default_factory=OrderedDict)

    def __getstate__(self):
        return {**self.__dict__, "open": OrderedDict()}

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s not in self.open:
            self.open[s] = tuple(_get(self.folder, f"{self.names[s]}.{part}", np.int64) for part in ("keys", "counts"))
        self.open.move_to_end(s)
        while len(self.open) > 1 and sum(x.nbytes for pair in self.open.values() for x in pair if not isinstance(x, np.memmap)) > HELD_BYTES:
            self.open.popitem(last=False)
        return self.open[s]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys; an error if one was not counted."""
        out = np.zeros(len(keys), np.int64)
        cuts = [*np.searchsorted(keys, self.firsts).tolist(), len(keys)]
        if cuts[0]:
            raise ValueError("a pair that was not counted")
        for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if i < j:
                known, n = self.shard(s)
                at = np.minimum(np.searchsorted(known, keys[i:j]), len(known) - 1)
                if (known[at] != keys[i:j]).any():
                    raise ValueError("a pair that was not counted")
                out[i:j] = n[at]
        return out


def counts_of(manifest: DataFrame, folder: str, ids: int) -> Counts:
    """Gathers the shards' names (few: see the module) and each A id's highest count (as many as the vocabulary has)."""
    shards = sorted(manifest.select("first", "name", "size").collect())
    best = np.zeros(ids, np.int64)
    for r in manifest.select(F.explode(F.arrays_zip("ids", "best")).alias("x")).groupBy("x.ids").agg(F.max("x.best").alias("best")).collect():
        best[r.ids] = r.best
    return Counts(folder, [r.name for r in shards], [r.first for r in shards], [r.size for r in shards], best)


def score(linked: DataFrame, counts: Counts, low: int) -> DataFrame:
    """linked without keys and times, with n_best (links whose pair has the highest count of its A id) and count_sum."""
    names = [c for c in linked.columns if c not in ("keys", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(names), 8 * LOOKED_UP):
                keys, times = (_flat(batch.column(len(names) + i)) for i in range(2))
                each, of = np.unique(keys, return_inverse=True)
                n = counts.find(each)
                top = n == counts.best[each >> low]
                size = np.array([len(k) // 8 for k in batch.column(len(names)).to_pylist()], np.int64)
                to = np.append(0, np.cumsum(size))
                sums = [np.diff(np.append(0, np.cumsum(times * x))[to]) for x in (top[of], n[of])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(s, pa.int64()) for s in sums]], [*names, "n_best", "count_sum"])
        tidy()

    kinds = dict(linked.dtypes)
    return linked.select(*names, "keys", "times").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_best bigint, count_sum bigint")


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Every text's alignment and what its links are worth in the corpus.

    A null or empty text, and one that its tokens do not spell, has no tokens: zeros, and '' in place of the digest. Every row
    has one result and counts as one text, rows that share a doc_id or a text too. Very long texts are aligned alone. Other columns
    are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    own = _pair(byte_path, piece_path)
    folder = f"{shared_folder(spark)}/pairs/{uuid.uuid4().hex}"
    linked = written(links(docs, byte_path, piece_path))
    partials = written(partial_counts(linked))
    manifest = write_counts(partials, folder, own.low, shard_keys)
    release(partials)
    counts = counts_of(manifest, folder, len(own.bytes.spelling.tokens))
    out = written(score(linked, counts, own.low))
    release(linked, manifest)
    remove(spark, folder)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
