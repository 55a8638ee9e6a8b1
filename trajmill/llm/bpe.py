"""BPE encoding and decoding with a walk over a trie of distinct words.

The last token of a prefix's encoding determines the rest: take it off and what remains is the encoding of a shorter
prefix. So the state at a trie node is one token, and a child's state is the only token that ends its prefix and is
compatible with the state before that token. Two tokens are compatible if BPE, run on their symbols, gives back these two
(decided by the merges along the boundary);
an encoding is right exactly if all neighbours in it are compatible. Words are visited in sorted order, which is the
depth-first order of their trie: the states of a shared prefix stay on the stack and are computed once.

A word's last symbol is another one than the same letter inside a word (it carries the end mark), so it is a leaf.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trajmill.llm.common import slices

#: Words whose encodings a Python worker keeps; older ones are encoded again when they come back.
KEPT_WORDS = 200_000
#: Verdicts on pairs of tokens that it keeps.
KEPT_PAIRS = 250_000
_ROWS_AT_ONCE, _BYTES_AT_ONCE = 1024, 4 << 20
_NEVER = 1 << 40
#: Separators for str.split() that Unicode's White_Space lacks.
_ODD = regex.compile("[\x1c-\x1f]")
#: Letters whose lower case depends on their neighbours, or is more than a letter.
_ODD_CASE = regex.compile("[\u03a3\u0130]")
_WHITE = regex.compile(r"\p{White_Space}+")


class Bpe:
    """The model of a tokenizers JSON file with merges and an end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m.split(" ", 1) if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        #: What is known of the tokens within words and at their ends: the tokens before them (none: "") that are compatible or are not.
        self.known: tuple[dict[str, dict[str, bool]], dict[str, dict[str, bool]]] = ({}, {})
        #: How long tokens are at most, by the two symbols (or the one) that they end with, within words and at their ends.
        self.reach: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for t in vocab:
            for side, body in ((0, t), *([(1, t.removesuffix(end))] if t.endswith(end) else [])):
                self.known[side][body] = {}
                for tail in (body[-2:], body[-1:]):  # one symbol: all that is left of a word
                    self.reach[side][tail] = max(self.reach[side].get(tail, 1), len(body))
        self.made: dict[str, tuple[int, str, str]] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        self.spines: dict[tuple[str, int], tuple[list[str], list[int]]] = {}
        self.pairs = 0
        self.single: dict[str, bool] = {}

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        out = list(body)
        if body != token and out:
            out[-1] += self.end
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE as defined: the lowest-ranked, leftmost pair is merged until none can be."""
        while len(symbols) > 1:
            rank, i = min((self.rank.get((a, b), _NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == _NEVER:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def alone(self, token: str) -> bool:
        """Whether BPE makes this one token of its symbols."""
        if (ok := self.single.get(token)) is None:
            ok = self.single[token] = self.merged(self.symbols(token)) == [token]
        return ok

    def spine(self, token: str, side: int) -> tuple[list[str], list[int]]:
        """The tokens that lie at one end (0: left, 1: right) of a token while it grows, and the ranks of the merges that end them."""
        if (known := self.spines.get((token, side))) is None:
            grown, ends = [token], [_NEVER]
            while (made := self.made.get(grown[-1])) is not None:
                ends.append(made[0])
                grown.append(made[1 + side])
            known = self.spines[token, side] = (grown[::-1], ends[::-1])
        return known

    def compatible(self, a: str, b: str) -> bool:
        """Whether no merge across the boundary comes before those that grow the two sides (of equal ranks the left one is first)."""
        (left, left_ends), (right, right_ends), i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            across = self.rank.get((left[i], right[j]), _NEVER)
            if across < left_ends[i] and across <= right_ends[j] and across < _NEVER:
                return False
            if left_ends[i] == right_ends[j] == _NEVER:
                return True
            if left_ends[i] <= right_ends[j]:
                i += 1
            else:
                j += 1

    def verdict(self, fits: dict[str, bool], before: str, token: str) -> bool:
        """Whether a token can follow the one before it, or begin a word, which is kept in what is known of it. One that BPE doesn't make
        of its own symbols never can."""
        self.pairs += 1
        if self.pairs > KEPT_PAIRS:
            for side in self.known:
                for verdicts in side.values():
                    verdicts.clear()
            self.pairs = 1
        ok = fits[before] = self.alone(token) and (not before or self.compatible(before, token))
        return ok

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of every word (in the alphabet of the vocabulary); symbols that the vocabulary lacks are left out."""
        vocab, end, known = self.vocab, self.end, self.verdict
        inside, last = self.known
        reach_inside, reach_last = self.reach
        done: dict[str, list[str]] = {}
        states: list[str | None] = [""]  # states[i]: the last token of the encoding of the first i symbols
        previous = ""
        for word in sorted(set(words)):
            size, shared = len(word), 0
            if not size:
                done[word] = []
                continue
            most = min(size - 1, len(states) - 1)
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del states[shared + 1 :]
            previous = word
            for n in range(shared + 1, size):
                for start in range(max(0, n - reach_inside.get(word[max(0, n - 2) : n], 1)), n):
                    if (fits := inside.get(body := word[start:n])) is not None and (before := states[start]) is not None:
                        if (ok := fits.get(before)) is None:
                            ok = known(fits, before, body)
                        if ok:
                            states.append(body)
                            break
                else:
                    states.append(None)
            for start in range(max(0, size - reach_last.get(word[-2:], 1)), size):
                if (fits := last.get(body := word[start:])) is not None and (before := states[start]) is not None:
                    if (ok := fits.get(before)) is None:
                        ok = known(fits, before, body + end)
                    if ok:
                        break
            else:
                done[word] = self.merged([s for s in (*word[:-1], word[-1] + end) if s in vocab])
                continue
            tokens = [body + end]
            while start:
                tokens.append(body := states[start])
                start -= len(body)
            tokens.reverse()
            done[word] = tokens
        return done


class WordTokenizer:
    """Encoding and decoding as the tokenizers library does with a BPE file that drops white space, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normalize, self.pieces = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.bpe = Bpe(data["model"]["vocab"], data["model"]["merges"], data["model"]["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        ids = data["model"]["vocab"] | self.special
        self.token = [""] * (max(ids.values(), default=-1) + 1)
        for t, i in ids.items():
            self.token[i] = t
        self.packed = {t: struct.pack("<I", i) for t, i in ids.items()}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the other bytes follow from 256 on, in order
        self.bytes = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens with a space between them: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        """What white space separates; a special token's text stands alone, marked by a space before it."""
        if self.marks and "<|" in text and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += [*self.chunks(text[at : m.start()]), " " + m[0]]
                at = m.end()
            return out + self.chunks(text[at:])
        return [c for c in _WHITE.split(text) if c] if _ODD.search(text) else text.split()

    def _letters(self, word: str) -> str | None:
        """The one piece of a word of letters, in the vocabulary's alphabet of bytes; None if it needs the library's rules."""
        if word.isascii():
            return word.lower()
        if is_normalized("NFC", word) and not _ODD_CASE.search(word):
            return word.lower().encode().decode("latin-1").translate(self.bytes)
        return None

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Every chunk's ids (little-endian, 32 bits each)."""
        found: dict[str, bytes] = {}
        whole: list[tuple[str, str]] = []
        cut: dict[str, list[str]] = {}
        new, old = self.new, self.old
        for c in chunks:
            if (x := new.get(c)) is not None or (x := old.get(c)) is not None:
                found[c] = x
            elif c.isalpha():
                whole.append((c, self._letters(c)))
            elif c[0] == " ":
                found[c] = self.packed[c[1:]]
            elif c[-1] in ".,;:!?" and c[:-1].isalpha():
                cut[c] = [self._letters(c[:-1]), c[-1]]
            else:
                cut[c] = [p for p, _ in self.pieces(self.normalize(c))]
        for i in [i for i, (_, p) in enumerate(whole) if p is None]:
            c = whole[i][0]
            cut[c] = [p for p, _ in self.pieces(self.normalize(c))]
        for c, pieces in cut.items():
            if pieces and pieces[0] is None:
                cut[c] = [p for p, _ in self.pieces(self.normalize(c))]
        words = {p for _, p in whole if p is not None}
        words.update(p for pieces in cut.values() for p in pieces)
        packed = self.packed.__getitem__
        ids = {p: b"".join(map(packed, tokens)) for p, tokens in self.bpe.encode(words).items()}
        for c, p in whole:
            if p is not None:
                found[c] = new[c] = ids[p]
        for c, pieces in cut.items():
            found[c] = new[c] = b"".join([ids[p] for p in pieces])
        if len(new) > KEPT_WORDS:
            self.old, self.new = new, {}
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids (little-endian, 32 bits each) and the decoded text of every text."""
        cut = [self.chunks(t) for t in texts]
        known = self.learn({c for chunks in cut for c in chunks})
        for chunks in cut:
            ids = b"".join(map(known.__getitem__, chunks))
            yield ids, self.decode(memoryview(ids).cast("I"))


def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, while Python's cyclic collector rests: words and tokens have no cycles, and it would go through all that are kept."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def batches_of_texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts in parts of so many rows and bytes (and one text) at most."""
    i = 0
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0, _BYTES_AT_ONCE):
        for k in range(0, len(part), _ROWS_AT_ONCE):
            texts = [t or "" for t in part.column(0).slice(k, _ROWS_AT_ONCE).to_pylist()]
            yield i, texts
            i += len(texts)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row's text; path is where each machine has the tokenizer's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for batch in batches:
            for i, texts in batches_of_texts(batch.column(1)):
                both = list(own.encode(texts))
                ids = pa.array([memoryview(b).cast("I").tolist() for b, _ in both], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), ids, pa.array([t for _, t in both], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def digest_tokens(docs: DataFrame, path: str) -> DataFrame:
    """tokenize() with the ids and the decoded text reduced to their SHA-256 where they arise.

    A null or empty text has no tokens and an empty decoded text. Texts are encoded a few megabytes at a time, a very long one by itself. Rows that share a doc_id have a result each. Other
    columns are ignored. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for batch in uncollected(batches):
            for i, texts in batches_of_texts(batch.column(1)):
                rows = [(len(b) // 4, hashlib.sha256(b).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for b, t in own.encode(texts)]
                n, ids, decoded = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
