"""Operators 11 to 13 against brute force, their files read without them, and odd input."""

import glob
import hashlib
import itertools
import json
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.errors import PythonException

from trajmill.llm import crosstok, filteraudit, warc
from trajmill.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, extra string, mask int"
PAGES = "page_id long, url string, html string, digest string, n int"


# --- filter audit ----------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    firsts = {}
    for i, t, *_ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in range(2))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t]}
        rows.append((lang or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                own = [r for r in rows if r[0] == part]
                before = set(order[:step])
                gone = [r for r in own if f in r[1] and not r[1] & before]
                out[part, "".join(order), step + 1] = [
                    sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return sorted((*k, *x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items())


def test_audit_by_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "fr"), (3, long + " #", "en"), (None, long, "en"), (4, None, None), (5, "", ""), (6, "A " * 300, "en"), (7, "a\x0bb\x85c　d" * 99, "fr"), (7, "AB" * 30, "fr"),
        (0, "A " * 300, "de"), (9, "é" * 1000 + long, "de"), (9, "é" * 1000 + long, "de"), (None, None, None),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, None, 1), (None, 1, 1), (77, 1, 1), (9, 1, None)]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], DOCS).repartition(3)
    got = filteraudit.audit_documents(df, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, mask int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    nothing = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filteraudit.audit_documents(nothing, labels).count() == 0
    one = filteraudit.audit_documents(spark.createDataFrame([(1, "a", "en", "", 0)], DOCS), labels.limit(0))
    assert one.count() == 600 and {r.removed for r in one.collect()} == {0, 1}


def test_audit_of_any_filters(spark):
    """Parts of many rows, in pieces, and another number of filters."""
    masks = spark.range(4000).selectExpr("concat('p', id % 300) as part", "cast(id % 4 as int) as mask", "1L as n", "0L as good", "id % 2 as toxic")
    rows = filteraudit.interactions(masks, "xy").collect()
    assert len(rows) == 300 * 4 and Counter(r.filter_order for r in rows) == {"xy": 600, "yx": 600}
    for order in ("xy", "yx"):
        assert sum(r.kept for r in rows if r.filter_order == order and r.step == 2) == 1000
        assert sum(r.removed for r in rows if r.filter_order == order) == 3000
    with pytest.raises(ValueError):
        filteraudit.interactions(masks, "xx")


# --- WARC ------------------------------------------------------------------------------------------------------------


def brute_archive(pages):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    firsts, out, used = {}, [], set()
    for r in sorted(pages, key=key):
        firsts.setdefault(r[2] or "", r)
    for r in sorted(pages, key=key):
        body = (r[2] or "").encode()
        again = len(body) >= 100 and r[2] in used
        used.add(r[2])
        out.append((r[0], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", firsts[r[2]][0] if again else None))
    return Counter(out)


HTML = "<html><body><p>" + "shared words of a page " * 20 + "</p></body></html>"
ODD_PAGES = [
    (3, "http://a/3", HTML), (1, "http://a/1", HTML), (1, "http://a/0", HTML), (1, "http://a/0", HTML), (1, "http://a/0", HTML), (None, None, HTML), (None, "x y\r\nz", HTML), (2, None, HTML + "é"), (4, "u", None), (5, "u", ""), (6, "u", "short"), (6, "u", "short"),
    (7, "u", "é" * 49 + "x"), (8, "u", "é" * 49 + "x"), (9, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "WARC/1.1\r\n\r\n" * 50), (11, "u", "long " * 2_000_000), (12, "u", "\x00" * 500), (None, None, "z" * 200), (None, None, "z" * 200),
]


def test_archives_by_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 5) for r in ODD_PAGES], PAGES).repartition(4)
    got = warc.archive_pages(spark, df)
    assert Counter(map(tuple, got.collect())) == brute_archive(ODD_PAGES)


def test_archives_of_nothing(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_repeated_rows_are_split(spark):
    """A row repeated far more often than one task writes."""
    df = spark.range(3 * warc.COPIES + 5).selectExpr("7L as page_id", "'u' as url", "repeat('page ', 50) as html")
    manifest = warc.write_warc(df, f"{shared_folder(spark)}/repeated")
    rows = warc.read_warc(manifest)
    assert {(r.type, r.refers_to): r["count"] for r in rows.groupBy("type", "refers_to").count().collect()} == {("response", None): 1, ("revisit", 7): 3 * warc.COPIES + 4}
    assert rows.select("record_id").distinct().count() == 3 * warc.COPIES + 5


def test_files_are_dictionary_compressed_records(spark):
    """Read with zstandard alone: a skippable frame with a dictionary, then frames that open one by one, from any offset."""
    pages = [(i, f"http://h/{i}", f"<html><head><title>{i}</title></head><body>" + "".join(f"<p class='c{k}'>{(i * 7919 + k) % 9973} of many</p>" for k in range(40)) + "</body></html>") for i in range(600)]
    df = spark.createDataFrame([(*r, "x", 5) for r in pages], PAGES)
    manifest = warc.write_warc(df, f"{shared_folder(spark)}/files", archive_bytes=200_000)
    files = {r.path: r for r in manifest.collect()}
    assert len(files) > 3 and sum(r.records for r in files.values()) == 600
    rows = warc.read_warc(manifest).collect()
    assert {(r.page_id, r.uri, r.payload.decode()) for r in rows} == {(i, u, h) for i, u, h in pages}
    for path, row in files.items():
        data = open(path.removeprefix("file://").removeprefix("file:"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and row.dictionary > 0
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        assert held.dict_id() > 0
        assert len(data) < row.bytes / 3
        for r in rows:
            if r.archive == path:
                one = zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(data[r.offset :])
                assert one.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and one.endswith(r.payload + b"\r\n\r\n")
                with pytest.raises(zstandard.ZstdError):
                    zstandard.ZstdDecompressor().decompress(data[r.offset :])


def test_spoiled_archives_are_errors(spark):
    page = warc.record("response", 1, "u", 0, hashlib.sha256(b"other").hexdigest(), 4, b"body", "1970-01-01T00:00:00Z")
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    whole = zstandard.ZstdCompressor().compress(page)
    for name, data in (("digest", whole), ("cut", whole[:-3]), ("head", zstandard.ZstdCompressor().compress(page[9:]))):
        with open(f"{folder}/{name}.warc.zst", "wb") as f:
            f.write(data)
        with pytest.raises(PythonException):
            warc.read_warc(spark.createDataFrame([(f"file://{folder}/{name}.warc.zst",)], "path string")).collect()


def test_archives_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got = warc.archive_pages(spark, spark.read.parquet(f"{d}/pages.parquet"))
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(warc.ORACLE).select(*got.columns).fetchall())


# --- tokenizers ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute_alignment(docs, byte_path, piece_path):
    """By the two libraries, one token after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
    a_model.encode_special_tokens = True
    with open(byte_path, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    a_bytes = lambda i: bytes(byte[c] for c in names[i])
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for i, t in docs:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        if t and not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + t).encode():
            a, b = [], []
        groups, x, y, own = [], 0, 0, ([], [])
        left, right = iter(a), iter(b)
        for _ in range(len(a) + len(b)):
            if x <= y:
                own[0].append(next(left))
                x += len(a_bytes(own[0][-1]))
            else:
                own[1].append(next(right))
                y += len(b_bytes(own[1][-1]))
            if x == y:
                groups.append(own)
                own = ([], [])
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        counts.update(links.keys())
        found.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for i, n, m, groups, links in found:
        s = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, n, m, len(groups), sum(links.values()), sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items()), hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return Counter(out)


ODD_TEXTS = [
    None, "", "a▁b", "<|endoftext|> <s> <unk> <0x0A>", "  two  spaces\n\n\ttabs \r\n ", "日本語 😀😀 naïve", "x" * 20000 + "ab" * 5000, "\x00null", " " * 5000, "1234567890" * 300, "same text", "same text", "é ﻿ 　", "▁",
]


@pytest.mark.parametrize("shard_keys", [1 << 20, 97])
def test_alignment_by_brute_force(spark, paths, shard_keys):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [*map(tuple, real), *enumerate(ODD_TEXTS), (None, "no id"), (1, "one id")]
    df = spark.createDataFrame([(*d, "", "", 0) for d in docs], DOCS).repartition(5)
    got = crosstok.align_documents(df, *paths, shard_keys=shard_keys)
    assert Counter(map(tuple, got.collect())) == brute_alignment(docs, *paths)


def test_alignment_of_nothing(spark, paths):
    assert crosstok.align_documents(spark.createDataFrame([], DOCS), *paths).count() == 0
    rows = crosstok.align_documents(spark.createDataFrame([(1, None, "", "", 0), (None, "", "", "", 0)], DOCS), *paths).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_every_token_is_encoded_as_by_the_library(paths):
    """Ranks in place of merges give the same ids: every token's own text, and random runs of tokens."""
    own = crosstok.ByteLevel(paths[0])
    assert own.ranked is not None
    texts = [t.decode(errors="replace") for t in own.spelling.tokens]
    rng = np.random.default_rng(5)
    texts += ["".join(texts[i] for i in rng.integers(0, len(texts), n)) for n in rng.integers(2, 30, 4000)]
    assert [own.encode(t) for t in texts] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


def test_large_groups_are_multiplied_by_distinct_ids(paths, monkeypatch):
    pair = crosstok.Pair(*paths)
    texts = ["some words, 日本語 and more " * 20, None, "other words"]
    x = pair.align(texts)
    want = [v.tolist() for v in pair.links(x)]
    monkeypatch.setattr(crosstok, "LARGE", 0)
    assert [v.tolist() for v in pair.links(x)] == want
    # one group of many tokens: all texts as if nothing but their ends met
    one = crosstok.Aligned(x.a, x.b, x.n_a, x.n_b, np.array([0, 2]), x.n_a[[0, 2]], x.n_b[[0, 2]])
    text, keys, times = pair.links(one)
    assert times[text == 0].sum() == x.n_a[0] * x.n_b[0] and (np.diff(keys[text == 0]) > 0).all()


def test_partial_counts_and_shards(spark, tmp_path):
    """Keys whose sums go on from batch to batch, and a lookup of one that was not counted."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 200))) for _ in range(300)]
    linked = spark.createDataFrame([(bytearray(s.astype(np.int64).tobytes()),) for s in sets], "keys binary").repartition(7)
    partials = crosstok.partial_counts(linked)
    assert Counter({r.key: r.n for r in partials.groupBy("key").sum("n").withColumnRenamed("sum(n)", "n").collect()}) == Counter(int(k) for s in sets for k in s)
    folder = f"file://{tmp_path}/pairs"
    counts = crosstok.counts_of(crosstok.write_counts(partials, folder, 4, shard_keys=33), folder, 40)
    want = Counter(int(k) for s in sets for k in s)
    keys = np.array(sorted(want))
    assert len(glob.glob(f"{tmp_path}/pairs/*.keys")) > 5 and counts.find(keys).tolist() == [want[int(k)] for k in keys]
    assert counts.best[3] == max(want[k] for k in range(48, 64))
    with pytest.raises(ValueError):
        counts.find(np.array([10**6]))


def test_texts_are_encoded_a_few_megabytes_at_a_time():
    """One Arrow batch of 1,024 long texts, and one text longer than a part."""
    import pyarrow as pa

    from trajmill.llm import bpe

    texts = ["x" * 50_000] * 1024 + [None, "", "y" * 9_000_000, "z"]
    parts = list(bpe.batches_of_texts(pa.array(texts)))
    assert [t for _, part in parts for t in part] == [t or "" for t in texts]
    assert all(sum(map(len, part)) <= 4 << 20 or len(part) == 1 for _, part in parts) and [i for i, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
