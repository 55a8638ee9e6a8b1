"""The pipeline stage by stage against brute force."""

import hashlib
import struct
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_jaccard import brute  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    vocabulary = {"en": ["the", "house", "with", "window", "green", "stone"], "de": ["der", "straße", "über", "grün", "haus", "stück"]}
    rows = []
    for i in range(120):
        lang = ["en", "de"][i % 2]
        words = [f"{w}{rng.integers(0, 40)}" for w in rng.choice(vocabulary[lang], 80)]
        rows.append((i, " ".join(words), lang, f"s{i % 3}", None))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(words), lang, "s9", None))  # a copy
            words[40] = "changed"
            rows.append((2000 + i, " ".join(words), lang, None, None))  # a near copy
    rows += [(3000, None, "en", "s1", None), (3001, "", "en", "s1", None), (3002, "12 ;;", "en", "s1", None), (3003, "one", None, "s1", None), (5, rows[5][1], "en", "s2", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, docs):
    from tokenizers import Tokenizer

    path, rows = docs
    df = spark.read.parquet(f"{path}/documents.parquet")
    (_, language), (_, dedup), (_, mix), (_, tokens) = corpus_pipeline.STAGES

    kept = language(spark, df, path).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert all(r.lang == ("en" if r.doc_id % 2 == 0 else "de") for r in kept if r.doc_id < 120)

    known = spark.createDataFrame(kept, COLUMNS)
    kept = dedup(spark, known, path).collect()
    own = sorted((r.doc_id, r.text) for r in known.collect())
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({own[i] for i in brute([t for _, t in own])})
    assert not {r.doc_id for r in kept} & {1000 + i for i in range(0, 120, 10)} and not {r.doc_id for r in kept} & {2000 + i for i in range(0, 120, 10)}

    single = spark.createDataFrame(kept, COLUMNS)
    used = Counter(r.doc_id for r in mix(spark, single, path).collect())
    from trajmill.llm import mixing

    want = {r.doc_id: int(r.taken / r["size"] + 0.5) if r["size"] else 1 for r in mixing.mix_documents(single).collect()}
    assert used == Counter({k: n for k, n in want.items() if n})

    lib = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for r in tokens(spark, single, path).collect():
        ids = lib.encode(next(x.text for x in kept if x.doc_id == r.doc_id), add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_run_of_few_and_no_rows(spark, tmp_path):
    few = [(1, "a house in the green", "en", "x", None), (2, "a house in the green", "en", "y", None), (3, None, "en", "x", None), (4, "!!", "de", "x", None)]
    spark.createDataFrame(few, COLUMNS).write.parquet(f"{tmp_path}/few/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/few").collect()} <= {1}
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
