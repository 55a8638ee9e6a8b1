"""The pipeline's near-duplicates against five-word similarity by brute force."""

import numpy as np
import pytest

from trajmill.llm import jaccard

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts):
    """The index of each text's component, by all pairs."""
    sets, label = [five(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def texts():
    rng = np.random.default_rng(7)
    out = ["", "one two", "One two", "a b c d e"]
    for _ in range(25):
        base = [f"w{k}" for k in rng.integers(0, 900, int(rng.integers(40, 250)))]
        out.append(" ".join(base))
        for share in (0.02, 0.06, 0.1, 0.12, 0.14, 0.25):  # a passage replaced: similarities on both sides of 0.8
            n = max(1, int(len(base) * share))
            at = int(rng.integers(0, len(base) - n))
            out.append(" ".join(base[:at] + [f"z{k}" for k in rng.integers(0, 900, n)] + base[at + n :]))
    hot = [f"h{k}" for k in range(100)]
    return out + [" ".join([*hot[:k], "x", *hot[k + 1 :]]) for k in range(100)]


@pytest.mark.parametrize("partners", [3, 1])
def test_components_are_those_of_all_pairs(spark, monkeypatch, partners):
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    own = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(own)], COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute(own)))


def test_null_and_shared_ids_lose_no_text(spark):
    a, b, c, d = ["".join(f" {k}{i}" for i in range(30)) for k in "abcd"]
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (None, d), (3, c)]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(0, a), (0, b), (1, c), (1, d)])


def test_bitmaps_never_hide_a_link():
    """Bits that differ are never more than tokens that differ, folded or not, and widths of like sets fit."""
    rng, bits = np.random.default_rng(5), lambda x: np.bitwise_count(x.view(np.uint64)).sum()
    for n in (1, 3, 200, 255, 256, 257, 500, 513, 1030, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for keep in (1.0, 0.95, 0.85):
            other = np.unique(np.concatenate([base[rng.random(len(base)) < keep], rng.integers(0, 1 << 63, int(n * rng.random() * 0.1), dtype=np.uint64)]))
            if not len(other):
                continue
            apart = len(np.setxor1d(base, other))
            assert bits(jaccard.bitmap(base) ^ jaccard.bitmap(other)) <= apart
            a, b = jaccard.wide_bitmap(base), jaccard.wide_bitmap(other)
            assert len(a) * 64 >= len(base) or len(base) <= 256
            if 5 * min(len(base), len(other)) >= 4 * max(len(base), len(other)):
                assert max(len(a), len(b)) <= 2 * min(len(a), len(b))
                fold = lambda x, n: x if len(x) == n else x[: len(x) // 2] ^ x[len(x) // 2 :]
                n_ = min(len(a), len(b))
                assert bits(fold(a, n_) ^ fold(b, n_)) <= apart
    assert len(jaccard.wide_bitmap(np.arange(257, dtype=np.uint64))) == 8 and len(jaccard.wide_bitmap(np.arange(256, dtype=np.uint64))) == 4


def test_shared_passages_and_long_texts(spark):
    """Texts that share a passage but little else stay apart, edited long texts are linked."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    own = []
    for g in range(40):
        words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
        at = int(rng.integers(0, 340))
        own.append(" ".join(words[:at] + passage + words[at:]))
    for g in range(0, 40, 8):
        words = own[g].split()
        words[5], words[300] = "edit", "edit"
        own.append(" ".join(words))
        own.append(" ".join(words[: len(words) - 40]))
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(own)], COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute(own)))
