"""Operators whose work was one task's: bootstrap, ranks, postings, many patterns, agent loops; against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajmill.operators import agent_loop, containment, episodes, evaluation, postings, ranges, selection
from trajmill.streaming import agent_loop as stream_loop


def sequential(xs, n, draw):
    m = len(xs)
    means = sorted(sum(xs[draw(m)] for _ in range(m)) / m for _ in range(n))
    return means[int(0.025 * n)], means[int(0.975 * n)]


@pytest.mark.parametrize(("generator", "seed"), [("lcg", 0), ("mt", 0), ("mt", 7)])
def test_bootstrap_is_the_sequential_one(spark, generator, seed):
    rng = random.Random(1)
    arms = {"a": [rng.random() for _ in range(130)], "b": [rng.gauss(0, 1) for _ in range(64)], "c": [0.5]}
    rows = [(arm, i, x) for arm, xs in arms.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    got = evaluation.bootstrap_interval(spark.createDataFrame(rows, "arm string, task int, delta double"), "arm", "task", "delta", 1000, generator, seed)
    for r in got.collect():
        xs = arms[r.arm]
        if generator == "mt":
            twister = random.Random(seed)
            want = sequential(xs, 1000, twister.randrange)
        else:
            state = [evaluation.LCG_SEED]

            def draw(m, state=state):
                state[0] = (evaluation.LCG_A * state[0] + evaluation.LCG_C) & evaluation.LCG_MASK
                return state[0] % m

            want = sequential(xs, 1000, draw)
        assert r.n == len(xs) and (r.low, r.high) == pytest.approx(want, abs=1e-12)
    assert got.count() == 3


@pytest.mark.parametrize("generator", ["lcg", "mt"])
def test_bootstrap_joins_no_draws(spark, generator):
    """Draws are many however small the arms' table is: a join that takes its side for small would send them all to the driver."""
    rows = [("a", i, None if i % 10 == 3 else float(i % 7)) for i in range(evaluation._BLOCK + 100)]
    got = evaluation.bootstrap_interval(spark.createDataFrame(rows, "arm string, task int, delta double"), "arm", "task", "delta", 40, generator)
    assert not re.search(r"Join \[[^\]]*\bi#", got._jdf.queryExecution().executedPlan().toString())
    state, twister, means = evaluation.LCG_SEED, random.Random(0), []
    for _ in range(40):
        drawn = []
        for _ in rows:
            state = (evaluation.LCG_A * state + evaluation.LCG_C) & evaluation.LCG_MASK
            drawn.append(rows[state % len(rows) if generator == "lcg" else twister.randrange(len(rows))][2])
        drawn = [x for x in drawn if x is not None]
        means.append(sum(drawn) / len(drawn))
    r = got.first()
    assert r.n == len(rows) and (r.low, r.high) == pytest.approx((sorted(means)[1], sorted(means)[39]), abs=1e-12)


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "arm string, task int, delta double")
    assert evaluation.bootstrap_interval(none, "arm", "task", "delta", 10).isEmpty() and evaluation.bootstrap_interval(none, "arm", "task", "delta", 10, "mt").isEmpty()


def test_many_replicates_and_states(spark):
    """More numbers than one stored state of the twister covers: 10,000 replicates in several tasks."""
    xs = [i % 7 / 7 for i in range(400)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "arm string, task int, delta double")
    r = evaluation.bootstrap_interval(df, "arm", "task", "delta", 10_000, "mt", 3).first()
    twister = random.Random(3)
    assert (r.low, r.high) == pytest.approx(sequential(xs, 10_000, twister.randrange), abs=1e-12)


def test_skip_ahead(spark):
    steps = [0, 1, 2, 63, 64, 1000, 12345678]
    got = spark.createDataFrame([(s,) for s in steps], "n long").select("n", evaluation.lcg_after(F.col("n")).alias("s")).collect()
    for r in got:
        if r.n <= 1000:
            x = evaluation.LCG_SEED
            for _ in range(r.n):
                x = (evaluation.LCG_A * x + evaluation.LCG_C) & evaluation.LCG_MASK
            assert r.s == x


# --- ranks -----------------------------------------------------------------------------------------------------------


def test_ranges_of_skewed_values(spark):
    """One outlier and one value of most rows: no range has twice the mean; ranks and sums are those of one sorted list."""
    df = spark.range(40_000).select("id", F.when(F.col("id") == 5, 10**12).when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("v"), (F.col("id") % 11).alias("w"))
    sizes = [r["count"] for r in ranges.in_ranges(df, ["v", "id"], 16).groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    rows = sorted((r.v, r.id, r.w) for r in df.collect())
    got = {r.id: r.rank for r in ranges.ranked_all(df, ["v", "id"], ranges=16).collect()}
    assert got == {i: k for k, (_, i, _) in enumerate(rows)}
    sums = {r.id: r.s for r in ranges.sum_before(df, ["v", "id"], "w", "s", ranges=16).collect()}
    total = 0
    for _, i, w in rows:
        assert sums[i] == total
        total += w


def test_batches_and_tasks_with_an_outlier(spark):
    df = spark.createDataFrame([(i, 10**9 if i == 3 else i % 4, f"t{i % 5}") for i in range(100)], "id int, n long, task string")
    got = {r.id: r.batch for r in selection.length_batches(df, "n", "id", 7).collect()}
    order = sorted(range(100), key=lambda i: (10**9 if i == 3 else i % 4, i))
    assert got == {i: k // 7 for k, i in enumerate(order)}
    assert [r.task for r in selection.greedy_tasks(df, "task", "n", 0.3, 1).orderBy("task").collect()] == ["t0", "t3"]


# --- postings --------------------------------------------------------------------------------------------------------


def brute_bm25(docs, queries, k, k1=1.5, b=0.75):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    counts = {i: Counter(w) for i, w in words.items()}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for q, text in queries:
        asked = Counter(re.findall("[a-z0-9]+", (text or "").lower()))
        scored = []
        for i, c in counts.items():
            s = sum(times * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(words[i]) / (avgdl or 1))) for t, times in asked.items() if c[t])
            if s > 0:
                scored.append((round(s, 9), i))
        out += [(q, r + 1, i, round(s, 6)) for r, (s, i) in enumerate(sorted(scored, reverse=True)[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query, r.rank, r.doc, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 12])
def test_search_by_brute_force(spark, k):
    """Documents of several chunks, ties, copies, null and empty texts, words in all documents, and queries with nothing to find."""
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(400)], k=rng.randrange(1, 9))) + " all") for i in range(9000)]
    docs += [(10_000 + i, "same copy of All") for i in range(300)] + [(20_000, None), (20_001, ""), (20_002, "..."), (20_003, "É W7-w7,W7")]
    queries = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 6)))) for i in range(25)] + [("copy", "copy of all"), ("all", "all all"), ("none", "zzz"), ("null", None), ("twice", "w399 W399 w3")]
    corpus = spark.createDataFrame(docs, "doc int, text string").repartition(3)
    asked = spark.createDataFrame(queries, "id string, text string")
    want = brute_bm25(docs, queries, k)
    index = postings.build(corpus, "doc", "text", passage="text")
    assert found(postings.search(index, asked, "id", "text", k)) == want
    assert found(postings.search(index, asked.where("id like 'q1%'"), "id", "text", k)) == [r for r in want if r[0].startswith("q1")]
    words = asked.select(F.explode(F.split("text", " ")).alias("term")).select(F.lower("term").alias("term"))
    assert found(postings.search(postings.build(corpus, "doc", "text", only=words), asked, "id", "text", k)) == want
    assert index.docs.where("passage = 'same copy of All'").count() == 300
    assert index.blocks.groupBy("term").count().where("term = 'all'").first()["count"] >= 3


def test_search_with_many_terms_by_brute_force(spark):
    """More rows of (query, term) than an Arrow batch has, and copies in two chunks."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(500)], k=rng.randrange(20, 200)))) for i in range(400)]
    docs += [(i + 1000, t) for i, t in docs[:100]]
    queries = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(200, 400)))) for i in range(60)]
    corpus, asked = spark.createDataFrame(docs, "doc bigint, text string").repartition(2), spark.createDataFrame(queries, "id bigint, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        assert found(postings.search(postings.build(corpus, "doc", "text"), asked, "id", "text", 3)) == brute_bm25(docs, queries, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_queries_are_packed_whole():
    """No query's terms are dealt to two packs, and none is lost."""
    size = postings.PACK_TERMS
    lengths = [3, size // 2, size // 2 - 3, 1, size + 5, 2, size // 3, size // 3, size // 2]
    name = [f"q{i}" for i, n in enumerate(lengths) for _ in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(name), pa.array([f"t{j % 1000}" for j in range(len(name))]), pa.array([1.0] * len(name)), pa.array([0.5] * len(name))], ["query", "term", "factor", "least"])
    cut = [rows.slice(i, 10_000) for i in range(0, len(rows), 10_000)]
    packs = [postings._Queries(p) for batch in postings._pack(iter(cut)) for p in batch.column(1)]
    assert [n for p in packs for n in p.names.to_pylist()] == [f"q{i}" for i in range(len(lengths))]
    assert [n for p in packs for n in np.bincount(p.owner).tolist()] == lengths
    assert all(len(p.codes) <= size or len(p.names) == 1 for p in packs) and len(packs) < len(lengths)


def test_search_shuffles_no_postings(spark):
    """What a search shuffles are its candidates: one exchange, by query, and none of the index or of the queries' terms."""
    corpus = spark.range(500, numPartitions=3).select(F.col("id").alias("doc"), F.concat(F.lit("all word"), F.col("id") % 50).alias("text"))
    asked = spark.range(200).select("id", F.concat(F.lit("all word"), F.col("id") % 50).alias("text"))
    got = postings.search(postings.build(corpus, "doc", "text"), asked, "id", "text", 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Broadcast" not in plan
    assert got.count() == 600


def test_episode_rounds_write_their_own_messages(spark, monkeypatch):
    """Each round's tables hold that round's messages, not those of the rounds before; what was said comes back in order."""
    corpus = spark.createDataFrame([(i, f"w{i} " + "x" * 1000) for i in range(3)], "doc bigint, passage string")
    asked = spark.createDataFrame([("e", "?")], "id string, question string")
    tables, write = [], episodes.written
    monkeypatch.setattr(episodes, "written", lambda df: tables.append(write(df)) or tables[-1])
    last = lambda df: F.element_at("messages", -1)["content"]
    turn = lambda df: F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    script = lambda df: df.select("id", F.when(turn(df) == 3, F.concat(F.lit("<answer>"), F.length(last(df)).cast("string"), F.lit("</answer>"))).otherwise(F.concat(F.lit("<search>w"), turn(df).cast("string"), F.lit("</search>"))).alias("text"))
    got = episodes.run(asked, corpus, script, most_searches=3, k=1).first().messages
    assert [m.role for m in got] == ["system", "user", *["assistant", "user"] * 3, "assistant"]
    assert [m.content[:18] for m in got[3::2]] == [f"Search results:\nw{i}" for i in range(3)] and got[-1].content == "<answer>1019</answer>"
    assert max(len(str(t.collect())) for t in tables) < 1500


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc int, text string")
    some = spark.createDataFrame([(1, "a b")], "doc int, text string")
    asked = spark.createDataFrame([("q", "a")], "id string, text string")
    assert postings.search(postings.build(none, "doc", "text"), asked, "id", "text", 3).isEmpty()
    assert postings.search(postings.build(some, "doc", "text"), asked.limit(0), "id", "text", 3).isEmpty()
    assert found(postings.search(postings.build(some, "doc", "text"), asked, "id", "text", 3)) == brute_bm25([(1, "a b")], [("q", "a")], 3)


def test_chunks_skipped_by_bounds(spark):
    """A rare word decides: chunks with nothing but common words are not read."""
    corpus = spark.range(20_000, numPartitions=1).select(F.col("id").alias("doc"), F.when(F.col("id").isin(7, 8, 9), "rare word").otherwise("common word").alias("text"))
    index = postings.build(corpus, "doc", "text")
    asked = spark.createDataFrame([("q", "rare word")], "id string, text string")
    assert [r[2] for r in found(postings.search(index, asked, "id", "text", 3))] == [9, 8, 7]
    reach = index.bounds.join(index.terms, "term").groupBy("chunk").agg(F.sum(F.col("idf") * F.col("most")).alias("reach"))
    rare = index.terms.where("term = 'rare'").select((F.col("idf") * F.col("tops")[2]).alias("least")).first().least
    assert reach.where(F.col("reach") >= rare).count() == 1 < reach.count() == 5


def test_answer_stats(spark):
    rows = [("a", [("user", "<search>no"), ("assistant", "<search>x</search> <search>y"), ("user", "r"), ("assistant", "<answer>1</answer> and <answer> two\n </answer>"), ("assistant", None)]), ("b", [("user", "x")]), ("c", [("assistant", "<ANSWER>x</ANSWER>")])]
    df = spark.createDataFrame(rows, "id string, messages array<struct<role:string,content:string>>")
    got = {r.id: tuple(r.s) for r in df.select("id", episodes.answer_stats(F.col("messages")).alias("s")).collect()}
    assert got == {"a": (3, 2, "two", 3), "b": (0, 0, "", 0), "c": (1, 0, "", 0)}


# --- patterns --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_patterns_by_brute_force(spark, shard_bytes):
    """One-word patterns within words, patterns that end within others, texts of many lanes, any bytes, nulls and blanks, equal patterns."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc é", k=rng.choice([0, 1, 5, 50, 3000, 9000]))) for _ in range(120)] + [None, "", "日本語", "x" * 5000]
    golds = ["a", "ab", "abc", "bca", "c é", "é", "aaaa", "abcabc", "b a", "本", "zz", "", None, "ab", "x" * 3000, "xx", "cab", "ca", " "]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc int, text string").repartition(3)
    wanted = spark.createDataFrame([(f"g{i}", g) for i, g in enumerate(golds)], "gold string, words string")
    got = Counter((r.doc, r.gold) for r in containment.contained(corpus, wanted, "doc", "text", "gold", "words", shard_bytes).collect())
    assert got == Counter((i, f"g{j}") for i, t in enumerate(texts) for j, g in enumerate(golds) if t and g and g in t)
    assert containment.contained(corpus, wanted.where("words = ''"), "doc", "text", "gold", "words").isEmpty()


def test_all_bytes_are_classes():
    own = containment.automaton([bytes(range(256)), bytes([255]), bytes([0, 1])])
    texts = [bytes(range(256)), bytes([0, 0, 1]), b"", bytes([254])]
    row, pattern = own.find(texts)
    assert list(zip(row.tolist(), pattern.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 2)]


# --- agent loops -----------------------------------------------------------------------------------------------------

EVENTS = "traj string, n long, kind string, calls boolean, stop boolean, tokens long, errors long"


def loops(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        kind, rows_of = "assistant", []
        for i in range(rng.randrange(1, 30)):
            calls = rng.random() < 0.6
            rows_of.append((f"t{t}", i, None if rng.random() < 0.01 else kind, calls, kind == "user" and rng.random() < 0.1, rng.choice([None, 0, 5, 10, 40]), rng.choice([None, 0, 0, 1])))
            kind = ("tool" if calls else "user") if kind == "assistant" else "assistant"
            if rng.random() < 0.03:
                kind = rng.choice(["assistant", "tool", "user"])
        rows += rows_of
    return rows


def states(rows, caps):
    """One event after the other."""
    import types

    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        x = out.setdefault(r[0], {**dict.fromkeys(agent_loop.COLUMNS, 0), "state": agent_loop.PENDING, "termination": agent_loop.MAX_STEPS})
        if x["state"] != agent_loop.TERMINATED:
            event = types.SimpleNamespace(kind=r[2], calls=r[3], stop=r[4], tokens=r[5], errors=r[6])
            out[r[0]] = stream_loop.after(x, event, caps)
    return {k: tuple(x.values()) for k, x in out.items()}


CAPS = [agent_loop.Caps(), agent_loop.Caps(response=120, assistant_turns=6, user_turns=3, errors=2), agent_loop.Caps(response=1, assistant_turns=1, user_turns=1, errors=1)]


@pytest.mark.parametrize("caps", CAPS)
def test_loop_of_a_table(spark, caps):
    rows = loops(300)
    got = agent_loop.fold(spark.createDataFrame(rows, EVENTS), "traj", "n", caps)
    assert {r.traj: tuple(r)[1:] for r in got.collect()} == states(rows, caps)
    if caps == CAPS[1]:
        assert {r.termination for r in got.collect()} == {agent_loop.MAX_STEPS, agent_loop.TOO_MANY_ERRORS, agent_loop.USER_STOP}


def test_loop_of_a_stream(spark, tmp_path):
    """Halves of trajectories come in other batches, the second one first."""
    rows = loops(40, 3)
    caps = CAPS[1]
    late = {f"t{i}" for i in range(0, 40, 2)}
    batches = [[r for r in rows if (r[0] in late) == (r[1] >= 4)], [r for r in rows if (r[0] in late) != (r[1] >= 4)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            if r.events >= got.get(r.traj, [0] * 4)[2]:
                got[r.traj] = tuple(r)[1:]

    stream_loop.fold(stream, "traj", "n", caps).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert got == states(rows, caps)


def test_chains_of_a_long_trajectory(spark):
    """A trajectory of 100,000 steps: linear work, and the same as looking at all steps before."""
    from trajmill.operators import trajectory

    rows = [("t", i, [f"v{(i * 7919) % 1000}", "vx"] if i % 3 else [], [f"v{i % 50}"] if i % 2 else None) for i in range(100_000)] + [("u", 0, ["v1"], ["v1"]), ("u", 1, ["v1"], []), ("w", 0, [], [])]
    df = spark.createDataFrame(rows, "traj string, idx int, asked array<string>, found array<string>")
    got = {(r.traj, r.idx): r.chained for r in trajectory.chained(df, F.col("asked"), F.col("found")).select("traj", "idx", "chained").collect()}
    seen, want = {}, {}
    for t, i, asked, found in rows:
        own = seen.setdefault(t, set())
        want[t, i] = any(a in own for a in asked)
        own |= set(found or [])
    assert got == want


def test_parameters_that_are_texts(spark):
    from trajmill.functions import rewards

    rows = ['{"a": "x", "b": 5, "c": null, "d": {"e": "f"}, "g": ["h"], "i": "\\u00e9\\"", "j": true, "k": ""}', "[1]", "not json", None, "{}", '"text"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a string")
    got = {r.i: (r.p, r.e) for r in df.select("i", rewards.text_parameters("a").alias("p"), rewards.entity_strings(F.col("a")).alias("e")).collect()}
    assert [got[i][0] for i in range(6)] == [{"a": "x", "i": 'é"', "k": ""}, {}, {}, {}, {}, {}]
    assert got[5][1] == ["text"] and got[2][1] == [] and got[3][1] == []


def test_groups_whose_rows_come_in_other_batches(spark, tmp_path):
    """Halves of groups a batch apart are one group; dead ones stay out; what comes after a group is full is not looked at."""
    from trajmill.streaming import live_groups

    schema = "g string, row int, o double"
    batches = [
        [("late", 1, 0.0), ("whole", 2, 0.0), ("whole", 3, 1.0), ("dead", 4, 1.0)],
        [("late", 11, 1.0), ("dead", 12, 1.0), ("whole", 13, 0.0), ("half", 14, 0.0)],
        [("later", 21, 1.0), ("later", 22, 0.0), ("dead", 23, 0.0), ("late", 24, 0.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_groups.accumulate(stream(), "g", "row", "o", 3, 9, str(tmp_path / "out"), str(tmp_path / "ck"), group_size=2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.g, r.row) for r in got.collect()) == [("late", 1), ("late", 11), ("later", 21), ("later", 22), ("whole", 2), ("whole", 3)]
    live_groups.accumulate(stream(), "g", "row", "o", 2, 9, str(tmp_path / "out2"), str(tmp_path / "ck2"), group_size=2).awaitTermination()
    assert {r.g for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == {"late", "whole"}
