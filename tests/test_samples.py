"""Rendering, checks, runs, samples, recovery and campaigns on small literal cases, and readers and writers on files."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trajmill.functions import rewards
from trajmill.operators import campaigns, guards, losses, recovery, rendering, runs, trajectory, validation
from trajmill.sinks import writers
from trajmill.sources import readers

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGES = f"messages array<struct<role:string,content:string,name:string,tool_call_id:string,calls:array<{CALL}>>>"


def msg(role, content="", name="", to="", calls=()):
    return (role, content, name, to, [tuple(c) for c in calls])


def convs(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), f"id int, {MESSAGES}").withColumn("loss_mask", F.transform("messages", lambda m: m["role"] == "assistant"))


TALK = [msg("user", "hi"), msg("assistant", "on it", calls=[("a", "look", '{"z": 1, "b": [2, "x"]}'), ("b", "note", "not json")]), msg("tool", "ok", "look", "a"), msg("assistant", "")]
TEXT = (
    "<|im_start|>user\nhi\n<|im_end|>\n<|im_start|>assistant\non it\n<tool_call>\n" + '{"arguments":{"b":[2,"x"],"z":1},"name":"look"}' + "\n</tool_call>\n<tool_call>\n"
    + '{"arguments":"not json","name":"note"}' + "\n</tool_call>\n<|im_end|>\n<|im_start|>tool name=look tool_call_id=a\nok\n<|im_end|>\n<|im_start|>assistant\n\n<|im_end|>\n"
)


@pytest.mark.parametrize("wrappers", [False, True])
def test_rendering(spark, wrappers):
    df = rendering.rendered(convs(spark, TALK, []), policy=rendering.LossPolicy(wrappers=wrappers))
    df = rendering.check_record(df).withColumn("marked", rendering.marked(F.col("text"), F.col("spans")))
    r, none = df.withColumn("back", rendering.unmarked(F.col("marked"))).orderBy("id").collect()
    assert r.text == TEXT == r.back and none.text == "" and none.spans == [] and none.target_char_ratio == 0
    pieces = [TEXT[s.start : s.end] for s in r.spans]
    calls = ['{"arguments":{"b":[2,"x"],"z":1},"name":"look"}', '{"arguments":"not json","name":"note"}']
    assert pieces == (["on it", "<tool_call>\n", calls[0], "\n</tool_call>", "<tool_call>\n", calls[1], "\n</tool_call>"] if wrappers else ["on it", *calls])
    assert r.marked.count("_START@@") == len(pieces) and "@@TARGET_1_START@@on it@@TARGET_1_END@@" in r.marked
    assert r.roles == ["assistant:2", "tool:1", "user:1"] and r.message_count == 4 and r.target_messages == 2


def test_normalised_messages(spark):
    raw = [("user", None, None, None, None, None, None, 0), ("critic", "no", None, None, None, None, None, 1), ("assistant", None, [("a", None, "look", "{}", None), ("a", "function", None, None, ("seek", "{}"))], None, None, None, None, 2), ("tool", "r", None, "a", None, None, None, 3)]
    df = spark.createDataFrame([("t", 0, 1.0, raw, None)], readers.ROLLOUT)
    r = rendering.normalized(df).first()
    assert [m.role for m in r.messages] == ["user", "assistant", "tool"] and r.loss_mask == [False, True, False]
    assert r.messages[0].content == "" and r.messages[2].name == "seek" and [c.name for c in r.messages[1].calls] == ["look", "seek"]


def test_token_stats_and_budget(spark):
    df = rendering.with_budget(rendering.with_token_stats(rendering.rendered(convs(spark, TALK))), 5, "id")
    r = df.withColumn("probe", F.lit(0)).first()
    words = TEXT.split()
    assert r.tokens == len(words) and r.target_tokens == 2 + 2 + 1 and r.truncated and r.over_budget == f"token_count_exceeds_max:0:{len(words)}>5"
    r = rendering.reference_body(convs(spark, TALK[:2])).first()
    assert r.prompt == "<|im_start|>user\nhi\n<|im_end|>\n<|im_start|>assistant\n" and r.reference.startswith("on it\n<tool_call>\n")
    mask = rendering.assistant_token_mask(F.col("messages"), F.array(F.lit(1), F.lit(1)), F.array(F.lit(2), F.lit(3)))
    assert convs(spark, TALK[:2]).select(mask.alias("m")).first().m == [0, 0, 0, 0, 1, 1, 1]


def test_words_take_little_memory():
    """Two million words' places: eight bytes each, and no Python object for each of them."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["a b " * 5000] * 200 + [None, "", "ä  b"])
    tracemalloc.start()
    got = rendering.word_offsets.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and [len(got[i].as_py()) for i in (0, 200, 201)] == [10_000, 0, 0] and got[202].as_py() == [{"start": 0, "end": 1}, {"start": 3, "end": 4}]


def test_structure(spark):
    bad = [msg("assistant", calls=[("", "x", ""), ("q", "", "")]), msg("tool", "r", "", "zz"), msg("tool", "r", "n", ""), msg("judge", "?")]
    df = convs(spark, bad, TALK, []).withColumn("loss_mask", F.when(F.col("id") == 0, F.array(*[F.lit(x) for x in (False, True)])).otherwise(F.col("loss_mask")))
    rows = df.select("id", validation.structure_report(F.col("messages"), F.col("loss_mask")).alias("r")).orderBy("id").collect()
    assert rows[0].r.errors == ["messages_loss_mask_length_mismatch", "tool_call_missing_id:0", "tool_call_missing_name:0:q", "non_assistant_target:1:tool", "tool_message_without_prior_call:1:zz", "tool_message_missing_call_id:2", "invalid_role:3:judge"]
    assert rows[0].r.warnings == ["assistant_not_targeted:0", "tool_message_missing_name:1:zz", "tool_calls_without_response:q", "conversation_starts_with_assistant"]
    assert rows[1].r.errors == [] and rows[1].r.warnings == ["empty_target_assistant:3", "tool_calls_without_response:b"] and rows[2].r.errors == ["empty_messages"]


def test_datasets(spark):
    df = convs(spark, TALK, TALK[:2], TALK[:3]).withColumn("key", F.lit("same"))
    found = validation.sample_errors(df, "key", ["id"], one_call=True).collect()
    assert sorted(r.error for r in found) == ["duplicate_id"] * 2 + ["last_not_assistant"] + ["loss_mask_not_last_only"] * 2 + ["target_call_count"] * 3
    rows = spark.createDataFrame([("1", "train"), ("1", "valid"), ("2", "train"), ("2", "heldout"), ("3", "valid")], "task string, split string")
    got = validation.leak_errors(rows, "task", "split", {"a": (["train"], ["valid"]), "b": (["train", "valid"], ["heldout"]), "c": (["x"], ["y"])}).collect()
    assert {r.error: r.tasks for r in got} == {"a": ["1"], "b": ["2"]}
    with pytest.raises(PySparkException, match="same"):
        guards.require_unique(df, "key").collect()


def test_outcomes_and_runs(spark):
    sims = "s1,1,0,user_stop,1.0,true,1.0;s2,1,1,max,,,;s3,2,0,user_stop,1.2,false,0.0"
    rows = []
    for line in sims.split(";"):
        i, t, n, end, reward, db, c = line.split(",")
        rows.append((i, t, int(n), end, ((float(reward) if reward else None), (db == "true", 0.0) if db else None, {"COMMUNICATE": float(c)} if c else {}, [((f"act{n}", "{}"), True)]) if reward else None, []))
    kind = readers.SIMULATION.removeprefix("struct<").removesuffix(">")
    df = runs.outcomes(spark.createDataFrame(rows, kind.replace(":", " ", 1) if False else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in readers.T.StructType.fromDDL(f"s {readers.SIMULATION}")["s"].dataType)))
    counted = {(r.counter, r.value): r.n for r in runs.run_counters(df).collect()}
    assert counted == {("termination", "user_stop"): 2, ("termination", "max"): 1, ("db", "match"): 1, ("db", "mismatch"): 1, ("db", "not_checked"): 1, ("communicate", "1.0"): 1, ("communicate", "0.0"): 1, ("communicate", "not_checked"): 1}
    r = runs.run_summary(df.withColumn("run", F.lit("a")), "run").first()
    assert (r.tasks, r.sims, r.success_count) == (2, 3, 1) and abs(r.avg_reward - 1.1) < 1e-9
    assert runs.compared(df.withColumn("run", F.lit("a")), "run", (1, 2)).first().pass_2 is None
    assert df.where("id = 's1'").select(runs.expected_actions(df, "act0")[0]["name"].alias("n")).first().n == "act0"
    assert runs.outcomes(df.drop("reward"), True).where("id = 's2'").first().reward == 0.0
    assert runs.picked(df, "id", "1", index=1).first().id == "s2" and runs.of_tasks(df, ["2"]).first().id == "s3"
    key = spark.createDataFrame([("", "k"), ("x", "k"), (None, None)], "id string, simulation_id string").select(runs.fallback_key("id", "simulation_id").alias("k"))
    assert [r.k for r in key.collect()] == ["k", "x", None]
    tags = spark.createDataFrame([(0.0, 1.0, []), (1.0, 1.0, ["a"]), (0.0, -1.0, ["a"])], "r double, s double, t array<string>").select(runs.evaluator_tags(F.col("r"), F.col("s"), F.col("t")).alias("x"))
    assert [r.x for r in tags.collect()] == [["evaluator_gap", "unclassified_failure"], ["a"], ["a"]]


def test_balance(spark):
    rows = [(f"p{i}", "tool_call", True) for i in range(5)] + [("t", "assistant_text", None), ("c", "tool_call", False), ("n", None, None)]
    df = spark.createDataFrame(rows, "id string, target_action string, protocol_only boolean")
    got = runs.balanced(df, 3, 0.5, 11).collect()
    role = lambda x: sorted(r.id for r in got if r.balance_role == x)
    assert len(role("protocol_tool_kept")) == 3 and len(role("protocol_tool_downsampled")) == 2 and role("tool_original") == ["c", "n"]
    assert role("assistant_text_original") == ["t"] and role("assistant_text_repeat") == ["t__text_repeat1", "t__text_repeat2"]
    assert {r.id for r in got} == {r.id for r in runs.balanced(df.repartition(3), 3, 0.5, 11).collect()}
    with pytest.raises(ValueError):
        runs.balanced(df, 0, 0.5, 11)
    with pytest.raises(PySparkException, match="repeated"):
        runs.balanced(df.union(df.where("id = 't'")), 1, 0.5, 11).collect()
    ids = spark.createDataFrame([("a/x/x",)], "i string").select(runs.repeat_id(F.col("i"), "x", F.lit("yy")).alias("i"))
    assert ids.first().i == "a/yy/x"


def test_selection(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1), ("d", 9)], "id string, n int")
    assert [r.id for r in runs.shortest_first(df, "n", "id", 2).collect()] == ["b", "c"]
    with pytest.raises(PySparkException, match="zz"):
        runs.shortest_first(df, "n", "id", 2, spark.createDataFrame([("zz",)], "id string")).collect()
    assert [r.id for r in runs.shuffled_first(df, "id", 4, 5).collect()] == [r.id for r in runs.shuffled_first(df.repartition(2), "id", 4, 5).collect()]
    assert [r.split for r in runs.three_way(df.withColumn("ok", F.col("n") < 9), df.where("id = 'b'"), "ok", "id").orderBy("id").collect()] == ["train", "valid", "train", "heldout"]
    stats = spark.createDataFrame([("a", 7), ("b", 0)], "id string, tokens int")
    assert [r.tokens for r in runs.row_tokens(df, stats, "id", "n").orderBy("id").collect()] == [7, 1, 1, 9]


def test_losses(spark):
    rows = spark.createDataFrame([(1, 2.0, [5, 7, -100, 8]), (2, 30.0, [5])], "id int, loss double, labels array<int>")
    a, b = losses.evaluated(rows).orderBy("id").collect()
    assert (a.target_tokens, a.nll_sum, b.target_tokens) == (2, 4.0, 0) and abs(b.perplexity - 485165195.4) < 1
    nan = float("nan")
    batches = spark.createDataFrame([(0, nan), (1, 2.0), (2, 4.0), (3, 9.0)], "i int, loss double")
    assert losses.finite_mean(batches, "i", "loss", 3).first().loss == 3.0 and str(losses.finite_mean(batches, "i", "loss", 1).first().loss) == "nan"
    with pytest.raises(PySparkException, match="base: 2"):
        losses.row_deltas(rows.where("id = 1"), rows).collect()
    tokens = spark.createDataFrame([("r", i, -1.0, -2.0, 1 if i else 0, 2.0) for i in range(5)] + [("s", 0, -1.0, -1.0, 0, 1.0)], "r string, i int, logp double, ref_logp double, mask int, adv double")
    out = losses.policy_loss(tokens, "r", "i", "adv", length_aware=True).collect()
    assert len(out) == 1 and abs(out[0].loss - 4.0) < 1e-9


def test_recovery(spark):
    talk = [("t", 0, "user", "cancel it", []), ("t", 1, "assistant", "which user? ", ["get_user_details"]), ("t", 2, "tool", "Error: User x not found", []), ("t", 3, "tool", "Error: Reservation Y not found", [])]
    m = spark.createDataFrame(talk, "k string, idx int, role string, content string, tools array<string>")
    own = spark.createDataFrame([("t", [msg(r, c) for _, _, r, c, _ in talk])], f"k string, {MESSAGES}")
    got = recovery.corrections(recovery.context(m, "k"), own, "k", recovery.online_rules(F.col("content").rlike("[a-z]+_[a-z]+_[0-9]+"))).orderBy("turn").collect()
    assert [(r.family, r.turn, len(r.messages)) for r in got] == [("ask_identity_before_tool", 0, 2), ("no_tool_while_asking", 1, 2), ("user_not_found_stop_guessing", 2, 4), ("reservation_not_found_stop_guessing", 3, 5)]
    assert got[0].id == "recovery_t_turn0_ask_identity_before_tool" and got[0].loss_mask == [False, True] and got[1].messages[-1].content == "which user?"
    rule = recovery.Rule("look", F.col("role") == "tool", tool="get", arguments=F.lit('{"a":1}'))
    last = recovery.corrections(recovery.context(m, "k"), own, "k", [rule]).orderBy("turn").first().messages[-1]
    assert last.calls[0].name == "get" and last.calls[0].id.startswith("call_")
    listed = spark.createDataFrame([("t", 0, ["a", "b"], None), ("t", 1, None, "a"), ("t", 2, None, None), ("t", 3, None, "b"), ("t", 4, None, None)], "k string, idx int, listed array<string>, done string")
    assert [r.candidate for r in recovery.remaining_candidates(listed, "k", "listed", "done").orderBy("idx").collect()] == ["a", "a", "b", "b", None]
    flights = spark.createDataFrame([("H1", "A", "B", {"d1": ("on", 3), "d2": ("off", 0)}), ("H2", "A", "C", {"d1": ("on", 1)})], "flight_number string, origin string, destination string, dates map<string,struct<status:string,seats:int>>")
    assert [(r.flight_number, r.status) for r in recovery.flights_on(flights, "d1", "A", "B").collect()] == [("H1", "on")] and recovery.flights_on(flights).count() == 3
    tasks = spark.createDataFrame([("1", "goal")], "task_id string, goal string")
    plans = recovery.blueprints(spark, [("1", "f", "p"), ("2", "f", "p")], tasks, spark.createDataFrame([("1", "train")], "task_id string, official_split string"), "v1", "air").orderBy("id").collect()
    assert [(r.trainable, r.official_split, r.task and r.task.goal) for r in plans] == [(True, "train", "goal"), (False, "unknown", None)]


def test_own_results(spark):
    calls = spark.createDataFrame([("t", 0, "a"), ("t", 2, "x"), ("t", 5, "y")], "traj string, idx int, call_id string")
    results = spark.createDataFrame([("t", 1, "a", "one"), ("t", 3, "zz", "next"), ("t", 4, "a", "two")], "traj string, idx int, reply_to string, content string")
    got = trajectory.own_result(calls, results, "traj", "call_id", "idx", "content").orderBy("idx").collect()
    assert [r.content for r in got] == ["two", "next", ""]


def test_rewards(spark):
    df = spark.createDataFrame([('{"outer": {"name_x": ["long value", 12345, 1, true]}, "ab": "xyz"}', '{"user_id": "bob", "n": 4}'), ("no json", None)], "c string, a string")
    a, b = df.select(rewards.entity_strings("c").alias("e"), rewards.has_placeholder(rewards.text_parameters("a")).alias("p")).collect()
    assert a.e == ["12345", "long value", "name_x", "outer"] and a.p and b.e == [] and not b.p
    one = spark.range(1).select(rewards.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), rewards.best_index(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("i"), rewards.sparkline(F.array(F.lit(0.0), F.lit(1.0))).alias("l"), rewards.percent(F.lit(0.1234)).alias("p"), rewards.optional(F.lit(None)).alias("o"), rewards.shaped(F.lit(1), F.lit(-0.5)).alias("r"), rewards.task_text(F.create_map(F.lit("a"), F.lit("x")), lists=(F.array(F.lit("y")),)).alias("t"), rewards.loose_error(F.lit("was Not Found")).alias("err")).first()
    assert one.s == [0.5, 0.5] and one.i == 1 and one.l == "▁█" and one.p == "12.3%" and one.o == "n/a" and one.r.reward == 0.85 and one.t == "x\ny" and one.err
    golds = F.array(F.lit("Paris"), F.lit(" "), F.lit("city of Paris"))
    vals = spark.range(1).select(*[rewards.qa_reward(F.lit(t), golds, m).alias(f"{m}{i}") for i, t in enumerate(["<answer>paris</answer>", "it is the city"]) for m in ("em", "f1", "em_or_f1half")]).first()
    assert vals.em0 == 1.0 and vals.em1 == 0.0 and 0 < vals.f11 < 1 and vals.em_or_f1half1 == vals.f11 / 2


def test_campaigns(spark, tmp_path):
    arms = [campaigns.Arm("a"), campaigns.Arm("b", "f1", True, 1.1, 100)]
    assert [(r.arm, r.gate, r.seed) for r in campaigns.matrix(spark, arms, [0, 1]).orderBy("arm", "seed").collect()] == [("a", "binary", 0), ("a", "binary", 1), ("b", "continuous", 100), ("b", "continuous", 101)]
    assert campaigns.run_matrix(arms, [0], lambda arm: spark.range(2)).count() == 4
    asked = []

    def work(name):
        asked.append(name)
        return spark.range(0 if len(asked) == 1 else 1)

    assert campaigns.with_retry(work, "x")[0] == "x_retry" and asked == ["x", "x_retry"]
    seen = []

    def collect(i, artifact):
        seen.append(i)
        return spark.range(i + 1) if artifact is None else artifact.select((F.col("n") + 1).alias("id"))

    loop = lambda n: [a.first().n for _, _, a in campaigns.iterate(spark, str(tmp_path / "loop"), n, collect, lambda i, r: r.agg(F.max("id").alias("n")))]
    assert loop(2) == [0, 1] and loop(3) == [0, 1, 2] and seen == [0, 1, 2]  # the first two were there
    tasks = spark.createDataFrame([("2",), ("10",)], "task_id string")
    done = spark.createDataFrame([("2", 0, "completed", 5.0), ("10", 1, "completed", 99.0), ("10", 0, "failed", 1.0)], "task_id string, trial int, status string, duration_seconds double")
    assert [(r.task_id, r.trial) for r in campaigns.pending(tasks, 2, done, 60).collect()] == [("2", 1), ("10", 0), ("10", 1)]
    one = spark.createDataFrame([("1", 0, "old"), ("2", 0, "old")], "task_id string, trial int, v string")
    assert {(r.task_id, r.v) for r in campaigns.merged([one, one.where("task_id = '1'").withColumn("v", F.lit("new"))]).collect()} == {("1", "new"), ("2", "old")}
    rows = campaigns.completions(spark.createDataFrame([("p",), ("q",)], "prompt string"), lambda ps: [[p + "1", p + "2"] for p in ps], "prompt").collect()
    assert sorted(r.completion for r in rows) == ["p1", "p2", "q1", "q2"]
    out = campaigns.agent_loop_rows(spark.createDataFrame([([1, 2], [0, 1], 1.0, "invalid"), ([1], [1], 1.0, "done")], "response_ids array<int>, response_mask array<int>, outcome_binary double, termination string"))
    assert [(r.trained_tokens, r.reward) for r in out.collect()] == [(1, 0.0), (1, 1.0)]


def test_files(spark, tmp_path, capsys):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"task_id": "1"}\n\n{"task_id": "2"}\n{oops\n')
    with pytest.raises(ValueError, match=r"bad.jsonl:4: not JSON: \{oops"):
        readers.strict_jsonl(spark, str(bad))
    bad.write_text('{"task_id": "1"}\n')
    assert readers.strict_jsonl(spark, str(bad)).first().task_id == "1"
    (tmp_path / "list.json").write_text(json.dumps([{"id": "a", "task_id": "1"}, {"id": "b", "task_id": "2"}]))
    (tmp_path / "dict.json").write_text(json.dumps({"simulations": [{"id": "c", "task_id": "3"}]}))
    assert sorted(r.id for r in readers.any_run(spark, [str(tmp_path / "list.json"), str(tmp_path / "dict.json")]).collect()) == ["a", "b", "c"]
    qa = tmp_path / "qa.jsonl"
    qa.write_text("".join(json.dumps({"question": f"q{i}", "answer": f"a{i}"}) + "\n" for i in range(5)))
    assert [r.question for r in readers.qa_items(spark, str(qa), 2).collect()] == ["q0", "q1"] and readers.qa_items(spark, str(qa)).count() == 5
    assert readers.named_paths(["m=/x/y.json", "/x/z.json"]) == [("m", "/x/y.json"), ("z", "/x/z.json")]
    with pytest.raises(ValueError):
        readers.named_paths(["m=a", "m=b"])
    dim = spark.createDataFrame([("k", 0, "old"), ("k", 1, "new"), (None, 2, "x")], "key string, n int, v string")
    assert [tuple(r) for r in readers.dimension(dim, "key", "n").collect()] == [("k", "new")]
    m = spark.createDataFrame([("1", 0, 2.5)], "task_id string, trial int, seconds double")
    for _ in range(2):
        writers.append_manifest(m, str(tmp_path / "manifest"))
    own = tmp_path / "manifest"
    assert (own / "_columns.csv").read_text() == "task_id,trial,seconds\n" and spark.read.csv(str(own)).count() == 2
    writers.write_train_and_test(m.withColumn("i", F.lit(0)), str(tmp_path / "split"), "i", 1)
    assert sorted(os.listdir(tmp_path / "split")) == ["test", "train"]
    writers.write_rollouts(m, str(tmp_path / "rollouts"))
    assert spark.read.json(str(tmp_path / "rollouts")).count() == 1
    assert writers.console(m, "title").splitlines() == ["title", "task_id  trial  seconds", "1        0      2.5000"] and "title" in capsys.readouterr().out
    rows = runs.catalogue_rows(spark.createDataFrame([(7, 0, "do it")], "task_id int, ordinal int, text string"), "agents", "air", "text").first()
    assert rows.data_source == "agents/air" and rows.extra_info.task_id == "7" and rows.prompt[0].content == "do it"
