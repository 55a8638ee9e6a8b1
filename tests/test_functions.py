"""Text, number and generated-call functions, statistics, streaming and episodes on literal cases."""

import json
import math
import time

import pytest
from pyspark.sql import functions as F

from trajmill.functions import generated, stats, text
from trajmill.operators import episodes, groups, trajectory
from trajmill.streaming import live_groups


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "value", "rule"), [
    ("so #### 42", 42.0, "hash"), ("#### $1,234.0 #### 7", 7.0, "hash"), ("\\boxed{ 18 }", 18.0, "boxed"), ("The answer is **5**", 5.0, "phrase"), ("total: $3.50.", 3.5, "phrase"),
    ("it makes 3 and then 9 dollars", 9.0, "last_number"), ("none here", None, "none"), ("", None, "empty"), ("-12 or so", -12.0, "last_number"), ("x" * 9000 + " 4", 4.0, "last_number"),
])
def test_flexible_answers(spark, raw, value, rule):
    got = one(spark, text.flexible_answer(F.col("t")), t=raw)
    assert (got.value, got.rule) == (value, rule)


@pytest.mark.parametrize(("raw", "want"), [("#### 1,234.0", "1234"), ("a 5 b 7.50", "7.5"), ("x", None), ("#### none 3", "3"), ("5 #### ", "5")])
def test_numeric_answers(spark, raw, want):
    assert one(spark, text.numeric_answer(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("<answer> Paris </answer> <ANSWER>Rome</ANSWER>", "Rome"), ("The answer is: Bern.", "Bern"), ("first\n\n last line \n", "last line"), ("", ""), ("<answer>a\nb</answer>", "a\nb"),
])
def test_answers(spark, raw, want):
    assert one(spark, text.answer_of(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("a", "b", "f1", "em"), [("The cat!", "cat", 1.0, 1.0), ("", "", 1.0, 1.0), ("", "x", 0.0, 0.0), ("a b b c", "b b d", 2 * (2 / 3) * (2 / 3) / (4 / 3), 0.0), ("x", "y", 0.0, 0.0), ("éa an", "éa", 1.0, 1.0)])
def test_overlap(spark, a, b, f1, em):
    tokens = lambda c: text.tokens_of(text.normalized(F.col(c)))
    assert one(spark, text.token_f1(tokens("a"), tokens("b")), a=a, b=b) == pytest.approx(f1)
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a=a, b=b) == em


def test_tails(spark):
    for a, b in ((0, 0), (3, 3), (0, 5), (204, 125), (1, 40)):
        n, x = a + b, min(a, b)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(x + 1)) / 2**n)
        assert one(spark, stats.binomial_two_sided(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, rel=1e-9)
    assert one(spark, stats.pass_hat(F.col("n"), F.col("s"), F.col("k")), n=2, s=1, k=2) == 0.0
    assert one(spark, stats.nearest_rank(F.array(*map(F.lit, (1, 2, 3, 4))), 0.5), x=0) == 3


def test_generated_calls(spark):
    raw = 'say <tool_call>{"name": "a", "arguments": {"y": 1, "x": "}"}}</tool_call> and {"function": {"name": "b", "params": "{\\"z\\": 2}"}} {"name": "a", "arguments": {"x": "}", "y": 1}} {"name": oops}<|im_end|>{"name": "c"}'
    calls, failed = generated.calls_in(raw)
    assert calls == [("a", '{"x":"}","y":1}'), ("b", '{"z":2}')] and failed
    got = one(spark, generated.generated_calls(F.col("t")), t=raw)
    assert [c.name for c in got.calls] == ["a", "b"] and got.parse_failed
    assert list(generated.json_objects('{"a": "{"} x {b {c}} } {"open')) == ['{"a": "{"}', "{b {c}}"]
    assert one(spark, generated.canonical_json(F.col("t")), t='{"b": 1, "a": [1, 2]}') == '{"a":[1,2],"b":1}'


def test_stops_labels_and_matches(spark):
    assert one(spark, generated.cut_at_stop(F.col("t"), ["STOP", "</x>"]), t="ab</x>cSTOPd") == "ab</x>"
    assert one(spark, generated.cut_at_stop_by_ends(F.col("t"), ["STOP", "</x>"]), t="ab</x>cSTOPd") == "ab</x>"
    assert one(spark, generated.cut_at_stop_by_ends(F.col("t"), ["</x>", "STOP"]), t="ab</xSTOP</x>") == "ab</xSTOP"
    for raw, want in (("tool_call<|im_end|>x", "tool_call"), ("assistant_text\nbye", "assistant_text"), ('<tool_call>{"name": "x"}', "tool_call"), ("hello", "unknown"), ("so tool_call, not assistant_text", "tool_call")):
        assert one(spark, generated.gate_label(F.col("t")), t=raw) == want
    call = lambda n, a: F.struct(F.lit(n).alias("name"), F.lit(json.dumps(a)).alias("arguments"))
    got = one(spark, generated.call_match(call("f", {"a": 1, "b": 2}), call("f", {"a": 1})), x=0)
    assert (got.name_match, got.key_recall, got.key_precision, got.exact) == (True, 0.5, 1.0, False)


def test_groups_gate(spark):
    rows = [("fail", 0.0, 0.1), ("fail", 0.0, 0.2), ("mixed", 1.0, 1.0), ("mixed", 0.0, 0.0), ("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, o double, s double")
    got = {r.g: r for r in groups.group_state(df, "g", "o", "s").collect()}
    assert got["fail"].dead_outcome and not got["fail"].dead_std and got["one"].dead_outcome and not got["mixed"].dead_outcome
    assert groups.mask_dead(df.drop("o"), "g", "o", "s").columns == ["g", "s"]
    assert groups.dead_weight(df, "g", "o").first().dead_weight == 0.6
    adv = {(r.g, r.s): (r.advantage, r.keep) for r in groups.gated_advantage(df, "g", "s", "o").collect()}
    assert adv["fail", 0.1] == (0.0, False) and adv["mixed", 1.0][1] and adv["mixed", 1.0][0] == pytest.approx(0.5 / (math.sqrt(0.5) + 1e-6))


def test_good_process_beats_bad(spark):
    tax = trajectory.Taxonomy(frozenset({"get", "list"}), frozenset({"book"}), frozenset({"transfer"}), frozenset({"think"}))
    good = [("think", "", False, False, False), ("get", "1", False, False, False), ("list", "2", False, False, True), ("book", "3", False, False, True)]
    bad = [("transfer", "", False, False, False), ("book", "unknown", True, True, False), ("book", "unknown", True, True, False)]
    rows = [(t, i, *s) for t, steps in (("good", good), ("bad", bad)) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "traj string, idx int, tool string, args string, is_error boolean, placeholder boolean, chained boolean").withColumn("content", F.lit(""))
    got = {r.traj: r.process_score for r in trajectory.process_scores(df, tax).collect()}
    assert got["good"] == pytest.approx((0.01 + 0.01 + 0.01 + 0.04 + 0.08) / 4)
    assert got["bad"] == pytest.approx((-0.10 - 0.05 - 0.05 - 0.03 - 0.04) / 3 - 0.05)


def test_stream_of_groups(spark, tmp_path):
    schema = "g string, row int, o double"
    for i in range(3):
        rows = [(f"live{i}{j}", 10 * j + k, float(k)) for j in range(2) for k in range(2)] + [(f"dead{i}", 90, 0.0), (f"dead{i}", 91, 0.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_groups.accumulate(stream(), "g", "row", "o", 3, 3, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("g").distinct().count() == 3 and got.count() == 6 and got.where("g like 'dead%'").isEmpty()
    with pytest.raises(Exception, match="of 9 live groups"):
        live_groups.accumulate(stream(), "g", "row", "o", 9, 3, str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination()


def test_episode(spark):
    corpus = spark.createDataFrame([(0, "Bern is the capital of Switzerland"), (1, "Paris lies on the Seine"), (2, "Cats sleep a lot")], "doc int, passage string")
    asked = spark.createDataFrame([("s", "capital of switzerland?"), ("d", "what?")], "id string, question string")
    last = lambda df: F.element_at("messages", -1)["content"]
    script = lambda df: df.select("id", F.when(F.col("id") == "d", "<answer>no idea</answer>").when(F.startswith(last(df), F.lit("Search results:")), "<answer>Bern</answer>").otherwise("<search>capital switzerland</search>").alias("text"))
    got = {r.id: [m.role for m in r.messages] for r in episodes.run(asked, corpus, script).collect()}
    assert got == {"s": ["system", "user", "assistant", "user", "assistant"], "d": ["system", "user", "assistant"]}
    scores = {r.id: r.p.score for r in episodes.run(asked, corpus, script).select("id", episodes.process_reward(F.col("messages"), F.array(F.lit("Bern"))).alias("p")).collect()}
    assert scores == {"s": 1.0, "d": 0.0}


def test_pass_hat_of_many_trials(spark):
    """A row's time must not grow with k: 3,000 rows with k about a million."""
    rows = [(1_200_000, 1_199_990, 1_000_000 + i) for i in range(3000)] + [(50, 45, 40), (50, 40, 41), (50, 50, 50), (3, 2, 4), (50, 45, 3)]
    begun = time.monotonic()
    got = spark.createDataFrame(rows, "n long, s long, k long").select("n", "s", "k", stats.pass_hat(F.col("n"), F.col("s"), F.col("k")).alias("p")).collect()
    assert time.monotonic() - begun < 60
    for r in [*got[::500], *got[-5:]]:  # of C(s, k) / C(n, k) the n - s factors (n - k - i) / (n - i) are fewer
        assert r.p == pytest.approx(math.prod((r.n - r.k - i) / (r.n - i) for i in range(r.n - r.s)), rel=1e-6, abs=1e-15) if r.k <= r.n else r.p is None
