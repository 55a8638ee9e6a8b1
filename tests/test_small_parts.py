"""Functions that no query uses, on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from trajmill.functions import generated
from trajmill.operators import campaigns, datasets, evaluation, recovery
from trajmill.sinks import writers


def test_summaries(spark, monkeypatch):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "name string, n int, rate double")
    assert json.loads(writers.summary_json(df)) == [{"name": "b", "n": 2}, {"name": "a", "n": 1, "rate": 0.5}]
    assert writers.summary_json(df).index('"n"') < writers.summary_json(df).index('"name"')
    assert writers.summary_markdown(df, "T").splitlines()[2:4] == ["| name | n | rate |", "| --- | --- | --- |"]
    monkeypatch.setattr(writers, "SUMMARY_ROWS", 1)
    for write in (writers.summary_json, lambda d: writers.summary_markdown(d, "T")):
        with pytest.raises(ValueError, match="more than 1 rows"):
            write(df)


def test_numeric_order(spark):
    ids = spark.createDataFrame([("10",), ("9",), ("x",), ("a",), ("-1",)], "task_id string")
    assert [r.task_id for r in ids.orderBy(*evaluation.numeric_order()).collect()] == ["-1", "9", "10", "a", "x"]


def test_padded(spark):
    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3, 4],)], "ids array<int>").select(datasets.padded(F.col("ids"), F.lit(3), 0).alias("p"))
    assert [r.p for r in df.collect()] == [[1, 2, 0], [0, 0, 0], [1, 2, 3, 4]]


def test_signatures_and_successes(spark):
    call = "struct<name:string,function:struct<name:string>>"
    said = lambda text, *calls: ("assistant", text, [(flat, (name,) if name else None) for flat, name in calls])
    rows = [
        ("t", 0, 1.0, [("user", "x", []), said("x" * 50), said("", (None, "look"), ("flat", None))]), ("t", 1, 1.0, [said("x" * 45), said("", (None, "look"), ("other", None))]), ("t", 2, 0.0, [said("no")]),
        ("t", 3, 1.0, [said("b")]), ("t", 4, 1.0, [said("c")]), ("u", 0, 1.0, [said(None)]),
    ]
    df = spark.createDataFrame(rows, f"task_id string, trial int, reward double, messages array<struct<role:string,content:string,tool_calls:array<{call}>>>")
    got = [r.s for r in df.select(generated.trajectory_signature(F.col("messages")).alias("s")).collect()]
    assert got == [f"S:{'x' * 40}|T:look,", f"S:{'x' * 40}|T:look,", "S:no", "S:b", "S:c", "S:"]
    flat = [r.s for r in df.select(generated.trajectory_signature(F.col("messages"), flat=True).alias("s")).collect()]
    assert flat[0].endswith("T:look,flat") and flat[1].endswith("T:look,other")
    kept = campaigns.success_dataset(df.withColumn("sig", generated.trajectory_signature(F.col("messages"))), "sig", 2)
    assert sorted((r.task_id, r.trial) for r in kept.collect()) == [("t", 0), ("t", 3), ("u", 0)]


def test_rule_of_one_task(spark):
    calls = "array<struct<id:string,name:string,arguments:string>>"
    messages = f"messages array<struct<role:string,content:string,name:string,tool_call_id:string,calls:{calls}>>"
    convs = spark.createDataFrame([("a", [("user", "hi", "", "", []), ("assistant", "wrong", "", "", [])]), ("b", [("user", "hi", "", "", []), ("assistant", "wrong", "", "", [])])], f"id_ string, {messages}")
    contexts = convs.select("id_", F.when(F.col("id_") == "a", "7").otherwise("8").alias("task_id"), F.posexplode("messages").alias("idx", "m"))
    rule = recovery.task_rule("say_it", "7", F.col("m.content") == "wrong", text=F.lit("right"))
    got = recovery.corrections(contexts, convs, "id_", [rule]).collect()
    assert [(r.id_, r.turn, r.family, r.messages[-1].content) for r in got] == [("a", 1, "say_it", "right")]


def test_objects_on_the_jvm(spark):
    """As the scanner in Python, over random runs of all that matters, long strings of escapes and many objects."""
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choices(['"', "{", "}", "\\", "a", "é", "\n", ",", '\\"'], k=rng.randrange(60))) for _ in range(2000)]
    texts += ['{"a": "' + "\\\\" * 30_000 + '"}', '{"x": {}}' * 500, "{" * 5000 + "}" * 5000, "", "no braces", '"{']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", generated.objects(F.col("t")).alias("o"))
    got = {r.i: r.o for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == [list(generated.json_objects(t)) for t in texts]
    assert spark.range(1).select(generated.objects(F.lit(None).cast("string")).alias("o")).first().o == []
