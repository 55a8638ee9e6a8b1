"""Large JSON documents read by splits, against json.loads."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from trajmill.sources import documents, readers


def nasty(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(["", "}", "]", '"', "\\", '\\"', '{"simulations": [', "é日😀", "a\\\\", ",", "x" * rng.randrange(300), "\n\t"])
    if kind in (1, 2):
        return rng.choice([None, True, 0, -1.5, 10**12])
    if kind == 3:
        return rng.choice([[], {}, [[]], {"a": {}}])
    if kind == 4:
        return [nasty(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "}", "simulations", 'q"', "\\"]): nasty(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_by_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent or 0)
    want = {}
    for i in range(12):
        items = [nasty(rng) for _ in range(rng.choice([0, 1, 40]))]
        whole = items if i % 3 == 0 else {"info": nasty(rng), "tasks": [nasty(rng) for _ in range(3)], "simulations": items, "more": {"simulations": [1, 2]}, "z": [nasty(rng)]}
        if i == 4:
            del whole["simulations"]
            items = []
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(whole, indent=indent, ensure_ascii=i % 2 == 0) + "\n" * (i % 2), encoding="utf-8")
        want[path.name] = (i % 3 == 0, items)
    for bare in (True, False):
        rows = documents.elements(spark, str(tmp_path), "simulations", bare).collect()
        got = {name: [json.loads(v) for _, v in sorted((r.ordinal, r.value) for r in rows if r.file_path.endswith(f"/{name}"))] for name in want}
        assert got == {name: [] if listed and not bare else items for name, (listed, items) in want.items()}
        assert all(sorted(r.ordinal for r in rows if r.file_path.endswith(f"/{name}")) == list(range(len(got[name]))) for name in want)


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "results.json"
    sims = [{"id": f"s{i}", "task_id": str(i % 7), "trial": i, "reward_info": {"reward": i / 2}, "messages": [{"role": "user", "content": "}{" * (i % 50)}]} for i in range(400)]
    path.write_text(json.dumps({"info": {}, "simulations": sims}))
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    rows = readers.run_document(spark, str(path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.id, r.trial, r.reward_info.reward, r.messages[0].content) for r in rows] == [(i, s["id"], s["trial"], s["reward_info"]["reward"], s["messages"][0]["content"]) for i, s in enumerate(sims)]


@pytest.mark.parametrize("text", ['{"simulations": [1, 2', '{"simulations": ["a]}', '[{"a": 1}, {', '{"a": "\\'])
def test_broken_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(PySparkException):
        documents.elements(spark, str(tmp_path / "x.json"), "simulations", True).collect()


def test_current_time_and_finished_shards(spark, tmp_path):
    (tmp_path / "policy.md").write_text("Rules.\nThe current time is 2024-05-15 15:00:00 EST.\n")
    (tmp_path / "none.md").write_text("No time here.")
    at = lambda name: str(spark.range(1).select(readers.current_time(spark, str(tmp_path / name), "2020-01-02 03:04:05").alias("t")).first().t)
    assert (at("policy.md"), at("none.md")) == ("2024-05-15 15:00:00", "2020-01-02 03:04:05")
    for shard, sims in (("task_1_trial_0", [{"id": "a"}]), ("task_2_trial_0", []), ("task_3_trial_1", [{"id": "b"}, {"id": "c"}])):
        (tmp_path / "run" / shard).mkdir(parents=True)
        (tmp_path / "run" / shard / "results.json").write_text(json.dumps({"simulations": sims}))
    assert sorted(r.shard for r in readers.finished_shards(spark, str(tmp_path / "run")).collect()) == ["task_1_trial_0", "task_3_trial_1"]
