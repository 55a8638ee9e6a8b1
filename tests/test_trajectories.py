"""Readers, writers, tool replies and slot grounding on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from trajmill.operators import grounding, messages
from trajmill.sinks import writers
from trajmill.sources import readers


def call(i, name, **arguments):
    return {"id": i, "name": name, "arguments": json.dumps(arguments)}


def nested(i, name, **arguments):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}


#: Bags are paid with a card that nobody named; then an account is guessed while a booking is asked for.
GUESSED = [
    {"role": "user", "content": "two more bags on QW12ER, please"},
    {"role": "assistant", "content": "One moment.", "tool_calls": [call("c1", "update_reservation_baggages", reservation_id="QW12ER", payment_id="gift_card_31")]},
    {"role": "tool", "id": "c1", "content": "ok"},
    {"role": "assistant", "content": "Send your reservation id again.", "tool_calls": [call("c2", "get_user_details", user_id="tom_fox_5")]},
    {"role": "tool", "id": "c2", "content": "Error: user tom_fox_5 not found"},
    {"role": "assistant", "content": "", "tool_calls": [call("c3", "cancel_reservation", reservation_id="QW12ER"), call("c4", "transfer_to_human_agents", summary="x")]},
]
#: The card comes out of the booking that the user named.
READ = [
    {"role": "user", "content": "it is kim_ray_8, put ZT55PL on another day"},
    {"role": "assistant", "content": "", "tool_calls": [nested("d1", "get_reservation_details", reservation_id="ZT55PL")]},
    {"role": "tool", "tool_call_id": "d1", "content": json.dumps({"reservation_id": "ZT55PL", "user_id": "kim_ray_8", "payment_history": [{"payment_id": "credit_card_71"}]})},
    {"role": "assistant", "content": "", "tool_calls": [nested("d2", "update_reservation_flights", reservation_id="ZT55PL", payment={"payment_id": "credit_card_71"})]},
]


@pytest.fixture(scope="module")
def rollouts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rollouts") / "r.jsonl"
    rows = [{"task_id": "1", "trial": 0, "reward": 0.0, "messages": GUESSED}, {"task_id": "2", "trial": 0, "reward": 1.0, "messages": READ}]
    path.write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    return readers.lenient_jsonl(spark, str(path))


def test_grounding(rollouts):
    rows = messages.exploded(rollouts, ["task_id"])
    found = sorted((r.task_id, r.component, r.value, r.severity) for r in grounding.issues(rows, ["task_id"]).collect())
    assert found == [("1", "ask_identifier_and_call_tool_same_turn", "tom_fox_5", 2.0), ("1", "transfer_after_ungrounded_slot_error", "tom_fox_5", 2.5), ("1", "ungrounded_payment_id", "gift_card_31", 1.5), ("1", "ungrounded_user_id", "tom_fox_5", 3.0)]
    scores = {r.task_id: sum(c.value for c in r.components) for r in grounding.components(rows, ["task_id"]).collect()}
    assert scores == {"1": -9.0, "2": 1.0}


def test_a_reply_belongs_to_the_last_call_before_it(spark):
    rows = [{"role": "assistant", "tool_calls": [call("x", "a")]}, {"role": "tool", "id": "x", "content": "1"}, {"role": "assistant", "tool_calls": [call("x", "b")]}, {"role": "tool", "id": "x", "content": "2"}, {"role": "tool", "id": "y", "content": "3"}]
    df = spark.read.schema(readers.ROLLOUT).json(spark.sparkContext.parallelize([json.dumps({"task_id": "1", "messages": rows})]))
    got = messages.replies_with_calls(messages.exploded(df, ["task_id"]), ["task_id"]).orderBy("idx").collect()
    assert [(r.content, r.tool) for r in got] == [("1", "a"), ("2", "b"), ("3", "<unknown>")]


def test_identifiers_in_text(spark):
    df = spark.createDataFrame([("please HELPME on 5 and ABC123, HAT123 pays credit_card_4 by mia_li_3",)], "t string")
    got = {(s.slot, s.value) for s in df.select(grounding.slots_in_text(F.col("t")).alias("s")).first().s}
    assert got == {("user_id", "mia_li_3"), ("user_id", "credit_card_4"), ("payment_id", "credit_card_4"), ("flight_number", "HAT123"), ("reservation_id", "HELPME"), ("reservation_id", "ABC123")}


def test_readers(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"task_id": "1"}\nnot json\n')
    with pytest.raises(ValueError, match="bad.jsonl"):
        readers.strict_jsonl(spark, str(bad))
    sims = lambda *ids: [{"id": i, "task_id": i, "reward_info": {"reward": 1.0}} for i in ids]
    for name in ("run_trial_0_task_3", "run_task_4_trial_1", "other"):
        (tmp_path / "shards" / name).mkdir(parents=True)
        (tmp_path / "shards" / name / "results.json").write_text(json.dumps({"simulations": sims(name)}))
    got = readers.shard_documents(spark, str(tmp_path / "shards"), "run").select("shard", readers.shard_task(F.col("shard")).alias("k")).collect()
    assert {(r.shard, r.k.task_id, r.k.trial) for r in got} == {("run_trial_0_task_3", "3", 0), ("run_task_4_trial_1", "4", 1)}
    one, folder = tmp_path / "results.json", tmp_path / "simulations"
    one.write_text(json.dumps({"simulations": sims("a", "b")}))
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(sims("c")[0]))
    ids = lambda df: [r.id for r in df.orderBy("ordinal").collect()]
    assert ids(readers.run_document(spark, str(one))) == ["a", "b"]
    assert ids(readers.run_document(spark, str(one), str(folder))) == ["c"]
    assert ids(readers.run_document(spark, str(one), str(folder), inline_first=True)) == ["a", "b"]
    assert [r.task_id for r in readers.ids(spark, "1,2 7").collect()] == ["1", "2", "7"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", [1, 2], 0.5), (1, None, [], None)], "b int, a string, l array<int>, x double")
    writers.write_jsonl(df, str(tmp_path / "j"), ["b"])
    lines = [x for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == ['{"a":null,"b":1,"l":[],"x":null}', '{"a":"é","b":2,"l":[1,2],"x":0.5}']
    writers.write_csv([df.select("b", "l"), df.select("b", "x")], str(tmp_path / "c"))
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert got.columns == ["b", "l", "x"] and {(r.b, r.l, r.x) for r in got.collect()} >= {("2", "1|2", None), ("2", None, "0.5000")}
    assert writers.summary_markdown(df.select("b", "x").orderBy("b"), "T").endswith("| 2 | 0.5000 |\n")
