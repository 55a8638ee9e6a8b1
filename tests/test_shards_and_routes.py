"""Runs that are killed and go on, and routes against all pairs of legs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trajmill.operators import recovery, routes, shards


def tasks(spark, n=4):
    return spark.createDataFrame([(str(i),) for i in range(n)], "task_id string")


def simulated(cells):
    rows = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("task_id").cast("int"))))
    return rows.select("task_id", "trial", "i", (F.col("seed") * 10 + F.col("i")).alias("value"))


def rows(df):
    return sorted(map(tuple, df.select("task_id", "trial", "i", "value").collect()))


def test_shards(spark, tmp_path):
    folder = str(tmp_path / "run")
    got = shards.run(spark, tasks(spark), 3, simulated, folder, at_once=5)
    assert rows(got) == sorted((str(t), k, i, (300 + k) * 10 + i) for t in range(4) for k in range(3) for i in range(t + 1))
    assert [r.status for r in shards.manifest(spark, folder).collect()] == ["ok"] * 12
    asked = []
    assert rows(shards.run(spark, tasks(spark), 3, lambda c: asked.append(1), folder)) == rows(got) and not asked


def test_killed_between_data_and_manifest(spark, tmp_path, monkeypatch):
    clean = rows(shards.run(spark, tasks(spark), 2, simulated, str(tmp_path / "clean"), at_once=3))
    folder, waves, append = str(tmp_path / "run"), [], shards._append

    def killed(*args):
        waves.append(1)
        if len(waves) == 2:
            raise KeyboardInterrupt
        append(*args)

    monkeypatch.setattr(shards, "_append", killed)
    with pytest.raises(KeyboardInterrupt):
        shards.run(spark, tasks(spark), 2, simulated, folder, at_once=3)
    assert shards.committed(spark, folder).count() == 3  # the second wave's rows are there, and count for nothing
    assert spark.read.parquet(f"{folder}/data").select("task_id", "trial").distinct().count() == 6
    assert len(rows(shards.merged(spark, folder))) < len(clean)
    assert rows(shards.run(spark, tasks(spark), 2, simulated, folder, at_once=3)) == clean


def test_shards_that_fail_or_have_no_rows(spark, tmp_path):
    folder = str(tmp_path / "run")

    def work(cells):
        bad = F.when(F.col("task_id") == "1", F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("i"))
        return simulated(cells).withColumn("i", bad).where("task_id != '2'")

    got = shards.run(spark, tasks(spark), 1, work, folder, most_tries=2)
    assert {r[0] for r in rows(got)} == {"0", "3"}
    states = {}
    for r in shards.manifest(spark, folder).orderBy("at").collect():
        states.setdefault(r.task_id, []).append(r.status)
    assert states == {"0": ["failed", "ok"], "1": ["failed", "failed"], "2": ["failed", "empty"], "3": ["failed", "ok"]}
    assert "boom" in shards.manifest(spark, folder).where("task_id = '1'").first().error


def test_shards_that_take_too_long(spark, tmp_path):
    folder = str(tmp_path / "run")

    def slow(cells):
        def wait(batches):
            for batch in batches:
                if "1" in batch.column(0).to_pylist():
                    time.sleep(60)
                yield batch

        return cells.select("task_id", "trial", "seed").mapInArrow(wait, "task_id string, trial int, seed int").select("task_id", "trial", F.lit(0).alias("i"), F.col("seed").alias("value"))

    began = time.time()
    got = shards.run(spark, tasks(spark, 2), 1, slow, folder, timeout=8, most_tries=2)
    assert [r[0] for r in rows(got)] == ["0"] and time.time() - began < 55
    assert sorted(r.status for r in shards.manifest(spark, folder).where("task_id = '1'").collect()) == ["timeout", "timeout"]


# --- routes ----------------------------------------------------------------------------------------------------------


def test_routes_by_brute_force(spark):
    rng = random.Random(4)
    legs = [(f"f{i}", rng.choice("ABCDE"), rng.choice("ABCDE"), rng.choice(["1", "2"]), t := rng.randrange(20), t + rng.randrange(1, 6), rng.choice([None, 1, 2, 3, 5, 8])) for i in range(150)]
    df = spark.createDataFrame(legs, "flight string, origin string, destination string, date string, departs int, arrives int, price long")
    good = [x for x in legs if x[6] is not None and x[1] != x[2]]
    pairs = [(x[1], y[2], x[3], x[0], y[0], x[6] + y[6]) for x in good for y in good if x[3] == y[3] and x[2] == y[1] and y[4] >= x[5] and y[2] != x[1]]
    usable = df.where("price is not null and origin != destination")
    assert sorted(map(tuple, routes.two_legs(usable).collect())) == sorted(pairs)
    wanted = spark.createDataFrame([("A", "B", "1"), ("C", "A", "2"), ("Z", "A", "1")], "origin string, destination string, date string")
    assert sorted(map(tuple, routes.two_legs(usable, wanted).collect())) == sorted(p for p in pairs if p[:3] in {("A", "B", "1"), ("C", "A", "2")})
    best = {}
    for o, d, date, price, n, a, b in [*((x[1], x[2], x[3], x[6], 1, x[0], "") for x in good), *((o, d, date, p, 2, a, b) for o, d, date, a, b, p in pairs)]:
        best[o, d, date] = min(best.get((o, d, date), (price, n, a, b)), (price, n, a, b))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in routes.cheapest(df).collect()} == best
    assert routes.cheapest(df.limit(0)).isEmpty()


def test_chain_of_a_route(spark):
    found = spark.createDataFrame([("A", "B", "1", 7, 2, "x", "y"), ("A", "C", "1", 5, 1, "z", "")], "origin string, destination string, date string, price long, legs int, first string, second string").withColumn("direct", F.when(F.col("legs") == 1, F.col("price")))
    steps = routes.search_chain(found, F.col("direct"))
    last = {r.chain: r.content for r in steps.where("i = 5").collect()}
    assert last == {"A_B_1": "Take x and y for 7.", "A_C_1": "Take z for 5."}
    assert {(r.chain, r.i): r.content for r in steps.where("role = 'tool'").collect()} == {("A_B_1", 2): "[]", ("A_B_1", 4): '[{"first":"x","second":"y","price":7}]', ("A_C_1", 2): '[{"price":5}]', ("A_C_1", 4): "[]"}
    made = recovery.progressive(steps, "chain", "i", ["role", "content", "tool", "arguments"])
    assert sorted((r.chain, len(r.messages), sum(r.loss_mask)) for r in made.collect()) == [(c, n, 1) for c in ("A_B_1", "A_C_1") for n in (2, 4, 6)]
