"""Plugins by name, and guards that are part of the plan."""

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trajmill.operators import groups, guards, plugins

ROWS = [("a", 1.0, 1.2), ("a", 0.0, 0.1), ("b", 0.0, 0.5), ("b", 0.0, 0.7), ("c", 1.0, 1.0)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "g string, o double, v double")


def named(register, name, **form):
    known = plugins.REWARDS if register is plugins.register_reward else plugins.ESTIMATORS
    known.pop(name, None)
    register(name, **form)
    return name


def test_estimators(df):
    for name, want in (("gated", groups.gated_advantage(df, "g", "v", "o")), ("standard", groups.sample_advantage(df, "g", "v"))):
        got = plugins.advantages(df, name, "g", "v", "o")
        assert sorted((r.g, r.v, r.advantage) for r in got.collect()) == sorted((r.g, r.v, r.advantage) for r in want.collect())
    mine = named(plugins.register_estimator, "mine", arrow=lambda v, o: pa.array([x.as_py() * 2 for x in v]))
    got = plugins.advantages(df.withColumn("more", F.lit(None).cast("string")), mine, "g", "v", "o")
    assert got.columns == ["g", "o", "v", "more", "advantage"] and sorted(r.advantage for r in got.collect()) == [0.2, 1.0, 1.4, 2.0, 2.4]


def test_estimators_that_break_their_contract(spark, df):
    with pytest.raises(ValueError, match="unknown name zz"):
        plugins.advantages(df, "zz", "g", "v", "o")
    with pytest.raises(ValueError, match="registered already"):
        plugins.register_estimator("gated", arrow=lambda v, o: v)
    with pytest.raises(ValueError, match="one of its two forms"):
        plugins.register_estimator("none")
    few = named(plugins.register_estimator, "few", arrow=lambda v, o: v[:1])
    with pytest.raises(PySparkException, match="1 numbers for 2 rows"):
        plugins.advantages(df, few, "g", "v", "o").collect()
    holes = named(plugins.register_estimator, "holes", arrow=lambda v, o: pa.nulls(len(v), pa.float64()))
    with pytest.raises(PySparkException, match="no number"):
        plugins.advantages(df, holes, "g", "v", "o").collect()
    with pytest.raises(PySparkException, match="without a value"):
        plugins.advantages(df.withColumn("v", F.lit(None).cast("double")), "gated", "g", "v", "o").collect()


def test_rewards(spark):
    own = named(plugins.register_reward, "length", arrow=lambda t, g: pa.array([float(len(x.as_py() or "")) for x in t]))
    rows = [("exact_match", "<answer>The Cat!</answer>", "cat", 1.0), ("token_f1", "<answer>red cat</answer>", "cat", 2 / 3), ("number", "it is 12", "12.0", 1.0), ("marked_number", "it is 12", "12", 0.0), ("marked_number", "#### 12", "12", 1.0), ("length", "abc", None, 3.0), ("length", None, "x", 0.0), ("number", None, "1", 0.0)]
    table = spark.createDataFrame(rows, "by string, t string, g string, want double")
    got = plugins.scored(table, "by", "t", "g", ["exact_match", "token_f1", "number", "marked_number", own]).collect()
    assert len(got) == len(rows) and all(r.reward == pytest.approx(r.want) for r in got)
    with pytest.raises(PySparkException, match="no such reward: (number|token_f1|marked_number)"):
        plugins.scored(table, "by", "t", "g", ["exact_match", own]).collect()
    with pytest.raises(PySparkException, match="no such reward: null"):
        plugins.scored(table.withColumn("by", F.lit(None).cast("string")), "by", "t", "g", [own]).collect()


def test_missing_outcomes_fail_the_action(spark, df):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    for bad in ((None, 1.0, 1.0), ("a", None, 1.0), ("a", float("nan"), 1.0)):
        table = df.union(spark.createDataFrame([bad], df.schema))
        before = jobs()
        guarded = guards.live_rows_only(table, "g", "o").groupBy("g").count()
        assert jobs() == before  # nothing has run
        with pytest.raises(Exception, match="without group or outcome"):
            guarded.collect()
    with pytest.raises(ValueError, match="no column o"):
        guards.live_rows_only(df.drop("o"), "g", "o")
    with pytest.raises(ValueError, match="no column mask"):
        guards.live_rows_only(df, "g", "o", ready="mask")


def test_live_rows(spark, df):
    assert sorted(r.v for r in guards.live_rows_only(df, "g", "o").collect()) == [0.1, 1.2]
    assert guards.live_rows_only(df.limit(0), "g", "o").isEmpty()
    with pytest.raises(PySparkException, match="no group has contrast"):
        guards.live_rows_only(df.where("g != 'a'"), "g", "o").collect()
    with pytest.raises(Exception, match="not ready"):
        guards.live_rows_only(df.withColumn("ready", F.col("g") != "b"), "g", "o", "ready").count()


def test_unique_and_all(spark, df):
    assert guards.require_unique(df, "v").count() == 5
    with pytest.raises(PySparkException, match="repeated id: [ab]"):
        guards.require_unique(df, "g").count()
    assert guards.require_unique(df, "g", F.col("o") == 1).count() == 5
    ids = spark.createDataFrame([("a",), ("b",), ("a",)], "g string")
    assert guards.require_all(ids, df, "g", "missing").count() == 4
    with pytest.raises(PySparkException, match="missing: q"):
        guards.require_all(ids.union(spark.createDataFrame([("q",)], "g string")), df, "g", "missing").count()
