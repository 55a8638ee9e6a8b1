"""Trajectory tables made of the star schema, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rollouts: a customer's orders are a task's trials, and a filled order is a success."""
    o = read(spark, d, "orders")
    trial = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    reward = (F.col("o_orderstatus") == "F").cast("double")
    cand = ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    shaped = reward + 0.3 * (F.col("o_totalprice") / 1000000.0)
    return o.select(F.col("o_custkey").cast("string").alias("task_id"), trial.cast("bigint").alias("trial"), F.col("o_orderkey").alias("ordinal"), reward.alias("reward"), shaped.alias("shaped"), F.when(cand, "cand").otherwise("base").alias("arm"), F.col("o_totalprice").alias("price"))


ROLLOUTS = """rollouts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial, o_orderkey AS ordinal,
    CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS reward,
    CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END + 3e-1 * (o_totalprice / 1e6) AS shaped,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'base' ELSE 'cand' END AS arm, o_totalprice AS price
  FROM orders)"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as a trajectory's steps, by user and time."""
    e = read(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("traj"), idx.cast("bigint").alias("idx"), F.col("event_type").alias("tool"), F.col("props").alias("args"), (F.col("event_type") == "error").alias("is_error"), F.col("value"))


STEPS = """steps AS (
  SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS tool, props AS args, event_type = 'error' AS is_error, value
  FROM events)"""


def component_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as an order's score components, a row each."""
    name = F.concat("l_returnflag", "l_linestatus")
    value = F.round((F.col("l_discount") - F.col("l_tax")) * 100, 0)
    tags = F.array(F.concat(F.lit("flag_"), F.col("l_returnflag")), F.concat(F.lit("status_"), F.col("l_linestatus")))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("traj"), F.col("l_linenumber").cast("bigint").alias("n"), name.alias("name"), value.alias("value"), tags.alias("tags"))


def components(spark: SparkSession, d: str) -> DataFrame:
    """component_rows() as an array a trajectory."""
    return component_rows(spark, d).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("n", "name", "value", "tags"))).alias("components"))


COMPONENTS = """comps AS (
  SELECT l_orderkey AS traj, l_linenumber AS n, l_returnflag || l_linestatus AS name, round((l_discount - l_tax) * 100, 0) AS value,
    l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def agent_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps with JSON arguments and results: what is looked for and found are items, one in ten is not named, and an
    assistant says up to 49 characters with a step."""
    e = read(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.get_json_object("props", "$.k").cast("int")
    args = F.when(k % 10 == 0, F.lit('{"item":"unknown"}')).otherwise(F.concat(F.lit('{"item":"item_'), k.cast("string"), F.lit('"}')))
    found = F.concat(F.lit('{"item":"item_'), (k * 7 % 100).cast("string"), F.lit('","total":'), k.cast("string"), F.lit("}"))
    error = F.col("event_type") == "error"
    reply = F.when(error, F.concat(F.lit("Error: item "), k.cast("string"), F.lit(" not found"))).otherwise(found)
    return e.select(F.col("user_id").alias("traj"), idx.cast("bigint").alias("idx"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id"), F.col("event_type").alias("tool"), args.alias("args"), F.repeat(F.lit("x"), k % 50).alias("content"), reply.alias("reply"), error.alias("is_error"), k.alias("k"), F.col("value"))


AGENT_STEPS = """agent_steps AS (
  SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 'c' || event_id AS call_id, event_type AS tool,
    CASE WHEN k % 10 = 0 THEN '{"item":"unknown"}' ELSE '{"item":"item_' || k || '"}' END AS args, repeat('x', k % 50) AS content,
    CASE WHEN event_type = 'error' THEN 'Error: item ' || k || ' not found' ELSE '{"item":"item_' || (k * 7 % 100) || '","total":' || k || '}' END AS reply,
    event_type = 'error' AS is_error, k, value, k * 7 % 100 AS found
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def agent_conversations(spark: SparkSession, d: str) -> DataFrame:
    """agent_steps() as a row a trajectory with canonical messages: a user's wish, then a call and its reply for each step."""
    s = agent_steps(spark, d)
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    message = lambda role, content, name="", reply="", calls=none: F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(name) if isinstance(name, str) else name).alias("name"), (F.lit(reply) if isinstance(reply, str) else reply).alias("tool_call_id"), calls.alias("calls"))
    call = F.array(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("args").alias("arguments")))
    pair = F.array(message("assistant", F.col("content"), calls=call), message("tool", F.col("reply"), F.col("tool"), F.col("call_id")))
    rows = s.groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("idx", pair.alias("pair")))).alias("rows"))
    wish = F.concat(F.lit("help "), F.col("traj").cast("string"))
    return rows.select("traj", F.concat(F.array(message("user", wish)), F.flatten(F.transform("rows", lambda r: r["pair"]))).alias("messages"))


def simulations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as simulations with what their checks found."""
    o = read(spark, d, "orders")
    reward = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise((F.col("o_orderstatus") == "F").cast("double"))
    db = F.when(F.col("o_custkey") % 5 == 0, None).otherwise(F.col("o_orderstatus") != "O")
    communicate = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise((F.col("o_totalprice") > 100000).cast("double"))
    trial = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").cast("string").alias("task_id"), trial.cast("bigint").alias("trial"), F.col("o_orderstatus").alias("termination_reason"), reward.alias("reward"), db.alias("db_match"),
        communicate.alias("communicate"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "base").otherwise("cand").alias("run"), (F.col("o_totalprice") / 100000).alias("process_score"),
    )


SIMULATIONS = """sims AS (
  SELECT o_orderkey AS ordinal, CAST(o_custkey AS VARCHAR) AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS trial, o_orderstatus AS termination_reason,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS reward, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderstatus <> 'O' END AS db_match,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_totalprice > 100000 THEN 1e0 ELSE 0e0 END AS communicate,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'base' ELSE 'cand' END AS run, o_totalprice / 1e5 AS process_score
  FROM orders)"""
