"""Queries over groups of rollouts: advantages, gates and paired evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.operators import evaluation as ev
from trajmill.operators import groups as g
from trajmill.operators import guards, plugins
from trajmill.plans.registry import query
from trajmill.plans.surrogates import ROLLOUTS, read, rollouts

_TAIL = """CASE WHEN {a} + {b} = 0 THEN 1e0 ELSE least(1e0, 2e0 * (SELECT sum(exp(lgamma({a} + {b} + 1) - lgamma(k + 1) - lgamma({a} + {b} - k + 1) - ({a} + {b}) * ln(2e0))) FROM range(0, least({a}, {b}) + 1) t(k))) END"""
_ARMS = f"WITH {ROLLOUTS}, r AS (SELECT arm, task_id, avg(reward) AS rate FROM rollouts GROUP BY ALL), b AS (SELECT * FROM r WHERE arm = 'base'), c AS (SELECT * FROM r WHERE arm = 'cand')"


def _arms(spark, d):
    rates = ev.task_rates(rollouts(spark, d), F.col("reward"), "arm", "task_id")
    return rates.where("arm = 'base'"), rates.where("arm = 'cand'")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("paired_mcnemar", f"""{_ARMS}, s AS (
  SELECT count(*) AS tasks, avg(b.rate) AS base_rate, avg(c.rate) AS cand_rate, count(*) FILTER (b.rate < 0.5 AND c.rate >= 0.5) AS up, count(*) FILTER (b.rate >= 0.5 AND c.rate < 0.5) AS down
  FROM b JOIN c USING (task_id))
SELECT tasks, round(base_rate, 6) AS base_rate, round(cand_rate, 6) AS cand_rate, up, down, round({_TAIL.format(a='up', b='down')}, 6) AS p_value FROM s""")
def paired_mcnemar(spark, d):
    return _rounded(ev.mcnemar(*_arms(spark, d)), "base_rate", "cand_rate", "p_value")


@query("outer_flips", f"""{_ARMS}, j AS (SELECT coalesce(b.rate, 0e0) AS b, coalesce(c.rate, 0e0) AS c FROM b FULL JOIN c USING (task_id)),
s AS (SELECT count(*) AS tasks, count(*) FILTER (b < 0.5 AND c >= 0.5) AS up, count(*) FILTER (b >= 0.5 AND c < 0.5) AS down FROM j)
SELECT tasks, up, down, round({_TAIL.format(a='up', b='down')}, 6) AS p_value FROM s""")
def outer_flips(spark, d):
    return _rounded(ev.outer_flips(*_arms(spark, d)), "p_value")


@query("sign_test", f"""{_ARMS}, j AS (SELECT c.rate - b.rate AS delta FROM b JOIN c USING (task_id)),
s AS (SELECT count(*) FILTER (delta > 1e-9) AS positive, count(*) FILTER (delta < -1e-9) AS negative FROM j)
SELECT positive, negative, round({_TAIL.format(a='positive', b='negative')}, 6) AS p_value FROM s""")
def sign_test(spark, d):
    return _rounded(ev.sign_test(ev.deltas(*_arms(spark, d))), "p_value")


@query("rate_se", f"""WITH {ROLLOUTS}, t AS (SELECT task_id, avg(reward) AS m, sum(reward) AS s, count(*) AS n FROM rollouts GROUP BY 1)
SELECT round(sum(s) / sum(n), 6) AS micro, round(avg(m), 6) AS macro, round(sqrt(avg(m) * (1 - avg(m)) / count(*)), 6) AS se, count(*) AS tasks FROM t""")
def rate_se(spark, d):
    return _rounded(ev.micro_macro(rollouts(spark, d), F.col("reward")), "micro", "macro", "se")


@query("task_rates", f"WITH {ROLLOUTS} SELECT arm, task_id, round(avg(reward), 6) AS rate, count(*) AS trials FROM rollouts GROUP BY ALL")
def task_rates(spark, d):
    return _rounded(ev.task_rates(rollouts(spark, d), F.col("reward"), "arm", "task_id"), "rate")


@query("pass_hat_k", """WITH t AS (SELECT o_custkey % 297 AS task_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s FROM orders GROUP BY 1),
k AS (SELECT unnest(range(1, (SELECT min(n) FROM t) + 1)) AS k)
SELECT k, round(avg(CASE WHEN s < k THEN 0e0 ELSE exp(lgamma(s + 1) - lgamma(s - k + 1) + lgamma(n - k + 1) - lgamma(n + 1)) END), 6) AS pass_hat_k, count(*) AS tasks FROM t, k GROUP BY k""")
def pass_hat_k(spark, d):
    tasks = rollouts(spark, d).withColumn("task_id", F.col("task_id").cast("bigint") % 297)
    return _rounded(ev.pass_hat_k(tasks, g.success_in_band(F.col("reward"))), "pass_hat_k")


@query("seen_unseen", f"""WITH {ROLLOUTS}, l AS (SELECT task_id, CASE WHEN CAST(task_id AS BIGINT) % 5 < 2 THEN 'seen' WHEN CAST(task_id AS BIGINT) % 5 < 4 THEN 'unseen' ELSE 'unlabeled' END AS label,
  count(*) AS n, count(*) FILTER (reward >= 1 - 1e-6) AS s FROM rollouts GROUP BY ALL)
SELECT coalesce(label, 'overall') AS label, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS trials, CAST(sum(s) AS BIGINT) AS successes, round(avg(s / n), 6) AS pass_1 FROM l GROUP BY ROLLUP (label)""")
def seen_unseen(spark, d):
    rest = F.col("task_id").cast("bigint") % 5
    label = F.when(rest < 2, "seen").when(rest < 4, "unseen").otherwise("unlabeled")
    return _rounded(ev.split_stats(rollouts(spark, d), g.success_at_least(F.col("reward")), label), "pass_1")


@query("passrate", f"WITH {ROLLOUTS} SELECT arm, count(*) FILTER (reward >= 1 - 1e-6) AS passed, count(*) AS total, round(avg(reward), 6) AS mean FROM rollouts GROUP BY 1")
def passrate(spark, d):
    return rollouts(spark, d).groupBy("arm").agg(F.count_if(g.success_at_least(F.col("reward"))).alias("passed"), F.count("*").alias("total"), F.round(F.avg("reward"), 6).alias("mean"))


@query("bootstrap_lcg", f"""{_ARMS.replace("WITH ", "WITH RECURSIVE ", 1)}, x AS (SELECT row_number() OVER (ORDER BY b.task_id) - 1 AS i, c.rate - b.rate AS delta FROM b JOIN c USING (task_id)), m AS (SELECT count(*) AS m FROM x),
p AS (SELECT CAST(1 AS BIGINT) AS k, CAST({ev.LCG_A} AS BIGINT) AS a, CAST({ev.LCG_C} AS BIGINT) AS c UNION ALL SELECT k + 1, (a * {ev.LCG_A}) % 2147483648, (c * {ev.LCG_A} + {ev.LCG_C}) % 2147483648 FROM p, m WHERE k < m),
l AS (SELECT a AS am, c AS cm FROM p, m WHERE k = m),
st AS (SELECT CAST(1 AS BIGINT) AS b, CAST({ev.LCG_SEED} AS BIGINT) AS s UNION ALL SELECT b + 1, (am * s + cm) % 2147483648 FROM st, l WHERE b < 500),
dr AS MATERIALIZED (SELECT st.b, ((p.a * st.s + p.c) % 2147483648) % m.m AS i FROM st, p, m),
w AS (SELECT b, avg(delta) AS mean FROM dr JOIN x USING (i) GROUP BY b), o AS (SELECT list_sort(list(mean)) AS s FROM w)
SELECT 'cand' AS arm, m AS n, round(s[13], 6) AS low, round(s[488], 6) AS high FROM o, m""")
def bootstrap_lcg(spark, d):
    df = ev.deltas(*_arms(spark, d)).withColumn("arm", F.lit("cand"))
    return _rounded(ev.bootstrap_interval(df, "arm", "task_id", "delta", 500), "low", "high")


@query("bootstrap_mt")
def bootstrap_mt(spark, d):
    df = ev.deltas(*_arms(spark, d)).withColumn("arm", F.lit("cand"))
    return ev.bootstrap_interval(df, "arm", "task_id", "delta", 200, "mt")


_LIVE = "count(*) OVER w >= 2 AND min(reward) OVER w < max(reward) OVER w"


@query("adv_population_gated", f"""WITH {ROLLOUTS} SELECT ordinal, round(CASE WHEN {_LIVE} THEN greatest(-3e0, least(3e0, (shaped - avg(shaped) OVER w) / (stddev_pop(shaped) OVER w + 0.25))) ELSE 0e0 END, 6) AS advantage
FROM rollouts WINDOW w AS (PARTITION BY task_id)""")
def adv_population_gated(spark, d):
    return g.population_advantage(rollouts(spark, d), "task_id", "shaped", "reward").select("ordinal", F.round("advantage", 6).alias("advantage"))


@query("adv_continuous", f"""WITH {ROLLOUTS} SELECT ordinal, round(CASE WHEN count(*) OVER w >= 2 AND min(shaped) OVER w < max(shaped) OVER w THEN greatest(-3e0, least(3e0, (shaped - avg(shaped) OVER w) / (stddev_pop(shaped) OVER w + 0.25))) ELSE 0e0 END, 6) AS advantage
FROM rollouts WINDOW w AS (PARTITION BY task_id)""")
def adv_continuous(spark, d):
    return g.population_advantage(rollouts(spark, d), "task_id", "shaped", "shaped").select("ordinal", F.round("advantage", 6).alias("advantage"))


@query("adv_sample_standard", f"""WITH {ROLLOUTS} SELECT ordinal, round(CASE WHEN count(*) OVER w = 1 THEN reward / (1 + 1e-6) ELSE (reward - avg(reward) OVER w) / (CASE WHEN min(reward) OVER w = max(reward) OVER w THEN 0e0 ELSE stddev_samp(reward) OVER w END + 1e-6) END, 6) AS advantage
FROM rollouts WINDOW w AS (PARTITION BY task_id)""")
def adv_sample_standard(spark, d):
    return g.sample_advantage(rollouts(spark, d), "task_id", "reward").select("ordinal", F.round("advantage", 6).alias("advantage"))


@query("adv_sample_gated", f"""WITH {ROLLOUTS} SELECT ordinal, {_LIVE} AS keep, round(CASE WHEN {_LIVE} THEN (shaped - avg(shaped) OVER w) / (stddev_samp(shaped) OVER w + 1e-6) ELSE 0e0 END, 6) AS advantage
FROM rollouts WINDOW w AS (PARTITION BY task_id)""")
def adv_sample_gated(spark, d):
    return g.gated_advantage(rollouts(spark, d), "task_id", "shaped", "reward").select("ordinal", "keep", F.round("advantage", 6).alias("advantage"))


_ADV = f"a AS (SELECT ordinal, CASE WHEN {_LIVE} THEN greatest(-3e0, least(3e0, (shaped - avg(shaped) OVER w) / (stddev_pop(shaped) OVER w + 0.25))) ELSE 0e0 END AS advantage FROM rollouts WINDOW w AS (PARTITION BY task_id))"


@query("zero_signal_drop", f"WITH {ROLLOUTS}, {_ADV} SELECT ordinal, round(advantage, 6) AS advantage FROM a WHERE abs(advantage) >= 1e-8")
def zero_signal_drop(spark, d):
    return g.without_signal(g.population_advantage(rollouts(spark, d), "task_id", "shaped", "reward")).select("ordinal", F.round("advantage", 6).alias("advantage"))


@query("batch_summary", f"WITH {ROLLOUTS}, {_ADV} SELECT count(*) AS usable, round(avg(abs(advantage)), 6) AS mean_abs_advantage, count(*) FILTER (advantage > 0) AS positive, count(*) FILTER (advantage < 0) AS negative FROM a WHERE abs(advantage) >= 1e-8")
def batch_summary(spark, d):
    return _rounded(g.batch_summary(g.without_signal(g.population_advantage(rollouts(spark, d), "task_id", "shaped", "reward"))), "mean_abs_advantage")


_STATES = "s AS (SELECT task_id, count(*) AS n, count(DISTINCT shaped) <= 1 AS dead_raw, count(DISTINCT reward >= 1 - 1e-6) <= 1 AS dead_binary, count(*) < 2 OR count(DISTINCT round(reward, 6)) < 2 AS dead_outcome, count(*) < 2 OR coalesce(stddev_pop(shaped), 0) <= 1e-8 AS dead_std FROM rollouts GROUP BY 1)"


@query("group_state", f"WITH {ROLLOUTS}, {_STATES} SELECT * FROM s")
def group_state(spark, d):
    return g.group_state(rollouts(spark, d), "task_id", "reward", "shaped")


@query("dead_group_stats", f"""WITH {ROLLOUTS}, {_STATES} SELECT CAST(sum(n) FILTER (NOT dead_outcome) AS BIGINT) AS kept_rows, CAST(sum(n) FILTER (dead_outcome) AS BIGINT) AS dropped_rows, count(*) FILTER (NOT dead_outcome) AS kept_groups, count(*) FILTER (dead_outcome) AS dropped_groups,
round(sum(n) FILTER (NOT dead_outcome) / sum(n), 4) AS live_frac, round(sum(n) / sum(n) FILTER (NOT dead_outcome), 4) AS loss_scale FROM s""")
def dead_group_stats(spark, d):
    return g.group_stats(g.group_state(rollouts(spark, d), "task_id", "reward", "shaped"), "dead_outcome")


@query("dead_weight_fraction", f"WITH {ROLLOUTS}, {_STATES} SELECT round(sum(CASE WHEN dead_outcome THEN n ELSE 0 END) / sum(n), 6) AS dead_weight FROM s")
def dead_weight_fraction(spark, d):
    return _rounded(g.dead_weight(rollouts(spark, d), "task_id", "reward"), "dead_weight")


@query("mask_dead_rows", f"WITH {ROLLOUTS} SELECT ordinal, CASE WHEN {_LIVE} THEN 3 ELSE 0 END AS mask_sum FROM rollouts WINDOW w AS (PARTITION BY task_id)")
def mask_dead_rows(spark, d):
    df = rollouts(spark, d).withColumn("mask", F.array(F.lit(1), F.lit(1), F.lit(1)))
    return g.mask_dead(df, "task_id", "reward", "mask").select("ordinal", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("accumulate_live_groups", f"""WITH {ROLLOUTS}, b AS (SELECT *, ordinal // 1000 AS batch FROM rollouts),
gr AS (SELECT batch, task_id, min(ordinal) AS f, count(*) >= 2 AND min(reward) < max(reward) AS live FROM b GROUP BY ALL),
t AS (SELECT batch, task_id FROM gr WHERE live ORDER BY batch, f LIMIT 100)
SELECT b.batch, b.task_id, b.ordinal FROM b JOIN t ON b.batch = t.batch AND b.task_id = t.task_id""")
def accumulate_live_groups(spark, d):
    df = rollouts(spark, d).withColumn("batch", F.expr("ordinal div 1000"))
    return g.accumulate_live(df, "batch", "task_id", "ordinal", "reward", 100).select("batch", "task_id", "ordinal")


def _gated(values, outcomes):  # noqa: ANN001, ANN202
    """A user's estimator: the deviation from the mean in sample deviations, where outcomes differ."""
    import numpy as np

    x, o = values.to_numpy(zero_copy_only=False), outcomes.to_numpy(zero_copy_only=False)
    if len(x) < 2 or o.min() == o.max():
        return np.zeros(len(x))
    return (x - x.mean()) / (x.std(ddof=1) + 1e-6)


@query("registered_estimator", f"""WITH {ROLLOUTS} SELECT ordinal, round(CASE WHEN {_LIVE} THEN (shaped - avg(shaped) OVER w) / (stddev_samp(shaped) OVER w + 1e-6) ELSE 0e0 END, 6) AS advantage,
round(CASE WHEN {_LIVE} THEN greatest(-3e0, least(3e0, (shaped - avg(shaped) OVER w) / (stddev_pop(shaped) OVER w + 0.25))) ELSE 0e0 END, 6) AS population FROM rollouts WINDOW w AS (PARTITION BY task_id)""")
def registered_estimator(spark, d):
    """A user's estimator over Arrow arrays, then a built-in one, both by name."""
    if "users_gated" not in plugins.ESTIMATORS:
        plugins.register_estimator("users_gated", arrow=_gated)
    df = plugins.advantages(rollouts(spark, d), "users_gated", "task_id", "shaped", "reward").withColumnRenamed("advantage", "own")
    df = plugins.advantages(df, "population_gated", "task_id", "shaped", "reward")
    return df.select("ordinal", F.round("own", 6).alias("advantage"), F.round("advantage", 6).alias("population"))


@query("gated_mean", f"""WITH {ROLLOUTS}, l AS (SELECT *, {_LIVE} AS live FROM rollouts WINDOW w AS (PARTITION BY task_id))
SELECT arm, count(*) AS n, round(avg(shaped), 6) AS mean FROM l WHERE live GROUP BY arm""")
def gated_mean(spark, d):
    """The filter that goes before an aggregate and refuses rows without an outcome."""
    live = guards.live_rows_only(rollouts(spark, d), "task_id", "reward")
    return live.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("shaped"), 6).alias("mean"))


def _letters(texts, golds):  # noqa: ANN001, ANN202
    """A user's reward: the share of the gold's letter in a text."""
    import pyarrow.compute as pc

    n = pc.utf8_length(texts)
    found = pc.subtract(n, pc.utf8_length(pc.replace_substring(texts, "e", "")))
    return pc.if_else(pc.equal(n, 0), 0.0, pc.divide(pc.cast(found, "float64"), pc.cast(n, "float64")))


@query("registered_reward", """SELECT doc_id, round(CASE doc_id % 4 WHEN 0 THEN 1e0 WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 1e0 ELSE 0e0 END WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 1e0 ELSE 0e0 END
ELSE CASE WHEN length(coalesce(text, '')) = 0 THEN 0e0 ELSE (length(text) - length(replace(text, 'e', ''))) / length(text) END END, 6) AS reward FROM documents""")
def registered_reward(spark, d):
    """Each document's reward by the one that its row names: two of the library's over answers, and a user's over Arrow arrays."""
    if "users_letter" not in plugins.REWARDS:
        plugins.register_reward("users_letter", arrow=_letters)
    n, i = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    right = F.when(F.col("doc_id") % 3 == 0, n).otherwise(F.concat(n, F.lit("1")))
    said = F.when(i == 0, F.concat(F.lit("<answer> The "), n, F.lit(" of them!</answer>"))).when(i == 1, F.concat(F.lit("the total is "), right)).when(i == 2, F.concat(F.lit("so #### "), right)).otherwise(F.coalesce("text", F.lit("")))
    gold = F.when(i == 0, F.concat(n, F.lit(" of them"))).otherwise(n)
    named = F.element_at(F.array(*map(F.lit, ("exact_match", "number", "marked_number", "users_letter"))), (i + 1).cast("int"))
    docs = read(spark, d, "documents").select("doc_id", named.alias("by"), said.alias("said"), gold.alias("gold"))
    return plugins.scored(docs, "by", "said", "gold", ["exact_match", "number", "marked_number", "users_letter"]).select("doc_id", F.round("reward", 6).alias("reward"))
