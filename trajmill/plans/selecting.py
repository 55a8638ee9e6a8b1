"""Queries that choose, count and compare rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.operators import components as co
from trajmill.operators import datasets as ds
from trajmill.operators import groups as g
from trajmill.operators import recovery, routes
from trajmill.operators import selection as sel
from trajmill.plans.registry import query
from trajmill.plans.surrogates import COMPONENTS, ROLLOUTS, component_rows, components, read, rollouts


@query("dedupe_cap", f"""WITH {ROLLOUTS}, s AS (SELECT *, row_number() OVER (PARTITION BY task_id, CAST(floor(price / 10000) AS BIGINT) ORDER BY ordinal) AS n FROM rollouts WHERE reward >= 1 - 1e-6),
t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ordinal) AS k FROM s WHERE n = 1)
SELECT task_id, ordinal FROM t WHERE k <= 3""")
def dedupe_cap(spark, d):
    df = rollouts(spark, d).where(g.success_at_least(F.col("reward"))).withColumn("sig", F.floor(F.col("price") / 10000))
    return sel.first_wins_capped(df, ["task_id", "sig"], ["task_id"], ["ordinal"], 3).select("task_id", "ordinal")


@query("shard_merge_first_wins", f"WITH {ROLLOUTS} SELECT ordinal, row_number() OVER (PARTITION BY task_id, trial % 4 ORDER BY ordinal) > 1 AS duplicate FROM rollouts")
def shard_merge_first_wins(spark, d):
    return sel.split_duplicates(rollouts(spark, d).withColumn("slot", F.col("trial") % 4), ["task_id", "slot"], ["ordinal"]).select("ordinal", "duplicate")


@query("preference_dedupe", f"""WITH {ROLLOUTS}, s AS (SELECT *, trial // 2 AS point, min(ordinal) OVER (PARTITION BY task_id, trial // 2) AS slot FROM rollouts),
t AS (SELECT *, row_number() OVER (PARTITION BY task_id, point ORDER BY CASE WHEN arm = 'base' THEN 1 ELSE 0 END, ordinal) AS n FROM s) SELECT ordinal, slot FROM t WHERE n = 1""")
def preference_dedupe(spark, d):
    df = rollouts(spark, d).withColumn("point", F.expr("trial div 2"))
    return sel.preferred_in_place(df, ["task_id", "point"], F.col("arm") == "base", "ordinal").select("ordinal", "slot")


@query("id_suffixing", f"WITH {ROLLOUTS}, s AS (SELECT ordinal, task_id, row_number() OVER (PARTITION BY task_id ORDER BY ordinal) - 1 AS n FROM rollouts) SELECT ordinal, CASE WHEN n = 0 THEN task_id ELSE task_id || '_dup' || n END AS unique_id FROM s")
def id_suffixing(spark, d):
    return sel.unique_ids(rollouts(spark, d), "task_id", ["ordinal"]).select("ordinal", "unique_id")


_BEST = "row_number() OVER (PARTITION BY task_id ORDER BY round(shaped, 1) DESC, reward DESC, trial % 3, trial NULLS LAST, ordinal)"


def _candidates(spark, d):
    return rollouts(spark, d).withColumn("score", F.round("shaped", 1)).withColumn("n_tags", F.col("trial") % 3)


@query("best_of_n", f"WITH {ROLLOUTS} SELECT task_id, ordinal FROM (SELECT *, {_BEST} AS n FROM rollouts) WHERE n = 1")
def best_of_n(spark, d):
    return sel.best_of(_candidates(spark, d), "task_id", "score", "reward", "n_tags", "trial", "ordinal").select("task_id", "ordinal")


@query("first_trial", f"WITH {ROLLOUTS} SELECT task_id, min(ordinal) AS ordinal FROM rollouts GROUP BY 1")
def first_trial(spark, d):
    return sel.first_trial(rollouts(spark, d), "task_id", "trial", "ordinal").select("task_id", "ordinal")


@query("rerank_summary", f"""WITH {ROLLOUTS}, r AS (SELECT *, reward >= 1 - 1e-6 AS ok, {_BEST} AS b FROM rollouts),
t AS (SELECT task_id, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS sample, max(CASE WHEN ok THEN 1 ELSE 0 END) AS oracle, max(CASE WHEN ok AND trial = 0 THEN 1 ELSE 0 END) AS first, max(CASE WHEN ok AND b = 1 THEN 1 ELSE 0 END) AS chosen FROM r GROUP BY 1)
SELECT count(*) AS tasks, round(avg(first), 6) AS first_rate, round(avg(sample), 6) AS sample_rate, round(avg(oracle), 6) AS oracle_rate, round(avg(chosen), 6) AS chosen_rate, round(avg(chosen) - avg(first), 6) AS gain,
  round(avg(oracle) - avg(chosen), 6) AS gap, round(sum(chosen * oracle) / sum(oracle), 6) AS solvable_accuracy FROM t""")
def rerank_summary(spark, d):
    df = sel.rerank_summary(_candidates(spark, d), "task_id", g.success_at_least(F.col("reward")), "score", "reward", "n_tags", "trial", "ordinal")
    return df.select("tasks", *[F.round(c, 6).alias(c) for c in df.columns if c != "tasks"])


@query("pref_pairs", f"""WITH {ROLLOUTS}, s AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY shaped DESC, ordinal) AS n FROM rollouts WHERE reward >= 1 - 1e-6),
f AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY shaped, ordinal) AS n FROM rollouts WHERE NOT reward >= 1 - 1e-6)
SELECT s.task_id, s.ordinal AS chosen_ordinal, f.ordinal AS rejected_ordinal FROM s JOIN f USING (task_id) WHERE s.n = 1 AND f.n <= 2""")
def pref_pairs(spark, d):
    df = rollouts(spark, d).select("task_id", "ordinal", "shaped", "reward")
    pairs = sel.preference_pairs(df, "task_id", g.success_at_least(F.col("reward")), [F.desc("shaped"), "ordinal"], ["shaped", "ordinal"], 2)
    return pairs.select("task_id", "chosen_ordinal", "rejected_ordinal")


@query("stable_hash_sample", f"""WITH {ROLLOUTS}, s AS (SELECT arm, ordinal, row_number() OVER (PARTITION BY arm ORDER BY substr(sha1('11:' || ordinal), 1, 16), ordinal) AS n, floor(count(*) OVER (PARTITION BY arm) * 0.5 + 0.5) AS k FROM rollouts)
SELECT arm, ordinal FROM s WHERE n <= k""")
def stable_hash_sample(spark, d):
    return sel.stable_sample(rollouts(spark, d), "ordinal", 0.5, 11, ["arm"]).select("arm", "ordinal")


@query("greedy_split", """WITH t AS (SELECT source, max(n_chars) AS most, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT source, coalesce(sum(n) OVER (ORDER BY most DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT greatest(4, round_even(sum(n) * 0.2e0, 0)) FROM t) AS want FROM t)
SELECT source FROM c WHERE before < want""")
def greedy_split(spark, d):
    return sel.greedy_tasks(read(spark, d, "documents"), "source", "n_chars", 0.2, 4)


@query("oversample", "SELECT CASE WHEN i = 0 THEN CAST(item_id AS VARCHAR) ELSE item_id || '_repeat' || i END AS copy_id FROM benchmark, range(0, 3) t(i)")
def oversample(spark, d):
    return sel.copies(read(spark, d, "benchmark"), "item_id", 3).select("copy_id")


@query("length_batches", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents")
def length_batches(spark, d):
    return sel.length_batches(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", "doc_id", 8, ["source"]).select("doc_id", "batch")


@query("nearest_rank_percentile", """WITH l AS (SELECT source, list_sort(list(n_chars)) AS s, count(*) AS n, avg(n_chars) AS mean, max(n_chars) AS max FROM documents GROUP BY 1)
SELECT source, n, round(mean, 6) AS mean, max, s[CAST(round_even((n - 1) * 0.5e0, 0) AS BIGINT) + 1] AS p50, s[CAST(round_even((n - 1) * 0.9e0, 0) AS BIGINT) + 1] AS p90 FROM l""")
def nearest_rank_percentile(spark, d):
    return ds.profile(read(spark, d, "documents"), "source", "n_chars").withColumn("mean", F.round("mean", 6))


_ARM_TASKS = f"WITH {ROLLOUTS}, b AS (SELECT DISTINCT task_id FROM rollouts WHERE arm = 'base'), c AS (SELECT DISTINCT task_id FROM rollouts WHERE arm = 'cand')"


@query("task_set_ops", f"""{_ARM_TASKS} SELECT 'both' AS kind, task_id FROM (SELECT * FROM b INTERSECT SELECT * FROM c) UNION ALL SELECT 'any', task_id FROM (SELECT * FROM b UNION SELECT * FROM c) UNION ALL SELECT 'base_only', task_id FROM (SELECT * FROM b EXCEPT SELECT * FROM c)""")
def task_set_ops(spark, d):
    r = rollouts(spark, d)
    b, c = (r.where(F.col("arm") == a).select("task_id").distinct() for a in ("base", "cand"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "task_id")
    return named("both", b.intersect(c)).unionAll(named("any", b.union(c).distinct())).unionAll(named("base_only", b.subtract(c)))


@query("component_scores", f"""WITH {COMPONENTS}, s AS (SELECT traj, sum(value) AS score, sum(abs(value)) AS size, count(DISTINCT CASE WHEN value < 0 THEN flag END) + count(DISTINCT CASE WHEN value < 0 THEN status END) AS n_tags FROM comps GROUP BY 1)
SELECT traj, round(score, 6) AS score, round(CASE WHEN size > 0 THEN score / size ELSE 0e0 END, 6) AS normalized, n_tags FROM s""")
def component_scores(spark, d):
    df = co.scored_rows(component_rows(spark, d), "traj")
    return df.select("traj", F.round("score", 6).alias("score"), F.round("normalized", 6).alias("normalized"), F.size("risk_tags").cast("bigint").alias("n_tags"))


SPECS = [
    co.Ablation("full"), co.Ablation("zero_score", zero=True), co.Ablation("positive_only", include=co.ComponentFilter(positive=True)),
    co.Ablation("no_flag_r", exclude=co.ComponentFilter(tags=("flag_R",))), co.Ablation("no_ao", exclude=co.ComponentFilter(names=("AF", "NO"))),
]


@query("ablation_grid", f"""WITH {COMPONENTS}, t AS (SELECT DISTINCT traj FROM comps), sp AS (SELECT unnest(['full', 'zero_score', 'positive_only', 'no_flag_r', 'no_ao']) AS spec),
k AS (SELECT * FROM comps, sp WHERE spec = 'full' OR (spec = 'positive_only' AND value > 0) OR (spec = 'no_flag_r' AND flag <> 'R') OR (spec = 'no_ao' AND name NOT IN ('AF', 'NO'))),
s AS (SELECT traj, spec, sum(value) AS v, sum(abs(value)) AS a FROM k GROUP BY ALL)
SELECT sp.spec, count(*) AS trajectories, round(sum(coalesce(v, 0)), 4) AS score, round(sum(CASE WHEN a > 0 THEN v / a ELSE 0 END), 4) AS normalized FROM t CROSS JOIN sp LEFT JOIN s ON s.traj = t.traj AND s.spec = sp.spec GROUP BY 1""")
def ablation_grid(spark, d):
    return co.ablated_rows(component_rows(spark, d), SPECS, "traj").groupBy("spec").agg(F.count("*").alias("trajectories"), F.round(F.sum("score"), 4).alias("score"), F.round(F.sum("normalized"), 4).alias("normalized"))


@query("confusion_matrix", "WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT quality, toxic, n, round(coalesce(sum(CASE WHEN quality = toxic THEN n END) OVER (PARTITION BY quality), 0) / sum(n) OVER (PARTITION BY quality), 6) AS recall FROM c")
def confusion_matrix(spark, d):
    return ds.confusion(read(spark, d, "labels"), "quality", "toxic").withColumn("recall", F.round("recall", 6))


@query("behavior_rates", "SELECT round(coalesce(count(*) FILTER (toxic = 0 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 0), 6) AS clean_rate, round(coalesce(count(*) FILTER (toxic = 1 AND quality = 7) / nullif(count(*) FILTER (quality = 7), 0), 0), 6) AS empty_rate FROM labels")
def behavior_rates(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return read(spark, d, "labels").agg(F.round(ds.guarded_rate(t == 0, q == 1), 6).alias("clean_rate"), F.round(ds.guarded_rate(t == 1, q == 7), 6).alias("empty_rate"))


@query("length_aware_loss", "SELECT l_orderkey AS traj, round(coalesce(sum(l_discount * m) / nullif(sqrt(sum(m)), 0), 0), 6) AS loss, CAST(sum(m) AS BIGINT) AS tokens FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END AS m FROM lineitem) GROUP BY 1")
def length_aware_loss(spark, d):
    df = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("traj"), (-F.col("l_discount")).alias("logp"), (F.col("l_linestatus") == "F").cast("double").alias("m"))
    return ds.masked_loss(df, "traj", "logp", "m", True).withColumn("loss", F.round("loss", 6))


@query("token_weighted_loss", "SELECT round(sum(l_discount) / sum(l_quantity), 9) AS loss, round(avg(l_discount / l_quantity), 9) AS mean_loss, round(exp(least(sum(l_discount) / sum(l_quantity), 20)), 9) AS perplexity FROM lineitem")
def token_weighted_loss(spark, d):
    df = ds.token_weighted(read(spark, d, "lineitem"), "l_discount", "l_quantity")
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


@query("missing_grid_antijoin", f"WITH {ROLLOUTS} SELECT t.task_id, CAST(i AS INTEGER) AS trial FROM (SELECT DISTINCT task_id FROM rollouts) t, range(0, 8) r(i) WHERE NOT EXISTS (SELECT 1 FROM rollouts x WHERE x.task_id = t.task_id AND x.trial = i)")
def missing_grid_antijoin(spark, d):
    r = rollouts(spark, d)
    return ds.missing_cells(r, 8, r.withColumn("trial", F.col("trial").cast("int")), "task_id", "trial")


@query("work_grid", f"WITH {ROLLOUTS} SELECT task_id, CAST(i AS INTEGER) AS trial FROM (SELECT DISTINCT task_id FROM rollouts), range(0, 4) r(i)")
def work_grid(spark, d):
    return rollouts(spark, d).select("task_id").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(3))))


@query("gate_tool_compose", f"WITH {ROLLOUTS} SELECT ordinal, CASE WHEN arm = 'cand' THEN 'tool_call' ELSE 'assistant_text' END AS decision, CASE WHEN arm = 'cand' THEN CAST(trial AS VARCHAR) END AS call FROM rollouts")
def gate_tool_compose(spark, d):
    r = rollouts(spark, d)
    gate = r.select("ordinal", F.when(F.col("arm") == "cand", "tool_call").otherwise("assistant_text").alias("decision"))
    return ds.composed(gate, r.select("ordinal", F.col("trial").cast("string").alias("call")), "ordinal", "decision", "call")


@query("sequence_buckets", "SELECT CASE WHEN n_chars <= 4096 THEN 4096 WHEN n_chars <= 8192 THEN 8192 WHEN n_chars <= 16384 THEN 16384 ELSE 32768 END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def sequence_buckets(spark, d):
    return read(spark, d, "documents").groupBy(ds.bucket(F.col("n_chars")).alias("bucket")).agg(F.count("*").alias("n"))


_LEGS = """l AS (SELECT l_orderkey || '-' || l_linenumber AS flight, 'P' || l_suppkey % 12 AS origin, 'P' || l_partkey % 12 AS destination, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS date,
 l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS departs, l_linenumber * 100 + CAST(l_quantity AS BIGINT) + 50 + l_orderkey % 150 AS arrives, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12),
c AS (SELECT origin, destination, date, price, 1 AS legs, flight AS first, '' AS second FROM l UNION ALL SELECT x.origin, y.destination, x.date, x.price + y.price, 2, x.flight, y.flight FROM l x JOIN l y ON x.date = y.date AND x.destination = y.origin AND y.departs >= x.arrives AND y.destination <> x.origin),
r AS (SELECT *, min(CASE WHEN legs = 1 THEN price END) OVER (PARTITION BY origin, destination, date) AS direct FROM c QUALIFY row_number() OVER (PARTITION BY origin, destination, date ORDER BY price, legs, first, second) = 1)"""


def _legs(spark, d):
    """Line items as flights of a month between twelve places."""
    li = read(spark, d, "lineitem")
    departs = F.col("l_linenumber") * 100 + F.col("l_quantity").cast("bigint")
    place = lambda c: F.concat(F.lit("P"), (F.col(c) % 12).cast("string"))
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("flight"), place("l_suppkey").alias("origin"), place("l_partkey").alias("destination"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("date"), departs.alias("departs"), (departs + 50 + F.col("l_orderkey") % 150).alias("arrives"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
    )


@query("cheapest_routes", f"WITH {_LEGS} SELECT origin, destination, date, price, legs, first, second FROM r")
def cheapest_routes(spark, d):
    return routes.cheapest(_legs(spark, d))


@query("route_chains", f"""WITH {_LEGS}, m AS (SELECT origin || '_' || destination || '_' || date AS chain, '{{"origin":"' || origin || '","destination":"' || destination || '","date":' || date || '}}' AS asked,
 CASE WHEN direct IS NULL THEN '[]' ELSE '[{{"price":' || direct || '}}]' END AS one, CASE WHEN legs = 2 THEN '[{{"first":"' || first || '","second":"' || second || '","price":' || price || '}}]' ELSE '[]' END AS two,
 'The cheapest way from ' || origin || ' to ' || destination || ' on ' || date || ', please.' AS wish, 'Take ' || first || CASE WHEN second <> '' THEN ' and ' || second ELSE '' END || ' for ' || price || '.' AS said FROM r),
a AS (SELECT chain, 'user:' || wish || chr(10) || 'assistant:search_direct_flight' || asked AS m1, chr(10) || 'tool:' || one || chr(10) || 'assistant:search_onestop_flight' || asked AS m3, chr(10) || 'tool:' || two || chr(10) || 'assistant:' || said AS m5 FROM m)
SELECT chain, 1 AS turn, 2 AS messages, md5(m1) AS digest FROM a UNION ALL SELECT chain, 3, 4, md5(m1 || m3) FROM a UNION ALL SELECT chain, 5, 6, md5(m1 || m3 || m5) FROM a""")
def route_chains(spark, d):
    """Every trip's gold chain of searches, made of the flight table, as samples that end with the assistant."""
    legs = _legs(spark, d)
    least = legs.where("origin != destination").groupBy(*routes.WHERE).agg(F.min("price").alias("__direct"))
    steps = routes.search_chain(routes.cheapest(legs).join(least, routes.WHERE, "left"), F.col("__direct"))
    made = recovery.progressive(steps, "chain", "i", ["role", "content", "tool", "arguments"])
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"], m["tool"], m["arguments"])), "\n")
    return made.select("chain", F.col("turn").cast("int").alias("turn"), F.size("messages").alias("messages"), F.md5(text).alias("digest"))
