"""Queries over rendered conversations, checks of samples, runs and the samples made of them, recovery and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajmill.functions import generated, rewards, text
from trajmill.operators import components as co
from trajmill.operators import grounding, groups, losses, ranges, recovery, runs, validation
from trajmill.operators import rendering as rd
from trajmill.plans.corpus import _NORM
from trajmill.plans.registry import query
from trajmill.plans.surrogates import AGENT_STEPS, SIMULATIONS, agent_conversations, agent_steps, read, simulations

_ROUND = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


def _conversations(spark, d):
    """The driver's conversations with canonical messages and the assistant's mask."""
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    m = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"), F.lit("").alias("name"), F.lit("").alias("tool_call_id"), none.alias("calls"))
    df = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    return df.withColumn("loss_mask", F.transform("messages", lambda m: m["role"] == "assistant"))


_TURN = """t AS (SELECT *, coalesce(text, '') AS body, '<|im_start|>' || role || CASE WHEN role = 'tool' THEN ' name=tool tool_call_id=' ELSE '' END || chr(10) AS head FROM conversations),
o AS (SELECT *, length(head) + length(body) + 12 AS n, coalesce(sum(length(head) + length(body) + 12) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t)"""


@query("render_conversations", f"""WITH {_TURN} SELECT conv_id, md5(string_agg(head || body || chr(10) || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest, CAST(sum(n) AS BIGINT) AS render_chars,
count(*) FILTER (role = 'assistant' AND body <> '') AS target_spans, CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS target_chars,
round(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) / sum(n), 6) AS target_char_ratio,
coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY turn) FILTER (role = 'assistant' AND body <> ''), '') AS spans FROM o GROUP BY conv_id""")
def render_conversations(spark, d):
    df = rd.check_record(rd.rendered(_conversations(spark, d)))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return df.select("conv_id", F.md5("text").alias("digest"), F.col("render_chars").cast("bigint").alias("render_chars"), F.col("target_spans").cast("bigint").alias("target_spans"), F.col("target_chars").cast("bigint").alias("target_chars"), F.round("target_char_ratio", 6).alias("target_char_ratio"), spans.alias("spans"))


@query("marked_spans", """WITH t AS (SELECT *, coalesce(text, '') AS body, count(*) FILTER (role = 'assistant' AND coalesce(text, '') <> '') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, md5(string_agg('<|im_start|>' || role || CASE WHEN role = 'tool' THEN ' name=tool tool_call_id=' ELSE '' END || chr(10) || CASE WHEN role = 'assistant' AND body <> '' THEN '@@TARGET_' || n || '_START@@' || body || '@@TARGET_' || n || '_END@@' ELSE body END || chr(10) || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest, true AS restored
FROM t GROUP BY conv_id""")
def marked_spans(spark, d):
    df = rd.rendered(_conversations(spark, d)).withColumn("marked", rd.marked(F.col("text"), F.col("spans")))
    return df.select("conv_id", F.md5("marked").alias("digest"), (rd.unmarked(F.col("marked")) == F.col("text")).alias("restored"))


@query("render_calls", f"""WITH {AGENT_STEPS}, m AS (SELECT traj, idx, '<|im_start|>assistant' || chr(10) || content || chr(10) || '<tool_call>' || chr(10) || '{{"arguments":' || args || ',"name":"' || tool || '"}}' || chr(10) || '</tool_call>' || chr(10) || '<|im_end|>' || chr(10)
  || '<|im_start|>tool name=' || tool || ' tool_call_id=' || call_id || chr(10) || reply || chr(10) || '<|im_end|>' || chr(10) AS t, CASE WHEN content <> '' THEN 2 ELSE 1 END AS spans, length(content) + length(args) + length(tool) + 24 AS chars FROM agent_steps)
SELECT traj, md5('<|im_start|>user' || chr(10) || 'help ' || traj || chr(10) || '<|im_end|>' || chr(10) || string_agg(t, '' ORDER BY idx)) AS digest, CAST(sum(spans) AS BIGINT) AS target_spans, CAST(sum(chars) AS BIGINT) AS target_chars FROM m GROUP BY traj""")
def render_calls(spark, d):
    df = agent_conversations(spark, d).withColumn("loss_mask", F.transform("messages", lambda m: m["role"] == "assistant"))
    df = rd.check_record(rd.rendered(df))
    return df.select("traj", F.md5("text").alias("digest"), F.col("target_spans").cast("bigint").alias("target_spans"), F.col("target_chars").cast("bigint").alias("target_chars"))


_WORDS = "len(regexp_extract_all({}, '[^\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'))"


@query("token_stats", f"""WITH t AS (SELECT conv_id, role, CASE WHEN role = 'tool' THEN 4 ELSE 2 END + {_WORDS.format("coalesce(text, '')")} AS n, {_WORDS.format("coalesce(text, '')")} AS body FROM conversations),
c AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(body) FILTER (role = 'assistant'), 0) AS BIGINT) AS target_tokens FROM t GROUP BY 1)
SELECT *, round(target_tokens / tokens, 6) AS target_token_ratio, CASE WHEN tokens > 200 THEN 'token_count_exceeds_max:' || conv_id || ':' || tokens || '>200' END AS over_budget FROM c""")
def token_stats(spark, d):
    df = rd.with_budget(rd.with_token_stats(rd.rendered(_conversations(spark, d))), 200, "conv_id")
    return df.select("conv_id", F.col("tokens").cast("bigint").alias("tokens"), F.col("target_tokens").cast("bigint").alias("target_tokens"), F.round("target_token_ratio", 6).alias("target_token_ratio"), "over_budget")


@query("assistant_token_mask", f"""SELECT conv_id, CAST(sum(CASE WHEN role = 'tool' THEN 4 ELSE 2 END + {_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS tokens, CAST(coalesce(sum({_WORDS.format("coalesce(text, '')")} + 1) FILTER (role = 'assistant'), 0) AS BIGINT) AS masked FROM conversations GROUP BY 1""")
def assistant_token_mask(spark, d):
    df = _conversations(spark, d)
    words = lambda t: F.size(rd.word_offsets(t))
    lengths = read(spark, d, "conversations").select("conv_id", "turn", words(F.coalesce("text", F.lit(""))).alias("n")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n"))), lambda x: x["n"] + 1).alias("body"))
    head = F.transform("messages", lambda m: F.when(m["role"] == "tool", 3).otherwise(1))
    mask = rd.assistant_token_mask(F.col("messages"), head, F.col("body"))
    out = df.join(lengths, "conv_id").withColumn("mask", mask)
    return out.select("conv_id", F.size("mask").cast("bigint").alias("tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("masked"))


@query("structure_report", f"""WITH {AGENT_STEPS}, s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'z' || k ELSE call_id END AS reply_to, CASE WHEN k % 5 = 0 THEN '' ELSE tool END AS named, 2 * idx + 1 AS i FROM agent_steps),
e AS (SELECT traj, i AS o, 0 AS p, 'tool_call_missing_name:' || i || ':' || call_id AS t FROM s WHERE named = '' UNION ALL SELECT traj, i + 1, 0, 'tool_message_without_prior_call:' || (i + 1) || ':' || reply_to FROM s WHERE k % 7 = 0),
w AS (SELECT traj, i AS o, 'assistant_not_targeted:' || i AS t FROM s WHERE idx < last UNION ALL SELECT traj, i + 1, 'tool_message_missing_name:' || (i + 1) || ':' || reply_to FROM s WHERE named = ''
  UNION ALL SELECT traj, 1000000000, 'tool_calls_without_response:' || array_to_string(list_sort(list(call_id))[1:5], ',') FROM s WHERE k % 7 = 0 GROUP BY traj)
SELECT t.traj, coalesce((SELECT md5(string_agg(e.t, ';' ORDER BY o, p)) FROM e WHERE e.traj = t.traj), md5('')) AS errors, (SELECT count(*) FROM e WHERE e.traj = t.traj) AS n_errors, coalesce((SELECT md5(string_agg(w.t, ';' ORDER BY o)) FROM w WHERE w.traj = t.traj), md5('')) AS warnings
FROM (SELECT DISTINCT traj FROM s) t""".replace("s AS (SELECT *,", "s AS (SELECT *, max(idx) OVER (PARTITION BY traj) AS last,"))
def structure_report(spark, d):
    steps = agent_steps(spark, d)
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    named = F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("tool"))
    reply = F.when(F.col("k") % 7 == 0, F.concat(F.lit("z"), F.col("k").cast("string"))).otherwise(F.col("call_id"))
    message = lambda role, content, name, to, calls: F.struct(F.lit(role).alias("role"), content.alias("content"), name.alias("name"), to.alias("tool_call_id"), calls.alias("calls"))
    call = F.array(F.struct(F.col("call_id").alias("id"), named.alias("name"), F.col("args").alias("arguments")))
    pair = F.array(message("assistant", F.col("content"), F.lit(""), F.lit(""), call), message("tool", F.col("reply"), named, reply, none))
    rows = steps.groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("idx", pair.alias("pair")))).alias("rows"))
    df = rows.select("traj", F.concat(F.array(message("user", F.lit("help"), F.lit(""), F.lit(""), none)), F.flatten(F.transform("rows", lambda r: r["pair"]))).alias("messages"))
    mask = F.transform("messages", lambda _, i: i == F.size("messages") - 2)  # on the last call alone
    found = df.withColumn("loss_mask", mask).withColumn("r", validation.structure_report(F.col("messages"), F.col("loss_mask")))
    return found.select("traj", F.md5(F.array_join("r.errors", ";")).alias("errors"), F.size("r.errors").cast("bigint").alias("n_errors"), F.md5(F.array_join("r.warnings", ";")).alias("warnings"))


@query("sample_errors", """WITH c AS (SELECT conv_id, conv_id // 2 AS id, count(*) AS n FROM conversations GROUP BY conv_id), l AS (SELECT c.*, role FROM c JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x ON x.conv_id = c.conv_id AND r = 1),
m AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1), f AS (SELECT id, l.role, a, row_number() OVER (PARTITION BY id ORDER BY l.conv_id) AS r FROM l JOIN m ON m.conv_id = l.conv_id)
SELECT 'duplicate_id' AS error, count(*) AS n FROM f WHERE r > 1 UNION ALL SELECT 'last_not_assistant', count(*) FROM f WHERE role <> 'assistant' HAVING count(*) > 0 UNION ALL SELECT 'loss_mask_not_last_only', count(*) FROM f WHERE role <> 'assistant' OR a <> 1 HAVING count(*) > 0""")
def sample_errors(spark, d):
    df = _conversations(spark, d).withColumn("id", F.expr("conv_id div 2"))
    return validation.sample_errors(df, "id", ["conv_id"]).groupBy("error").agg(F.count("*").alias("n"))


@query("split_leaks", """WITH s AS (SELECT source AS task, CASE WHEN doc_id % 10 = 0 THEN 'valid' WHEN doc_id % 10 = 1 AND doc_id % 3 = 0 THEN 'heldout' ELSE 'train' END AS split FROM documents), l AS (SELECT coalesce(task, '-') AS task, list_sort(list_distinct(list(split))) AS splits FROM s GROUP BY 1)
SELECT 'train_valid' AS error, string_agg(task, ',' ORDER BY task) AS tasks FROM l WHERE list_contains(splits, 'train') AND list_contains(splits, 'valid') HAVING count(*) > 0
UNION ALL SELECT 'official', string_agg(task, ',' ORDER BY task) FROM l WHERE (list_contains(splits, 'train') OR list_contains(splits, 'valid')) AND list_contains(splits, 'heldout') HAVING count(*) > 0""")
def split_leaks(spark, d):
    r = F.col("doc_id") % 10
    df = read(spark, d, "documents").select(F.coalesce("source", F.lit("-")).alias("task"), F.when(r == 0, "valid").when((r == 1) & (F.col("doc_id") % 3 == 0), "heldout").otherwise("train").alias("split"))
    found = validation.leak_errors(df, "task", "split", {"train_valid": (["train"], ["valid"]), "official": (["train", "valid"], ["heldout"])})
    return found.select("error", F.array_join("tasks", ",").alias("tasks"))


@query("run_counters", f"""WITH {SIMULATIONS} SELECT 'termination' AS counter, termination_reason AS value, count(*) AS n FROM sims GROUP BY ALL UNION ALL SELECT 'db', CASE WHEN db_match IS NULL THEN 'not_checked' WHEN db_match THEN 'match' ELSE 'mismatch' END, count(*) FROM sims GROUP BY ALL
UNION ALL SELECT 'communicate', coalesce(CASE communicate WHEN 1 THEN '1.0' WHEN 0 THEN '0.0' END, 'not_checked'), count(*) FROM sims GROUP BY ALL""")
def run_counters(spark, d):
    return runs.run_counters(simulations(spark, d))


@query("run_comparison", f"""WITH {SIMULATIONS}, t AS (SELECT run, task_id, count(*) AS n, count(*) FILTER (reward >= 1 - 1e-6 AND reward <= 1 + 1e-6) AS s FROM sims GROUP BY ALL),
p AS (SELECT run, CASE WHEN min(n) >= 1 THEN avg(s / n) END AS pass_1, CASE WHEN min(n) >= 2 THEN avg(s * (s - 1) / (n * (n - 1))) FILTER (n >= 2) END AS pass_2 FROM t GROUP BY 1),
r AS (SELECT run, count(DISTINCT task_id) AS tasks, count(*) AS sims, avg(reward) AS avg_reward, count(*) FILTER (reward >= 1 - 1e-6 AND reward <= 1 + 1e-6) AS success_count, count(*) FILTER (db_match) AS db_match, count(*) FILTER (NOT db_match) AS db_mismatch, count(*) FILTER (communicate = 1) AS communicate_full FROM sims GROUP BY 1)
SELECT run, tasks, sims, round(avg_reward, 6) AS avg_reward, success_count, round(pass_1, 6) AS pass_1, round(pass_2, 6) AS pass_2, db_match, db_mismatch, communicate_full FROM r JOIN p USING (run)""")
def run_comparison(spark, d):
    return _ROUND(runs.compared(simulations(spark, d), "run", (1, 2)), "avg_reward", "pass_1", "pass_2")


@query("score_summary", f"""WITH {SIMULATIONS}, o AS (SELECT *, coalesce(reward >= 1 - 1e-6 AND reward <= 1 + 1e-6, false) AS ok FROM sims)
SELECT count(*) AS num_simulations, round(avg(reward), 6) AS avg_reward, count(*) FILTER (ok) AS success_count, round(avg(process_score), 6) AS avg_score, round(avg(process_score) FILTER (ok), 6) AS avg_score_success, round(avg(process_score) FILTER (NOT ok), 6) AS avg_score_failure FROM o""")
def score_summary(spark, d):
    return _ROUND(runs.score_summary(simulations(spark, d)), "avg_reward", "avg_score", "avg_score_success", "avg_score_failure")


@query("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT DISTINCT l_orderkey, unnest(['flag_' || l_returnflag, 'status_' || l_linestatus]) AS tag FROM lineitem WHERE round((l_discount - l_tax) * 100, 0) < 0) GROUP BY 1")
def tag_counts(spark, d):
    from trajmill.plans.surrogates import components

    return runs.tag_counts(co.scored(components(spark, d)))


@query("catalogue_top", "SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, min(l_orderkey * 100 + l_linenumber) LIMIT 12")
def catalogue_top(spark, d):
    df = read(spark, d, "lineitem").select(F.col("l_shipdate").alias("value"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"))
    return runs.top_values(df, "value", "at")


@query("accumulator_efficiency", f"""WITH {SIMULATIONS}, g AS (SELECT ordinal // 1000 AS batch, task_id, count(*) AS n, count(*) >= 2 AND coalesce(min(reward) < max(reward), false) AS live FROM sims GROUP BY ALL)
SELECT count(DISTINCT batch) AS gen_batches, CAST(sum(n) AS BIGINT) AS rows_generated, count(*) AS groups_generated, count(*) FILTER (live) AS groups_kept, round(count(*) FILTER (live) / count(*), 4) AS group_yield, round(count(*) / 100, 4) AS generation_overhead FROM g""")
def accumulator_efficiency(spark, d):
    states = simulations(spark, d).groupBy(F.expr("ordinal div 1000").alias("batch"), "task_id").agg(F.count("*").alias("n"), ((F.count("*") >= 2) & F.coalesce(F.min("reward") < F.max("reward"), F.lit(False))).alias("live"))
    return runs.accumulator_efficiency(states, "batch", "live", "n", 100)


@query("success_samples", f"""WITH {SIMULATIONS}, x AS (SELECT s.*, process_score AS score, c_mktsegment FROM sims s LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS k, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0) c ON c.k = task_id WHERE reward >= 1 - 1e-6 AND reward <= 1 + 1e-6)
SELECT 'sft_success_task' || task_id || '_trial' || trial AS id, coalesce(c_mktsegment, 'unknown') AS official_split, coalesce(c_mktsegment, '') = 'BUILDING' AS trainable, round(CASE WHEN ordinal % 2 = 0 THEN score END, 9) AS process_score, 2 AS tool_calls, 1 AS write_calls FROM x""")
def success_samples(spark, d):
    sims = simulations(spark, d).withColumn("simulation_id", F.col("ordinal").cast("string")).drop("process_score")
    call = lambda i, name: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit("{}").alias("arguments"))
    message = F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), F.array(call("a", "cancel_reservation"), call("b", "get_user_details")).alias("calls"))
    splits = read(spark, d, "customer").where("c_custkey % 4 != 0").select(F.col("c_custkey").cast("string").alias("task_id"), F.when(F.col("c_mktsegment") == "BUILDING", "train").otherwise(F.col("c_mktsegment")).alias("official_split"))
    scores = simulations(spark, d).where("ordinal % 2 = 0").select(F.col("ordinal").cast("string").alias("simulation_id"), "process_score", F.array(F.lit("t")).alias("risk_tags"))
    tasks = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("task_id"), "c_name")
    out = runs.success_samples(sims.withColumn("messages", F.array(message)), tasks, scores, splits, "v1", "shop")
    split = F.when(F.col("metadata.official_split") == "train", "BUILDING").otherwise(F.col("metadata.official_split"))
    return out.select("id", split.alias("official_split"), "metadata.trainable", F.round("metadata.process_score", 9).alias("process_score"), "tool_calls", "write_calls")


@query("row_tokens", "SELECT d.doc_id, coalesce(nullif(CASE WHEN l.doc_id IS NOT NULL THEN l.quality * 10 END, 0), nullif(d.n_chars // 4, 0), 0) AS tokens FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def row_tokens(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.expr("n_chars div 4").alias("estimate"))
    stats = read(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") * 10).alias("tokens"))
    return runs.row_tokens(rows, stats, "doc_id", "estimate").select("doc_id", "tokens")


@query("three_way_split", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'heldout' WHEN o_custkey % 7 = 3 THEN 'valid' ELSE 'train' END AS split FROM orders""")
def three_way_split(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") != "P").alias("trainable"))
    return runs.three_way(rows, read(spark, d, "orders").where("o_custkey % 7 = 3").select(F.col("o_custkey").alias("task_id")), "trainable", "task_id").select("id", "split")


_BALANCE = """r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 'assistant_text' ELSE 'tool_call' END AS target_action, o_orderpriority = '5-LOW' AS protocol_only FROM orders),
p AS (SELECT id, row_number() OVER (ORDER BY substr(sha1('11:' || id), 1, 16), id) AS n, count(*) OVER () AS total FROM r WHERE target_action = 'tool_call' AND protocol_only),
b AS (SELECT r.id, target_action, i, CASE WHEN target_action = 'assistant_text' THEN CASE WHEN i = 0 THEN 'assistant_text_original' ELSE 'assistant_text_repeat' END WHEN p.id IS NULL THEN 'tool_original' WHEN n <= floor(total * 0.5e0 + 0.5e0) THEN 'protocol_tool_kept' ELSE 'protocol_tool_downsampled' END AS role
  FROM r LEFT JOIN p ON p.id = r.id, (SELECT unnest([0, 1, 2]) AS i) k WHERE i = 0 OR target_action = 'assistant_text')"""


def _balanced(spark, d, check=False):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "assistant_text").otherwise("tool_call").alias("target_action"), (F.col("o_orderpriority") == "5-LOW").alias("protocol_only"))
    return runs.balanced(rows, 3, 0.5, 11, check=check)


@query("balance_rows", f"WITH {_BALANCE} SELECT CASE WHEN i > 0 THEN id || '__text_repeat' || i ELSE id END AS id, id AS original_id, role AS balance_role FROM b")
def balance_rows(spark, d):
    return _balanced(spark, d).select("id", "original_id", "balance_role")


@query("decision_mix", f"WITH {_BALANCE}, m AS (SELECT count(*) FILTER (target_action = 'assistant_text') AS a, count(*) FILTER (target_action = 'tool_call') AS t FROM b WHERE role <> 'protocol_tool_downsampled') SELECT a AS assistant_text, t AS tool_call, a + t AS total, round(a / (a + t), 6) AS text_share, round(t / (a + t), 6) AS tool_share FROM m")
def decision_mix(spark, d):
    return _ROUND(runs.decision_mix(_balanced(spark, d).where("balance_role != 'protocol_tool_downsampled'")), "text_share", "tool_share")


@query("reason_summary", "WITH r AS (SELECT CASE WHEN length(text) > 300 THEN 'too_long' WHEN turn = 0 THEN 'greeting' ELSE 'clean' END AS reason FROM conversations) SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1")
def reason_summary(spark, d):
    c = read(spark, d, "conversations").withColumn("reason", F.when(F.length("text") > 300, "too_long").when(F.col("turn") == 0, "greeting"))
    return _ROUND(runs.reason_summary(c.where("reason is null"), c.where("reason is not null"), "reason"), "share")


@query("broken_calls", f"WITH {AGENT_STEPS} SELECT traj, count(*) FILTER (k % 4 = 0) AS broken FROM agent_steps GROUP BY 1")
def broken_calls(spark, d):
    k = F.col("k") % 4  # 0: cut; 1: closed; 2: parsed; 3: none
    content = F.when(k == 1, '<tool_call>{"name": "x"}</tool_call>').when(k == 3, "no call").otherwise('<tool_call>{"na')
    m = F.struct(F.lit("assistant").alias("role"), content.alias("content"), F.when(k == 2, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("calls"))
    rows = agent_steps(spark, d).groupBy("traj").agg(F.collect_list(m).alias("messages"))
    return rows.select("traj", runs.broken_calls(F.col("messages")).cast("bigint").alias("broken"))


@query("shortest_first", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50")
def shortest_first(spark, d):
    return runs.shortest_first(read(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 50)


@query("first_probes", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn LIMIT 40")
def first_probes(spark, d):
    return runs.first_probes(read(spark, d, "conversations"), ["conv_id", "turn"], 40, F.col("role") == "assistant").select("conv_id", "turn")


@query("picked_trials", f"WITH {SIMULATIONS} SELECT task_id, trial, ordinal FROM sims WHERE task_id = (SELECT min(CAST(o_custkey AS VARCHAR)) FROM orders) ORDER BY ordinal LIMIT 1")
def picked_trials(spark, d):
    sims = simulations(spark, d)
    return runs.picked(sims, "ordinal", sims.agg(F.min("task_id")).first()[0]).select("task_id", "trial", "ordinal")


_NUM = "round(value, 2)"


@query("flexible_answer", f"""WITH {AGENT_STEPS} SELECT call_id, CASE k % 5 WHEN 4 THEN NULL ELSE {_NUM} END AS value, ['hash', 'boxed', 'phrase', 'last_number', 'none'][k % 5 + 1] AS rule FROM agent_steps""")
def flexible_answer(spark, d):
    v, k = F.format_string("%.2f", "value"), F.col("k") % 5
    t = F.when(k == 0, F.concat(F.lit("3 so #### "), v)).when(k == 1, F.concat(F.lit("from 7: \\boxed{ "), v, F.lit(" }"))).when(k == 2, F.concat(F.lit("of 12, The answer is **"), v, F.lit("**"))).when(k == 3, F.concat(F.lit("it makes 3 and then "), v, F.lit(" dollars"))).otherwise("none here")
    return agent_steps(spark, d).select("call_id", text.flexible_answer(t).alias("a")).select("call_id", F.round("a.value", 2).alias("value"), "a.rule")


@query("generated_calls", f"""WITH {AGENT_STEPS} SELECT call_id, CASE k % 3 WHEN 2 THEN NULL ELSE tool END AS name, CASE k % 3 WHEN 2 THEN NULL ELSE '{{"x":' || k || '}}' END AS arguments, k % 3 = 2 AS parse_failed FROM agent_steps""")
def generated_calls(spark, d):
    k, n = F.col("k") % 3, F.col("k").cast("string")
    t = F.when(k == 0, F.concat(F.lit('<tool_call>{"name": "'), F.col("tool"), F.lit('", "arguments": {"x": '), n, F.lit("}}</tool_call>"))).when(k == 1, F.concat(F.lit('I call {"function": {"name": "'), F.col("tool"), F.lit('", "params": "{\\"x\\": '), n, F.lit('}"}}'))).otherwise('{"name": oops}')
    df = agent_steps(spark, d).select("call_id", t.alias("t")).select("call_id", generated.generated_calls("t").alias("g"))
    first = F.get("g.calls", F.lit(0))
    return df.select("call_id", first["name"].alias("name"), first["arguments"].alias("arguments"), F.col("g.parse_failed").alias("parse_failed"))


def _slots(spark, d):
    """Views as look-ups of a user who said a name first: even ones are of that name, odd ones of another; cheap ones fail."""
    s = agent_steps(spark, d).where("tool = 'view'")
    name = lambda n: F.concat(F.lit("ann_lee_"), n.cast("string"))
    call = F.array(F.struct(F.col("call_id").alias("id"), F.lit("get_user_details").alias("name"), F.concat(F.lit('{"user_id":"'), name(F.col("traj") + F.col("k") % 2), F.lit('"}')).alias("arguments")))
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    row = lambda df, idx, role, content, to, calls: df.select("traj", idx.cast("int").alias("idx"), F.lit(role).alias("role"), content.alias("content"), F.lit(False).alias("error"), to.alias("reply_to"), calls.alias("calls"))
    said = row(s.select("traj").distinct(), F.lit(0), "user", F.concat(F.lit("I am "), name(F.col("traj"))), F.lit(""), none)
    calls = row(s, 2 * F.col("idx") + 1, "assistant", F.lit("one moment"), F.lit(""), call)
    replies = row(s, 2 * F.col("idx") + 2, "tool", F.when(F.col("value") < 20, "Error: try again").otherwise("{}"), F.col("call_id"), none)
    return said.unionByName(calls).unionByName(replies)


_SLOT = f"""{AGENT_STEPS}, v AS (SELECT traj, idx, k, value, min(CASE WHEN k % 2 = 1 AND value >= 20 THEN idx END) OVER (PARTITION BY traj) AS attested FROM agent_steps WHERE tool = 'view'),
i AS (SELECT traj, 2 * idx + 1 AS idx, 'ungrounded_user_id' AS component, 'ann_lee_' || (traj + 1) AS value, 3e0 AS severity FROM v WHERE k % 2 = 1 AND (attested IS NULL OR idx <= attested))"""


@query("slot_grounding", f"WITH {_SLOT} SELECT * FROM i")
def slot_grounding(spark, d):
    return grounding.issues(_slots(spark, d), ["traj"]).select("traj", F.col("idx").cast("bigint").alias("idx"), "component", "value", "severity")


@query("grounding_scores", f"""WITH {_SLOT} SELECT v.traj, CASE WHEN n IS NULL THEN 1e0 ELSE -3 * n END AS score, CASE WHEN n IS NULL THEN '' ELSE 'argument_hallucination,slot_grounding_error,ungrounded_user_id' END AS risk_tags
FROM (SELECT DISTINCT traj FROM v) v LEFT JOIN (SELECT traj, CAST(count(*) AS DOUBLE) AS n FROM i GROUP BY 1) x ON x.traj = v.traj""")
def grounding_scores(spark, d):
    return co.scored(grounding.components(_slots(spark, d), ["traj"])).select("traj", "score", F.array_join("risk_tags", ",").alias("risk_tags"))


@query("evidence_counts", f"WITH {_SLOT} SELECT 'user_id' AS slot, (SELECT count(DISTINCT traj) FROM v) + (SELECT count(DISTINCT traj) FROM v WHERE attested IS NOT NULL) AS n")
def evidence_counts(spark, d):
    return runs.evidence_counts(grounding.evidence(_slots(spark, d), ["traj"]))


@query("target_grounding", f"""WITH {_SLOT}, l AS (SELECT traj, max(idx) AS last FROM v GROUP BY 1) SELECT v.traj, v.k % 2 = 0 OR coalesce(attested < v.idx, false) AS is_grounded, CASE WHEN v.k % 2 = 0 OR coalesce(attested < v.idx, false) THEN '' ELSE 'ungrounded_user_id' END AS issues FROM v JOIN l ON l.traj = v.traj AND l.last = v.idx""")
def target_grounding(spark, d):
    return grounding.target_grounding(_slots(spark, d), ["traj"]).select("traj", "is_grounded", F.array_join("issues", ",").alias("issues"))


@query("lookback", "SELECT conv_id, turn, list_count(list_filter(list_value(lag(role, 1) OVER w, lag(role, 2) OVER w, lag(role, 3) OVER w), lambda x: CASE WHEN x = 'assistant' THEN true END)) AS recent, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)".replace("list_count(list_filter(list_value(lag(role, 1) OVER w, lag(role, 2) OVER w, lag(role, 3) OVER w), lambda x: CASE WHEN x = 'assistant' THEN true END))", "CAST(coalesce(lag(role, 1) OVER w = 'assistant', false) AS BIGINT) + CAST(coalesce(lag(role, 2) OVER w = 'assistant', false) AS BIGINT) + CAST(coalesce(lag(role, 3) OVER w = 'assistant', false) AS BIGINT)"))
def lookback(spark, d):
    m = read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), F.array().cast("array<string>").alias("tools"))
    return recovery.context(m, "conv_id", "turn").select("conv_id", "turn", F.size("assistant_before").cast("bigint").alias("recent"), "next_role")


@query("recovery_samples", f"""WITH {AGENT_STEPS}, e AS (SELECT traj, 2 * idx + 2 AS turn, CASE WHEN k % 2 = 0 THEN 'user' ELSE 'reservation' END || '_not_found_stop_guessing' AS family FROM agent_steps WHERE is_error
UNION ALL SELECT traj, 2 * idx + 1, 'no_tool_while_asking' FROM agent_steps WHERE k % 9 = 1)
SELECT 'recovery_' || traj || '_turn' || turn || '_' || family AS id, family, turn, CASE family WHEN 'no_tool_while_asking' THEN turn + 1 ELSE turn + 2 END AS n_messages FROM e""")
def recovery_samples(spark, d):
    s = agent_steps(spark, d)
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    content = F.when(F.col("k") % 9 == 1, "which one?").otherwise(F.col("content"))
    failed = F.concat(F.lit("Error: "), F.when(F.col("k") % 2 == 0, "User ").otherwise("Reservation "), F.col("k").cast("string"), F.lit(" not found"))
    call = F.array(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("args").alias("arguments")))
    row = lambda df, idx, role, content, calls: df.select("traj", idx.cast("int").alias("idx"), F.lit(role).alias("role"), content.alias("content"), F.lit("").alias("name"), F.lit("").alias("tool_call_id"), calls.alias("calls"))
    rows = row(s.select("traj").distinct(), F.lit(0), "user", F.lit("help"), none).unionByName(row(s, 2 * F.col("idx") + 1, "assistant", content, call)).unionByName(row(s, 2 * F.col("idx") + 2, "tool", F.when(F.col("is_error"), failed).otherwise(F.col("reply")), none))
    convs = rows.groupBy("traj").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "role", "content", "name", "tool_call_id", "calls"))), lambda m: F.struct(*[m[c].alias(c) for c in ("role", "content", "name", "tool_call_id", "calls")])).alias("messages"))
    found = recovery.corrections(recovery.context(rows.withColumn("tools", F.transform("calls", lambda c: c["name"])), "traj"), convs, "traj", recovery.online_rules(F.lit(False)))
    return found.select("id", "family", F.col("turn").cast("bigint").alias("turn"), F.size("messages").cast("bigint").alias("n_messages"))


@query("gold_chains", "SELECT conv_id, i - 1 AS turn, i AS n_messages FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE role = 'assistant'")
def gold_chains(spark, d):
    found = recovery.progressive(read(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])
    return found.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.size("messages").cast("bigint").alias("n_messages"))


@query("later_writes_win", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, last_value(l_extendedprice IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price FROM lineitem")
def later_writes_win(spark, d):
    df = read(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice")).withColumn("at", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return recovery.looked_up_before(df, "l_orderkey", "at", ["l_returnflag", "l_linestatus"], "price").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "last_price")


_ROWS = "r AS (SELECT o_orderkey AS id, o_orderpriority AS split, o_totalprice / 1e5 AS loss, o_custkey % 7 + 1 AS target_tokens, o_custkey % 3 = 0 AS truncated, CASE WHEN o_orderstatus = 'F' THEN 'base' ELSE 'tuned' END AS model FROM orders)"


def _evaluated(spark, d):
    labels = F.concat(F.array(F.lit(5)), F.array_repeat(F.lit(7), (F.col("o_custkey") % 7 + 1).cast("int")), F.array(F.lit(-100)))
    df = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("split"), (F.col("o_totalprice") / 100000).alias("loss"), labels.alias("labels"), (F.col("o_custkey") % 3 == 0).alias("truncated"), F.when(F.col("o_orderstatus") == "F", "base").otherwise("tuned").alias("model"))
    return losses.evaluated(df)


@query("evaluation_losses", f"WITH {_ROWS}, s AS (SELECT model, split, count(*) AS rows, sum(loss * target_tokens) / sum(target_tokens) AS w, avg(loss) AS m, sum(target_tokens) AS t, count(*) FILTER (truncated) AS truncated FROM r GROUP BY ALL) SELECT model, split, rows, round(w, 6) AS weighted_loss, round(m, 6) AS mean_loss, round(exp(least(w, 20)), 4) AS perplexity, CAST(t AS BIGINT) AS target_tokens, truncated FROM s")
def evaluation_losses(spark, d):
    out = losses.summarised(_evaluated(spark, d), "model", "split")
    return _ROUND(out.withColumn("perplexity", F.round("perplexity", 4)), "weighted_loss", "mean_loss")


@query("loss_changes", f"WITH {_ROWS}, s AS (SELECT model, split, sum(loss * target_tokens) / sum(target_tokens) AS w FROM r GROUP BY ALL) SELECT t.model, t.split, round(t.w - b.w, 6) AS weighted_loss_delta, round((t.w - b.w) / b.w * 100, 4) AS relative_change_pct FROM s t JOIN s b ON b.split = t.split AND b.model = 'base' WHERE t.model <> 'base'")
def loss_changes(spark, d):
    out = losses.loss_changes(losses.summarised(_evaluated(spark, d), "model", "split"), "model", "base")
    return _ROUND(out.withColumn("relative_change_pct", F.round("relative_change_pct", 4)), "weighted_loss_delta")


@query("row_deltas", "SELECT o_orderkey AS id, round(o_totalprice / 1e5, 9) AS base_loss, round(o_totalprice / 1e5 / 2, 9) AS loss, round(o_totalprice / 1e5 / 2 - o_totalprice / 1e5, 9) AS delta FROM orders WHERE o_orderstatus <> 'P'")
def row_deltas(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", (F.col("o_totalprice") / 100000).alias("loss"))
    found = losses.row_deltas(o, o.where("o_orderstatus != 'P'").withColumn("loss", F.col("loss") / 2))
    return found.withColumns({c: F.round(c, 9) for c in ("base_loss", "loss", "delta")})


@query("finite_mean", "SELECT round(avg(x), 6) AS loss FROM (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 1e5 END AS x FROM orders ORDER BY o_orderkey LIMIT 500)")
def finite_mean(spark, d):
    x = F.when(F.col("o_orderkey") % 8 == 0, float("nan")).when(F.col("o_orderkey") % 4 == 0, float("inf")).otherwise(F.col("o_totalprice") / 100000)
    return _ROUND(losses.finite_mean(read(spark, d, "orders").withColumn("x", x), "o_orderkey", "x", 500), "loss")


@query("policy_loss", """WITH t AS (SELECT l_orderkey AS rollout, l_linenumber AS idx, -l_discount AS logp, -l_tax AS ref, (l_orderkey % 5) - 2 AS adv, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag <> 'R' WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice)),
w AS (SELECT *, pow(1.1e0, n - rn) / avg(pow(1.1e0, n - rn)) OVER (PARTITION BY rollout) AS wt, greatest(-10e0, least(10e0, ref - logp)) AS r FROM t)
SELECT rollout, round(-max(adv) * sum(logp * wt) / sqrt(max(n)) + 0.1e0 * avg(exp(r) - r - 1), 6) AS loss, round(avg(exp(r) - r - 1), 6) AS kl FROM w GROUP BY 1""")
def policy_loss(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("rollout"), F.struct("l_linenumber", "l_extendedprice").alias("idx"), (-F.col("l_discount")).alias("logp"), (-F.col("l_tax")).alias("ref_logp"), (F.col("l_orderkey") % 5 - 2).alias("adv"), (F.col("l_returnflag") != "R").cast("int").alias("mask"))
    return _ROUND(losses.policy_loss(t, "rollout", "idx", "adv", True, 1.1, 0.1), "loss", "kl")


_PROBE = """p AS (SELECT o_orderkey AS probe_id, CASE WHEN o_custkey % 2 = 0 THEN 'assistant_text' ELSE 'tool_call' END AS target, CASE WHEN o_custkey % 3 = 0 THEN 'assistant_text' ELSE 'tool_call' END AS gate, o_orderkey % 4 <> 0 AS has, o_orderkey % 8 < 3 AS exact FROM orders)"""


def _probes(spark, d):
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    target = F.when(F.col("o_custkey") % 2 == 0, "assistant_text").otherwise("tool_call")
    action = F.when(F.col("o_custkey") % 3 == 0, "assistant_text").otherwise("tool_call")
    gate = o.select(key.alias("probe_id"), target.alias("target_action"), action.alias("predicted_action"), (target == action).alias("action_type_match"), F.lit(True).alias("tool_probe_has_tool"), F.lit(False).alias("has_protocol_wrapper"), F.lit(True).alias("tool_name_match"), F.lit(True).alias("arg_exact_match"))
    has = key % 4 != 0
    tools = o.select(key.alias("probe_id"), F.when(has, "tool_call").otherwise("unknown").alias("predicted_action"), has.alias("action_type_match"), has.alias("tool_probe_has_tool"), F.lit(True).alias("has_protocol_wrapper"), has.alias("tool_name_match"), (key % 8 < 3).alias("arg_exact_match"))
    return gate, tools


@query("oracle_gate", f"WITH {_PROBE} SELECT target, count(*) AS n, count(*) FILTER (target = 'assistant_text' OR has) AS matched, count(*) FILTER (target = 'tool_call' AND exact) AS exact FROM p GROUP BY 1")
def oracle_gate(spark, d):
    gate, tools = _probes(spark, d)
    out = losses.oracle_gate(tools, gate)
    return out.groupBy(F.col("target_action").alias("target")).agg(F.count("*").alias("n"), F.count_if("action_type_match").alias("matched"), F.count_if("arg_exact_match").alias("exact"))


@query("gated_tools", f"WITH {_PROBE} SELECT target, count(*) AS n, count(*) FILTER (CASE WHEN target = 'assistant_text' THEN gate = target ELSE gate = 'tool_call' AND has END) AS matched, count(*) FILTER (CASE WHEN target = 'assistant_text' THEN true ELSE gate = 'tool_call' AND exact END) AS exact FROM p GROUP BY 1")
def gated_tools(spark, d):
    gate, tools = _probes(spark, d)
    out = losses.gated_tools(gate, tools)
    return out.groupBy(F.col("target_action").alias("target")).agg(F.count("*").alias("n"), F.count_if("action_type_match").alias("matched"), F.count_if("arg_exact_match").alias("exact"))


@query("placeholders", f"""WITH {AGENT_STEPS}, f AS (SELECT call_id, CASE k % 4 WHEN 0 THEN 'user_id' WHEN 1 THEN 'flight_date' WHEN 2 THEN 'note' ELSE 'reservation_id' END AS field, CASE k % 4 WHEN 0 THEN 'ann_lee_' || k WHEN 1 THEN '2024-05-' || k WHEN 2 THEN CASE WHEN k % 8 = 2 THEN 'the last one' ELSE 'fine' END ELSE 'AB' || (k + 9900) END AS value FROM agent_steps)
SELECT call_id, CASE field WHEN 'user_id' THEN false WHEN 'flight_date' THEN length(value) <> 10 WHEN 'note' THEN value = 'the last one' ELSE length(value) <> 6 END AS placeholder FROM f""")
def placeholders(spark, d):
    k, n = F.col("k") % 4, F.col("k").cast("string")
    field = F.when(k == 0, "user_id").when(k == 1, "flight_date").when(k == 2, "note").otherwise("reservation_id")
    value = F.when(k == 0, F.concat(F.lit("ann_lee_"), n)).when(k == 1, F.concat(F.lit("2024-05-"), n)).when(k == 2, F.when(F.col("k") % 8 == 2, "the last one").otherwise("fine")).otherwise(F.concat(F.lit("AB"), (F.col("k") + 9900).cast("string")))
    return agent_steps(spark, d).select("call_id", rewards.has_placeholder(F.create_map(field, value)).alias("placeholder"))


@query("alias_rewards", f"""WITH b AS (SELECT item_id, list_filter(string_split({_NORM}, ' '), lambda w: w <> '') AS t FROM benchmark),
g AS (SELECT item_id, t AS p, t[1:len(t) // 2] AS g FROM b UNION ALL SELECT x.item_id, x.t, y.t FROM b x JOIN b y ON y.item_id = x.item_id + 1 UNION ALL SELECT item_id, t, t FROM b WHERE item_id % 3 = 0),
o AS (SELECT item_id, p, g, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(g, lambda v: v = w))))) AS k FROM g WHERE len(g) > 0),
s AS (SELECT item_id, max(CASE WHEN p = g THEN 1e0 ELSE 0e0 END) AS em, max(CASE WHEN len(p) = 0 OR k = 0 THEN 0e0 ELSE 2 * (k / len(p)) * (k / len(g)) / (k / len(p) + k / len(g)) END) AS f1 FROM o GROUP BY 1)
SELECT item_id, em, round(f1, 6) AS f1, round(CASE WHEN em > 0 THEN em ELSE f1 / 2 END, 6) AS half, 0e0 AS none FROM s""")
def alias_rewards(spark, d):
    """A benchmark text against the first half of itself, the next text, and for a third of them itself with an article and a mark, among
    blank aliases."""
    b = read(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    words = text.tokens_of(text.normalized(F.col("t")))
    following = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("next"))
    b = b.join(following, "item_id", "left")
    golds = F.array(F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " "), F.col("next"), F.lit(None).cast("string"), F.lit("  "), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("The "), F.col("t"), F.lit("!"))))
    answer = F.concat(F.lit("I think <answer> "), F.col("t"), F.lit(" </answer>"))
    return b.select("item_id", *[F.round(rewards.qa_reward(answer, golds, m), 6).alias(n) for m, n in (("em", "em"), ("f1", "f1"), ("em_or_f1half", "half"))], rewards.qa_reward(answer, F.array(F.lit(" "))).alias("none"))


_RULES = f"""{AGENT_STEPS}, e AS (SELECT *, k % 10 AS r, last_value(CASE WHEN tool = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY traj, k % 10 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  coalesce(max(CASE WHEN tool = 'click' AND k % 10 = 0 THEN 1 END) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM agent_steps),
f AS (SELECT *, seen // 10 % 2 = 1 AND NOT (seen // 10 % 3 = 0 OR stopped) AS late FROM e),
c AS (SELECT traj, CASE WHEN seen IS NULL THEN 'cancel_without_reservation_details' WHEN late THEN 'cancel_after_24h_without_policy_basis' ELSE 'cancel_precondition_supported' END AS component FROM f WHERE tool = 'purchase'
UNION ALL SELECT traj, 'user_pressure_susceptibility' FROM f WHERE tool = 'purchase' AND late AND traj % 2 = 0 UNION ALL SELECT traj, 'certificate_without_status_confirmation' FROM f WHERE tool = 'error' AND NOT stopped
UNION ALL SELECT traj, 'wrong_tool_for_schedule_lookup' FROM f WHERE tool = 'click' AND traj % 3 = 0 GROUP BY traj UNION ALL SELECT traj, 'forbidden_db_write' FROM f WHERE tool IN ('purchase', 'error') AND traj % 5 = 0 GROUP BY traj
UNION ALL SELECT traj, 'unexpected_write_tool' FROM f WHERE tool = 'error' AND traj % 5 = 1 UNION ALL SELECT DISTINCT traj, CASE WHEN traj % 7 = 0 THEN 'required_communication_met' ELSE 'missing_required_communication' END FROM f WHERE traj % 7 < 2
UNION ALL SELECT DISTINCT traj, CASE WHEN traj % 4 = 0 THEN 'reference_actions_matched' ELSE 'reference_action_mismatch' END FROM f WHERE traj % 4 < 2)"""


_WORTH = """v(component, value, tags) AS (VALUES ('cancel_without_reservation_details', -2e0, 'incomplete_evidence,premature_write'), ('cancel_after_24h_without_policy_basis', -3e0, 'temporal_policy_error,premature_write'), ('cancel_precondition_supported', 1e0, ''),
 ('user_pressure_susceptibility', -1e0, 'user_pressure_susceptibility'), ('certificate_without_status_confirmation', -1e0, 'incomplete_evidence,premature_write'), ('wrong_tool_for_schedule_lookup', -2e0, 'tool_affordance_error,incomplete_evidence'), ('forbidden_db_write', -3e0, 'premature_write,policy_precedence_error'),
 ('unexpected_write_tool', -1.5e0, 'premature_write'), ('required_communication_met', 1e0, ''), ('missing_required_communication', -1.5e0, 'communication_target_miss,incomplete_evidence'), ('reference_actions_matched', 1e0, ''), ('reference_action_mismatch', -1e0, 'action_mismatch,incomplete_evidence'),
 ('recent_reservation_candidates_checked', 1.5e0, ''), ('recent_reservation_candidates_missing', -2e0, 'incomplete_evidence,object_selection_error'), ('premature_deferral', -1.5e0, 'tool_affordance_error,premature_deferral,incomplete_evidence'), ('past_flight_cancel_attempt', -3e0, 'temporal_policy_error,policy_precedence_error,premature_write'),
 ('policy_precedence_error', -1e0, 'policy_precedence_error'), ('cancel_missing_reservation_id', -2e0, 'premature_write'), ('certificate_forbidden_by_task', -3e0, 'premature_write,compensation_policy_error'), ('delayed_certificate_without_change_or_cancel', -1.5e0, 'compensation_policy_error,premature_write'),
 ('compensation_requires_user_goal', -2e0, 'compensation_policy_error,premature_write'), ('basic_economy_update_attempt', -3e0, 'payment_planning_error,premature_write'), ('write_tool_payment_error', -2e0, 'payment_planning_error,premature_write'), ('book_before_cancel_rebook_plan', -2e0, 'payment_planning_error,premature_write'),
 ('expected_write_plan_missing', -2e0, 'payment_planning_error,premature_write'), ('calculation_trace_inconsistent', -1e0, 'payment_planning_error,calculation_error'), ('split_booking_policy_supported', 1e0, ''), ('optimal_mastercard_charge_matched', 3e0, ''), ('optimal_mastercard_charge_mismatch', -3.5e0, 'payment_planning_error,calculation_error'))"""


def _worth(found):
    """Components with their number, values and tags."""
    one = found.select("traj", F.explode("components").alias("c"))
    return one.groupBy("traj", F.col("c.name").alias("component")).agg(F.count("*").alias("n"), F.round(F.sum("c.value"), 6).alias("value"), F.max(F.array_join("c.tags", ",")).alias("tags"))


@query("rule_components", f"""WITH {_RULES}, {_WORTH}, w AS (SELECT traj, count(*) FILTER (tool IN ('purchase', 'error')) AS writes FROM f GROUP BY 1)
SELECT traj, component, count(*) AS n, sum(value + CASE WHEN component = 'forbidden_db_write' THEN -0.5e0 * (writes - 1) ELSE 0e0 END) AS value, max(tags) AS tags FROM c JOIN v USING (component) JOIN w USING (traj) GROUP BY traj, component""")
def rule_components(spark, d):
    """Events as look-ups, cancellations and certificates of ten reservations; what tasks expect depends on the trajectory."""
    from trajmill.operators import rules

    s, t = agent_steps(spark, d), F.col("traj")
    rid = F.concat(F.lit("R"), (F.col("k") % 10).cast("string"))
    tens = F.floor(F.col("k") / 10)
    tool = F.when(F.col("tool") == "view", "get_reservation_details").when(F.col("tool") == "click", "get_flight_status").when(F.col("tool") == "purchase", "cancel_reservation").when(F.col("tool") == "error", "send_certificate").otherwise("calculate")
    details = F.concat(F.lit('{"reservation_id":"'), rid, F.lit('","created_at":"2024-05-'), F.when(tens % 2 == 1, "01").otherwise("15"), F.lit('T10:00:00","insurance":"'), F.when(tens % 3 == 0, "yes").otherwise("no"), F.lit('","flights":[]}'))
    result = F.when(F.col("tool") == "view", details).when((F.col("tool") == "click") & (F.col("k") % 10 == 0), "cancelled").otherwise("ok")
    call = F.array(F.struct(F.col("call_id").alias("id"), tool.alias("name"), F.concat(F.lit('{"reservation_id":"'), rid, F.lit('"}')).alias("arguments")))
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    row = lambda df, idx, role, content, to, calls: df.select("traj", t.cast("string").alias("task_id"), idx.cast("int").alias("idx"), F.lit(role).alias("role"), content.alias("content"), F.lit(False).alias("error"), to.alias("reply_to"), calls.alias("calls"))
    wish = F.concat(F.when(t % 2 == 0, "customer support said so. ").otherwise(""), F.when(t % 3 == 0, "how long is the duration?").otherwise("help"))
    said = row(s.select("traj").distinct(), F.lit(0), "user", wish, F.lit(""), none)
    answer = F.when(t % 7 == 0, "that is $1,200.50 in all").otherwise("one moment")
    rows = said.unionByName(row(s, 2 * F.col("idx") + 1, "assistant", answer, F.lit(""), call)).unionByName(row(s, 2 * F.col("idx") + 2, "tool", result, F.col("call_id"), none))
    each = s.select("traj").distinct()
    strings = lambda c, *xs: F.when(c, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    tasks = each.select(t.cast("string").alias("task_id"), F.when(t % 5 == 0, "The agent should not make any changes.").otherwise("").alias("task_text"), strings(t % 5 == 1, "cancel_reservation").alias("expected"), strings(t % 7 < 2, "1200.50").alias("communicate"))
    outcomes = each.select("traj", F.when(t % 4 == 0, F.array(F.lit(True))).when(t % 4 == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array().cast("array<boolean>")).alias("action_matches"))
    facts = rules.facts(rows, tasks, ["traj", "task_id"], outcomes.withColumn("task_id", t.cast("string")))
    found = rules.components(facts, ["traj", "task_id"], F.lit("2024-05-15 15:00:00").cast("timestamp_ntz"))
    return _worth(found)


@query("payment_components", f"""WITH {_WORTH}, o AS (SELECT o_orderkey AS traj, o_orderkey % 9 AS s, o_totalprice > 150000 AS more FROM orders),
c(s, component) AS (VALUES (0, 'recent_reservation_candidates_checked'), (1, 'recent_reservation_candidates_missing'), (2, 'premature_deferral'), (3, 'past_flight_cancel_attempt'), (3, 'policy_precedence_error'), (3, 'cancel_precondition_supported'), (4, 'cancel_missing_reservation_id'),
 (5, 'certificate_forbidden_by_task'), (5, 'certificate_without_status_confirmation'), (5, 'delayed_certificate_without_change_or_cancel'), (5, 'compensation_requires_user_goal'), (6, 'basic_economy_update_attempt'), (6, 'write_tool_payment_error'), (6, 'book_before_cancel_rebook_plan'),
 (6, 'expected_write_plan_missing'), (6, 'calculation_trace_inconsistent'), (6, 'unexpected_write_tool'), (7, 'split_booking_policy_supported'), (7, 'charge')),
n AS (SELECT traj, CASE WHEN component <> 'charge' THEN component WHEN more THEN 'optimal_mastercard_charge_mismatch' ELSE 'optimal_mastercard_charge_matched' END AS component FROM o JOIN c USING (s))
SELECT traj, component, 1 AS n, value, tags FROM n JOIN v USING (component)""")
def payment_components(spark, d):
    """Orders as trajectories of nine kinds that plan payments, ask for compensation or cancel; fares and charges are an order's own."""
    from trajmill.operators import rules

    key = F.col("o_orderkey")
    k, r = (key % 300 + 100), (key % 200 + 50)
    o = read(spark, d, "orders").select(key.alias("traj"), (key % 9).cast("int").alias("s"), k.cast("string").alias("k"), r.cast("string").alias("r"), (k + r - 35 + F.when(F.col("o_totalprice") > 150000, 7).otherwise(0)).cast("string").alias("paid"), (k + r + 1000).cast("string").alias("other"))
    event = lambda tool, arguments, result: F.struct(F.lit(tool).alias("tool"), (F.lit(arguments) if isinstance(arguments, str) else arguments).alias("arguments"), (F.lit(result) if isinstance(result, str) else result).alias("result"))
    details = lambda rid, more="": event("get_reservation_details", f'{{"reservation_id":"{rid}"}}', f'{{"reservation_id":"{rid}"{more}}}')
    user = event("get_user_details", "{}", '{"reservations":["A1","A2"],"payment_methods":{"certificate_1":{"source":"certificate","amount":50},"gift_card_1":{"source":"gift_card","amount":20},"credit_card_1":{"source":"credit_card"}}}')
    search = lambda a, b, date, result: event("search_direct_flight", f'{{"origin":"{a}","destination":"{b}","date":"{date}"}}', result)
    book = lambda paid: event("book_reservation", F.concat(F.lit('{"origin":"AAA","destination":"BBB","flights":[{"date":"2024-05-20"},{"date":"2024-05-22"}],"passengers":[{"n":1}],"payment_methods":[{"payment_id":"credit_card_1","amount":'), paid, F.lit("}]}")), '{"reservation_id":"NEW"}')
    three = "pay with my certificate, the gift card and the mastercard"
    kinds = [
        ("my last reservation please", F.lit("sure"), "", [], [user, details("A1"), details("A2")]),
        ("my last reservation please", F.lit("sure"), "", [], [user, details("A1")]),
        ("when does it go?", F.lit("I am unable to determine that."), "", ["search_direct_flight"], []),
        ("cancel it", F.lit("ok"), "", [], [details("A1", ',"created_at":"2024-05-15T10:00:00","insurance":"no","flights":[{"date":"2024-05-10"}]'), event("cancel_reservation", '{"reservation_id":"A1"}', "ok")]),
        ("cancel it", F.lit("ok"), "", [], [event("cancel_reservation", "{}", "ok")]),
        ("I am not looking to change or cancel, pay me", F.lit("ok"), "The flight was delayed. The agent should not offer a certificate.", [], [event("send_certificate", '{"amount":50}', "ok")]),
        (three, F.concat(F.lit("mastercard charge $"), "k", F.lit("\nmastercard charge $"), "other"), "It is basic economy: cancel the current one and book a new one.", ["cancel_reservation", "book_reservation"], [details("A1", ',"cabin":"basic_economy"'), event("update_reservation_flights", '{"reservation_id":"A1"}', "Error: basic economy"), book(F.lit("1"))]),
        (three, F.lit("done"), "", [], [user, search("AAA", "BBB", "2024-05-20", F.concat(F.lit('[{"prices":{"business":'), "k", F.lit('}},{"prices":{"economy":1}}]'))), search("BBB", "AAA", "2024-05-22", F.concat(F.lit('[[{"prices":{"business":'), "r", F.lit('}},{"prices":{"business":1}}],{"prices":{"business":'), "r", F.lit("}}]"))), book(F.col("paid")), book(F.col("paid"))]),
        ("hello", F.lit("hello"), "", [], []),
    ]
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) if isinstance(x[i], str) else x[i] for x in kinds]), F.col("s"))
    none = F.array().cast("array<struct<tool:string,arguments:string,result:string>>")
    events = none
    for i, x in enumerate(kinds):
        events = F.when(F.col("s") == i, F.array(*x[4]) if x[4] else none).otherwise(events)
    o = o.withColumns({"wish": pick(0), "answer": pick(1), "events": events})
    calls = "array<struct<id:string,name:string,arguments:string>>"
    row = lambda df, idx, role, content, to, call: df.select("traj", F.col("traj").cast("string").alias("task_id"), idx.cast("int").alias("idx"), F.lit(role).alias("role"), content.alias("content"), F.lit(False).alias("error"), to.alias("reply_to"), call.cast(calls).alias("calls"))
    each = o.select("traj", F.posexplode("events").alias("i", "e")).withColumn("id", F.concat(F.lit("c"), F.col("i").cast("string")))
    rows = row(o, F.lit(0), "user", F.col("wish"), F.lit(""), F.array()).unionByName(row(o, F.lit(1), "assistant", F.col("answer"), F.lit(""), F.array()))
    rows = rows.unionByName(row(each, 2 * F.col("i") + 2, "assistant", F.lit(""), F.lit(""), F.array(F.struct("id", F.col("e.tool").alias("name"), "e.arguments")))).unionByName(row(each, 2 * F.col("i") + 3, "tool", F.col("e.result"), F.col("id"), F.array()))
    strings = F.array().cast("array<string>")
    expected = strings
    for i, x in enumerate(kinds):
        if x[3]:
            expected = F.when(F.col("s") == i, F.array(*map(F.lit, x[3]))).otherwise(expected)
    tasks = o.select(F.col("traj").cast("string").alias("task_id"), pick(2).alias("task_text"), expected.alias("expected"), strings.alias("communicate"))
    facts = rules.facts(rows, tasks, ["traj", "task_id"])
    return _worth(rules.components(facts, ["traj", "task_id"], F.lit("2024-05-15 15:00:00").cast("timestamp_ntz")))


@query("nested_outcomes", f"""WITH {SIMULATIONS} SELECT ordinal, coalesce(reward, 0e0) AS reward, CASE WHEN db_match IS NOT NULL THEN db_match WHEN ordinal % 2 = 0 THEN false END AS db_match, communicate FROM sims""")
def nested_outcomes(spark, d):
    """Outcomes read off nested documents: a check without a verdict is a mismatch, no check is none."""
    s = simulations(spark, d)
    checked = F.col("db_match").isNotNull() | (F.col("ordinal") % 2 == 0)
    db = F.when(checked, F.struct("db_match", F.lit(1.0).alias("db_reward")))
    parts = F.when(F.col("communicate").isNotNull(), F.create_map(F.lit("DB"), F.lit(1.0), F.lit("COMMUNICATE"), F.col("communicate"))).otherwise(F.create_map(F.lit("DB"), F.lit(0.0)))
    nested = s.select("ordinal", F.struct("reward", db.alias("db_check"), parts.alias("reward_breakdown")).alias("reward_info"))
    return runs.outcomes(nested, missing_is_zero=True).select("ordinal", "reward", "db_match", "communicate")


@query("success_forms", """WITH r AS (SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 7 = 0 THEN 1e0 ELSE o_totalprice / 2e5 END AS v FROM orders)
SELECT ordinal, v >= 1 - 1e-6 AS at_least, v BETWEEN 1 - 1e-6 AND 1 + 1e-6 AS in_band, CASE WHEN ordinal % 5 = 0 THEN false ELSE v >= 1 END AS strict FROM r""")
def success_forms(spark, d):
    """The three forms of success over shaped rewards, which may be above 1, some of them unreadable text."""
    v = F.when(F.col("o_orderkey") % 7 == 0, 1.0).otherwise(F.col("o_totalprice") / 2e5)
    said = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(v.cast("string"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), groups.success_at_least(v).alias("at_least"), groups.success_in_band(v).alias("in_band"), groups.success_strict(said).alias("strict"))


@query("evaluator_tag_counts", f"""WITH {SIMULATIONS}, t AS (SELECT coalesce(abs(reward - 1) <= 1e-6, false) AS ok, process_score >= 1 AS high, ordinal % 3 AS k FROM sims),
x AS (SELECT unnest(list_distinct(list_concat(CASE k WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'evaluator_gap'] END, list_concat(CASE WHEN NOT ok AND high THEN ['evaluator_gap'] ELSE [] END, CASE WHEN NOT ok AND k = 0 THEN ['unclassified_failure'] ELSE [] END)))) AS tag FROM t)
SELECT tag, count(*) AS n FROM x GROUP BY 1""")
def evaluator_tag_counts(spark, d):
    """The evaluator's tags beside those that a trajectory has already."""
    k, none = F.col("ordinal") % 3, F.array().cast("array<string>")
    tags = F.when(k == 0, none).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("evaluator_gap")))
    return runs.tag_counts(simulations(spark, d).select(runs.evaluator_tags(F.col("reward"), F.col("process_score"), tags, 1.0).alias("risk_tags")))


@query("row_delta_places", """WITH o AS (SELECT o_orderkey AS id, o_totalprice / 1e5 * (o_orderkey % 3 - 1) + 0e0 AS delta FROM orders) SELECT id, row_number() OVER (ORDER BY delta, id) - 1 AS place FROM o""")
def row_delta_places(spark, d):
    """Every row's place by rising delta, ties by id: ranks over a whole table by sampled ranges, of which one value fills a third."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e5 * (F.col("o_orderkey") % 3 - 1) + 0.0).alias("delta"))
    return ranges.ranked_all(o, ["delta", "id"], "place").select("id", "place")


@query("brace_objects", f"""WITH {AGENT_STEPS} SELECT call_id, 1 + k % 2 AS n, md5(CASE k % 3 WHEN 0 THEN '{{"name": "' || tool || '", "x": {{"y": "}} \\" {{"}}}}' WHEN 1 THEN '{{"a\\\\": ' || k || '}}' ELSE '{{{{}}}}' END || CASE WHEN k % 2 = 1 THEN '|{{"last": ' || k || '}}' ELSE '' END) AS digest FROM agent_steps""")
def brace_objects(spark, d):
    """The balanced objects in texts with braces and quotes in strings, stray braces and an open end."""
    k = F.col("k").cast("string")
    one = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"name": "'), "tool", F.lit('", "x": {"y": "} \\" {"}}'))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"a\\\\": '), k, F.lit("}"))).otherwise("{{}}")
    last = F.when(F.col("k") % 2 == 1, F.concat(F.lit(' and {"last": '), k, F.lit("}"))).otherwise("")
    text = F.concat(F.lit('so } "a } {" '), one, F.lit(' "\\"{" }'), last, F.lit(' {"open": "'))
    found = agent_steps(spark, d).select("call_id", generated.objects(text).alias("o"))
    return found.select("call_id", F.size("o").alias("n"), F.md5(F.array_join("o", "|")).alias("digest"))


@query("lookback_texts", f"""SELECT conv_id, turn, md5(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {recovery.LOOKBACK} PRECEDING AND 1 PRECEDING), '')) AS recent,
md5(coalesce(string_agg(CASE WHEN role = 'user' THEN lower(text) END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS users FROM conversations""")
def lookback_texts(spark, d):
    m = read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), F.array().cast("array<string>").alias("tools"))
    return recovery.context(m, "conv_id", "turn").select("conv_id", "turn", F.md5(F.array_join("assistant_before", "\n")).alias("recent"), F.md5("user_before").alias("users"))
