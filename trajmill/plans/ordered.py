"""Queries over ordered steps and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajmill.operators import agent_loop
from trajmill.operators import datasets as ds
from trajmill.operators import trajectory as tr
from trajmill.plans.registry import query
from trajmill.functions import rewards
from trajmill.plans.surrogates import AGENT_STEPS, STEPS, agent_steps, read, steps

TAX = tr.Taxonomy(read=frozenset({"view", "click"}), write=frozenset({"purchase"}), escalation=frozenset({"error"}), think=frozenset({"signup"}))
_W = "WINDOW w AS (PARTITION BY traj ORDER BY idx)"
_SIG = "tool || chr(31) || lower(coalesce(args, ''))"


@query("redundant_steps", f"""WITH {STEPS}, s AS (SELECT *, CASE WHEN tool <> 'signup' THEN {_SIG} END AS sig FROM steps)
SELECT traj, idx, coalesce(tool <> 'signup' AND (sig = lag(sig, 1) OVER w IS TRUE OR sig = lag(sig, 2) OVER w IS TRUE OR sig = lag(sig, 3) OVER w IS TRUE), false) AS redundant FROM s {_W}""".replace("sig = lag(sig, 1) OVER w IS TRUE", "coalesce(sig = lag(sig, 1) OVER w, false)").replace("sig = lag(sig, 2) OVER w IS TRUE", "coalesce(sig = lag(sig, 2) OVER w, false)").replace("sig = lag(sig, 3) OVER w IS TRUE", "coalesce(sig = lag(sig, 3) OVER w, false)"))
def redundant_steps(spark, d):
    return steps(spark, d).select("traj", "idx", tr.redundant(F.col("tool"), F.col("args"), F.col("tool") == "signup").alias("redundant"))


@query("error_recovery", f"""WITH {STEPS}, s AS (SELECT *, {_SIG} AS sig FROM steps)
SELECT traj, idx, CASE WHEN coalesce(lag(is_error) OVER w, false) AND tool <> 'signup' THEN CASE WHEN lag(sig) OVER w = sig THEN 'repeated' ELSE 'recovered' END END AS outcome FROM s {_W}""")
def error_recovery(spark, d):
    return steps(spark, d).select("traj", "idx", tr.after_error(F.col("tool"), F.col("args"), F.col("is_error"), F.col("tool") == "signup").alias("outcome"))


@query("running_first_read", f"""WITH {STEPS}
SELECT traj, idx, tool IN ('view', 'click') AND row_number() OVER (PARTITION BY traj, tool ORDER BY idx) = 1 AS first_read,
  coalesce(max(CASE WHEN tool IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS read_before FROM steps""")
def running_first_read(spark, d):
    reads = TAX.has(F.col("tool"), "read")
    return steps(spark, d).select("traj", "idx", tr.first_of_its_kind(F.col("tool"), reads).alias("first_read"), tr.before_any(reads).alias("read_before"))


@query("rolling_mean", f"WITH {STEPS} SELECT traj, idx, round(avg(value) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM steps")
def rolling_mean(spark, d):
    return steps(spark, d).select("traj", "idx", F.round(tr.rolling_mean(F.col("value"), 5), 6).alias("mean"))


@query("asof_last_detail", f"WITH {STEPS} SELECT traj, idx, round(last_value(CASE WHEN tool = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS last_view FROM steps")
def asof_last_detail(spark, d):
    return steps(spark, d).select("traj", "idx", F.round(tr.as_of_before(F.when(F.col("tool") == "view", F.col("value"))), 6).alias("last_view"))


@query("forward_asof", f"WITH {STEPS} SELECT traj, idx, first_value(CASE WHEN tool = 'purchase' THEN idx END IGNORE NULLS) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM steps")
def forward_asof(spark, d):
    return steps(spark, d).select("traj", "idx", tr.next_after(F.when(F.col("tool") == "purchase", F.col("idx"))).alias("next_purchase"))


@query("seen_before", f"WITH {STEPS} SELECT traj, idx, coalesce(array_to_string(list_sort(list_distinct(list(tool) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), ','), '') AS tools FROM steps")
def seen_before(spark, d):
    return steps(spark, d).select("traj", "idx", F.array_join(tr.seen_before(F.col("tool")), ",").alias("tools"))


@query("reply_islands", f"WITH {STEPS} SELECT traj, idx, CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER w AS BIGINT) AS island FROM steps {_W}")
def reply_islands(spark, d):
    return steps(spark, d).select("traj", "idx", tr.island(F.col("is_error")).alias("island"))


@query("span_offsets", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS length FROM conversations")
def span_offsets(spark, d):
    n = F.length("text").cast("bigint")
    return read(spark, d, "conversations").select("conv_id", "turn", tr.offsets(n, "conv_id", "turn").alias("start"), n.alias("length"))


@query("turn_discount", f"""WITH {STEPS}, r AS (SELECT traj, idx, pow(0.9e0, count(*) OVER (PARTITION BY traj) - row_number() OVER (PARTITION BY traj ORDER BY idx)) AS raw FROM steps)
SELECT traj, idx, round(raw / avg(raw) OVER (PARTITION BY traj), 6) AS weight FROM r""")
def turn_discount(spark, d):
    return tr.turn_weights(steps(spark, d), 0.9).select("traj", "idx", F.round("weight", 6).alias("weight"))


@query("budget_trim", """WITH m AS (SELECT *, length(text) // 4 + 1 AS tok, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
c AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM m),
k AS (SELECT *, min(CASE WHEN role <> 'tool' OR turn = last THEN turn END) OVER (PARTITION BY conv_id) AS start FROM c WHERE suffix <= 120 OR turn = last)
SELECT conv_id, count(*) AS kept, min(turn) AS first_turn FROM k WHERE turn >= start GROUP BY 1""")
def budget_trim(spark, d):
    m = read(spark, d, "conversations").withColumn("tok", F.expr("length(text) div 4 + 1"))
    return tr.trimmed_to_budget(m, "tok", 120, "role", "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first_turn"))


_STEP = """y AS (SELECT *, k % 10 = 0 AS ph, k % 10 <> 0 AND coalesce(list_contains(list(CASE WHEN NOT is_error THEN found END) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k), false) AS ch FROM agent_steps),
b AS (SELECT *, tool || chr(31) || lower(coalesce(args, '')) AS sig, tool = 'signup' AS th, tool IN ('view', 'click') AS rd, tool = 'error' AS es, tool = 'purchase' AS wr, row_number() OVER w AS rn,
    coalesce(lag(is_error) OVER w, false) AS pe, coalesce(lag(tool) OVER w = 'signup', false) AS pt, lead(tool) OVER w AS nx,
    coalesce(max(CASE WHEN tool IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY traj ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS rb,
    row_number() OVER (PARTITION BY traj, tool ORDER BY idx) = 1 AS first, coalesce(lead(ph) OVER w, false) AS nph FROM y WINDOW w AS (PARTITION BY traj ORDER BY idx)),
c AS (SELECT *, CASE WHEN NOT th THEN sig END AS csig FROM b),
e AS (SELECT *, NOT th AND (coalesce(csig = lag(csig, 1) OVER w, false) OR coalesce(csig = lag(csig, 2) OVER w, false) OR coalesce(csig = lag(csig, 3) OVER w, false)) AS red, lag(sig) OVER w = sig AS same FROM c WINDOW w AS (PARTITION BY traj ORDER BY idx)),
f AS (SELECT *, coalesce(lead(red) OVER (PARTITION BY traj ORDER BY idx), false) AS nred FROM e),
sc AS (SELECT traj, th, rd, tool,
    CASE WHEN red THEN -0.03e0 ELSE 0e0 END + CASE WHEN pe AND NOT th THEN CASE WHEN same THEN -0.04e0 ELSE 0.05e0 END ELSE 0e0 END + CASE WHEN es THEN CASE WHEN rb THEN -0.05e0 ELSE -0.1e0 END ELSE 0e0 END
    + CASE WHEN rd AND first THEN 0.01e0 ELSE 0e0 END + CASE WHEN th AND NOT pt AND nx IS NOT NULL AND NOT nred AND NOT nph THEN 0.01e0 ELSE 0e0 END
    + CASE WHEN NOT th AND ph THEN CASE WHEN wr THEN -0.05e0 ELSE -0.03e0 END ELSE 0e0 END + CASE WHEN NOT th AND ch AND rn > 1 THEN CASE WHEN wr THEN 0.08e0 ELSE 0.04e0 END ELSE 0e0 END + CASE WHEN NOT th AND length(content) BETWEEN 1 AND 29 THEN -0.02e0 ELSE 0e0 END AS s FROM f),
t AS (SELECT traj, avg(s) AS m, count(*) AS n, count(*) FILTER (th) AS thoughts, count(DISTINCT CASE WHEN rd THEN tool END) AS reads FROM sc GROUP BY 1)"""


@query("process_score", f"""WITH {AGENT_STEPS}, {_STEP} SELECT traj, round(greatest(-0.5e0, least(0.5e0, m + CASE WHEN thoughts = 0 AND n >= 3 THEN -0.05e0 ELSE 0e0 END + CASE WHEN reads >= 3 THEN 0.01e0 ELSE 0e0 END - 0.01e0 * greatest(0, n - 16))), 6) AS process_score FROM t""")
def process_score(spark, d):
    df = agent_steps(spark, d).withColumn("params", rewards.text_parameters("args"))
    asked = F.filter(F.map_values("params"), lambda v: F.length(v) >= rewards.ENTITY_CHARS)
    df = tr.chained(df, asked, rewards.entity_strings("reply")).withColumn("placeholder", rewards.has_placeholder(F.col("params")))
    return tr.process_scores(df, TAX).withColumn("process_score", F.round("process_score", 6))


@query("prefix_samples", """WITH m AS (SELECT conv_id, role, row_number() OVER w - 1 AS i, string_agg(role || ':' || text, chr(30)) OVER w AS prefix FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id || '_t_' || i AS id, i + 1 AS n_messages, md5(prefix) AS digest, repeat('0', CAST(i AS BIGINT)) || '1' AS mask FROM m WHERE role = 'assistant'""")
def prefix_samples(spark, d):
    convs = ds.collected(read(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\x1e")
    mask = F.array_join(F.transform("loss_mask", lambda k: k.cast("int").cast("string")), "")
    return ds.prefix_samples(convs, "conv_id").select("id", F.size("messages").cast("bigint").alias("n_messages"), F.md5(text).alias("digest"), mask.alias("mask"))


@query("loss_mask_check", """WITH m AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CASE WHEN role <> 'assistant' THEN 'last_not_assistant,target_not_assistant' ELSE '' END AS errors FROM m WHERE i = n""")
def loss_mask_check(spark, d):
    convs = ds.collected(read(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])
    return convs.select("conv_id", F.array_join(ds.structure_errors(F.col("messages"), ds.last_only_mask(F.col("messages"))), ",").alias("errors"))


@query("reject_reasons", """SELECT coalesce(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN turn = 0 THEN 'greeting' WHEN length(text) > 300 THEN 'too_long' WHEN role <> 'assistant' THEN 'not_assistant' END, 'clean') AS reason, count(*) AS n FROM conversations GROUP BY 1""")
def reject_reasons(spark, d):
    text = F.col("text")
    reason = ds.first_reason({"empty": text.isNull() | (F.trim(text) == ""), "greeting": F.col("turn") == 0, "too_long": F.length(text) > 300, "not_assistant": F.col("role") != "assistant"})
    return read(spark, d, "conversations").groupBy(F.coalesce(reason, F.lit("clean")).alias("reason")).agg(F.count("*").alias("n"))


@query("sample_profile", """WITH c AS (SELECT role, length(text) AS v FROM conversations), l AS (SELECT role, list_sort(list(v)) AS s, count(*) AS n, avg(v) AS mean, max(v) AS max FROM c GROUP BY 1)
SELECT role, n, round(mean, 6) AS mean, max, s[CAST(round_even((n - 1) * 0.5e0, 0) AS BIGINT) + 1] AS p50, s[CAST(round_even((n - 1) * 0.9e0, 0) AS BIGINT) + 1] AS p90 FROM l""")
def sample_profile(spark, d):
    df = read(spark, d, "conversations").select("role", F.length("text").cast("bigint").alias("v"))
    return ds.profile(df, "role", "v").withColumn("mean", F.round("mean", 6))


@query("interval_overlap_tokens", """SELECT conv_id, count(*) FILTER (len > 0 AND ((s < 200 AND s + len > 100) OR (s < 600 AND s + len > 500))) AS hits FROM (
  SELECT conv_id, length(text) AS len, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations) GROUP BY 1""")
def interval_overlap_tokens(spark, d):
    n = F.length("text").cast("bigint")
    df = read(spark, d, "conversations").select("conv_id", tr.offsets(n, "conv_id", "turn").alias("s"), n.alias("len"))
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((100, 200), (500, 600))])
    return df.groupBy("conv_id").agg(F.count_if(ds.overlaps(F.col("s"), F.col("s") + F.col("len"), spans)).alias("hits"))


_CAPS = agent_loop.Caps(response=1500, assistant_turns=20, user_turns=12, errors=6)


@query("agent_loop_states", f"""WITH RECURSIVE {STEPS}, k AS (SELECT *, CAST(json_extract_string(args, '$.k') AS INTEGER) AS k, idx % 2 = 0 AND tool <> 'signup' AS calls FROM steps),
e AS (SELECT traj, idx, CASE WHEN k = 7 THEN NULL WHEN idx % 2 = 0 THEN 'assistant' WHEN lag(calls) OVER w THEN 'tool' ELSE 'user' END AS kind, calls, k < 10 AS stop, k AS tokens, CAST(tool = 'error' AS INTEGER) AS errors FROM k {_W}),
f AS (SELECT DISTINCT traj, CAST(-1 AS BIGINT) AS idx, 'pending' AS state, 'max_steps' AS termination, 0 AS n_a, 0 AS n_u, 0 AS n_e, 0 AS n_r, 0 AS n_t FROM e
UNION ALL SELECT traj, idx, CASE WHEN a THEN CASE WHEN full_ OR n_a + 1 >= {_CAPS.assistant_turns} THEN 'terminated' WHEN calls THEN 'processing_tools' ELSE 'processing_user' END
 WHEN t THEN CASE WHEN full_ OR n_e + errors >= {_CAPS.errors} THEN 'terminated' ELSE 'generating' END WHEN u THEN CASE WHEN stop OR full_ OR n_u + 1 >= {_CAPS.user_turns} THEN 'terminated' ELSE 'generating' END ELSE 'terminated' END,
 CASE WHEN u AND stop THEN 'user_stop' WHEN t AND NOT full_ AND n_e + errors >= {_CAPS.errors} THEN 'too_many_errors' ELSE 'max_steps' END,
 n_a + CAST(a AS INTEGER), n_u + CAST(u AND NOT stop AND NOT full_ AS INTEGER), n_e + CASE WHEN t THEN errors ELSE 0 END, n_r + CASE WHEN a OR (t AND NOT full_) OR (u AND NOT stop AND NOT full_) THEN tokens ELSE 0 END, n_t + CASE WHEN a THEN tokens ELSE 0 END
 FROM (SELECT f.traj, e.idx, e.calls, e.stop, e.tokens, e.errors, f.n_a, f.n_u, f.n_e, f.n_r, f.n_t, coalesce(e.kind = 'assistant', false) AND f.state IN ('pending', 'generating') AS a, coalesce(e.kind = 'tool', false) AND f.state = 'processing_tools' AS t,
  coalesce(e.kind = 'user', false) AND f.state = 'processing_user' AS u, f.n_r + e.tokens >= {_CAPS.response} AS full_ FROM f JOIN e ON e.traj = f.traj AND e.idx = f.idx + 1 WHERE f.state <> 'terminated'))
SELECT traj, arg_max(state, idx) AS state, arg_max(termination, idx) AS termination, max(idx) + 1 AS events, CAST(max(n_a) AS BIGINT) AS assistant_turns, CAST(max(n_u) AS BIGINT) AS user_turns, CAST(max(n_e) AS BIGINT) AS errors, CAST(max(n_r) AS BIGINT) AS response_length, CAST(max(n_t) AS BIGINT) AS trained_tokens FROM f GROUP BY 1""")
def agent_loop_states(spark, d):
    """Events as turns: an assistant's and a reply to it by turns, from the tools if it called some; the state each trajectory is left in."""
    k = F.get_json_object("args", "$.k").cast("int")
    s = steps(spark, d).withColumns({"k": k, "calls": (F.col("idx") % 2 == 0) & (F.col("tool") != "signup")})
    before = F.lag("calls").over(Window.partitionBy("traj").orderBy("idx"))
    kind = F.when(F.col("k") == 7, None).when(F.col("idx") % 2 == 0, "assistant").when(before, "tool").otherwise("user")
    turns = s.select("traj", "idx", kind.alias("kind"), "calls", (F.col("k") < 10).alias("stop"), F.col("k").alias("tokens"), (F.col("tool") == "error").cast("int").alias("errors"))
    return agent_loop.fold(turns, "traj", "idx", _CAPS)
