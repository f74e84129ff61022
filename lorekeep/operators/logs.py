"""Analytics over what a retrieval service logs: tool calls, tokens, questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.ranks import distribution
from lorekeep.plans.operator import coded, operator

#: Price per million tokens, in and out; unknown models get the default.
PRICES = {"deepseek-chat": (1.0, 2.0), "deepseek-v4-flash": (1.0, 2.0), "deepseek-reasoner": (4.0, 16.0)}
DEFAULT_PRICE = (1.0, 2.0)

_CALLS = "SELECT * FROM tool_audit WHERE coalesce(type, '') <> 'decision'"
_PRICES = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for m, (a, b) in PRICES.items()) + ") AS p(model, price_in, price_out)"
_COST = f"""SELECT t.*, (prompt_tokens * coalesce(price_in, {DEFAULT_PRICE[0]}) + completion_tokens * coalesce(price_out, {DEFAULT_PRICE[1]})) / 1000000 AS cost
  FROM token_log t LEFT JOIN ({_PRICES}) p ON t.model = p.model"""
_TRACES = lambda d: f"""SELECT coalesce(trace_id, 'unknown') AS trace_id, CAST({d.micros('max(ts)')} - {d.micros('min(ts)')} AS DOUBLE) / 1000 AS e2e_ms, count(ts) AS n
  FROM tool_audit GROUP BY coalesce(trace_id, 'unknown')"""  # noqa: E731


def _dist(x: str, src: str, prefix: str) -> str:
    """Mean, median and the element of sorted values at min(floor(0.95 n), n - 1), by rank."""
    return f"""SELECT round(avg({x}), 3) AS {prefix}_mean, round(median({x}), 6) AS {prefix}_median, round(max(CASE WHEN rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1 THEN {x} END), 6) AS {prefix}_p95, max(n) AS n
  FROM (SELECT {x}, row_number() OVER (ORDER BY {x}, id) AS rn, count(*) OVER () AS n FROM ({src}) s WHERE {x} IS NOT NULL) r"""


tool_summary = operator("agg_tool_summary", "Totals, success rate, retries and decisions of one audit log.", """
SELECT CAST(count_if(coalesce(type, '') <> 'decision') AS BIGINT) AS total_calls, CAST(count_if(coalesce(type, '') <> 'decision' AND success) AS BIGINT) AS success_calls,
  round(CAST(count_if(coalesce(type, '') <> 'decision' AND success) AS DOUBLE) / count_if(coalesce(type, '') <> 'decision'), 6) AS success_rate,
  CAST(count_if(retry_count > 0) AS BIGINT) AS retried, round(CAST(count_if(retry_count > 0) AS DOUBLE) / count_if(coalesce(type, '') <> 'decision'), 6) AS retry_rate,
  CAST(count_if(type = 'decision') AS BIGINT) AS decision_count FROM tool_audit""")
event_kind = operator("flt_event_kind", "Tool calls and decisions told apart, null-safe.", "SELECT event_id, CASE WHEN coalesce(type, '') <> 'decision' THEN 'call' ELSE 'decision' END AS kind FROM tool_audit")
sample_guard = operator("flt_sample_guard", "Flags for too few calls (30) or traces (10), per tool.", """
SELECT tool_name, count(*) AS calls, count(DISTINCT coalesce(trace_id, 'unknown')) AS traces, count(*) < 30 AS few_calls, count(DISTINCT coalesce(trace_id, 'unknown')) < 10 AS few_traces
FROM tool_audit WHERE coalesce(type, '') <> 'decision' GROUP BY tool_name""")


def _shown(d: DataFrame, p: str, *more: str) -> DataFrame:
    return d.select(*more, F.round("mean", 3).alias(f"{p}_mean"), F.round("median", 6).alias(f"{p}_median"), F.round("p95", 6).alias(f"{p}_p95"), "n")


@coded("agg_latency_dist", "Exact mean, median and P95 of call latency.", ["tool_audit"], _dist("latency_ms", f"SELECT *, event_id AS id FROM ({_CALLS})", "latency"))
def latency_dist(tool_audit: DataFrame) -> DataFrame:
    return _shown(distribution(tool_audit.where("coalesce(type, '') <> 'decision'").select(F.col("latency_ms").alias("v")), []), "latency")


@coded("agg_latency_by_tool", "The same for each tool and for all of them, in three scans.", ["tool_audit"], f"""
SELECT tool, round(avg(v), 3) AS latency_mean, round(median(v), 6) AS latency_median, round(max(CASE WHEN rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1 THEN v END), 6) AS latency_p95, count(v) AS n
FROM (SELECT tool, v, row_number() OVER (PARTITION BY tool ORDER BY v NULLS LAST) AS rn, count(v) OVER (PARTITION BY tool) AS n FROM (SELECT tool_name AS tool, latency_ms AS v FROM ({_CALLS}) a UNION ALL SELECT 'all tools', latency_ms FROM ({_CALLS}) b) c) e GROUP BY tool""")
def latency_by_tool(tool_audit: DataFrame) -> DataFrame:
    calls = tool_audit.where("coalesce(type, '') <> 'decision'").select(F.explode(F.array("tool_name", F.lit("all tools"))).alias("tool"), F.col("latency_ms").alias("v"))
    return _shown(distribution(calls, ["tool"]), "latency", "tool")


trace_e2e = operator("agg_trace_e2e", "End-to-end latency per trace: last minus first time, for traces with two or more.", lambda d: f"SELECT trace_id, round(e2e_ms, 3) AS e2e_ms, n FROM ({_TRACES(d)}) t WHERE n >= 2")


@coded("agg_trace_dist", "Distribution of end-to-end latencies, and traces of a single event.", ["tool_audit"],
    lambda d: f"SELECT * FROM ({_dist('e2e_ms', f'SELECT e2e_ms, trace_id AS id FROM ({_TRACES(d)}) t WHERE n >= 2', 'e2e')}) a CROSS JOIN (SELECT CAST(count_if(n < 2) AS BIGINT) AS single_event_traces FROM ({_TRACES(d)}) t) b")
def trace_dist(tool_audit: DataFrame) -> DataFrame:
    at = F.unix_micros("ts")
    traces = tool_audit.groupBy(F.coalesce("trace_id", F.lit("unknown")).alias("trace_id")).agg(((F.max(at) - F.min(at)).cast("double") / 1000).alias("e2e_ms"), F.count("ts").alias("n"))
    single = F.broadcast(traces.agg(F.count_if(F.col("n") < 2).alias("single_event_traces")))  # one row
    return _shown(distribution(traces.where("n >= 2").select(F.col("e2e_ms").alias("v")), []), "e2e").crossJoin(single)


by_tool = operator("agg_by_tool", "Calls, success rate and mean latency by tool.", """
SELECT tool_name, count(*) AS calls, CAST(count_if(success) AS BIGINT) AS success_calls, round(CAST(count_if(success) AS DOUBLE) / count(*), 6) AS success_rate, round(avg(latency_ms), 6) AS latency_mean
FROM tool_audit WHERE coalesce(type, '') <> 'decision' GROUP BY tool_name""")
qa_stats = operator("agg_qa_stats", "Question log totals, overall and by intent.", """
SELECT intent, count(*) AS total, round(avg(latency_ms), 6) AS latency_mean, round(avg(retrieved_docs_count), 6) AS docs_mean, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
  round(CAST(sum(prompt_tokens) + sum(completion_tokens) * 2 AS DOUBLE) / 1000000, 6) AS cost FROM qa_log GROUP BY GROUPING SETS ((intent), ())""")
price_join = operator("join_price", "Cost of each call from the rate card, with a default price.", f"SELECT event_id, model, round(cost, 6) AS cost FROM ({_COST}) c")
token_session = operator("agg_token_session", "Totals, duration and last call of each session.", lambda d: f"""
SELECT session_id, CAST(sum(prompt_tokens) AS BIGINT) AS total_input, CAST(sum(completion_tokens) AS BIGINT) AS total_output, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, round(sum(cost), 4) AS total_cost, count(*) AS call_count,
  round(CAST({d.micros('max(ts)')} - {d.micros('min(ts)')} AS DOUBLE) / 1000000, 1) AS duration_s, max_by(event_id, {d.micros('ts')} * 1000 + event_id % 1000) AS last_call FROM ({_COST}) c GROUP BY session_id""")
token_model = operator("agg_token_model", "Totals and calls by model.", f"SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS input, CAST(sum(completion_tokens) AS BIGINT) AS output, count(*) AS calls, round(sum(cost), 4) AS cost FROM ({_COST}) c GROUP BY model")
token_rollup = operator("agg_token_rollup", "Sessions by model, sessions and all time in one pass.", f"SELECT session_id, model, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, count(*) AS calls FROM ({_COST}) c GROUP BY ROLLUP (session_id, model)")
token_diff = operator("agg_token_diff", "Tokens since the last mark (a call of kind purchase) of a session.", lambda d: f"""
SELECT event_id, session_id, CAST(cum - coalesce({d.last("CASE WHEN call_site = 'purchase' THEN cum END", 'PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0) AS BIGINT) AS since_mark
FROM (SELECT *, sum(prompt_tokens + completion_tokens) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM token_log) c""")
recent_calls = operator("topk_recent_calls", "The newest 50 calls.", "SELECT event_id, session_id, model FROM token_log ORDER BY ts DESC, event_id DESC LIMIT 50")
audit_tail = operator("topk_audit", "Newest audit rows first, 100.", "SELECT event_id, tool_name, trace_id FROM tool_audit ORDER BY ts DESC, event_id DESC LIMIT 100")
stage_breakdown = operator("agg_stage_breakdown", "Means of the variants cold and hot by stage, saving and ratio.", """
SELECT stage, round(cold, 6) AS cold, round(hot, 6) AS hot, round(cold - hot, 6) AS saved, round(cold / nullif(hot, 0), 6) AS ratio
FROM (SELECT stage, avg(CASE WHEN variant = 'cold' THEN ms END) AS cold, avg(CASE WHEN variant = 'hot' THEN ms END) AS hot FROM stage_timings GROUP BY stage) s""",
    apart="SELECT c.stage, round(c.m, 6) AS cold, round(h.m, 6) AS hot, round(c.m - h.m, 6) AS saved, round(c.m / h.m, 6) AS ratio FROM (SELECT stage, avg(ms) AS m FROM stage_timings WHERE variant = 'cold' GROUP BY stage) c JOIN (SELECT stage, avg(ms) AS m FROM stage_timings WHERE variant = 'hot' GROUP BY stage) h ON c.stage = h.stage")
serial_parallel = operator("agg_serial_parallel", "Serial (sum) and parallel (max) cost of a trace's calls.", "SELECT coalesce(trace_id, 'unknown') AS trace_id, round(sum(latency_ms), 4) AS serial_ms, round(max(latency_ms), 6) AS parallel_ms FROM tool_audit WHERE latency_ms IS NOT NULL GROUP BY coalesce(trace_id, 'unknown')")
failure_runs = operator("win_failure_runs", "Runs of consecutive failures per destination; five or more open the breaker.", """
SELECT dest, run_start, length, length >= 5 AS opens FROM (
  SELECT dest, min_by(call_id, pos) AS run_start, count(*) AS length FROM (SELECT call_id, dest, failed, row_number() OVER (PARTITION BY dest ORDER BY ts, call_id) AS pos, row_number() OVER (PARTITION BY dest, failed ORDER BY ts, call_id) AS nth FROM destination_calls) x
  WHERE failed GROUP BY dest, pos - nth) y""",
    apart="""WITH placed AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY dest ORDER BY ts, call_id) AS well FROM destination_calls)
SELECT dest, arg_min(call_id, (ts, call_id)) AS run_start, count(*) AS length, count(*) >= 5 AS opens FROM placed WHERE failed GROUP BY dest, well""")
retry_collapse = operator("agg_retry_collapse", "Attempts of one call become one row with its retry count and last outcome.", """
SELECT call_id, count(*) - 1 AS retry_count, max_by(tool, attempt) AS tool, max_by(value, attempt) AS last_value, max_by(success, attempt) AS success FROM attempts GROUP BY call_id""",
    apart="SELECT call_id, n - 1 AS retry_count, tool, value AS last_value, success FROM (SELECT *, count(*) OVER (PARTITION BY call_id) AS n, row_number() OVER (PARTITION BY call_id ORDER BY attempt DESC) AS rn FROM attempts) a WHERE rn = 1")
dashboard = operator("agg_dashboard", "Counts that a dashboard shows.", """
SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'groups', count(*) FROM kb_groups UNION ALL SELECT 'users', count(*) FROM users UNION ALL SELECT 'searches', count(*) FROM qa_log""")
fmt_pct = operator("fn_fmt_pct", "A share as a percentage with one decimal, N/A where there is none.", lambda d: f"SELECT qid, config, coalesce({d.fmt('%.1f%%', 'context_recall * 100')}, 'N/A') AS recall FROM eval_scores WHERE context_recall IS NOT NULL UNION ALL SELECT qid, config, 'N/A' FROM eval_scores WHERE context_recall IS NULL")
try_ts = operator("fn_try_ts", "ISO times; what can't be read is null.", lambda d: f"SELECT event_id, coalesce({d.micros('try_cast(t AS TIMESTAMP)')}, -1) AS us FROM raw_times")
report_agent = operator("rpt_agent", "Markdown table of the by-tool aggregates.", lambda d: f"""
SELECT concat('| tool | calls | ok |', chr(10), '| --- | --- | --- |', chr(10), {d.agg_join("concat('| ', tool_name, ' | ', CAST(calls AS STRING), ' | ', CAST(ok AS STRING), ' |')", 'chr(10)', 'tool_name')}) AS report
FROM (SELECT tool_name, count(*) AS calls, count_if(success) AS ok FROM tool_audit WHERE coalesce(type, '') <> 'decision' GROUP BY tool_name) t""")
