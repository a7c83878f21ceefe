"""Queries over log lines. The lines are built from the events table and then parsed; the checking SQL starts from the
events themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logstats as stats
from ..operators import loglines as ops
from ..operators import sessions
from .adapters import AS_OF, RAW_SQL, raw_events, spread, table

C = F.col

_MODEL = (
    "CASE k % 7 WHEN 6 THEN 'model-6 -> dep-1' WHEN 5 THEN 'model-5-copilot' "
    "ELSE concat('model-', CAST(k % 7 AS STRING)) END"
)
_JSON_MODEL = f"CASE k % 7 WHEN 4 THEN 'model-4:2024' ELSE {_MODEL} END"
_ENGINE = "concat('model-', CAST(k % 7 AS STRING), CASE WHEN k % 7 = 5 THEN '-copilot' ELSE '' END)"
_MS = "CAST(CAST(floor(value) AS BIGINT) AS STRING)"
_INTENT = (
    "CASE k % 6 WHEN 0 THEN 'vscodePrompt' WHEN 1 THEN 'panel/unknown' WHEN 2 THEN 'tool/runSubagent' "
    "WHEN 3 THEN 'tool/searchSubagentTool' WHEN 4 THEN 'apply_patch' ELSE 'title' END"
)
_REQUEST = f"concat('ccreq:', CAST(event_id AS STRING), '.md | success | ', {_MODEL}, ' | ', {_MS}, 'ms | [', {{0}}, ']')"
_PREFIX = "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' [info] ')"
_JSON = (
    "concat('{\"event\":\"', CASE k % 3 WHEN 0 THEN 'ghost-text/shown' WHEN 1 THEN 'suggestion_accepted' "
    f"ELSE 'completion_rejected' END, '\",\"modelId\":\"', {_JSON_MODEL}, "
    "'\"', CASE WHEN k % 10 = 0 THEN concat(',\"totalTokens\":', CAST(2 * k AS STRING)) "
    "ELSE concat(',\"promptTokens\":', CAST(k AS STRING), "
    "CASE WHEN k % 4 = 0 THEN '' ELSE concat(',\"completionTokens\":', CAST(k + 1 AS STRING)) END) END, '}')"
)
_BODY = (
    f"CASE et WHEN 'purchase' THEN {_REQUEST.format(chr(39) + 'nes.nextCursorPosition' + chr(39))} "
    f"WHEN 'view' THEN {_REQUEST.format(chr(39) + 'XtabProvider' + chr(39))} "
    f"WHEN 'signup' THEN {_REQUEST.format(_INTENT)} WHEN 'click' THEN {_JSON} "
    "ELSE CASE WHEN k % 4 = 0 THEN concat('ccreq:', CAST(event_id AS STRING), ' | timeout | ') "
    "WHEN k % 2 = 0 THEN concat('ccreq:', CAST(event_id AS STRING), ' | CANCELLED | ') "
    f"ELSE concat('[fetchCompletions] Request to /v1/engines/', {_ENGINE}, '/completions finished with ', "
    f"CASE WHEN k % 5 = 0 THEN '200' WHEN k % 3 = 0 THEN '429' ELSE '500' END, ' status after ', {_MS}, 'ms') END END"
)
_T = "CAST(floor(k / 10) AS INT)"
_EXTRA = (
    "CASE k % 10 "
    f"WHEN 0 THEN concat('[streamChoices] solution 0 returned. finish reason: [', CASE {_T} % 3 WHEN 0 THEN 'Stop' "
    "WHEN 1 THEN 'length' ELSE 'Content_Filter' END, ']') "
    "WHEN 1 THEN '[ToolCallingLoop] Subagent stop hook result: shouldContinue=false' "
    "WHEN 2 THEN concat('RunInTerminalTool#CommandLineAutoApproveAnalyzer: Parsed sub-commands via bash grammar ', "
    "'[[\"ls -la\",\" cmd ', CAST(k AS STRING), ' \"],[\"\"],[\"git status\"]]') "
    f"WHEN 3 THEN concat('{{\"event\":\"', CASE WHEN {_T} % 4 = 3 THEN 'code.copy' ELSE 'chat/request' END, "
    f"'\",\"command\":\"', CASE {_T} % 5 WHEN 0 THEN '/fix' WHEN 1 THEN '/explain: code' WHEN 2 THEN '@workspace where' "
    "WHEN 3 THEN '/newnotebook x' ELSE ' /tests ' END, '\",\"sessionId\":\"c', CAST(user_id % 20 AS STRING), "
    "'\",\"totalTokens\":', CAST(2 * k AS STRING), ',\"note\":{\"topic\":\"Topic number ', CAST(k AS STRING), '\"}}') "
    f"WHEN 4 THEN CASE {_T} % 3 WHEN 0 THEN 'Running /compact now' "
    "WHEN 1 THEN 'context_limit_reached in session memory' ELSE 'truncating history compaction' END "
    f"WHEN 5 THEN CASE {_T} % 3 WHEN 0 THEN 'Browser tool: playwright run' WHEN 1 THEN 'taking screenshot' "
    "ELSE concat('browser_navigate https://example.com/', CAST(k AS STRING)) END "
    f"WHEN 6 THEN CASE {_T} % 3 WHEN 0 THEN '[plugin] loaded' WHEN 1 THEN concat('skill: helper-', CAST(k AS STRING)) "
    "ELSE 'tool_call executed' END "
    f"WHEN 7 THEN CASE {_T} % 3 WHEN 0 THEN 'agent-debug on' WHEN 1 THEN 'breakpoint hit' "
    "ELSE 'Step Execution resumed' END "
    f"WHEN 8 THEN CASE {_T} % 3 WHEN 0 THEN 'agent/plan draft' "
    "WHEN 1 THEN concat('workspace/editFile src/a', CAST(k AS STRING), '.ts') "
    "ELSE 'choice_selected strategy/propose' END "
    f"ELSE CASE WHEN {_T} % 2 = 0 THEN {_REQUEST.format(chr(39) + 'tool/runSubagent-x' + chr(39))} "
    "ELSE '[AsyncCompletionManager] request AbortError' END END"
)


def _lines(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    return spread(raw_events(spark, sf_dir)).selectExpr(
        "concat('u', CAST(user_id AS STRING)) AS session_id", "'main.log' AS file", "event_id AS block_start",
        "CAST(0 AS BIGINT) AS row", f"concat({_PREFIX}, {body}) AS line",
    )


def log_lines(spark, sf_dir):
    return _lines(spark, sf_dir, _BODY)


def extra_lines(spark, sf_dir):
    return _lines(spark, sf_dir, _EXTRA)


def facts(spark, sf_dir):
    return ops.log_facts(log_lines(spark, sf_dir))


def extra_facts(spark, sf_dir):
    return ops.log_facts(extra_lines(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


def _loops(spark, sf):
    return ops.agent_loops(extra_facts(spark, sf))


def _terminal(spark, sf):
    signals = ops.session_signals(extra_facts(spark, sf)).where(C("signal_type") == "command-executed")
    return signals.groupBy("raw_text").agg(F.count(F.lit(1)).alias("n"))


def _memory(spark, sf):
    features = ops.feature_signals(extra_facts(spark, sf)).where(C("category") == "memory")
    return ops.feature_counts(features).select("subtype", "seen", "in_total")


def _signals(spark, sf):
    lines = extra_lines(spark, sf)
    return ops.signal_events(lines, ops.log_facts(lines)).select(
        C("block_start").alias("seq"), "part", "session_id", "ms", "signal_type", "intent", "actor", "phase",
        "model_name", "latency_ms",
    )


def _titles(spark, sf):
    return ops.thread_titles(extra_lines(spark, sf)).select(
        "session_id", C("block_start").alias("seq"), C("raw_text").alias("title")
    )


QUERIES = {
    "q_log_daily": lambda s, d: stats.daily(facts(s, d)),
    "q_log_hourly24": lambda s, d: stats.hourly24(facts(s, d)),
    "q_hour_intensity": lambda s, d: _rounded(
        stats.hour_intensity(stats.hourly24(facts(s, d))), "inline_intensity", "chat_intensity"
    ),
    "q_log_by_model": lambda s, d: stats.by_model(facts(s, d)),
    "q_log_by_session": lambda s, d: stats.by_session(facts(s, d)),
    "q_title_fallback": lambda s, d: sessions.fallback_summaries(
        stats.by_session(facts(s, d).withColumn("session_id", F.concat(F.replace("date", F.lit("-")), F.lit("T"), "session_id")))
    ),
    "q_errors_by_type": lambda s, d: stats.errors_by_type(facts(s, d)),
    "q_intents": lambda s, d: stats.chat_intents(facts(s, d)),
    "q_log_totals": lambda s, d: _rounded(
        stats.totals(facts(s, d)), "avg_latency_ms", "avg_chat_latency_ms", "acceptance_rate"
    ),
    "q_latency_percentiles": lambda s, d: stats.latency_percentiles(facts(s, d)),
    "q_latency_histogram": lambda s, d: stats.latency_histogram(facts(s, d)),
    "q_token_totals": lambda s, d: stats.token_totals(facts(s, d)),
    "q_tokens_by_model": lambda s, d: stats.tokens_by_model(facts(s, d), 5),
    "q_grouping_sets_counts": lambda s, d: stats.counters(facts(s, d)),
    "q_timeline_anomaly": lambda s, d: _rounded(stats.timeline(stats.daily(facts(s, d))), "rate"),
    "q_weekly_trend": lambda s, d: _rounded(
        stats.weekly_trend(stats.daily(facts(s, d)), AS_OF), "this_rate", "last_rate", "rate_diff"
    ),
    "q_day_over_day": lambda s, d: _rounded(stats.day_over_day(stats.daily(facts(s, d))), "rate"),
    "q_insights": lambda s, d: stats.insights(facts(s, d), AS_OF),
    "q_period": lambda s, d: stats.recorded_period(stats.daily(facts(s, d)), 14),
    "q_available_range": lambda s, d: stats.available_range(stats.daily(facts(s, d))),
    "q_top_chat_model": lambda s, d: stats.top_chat_model(stats.chat_models(facts(s, d))),
    "q_subagent_requests": lambda s, d: stats.subagent_requests(facts(s, d)),
    "q_chat_state": lambda s, d: stats.chat_session_states(extra_facts(s, d)),
    "q_command_usage": lambda s, d: stats.command_usage(extra_facts(s, d)),
    "q_finish_reasons": lambda s, d: _rounded(stats.finish_reasons(extra_facts(s, d)), "share"),
    "q_loop_stops": lambda s, d: _loops(s, d).select(
        "session_id", C("block_start").alias("seq"), "start_date", "model", "duration_ms"
    ),
    "q_terminal_commands": _terminal,
    "q_memory_signals": _memory,
    "q_feature_signals": lambda s, d: ops.feature_counts(ops.feature_signals(extra_facts(s, d))),
    "q_log_signals": _signals,
    "q_log_titles": _titles,
    "q_prompt_size_by_source": lambda s, d: stats.context_sources(table(s, d, "documents")),
}

# What the lines say, stated on the events.
_LL = (
    "ll AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, "
    "'u' || user_id AS session_id, 'model-' || (k % 7) AS model, CAST(floor(value) AS DOUBLE) AS lat, "
    "et = 'view' OR (et = 'click' AND k % 3 = 0) OR (et = 'error' AND k % 2 = 1 AND k % 5 = 0) AS shown, "
    "et = 'purchase' OR (et = 'click' AND k % 3 = 1) AS accepted, et = 'signup' AS chat, "
    "CASE WHEN et <> 'error' OR (k % 2 = 1 AND k % 5 = 0) THEN NULL WHEN k % 4 = 0 THEN 'Timeout' "
    "WHEN k % 2 = 0 THEN 'Cancelled' WHEN k % 3 = 0 THEN 'HTTP 429' ELSE 'HTTP 500' END AS err, "
    "CASE WHEN et <> 'click' OR k % 10 = 0 THEN 0 ELSE k END AS pt, "
    "CASE WHEN et <> 'click' THEN 0 WHEN k % 10 = 0 THEN 2 * k WHEN k % 4 = 0 THEN 0 ELSE k + 1 END AS ctk, "
    "CASE WHEN et = 'signup' THEN CASE k % 6 WHEN 0 THEN 'Ask' WHEN 1 THEN 'Plan' WHEN 5 THEN 'Title' END END AS iname "
    "FROM raw)"
)
_DAILY = (
    "daily AS (SELECT date, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE accepted) AS accepted, "
    "count(*) FILTER (WHERE chat) AS chat FROM ll WHERE shown OR accepted OR chat GROUP BY date)"
)
_HOURS = (
    "hours AS (SELECT lpad(h::VARCHAR, 2, '0') AS hour, "
    "count(*) FILTER (WHERE (shown OR accepted) AND et <> 'click') AS inline, count(*) FILTER (WHERE chat) AS chat "
    "FROM generate_series(0, 23) g(h) LEFT JOIN ll ON ll.hour = lpad(h::VARCHAR, 2, '0') GROUP BY 1)"
)
_BY_SESSION = (
    "SELECT {0} AS session_id, count(*) FILTER (WHERE et = 'view' OR (et = 'error' AND k % 2 = 1)) AS shown, "
    "count(*) FILTER (WHERE et = 'purchase') AS accepted, count(*) FILTER (WHERE chat) AS chat, "
    "count(*) FILTER (WHERE err IS NOT NULL) AS errors FROM ll WHERE et <> 'click' GROUP BY 1"
)
_LAT = (
    "lat AS (SELECT CASE WHEN chat THEN 'chat' ELSE 'inline' END AS kind, lat AS v FROM ll "
    "WHERE lat > 0 AND (chat OR ((shown OR accepted) AND et <> 'click')))"
)
_TIMELINE = (
    "r AS (SELECT *, CASE WHEN shown > 0 THEN accepted / shown * 100 END AS rate FROM daily), "
    "b AS (SELECT avg(rate) AS m, stddev_pop(rate) AS s, count(*) AS n FROM "
    "(SELECT rate FROM r WHERE shown >= 10 ORDER BY date DESC LIMIT 14) q), "
    "z AS (SELECT r.*, m, CASE WHEN n >= 2 AND s > 0 AND shown >= 10 THEN (rate - m) / s END AS z FROM r, b)"
)
_WEEK = (
    "wk AS (SELECT coalesce(sum(shown) FILTER (WHERE d BETWEEN '2024-01-29' AND '2024-01-31'), 0)::BIGINT AS this_shown, "
    "coalesce(sum(accepted) FILTER (WHERE d BETWEEN '2024-01-29' AND '2024-01-31'), 0)::BIGINT AS this_accepted, "
    "coalesce(sum(chat) FILTER (WHERE d BETWEEN '2024-01-29' AND '2024-01-31'), 0)::BIGINT AS this_chat, "
    "coalesce(sum(shown) FILTER (WHERE d BETWEEN '2024-01-22' AND '2024-01-28'), 0)::BIGINT AS last_shown, "
    "coalesce(sum(accepted) FILTER (WHERE d BETWEEN '2024-01-22' AND '2024-01-28'), 0)::BIGINT AS last_accepted, "
    "coalesce(sum(chat) FILTER (WHERE d BETWEEN '2024-01-22' AND '2024-01-28'), 0)::BIGINT AS last_chat "
    "FROM (SELECT *, date AS d FROM daily) q), "
    "wr AS (SELECT *, CASE WHEN this_shown > 0 THEN this_accepted / this_shown * 100 ELSE 0 END AS this_rate, "
    "CASE WHEN last_shown > 0 THEN last_accepted / last_shown * 100 ELSE 0 END AS last_rate FROM wk), "
    "wd AS (SELECT *, CASE WHEN this_shown > 0 AND last_shown > 0 THEN this_rate - last_rate ELSE 0 END AS rate_diff "
    "FROM wr)"
)
_LX = (
    "lx AS (SELECT *, k // 10 AS t, 'u' || user_id AS session_id, strftime(ts, '%Y-%m-%d') AS date, "
    "(epoch_us(ts) // 1000) AS ms, 'model-' || (k % 7) AS model, CAST(floor(value) AS DOUBLE) AS lat FROM raw)"
)
_FEATURES = (
    "fs AS (SELECT CASE k % 10 WHEN 4 THEN 'memory' WHEN 5 THEN 'browser' WHEN 6 THEN 'plugin' ELSE 'debug' END AS category, "
    "CASE k % 10 WHEN 4 THEN CASE t % 3 WHEN 0 THEN 'compact' WHEN 1 THEN 'context-limit-reached' "
    "ELSE 'truncating-history' END WHEN 5 THEN CASE t % 3 WHEN 0 THEN 'playwright' WHEN 1 THEN 'screenshot' "
    "ELSE 'navigate' END WHEN 6 THEN CASE t % 3 WHEN 0 THEN 'plugin' WHEN 1 THEN 'helper-' || k ELSE 'tool-call' END "
    "ELSE CASE t % 3 WHEN 0 THEN 'agent-debug' WHEN 1 THEN 'breakpoint' ELSE 'step-execution' END END AS subtype "
    "FROM lx WHERE k % 10 IN (4, 5, 6, 7))"
)
_LOOPS = (
    "lp0 AS (SELECT *, coalesce(sum((k % 10 = 1)::INT) OVER (PARTITION BY session_id ORDER BY event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sno FROM lx), "
    "lp1 AS (SELECT session_id, sno, max(event_id) FILTER (WHERE k % 10 = 1) AS seq, "
    "max(ms) FILTER (WHERE k % 10 = 1) AS e, "
    "arg_min({'ms': ms, 'd': date, 'm': model}, event_id) FILTER (WHERE k % 10 = 9 AND t % 2 = 0) AS f "
    "FROM lp0 GROUP BY ALL HAVING count(*) FILTER (WHERE k % 10 = 1) > 0), "
    "loops AS (SELECT session_id, seq, f.d AS start_date, coalesce(f.m, '') AS model, "
    "coalesce(e - f.ms, 0) AS duration_ms, e AS ms FROM lp1)"
)


def _ll(*parts: str) -> str:
    return f"WITH {', '.join([RAW_SQL, _LL, *parts[:-1]])} {parts[-1]}"


def _lx(*parts: str) -> str:
    return f"WITH {', '.join([RAW_SQL, _LX, *parts[:-1]])} {parts[-1]}"


_COUNTER = "SELECT '{0}' AS dimension, {1} AS key, count(*) AS n FROM ll WHERE {2} GROUP BY 2"

ORACLES = {
    "q_log_daily": _ll(_DAILY, "SELECT * FROM daily"),
    "q_log_hourly24": _ll(_HOURS, "SELECT * FROM hours"),
    "q_hour_intensity": _ll(
        _HOURS,
        "SELECT hour, round(inline / greatest((SELECT max(inline) FROM hours), 1), 4) AS inline_intensity, "
        "round(chat / greatest((SELECT max(chat) FROM hours), 1), 4) AS chat_intensity FROM hours",
    ),
    "q_log_by_model": _ll(
        "SELECT model, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE accepted) AS accepted FROM ll "
        "WHERE shown OR accepted GROUP BY model"
    ),
    "q_log_by_session": _ll(_BY_SESSION.format("session_id")),
    "q_title_fallback": _ll(
        "s AS (" + _BY_SESSION.format("replace(date, '-', '') || 'T' || session_id") + ")",
        "SELECT session_id, left(session_id, 4) || '-' || substr(session_id, 5, 2) || '-' || substr(session_id, 7, 2) "
        "AS date, left(session_id, 4) || '-' || substr(session_id, 5, 2) || '-' || substr(session_id, 7, 2) AS title, "
        "shown + accepted + chat + errors AS total_actions, CAST(0 AS BIGINT) AS autonomous_ms FROM s",
    ),
    "q_errors_by_type": _ll("SELECT err AS error_type, count(*) AS n FROM ll WHERE err IS NOT NULL GROUP BY err"),
    "q_intents": _ll("SELECT iname AS name, count(*) AS n FROM ll WHERE iname IS NOT NULL GROUP BY iname"),
    "q_log_totals": _ll(
        _LAT,
        "SELECT count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE accepted) AS accepted, "
        "count(*) FILTER (WHERE et = 'click' AND k % 3 = 2) AS rejected, count(*) FILTER (WHERE chat) AS chat, "
        "count(err) AS errors, round((SELECT avg(v) FROM lat WHERE kind = 'inline'), 4) AS avg_latency_ms, "
        "round((SELECT avg(v) FROM lat WHERE kind = 'chat'), 4) AS avg_chat_latency_ms, "
        "round(count(*) FILTER (WHERE accepted) / count(*) FILTER (WHERE shown) * 100, 4) AS acceptance_rate FROM ll",
    ),
    "q_latency_percentiles": _ll(
        _LAT,
        "o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY v) AS rn, count(*) OVER (PARTITION BY kind) AS n "
        "FROM lat)",
        "SELECT kind, min(v) FILTER (WHERE rn >= ceil(n * 0.5)) AS p50, min(v) FILTER (WHERE rn >= ceil(n * 0.95)) AS p95, "
        "min(v) FILTER (WHERE rn >= ceil(n * 0.99)) AS p99 FROM o GROUP BY kind",
    ),
    "q_latency_histogram": _ll(
        _LAT,
        "b AS (SELECT * FROM (VALUES (0, '0-100ms', 0, 100), (1, '100-200ms', 100, 200), (2, '200-500ms', 200, 500), "
        "(3, '500ms-1s', 500, 1000), (4, '1-2s', 1000, 2000), (5, '2-5s', 2000, 5000), (6, '5s+', 5000, 1e18)) "
        "t(position, bucket, lo, hi)), kinds AS (SELECT unnest(['inline', 'chat']) AS kind)",
        "SELECT kinds.kind, position, bucket, count(v) AS n FROM b CROSS JOIN kinds LEFT JOIN lat "
        "ON lat.kind = kinds.kind AND v >= lo AND v < hi GROUP BY ALL",
    ),
    "q_token_totals": _ll(
        "SELECT sum(pt)::BIGINT AS prompt_tokens, sum(ctk)::BIGINT AS completion_tokens, "
        "sum(pt + ctk)::BIGINT AS total_tokens, "
        "floor(sum(pt) / count(*) FILTER (WHERE shown OR chat) + 0.5)::BIGINT AS avg_prompt_tokens FROM ll"
    ),
    "q_tokens_by_model": _ll(
        "SELECT model, sum(pt)::BIGINT AS prompt_tokens, sum(ctk)::BIGINT AS completion_tokens FROM ll WHERE pt + ctk > 0 "
        "GROUP BY model ORDER BY sum(pt + ctk) DESC, model LIMIT 5"
    ),
    "q_grouping_sets_counts": _ll(
        " UNION ALL ".join([
            _COUNTER.format("shown_by_date", "date", "shown"),
            _COUNTER.format("accepted_by_date", "date", "accepted"),
            _COUNTER.format("chat_by_date", "date", "chat"),
            _COUNTER.format("inline_by_hour", "hour", "(shown OR accepted) AND et <> 'click'"),
            _COUNTER.format("chat_by_hour", "hour", "chat"),
            _COUNTER.format("shown_by_model", "model", "shown"),
            _COUNTER.format("accepted_by_model", "model", "accepted"),
            _COUNTER.format("error", "err", "err IS NOT NULL"),
            _COUNTER.format("chat_intent", "iname", "iname IS NOT NULL"),
        ])
    ),
    "q_timeline_anomaly": _ll(
        _DAILY, _TIMELINE,
        "SELECT date, shown, accepted, chat, round(rate, 4) AS rate, coalesce(abs(z) > 2, false) AS is_anomaly, "
        "CASE WHEN abs(z) > 2 THEN printf('Acceptance rate is %.1f%% %s than usual (z-score: %.2f). Check model changes "
        "or environment configuration.', round(abs(rate - m), 1), CASE WHEN z < 0 THEN 'lower' ELSE 'higher' END, "
        "round(z, 2)) END AS anomaly_reason FROM z",
    ),
    "q_weekly_trend": _ll(
        _DAILY, _WEEK,
        "SELECT this_shown, this_accepted, this_chat, last_shown, last_accepted, last_chat, round(this_rate, 4) AS "
        "this_rate, round(last_rate, 4) AS last_rate, round(rate_diff, 4) AS rate_diff FROM wd",
    ),
    "q_day_over_day": _ll(
        _DAILY,
        "d AS (SELECT *, CASE WHEN shown > 0 THEN accepted / shown * 100 END AS rate FROM daily ORDER BY date DESC LIMIT 7), "
        "e AS (SELECT *, last_value(rate IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND "
        "1 PRECEDING) AS p FROM d)",
        "SELECT date, shown, accepted, chat, round(rate, 4) AS rate, CASE WHEN rate IS NULL OR p IS NULL THEN '' "
        "WHEN rate > p THEN '↑' WHEN rate < p THEN '↓' ELSE '→' END AS trend FROM e",
    ),
    "q_insights": _ll(
        _DAILY, _WEEK, _HOURS,
        "SELECT 1 AS position, printf('📈 This week''s acceptance %s than last week (%.1f%% vs %.1f%%).', "
        "CASE WHEN rate_diff > 0 THEN printf('rate is +%.1f%% higher', round(rate_diff, 1)) "
        "ELSE printf('rate is %.1f%% lower', round(rate_diff, 1)) END, round(this_rate, 1), round(last_rate, 1)) AS insight "
        "FROM wd WHERE this_shown > 0 AND last_shown > 0 AND rate_diff <> 0 UNION ALL "
        "SELECT 2, insight FROM (SELECT printf('⏰ Most active hour: %s:00 with %d completions.', hour, inline) AS insight "
        "FROM hours WHERE inline > 0 ORDER BY inline DESC, hour LIMIT 1) q UNION ALL "
        "SELECT 3, printf('💬 Chat usage ratio: %.1f%% of all interactions are chat requests.', "
        "round(count(*) FILTER (WHERE chat) / count(*) FILTER (WHERE chat OR shown) * 100, 1)) FROM ll",
    ),
    "q_period": _ll(
        _DAILY, "SELECT strftime(max(date)::DATE - 13, '%Y-%m-%d') AS start, max(date) AS \"end\" FROM daily"
    ),
    "q_available_range": _ll(_DAILY, "SELECT min(date) AS min_date, max(date) AS max_date FROM daily"),
    "q_top_chat_model": _ll(
        "SELECT model, count(*) AS n FROM ll WHERE chat GROUP BY model ORDER BY n DESC, model LIMIT 1"
    ),
    "q_subagent_requests": _ll(
        "SELECT CASE k % 6 WHEN 2 THEN 'runSubagent' ELSE 'searchSubagentTool' END AS tool, model, count(*) AS n FROM ll "
        "WHERE chat AND k % 6 IN (2, 3) GROUP BY 1, 2"
    ),
    "q_chat_state": _lx(
        "SELECT CASE WHEN k % 10 = 3 THEN 'c' || (user_id % 20) ELSE session_id END AS chat_session_id, "
        "count(*) FILTER (WHERE k % 10 = 9 OR t % 4 <> 3) AS turns, bool_or(k % 10 = 3 AND t % 4 = 3) AS accepted "
        "FROM lx WHERE k % 10 = 3 OR (k % 10 = 9 AND t % 2 = 0) GROUP BY 1"
    ),
    "q_command_usage": _lx(
        "SELECT CASE t % 5 WHEN 0 THEN '/fix' WHEN 1 THEN '/explain' WHEN 2 THEN '@workspace' ELSE '/tests' END AS command, "
        "count(*) AS n FROM lx WHERE k % 10 = 3 AND t % 5 <> 3 GROUP BY 1"
    ),
    "q_finish_reasons": _lx(
        "SELECT CASE t % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' ELSE 'content_filter' END AS finish_reason, "
        "count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS share FROM lx WHERE k % 10 = 0 GROUP BY 1"
    ),
    "q_loop_stops": _lx(_LOOPS, "SELECT session_id, seq, start_date, model, duration_ms FROM loops"),
    "q_terminal_commands": _lx(
        "SELECT c AS raw_text, count(*) AS n FROM (SELECT unnest(['ls -la', 'cmd ' || k, 'git status']) AS c FROM lx "
        "WHERE k % 10 = 2) q GROUP BY c"
    ),
    "q_memory_signals": _lx(
        _FEATURES, "SELECT subtype, count(*) AS seen, count(*) AS in_total FROM fs WHERE category = 'memory' GROUP BY 1"
    ),
    "q_feature_signals": _lx(
        _FEATURES, "SELECT category, subtype, count(*) AS seen, count(*) AS in_total FROM fs GROUP BY 1, 2"
    ),
    "q_log_signals": _lx(
        _LOOPS,
        "s AS ("
        "SELECT event_id AS seq, CAST(unnest([0, 1, 2]) AS INT) AS part, session_id, ms, 'command-executed' AS signal_type, "
        "'terminal/runCommand' AS intent, 'ai' AS actor, 'execution' AS phase, '' AS model_name, 0.0 AS lat FROM lx "
        "WHERE k % 10 = 2 UNION ALL "
        "SELECT event_id, 0, session_id, ms, 'thread-title', 'thread-title', 'system', 'planning', '', 0 FROM lx "
        "WHERE k % 10 = 3 UNION ALL "
        "SELECT event_id, 0, session_id, ms, 'memory-boundary', CASE t % 3 WHEN 0 THEN 'compact' "
        "WHEN 1 THEN 'context-limit-reached' ELSE 'truncating-history' END, 'system', 'memory', '', 0 FROM lx "
        "WHERE k % 10 = 4 UNION ALL "
        "SELECT event_id, 0, session_id, ms, 'chat-request', CASE t % 3 WHEN 0 THEN 'browser/playwright' "
        "WHEN 1 THEN 'browser/screenshot' ELSE 'browser/navigate' END, 'ai', 'research', '', 0 FROM lx "
        "WHERE k % 10 = 5 UNION ALL "
        "SELECT event_id, 0, session_id, ms, CASE t % 3 WHEN 1 THEN 'chat-request' ELSE 'plan-proposal' END, "
        "CASE t % 3 WHEN 0 THEN 'agent/plan' WHEN 1 THEN 'workspace/editfile' ELSE 'strategy/propose' END, 'ai', "
        "CASE t % 3 WHEN 1 THEN 'execution' ELSE 'planning' END, '', 0 FROM lx WHERE k % 10 = 8 UNION ALL "
        "SELECT event_id, 1, session_id, ms, 'user-choice', 'choice_selected', 'human', 'human', '', 0 FROM lx "
        "WHERE k % 10 = 8 AND t % 3 = 2 UNION ALL "
        "SELECT event_id, 0, session_id, ms, 'chat-request', 'tool/runSubagent-x', 'ai', 'execution', model, lat FROM lx "
        "WHERE k % 10 = 9 AND t % 2 = 0 UNION ALL "
        "SELECT seq, 0, session_id, ms, 'tool-loop-stop', 'tool-calling-loop-stop', 'system', 'execution', model, 0 "
        "FROM loops)",
        "SELECT seq, part, session_id, ms, signal_type, intent, actor, phase, model_name, CAST(lat AS DOUBLE) AS latency_ms "
        "FROM s",
    ),
    "q_log_titles": _lx(
        "SELECT session_id, event_id AS seq, 'Topic number ' || k AS title FROM lx WHERE k % 10 = 3"
    ),
    "q_prompt_size_by_source": (
        "SELECT source, count(*) AS entries, count(*) FILTER (WHERE length(text) > 0) AS prompts, "
        "CAST(sum(length(text)) AS BIGINT) AS prompt_chars FROM documents GROUP BY source"
    ),
}
