"""Queries over tracked events: rollups, baselines, cross-tabs and velocity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ops
from .adapters import AS_OF, TE_SQL, tracked_events

C = F.col
HOUR_MS = 3_600_000
# Events before this instant count as already compacted (2024-01-20T00:00Z).
COMPACT_MS = 1_705_708_800_000


def _report(spark, sf):
    events = tracked_events(spark, sf)
    rolled, fresh = ops.compact(events, COMPACT_MS)
    return ops.anomaly_report(ops.daily_accepts(fresh, rolled), AS_OF)


def _baseline(spark, sf):
    rolled, fresh = ops.compact(tracked_events(spark, sf), COMPACT_MS)
    row = ops.baseline(ops.daily_accepts(fresh, rolled))
    return row.select(F.round("mean", 4).alias("mean"), F.round("std_dev", 4).alias("std_dev"), "sample_size")


def _model_language(spark, sf):
    return ops.model_language(tracked_events(spark, sf)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


def _velocity(spark, sf):
    return ops.velocity(tracked_events(spark, sf), HOUR_MS).withColumn("kpm", F.round("kpm", 4))


def _velocity_summary(spark, sf):
    summary = ops.velocity_summary(ops.velocity(tracked_events(spark, sf), HOUR_MS))
    return summary.withColumn("average_kpm", F.round("average_kpm", 4))


def _by_type(spark, sf):
    return ops.events_by_type(tracked_events(spark, sf), "completionAccept").select(
        "seq", "session_id", "ms", "language_id", "model_name", "accepted_characters", "latency_ms", "file_path"
    )


QUERIES = {
    "q_model_language": _model_language,
    "q_best_model": lambda s, d: ops.best_model(ops.model_language(tracked_events(s, d))),
    "q_sessions": lambda s, d: ops.sessions(tracked_events(s, d)),
    "q_file_metadata": lambda s, d: ops.file_metadata(tracked_events(s, d)),
    "q_events_by_type": _by_type,
    "q_daily_stats": lambda s, d: ops.daily_stats(tracked_events(s, d)),
    "q_compacted_daily": lambda s, d: ops.merge_daily(
        ops.compact(tracked_events(s, d), COMPACT_MS)[0],
        ops.daily_stats(ops.compact(tracked_events(s, d), COMPACT_MS)[1]),
    ),
    "q_baseline_14d": _baseline,
    "q_anomaly_accepts": _report,
    "q_anomaly_banner": lambda s, d: ops.latest_anomaly(_report(s, d)),
    "q_usage_summary": lambda s, d: ops.usage_summary(tracked_events(s, d), AS_OF),
    "q_top_languages": lambda s, d: ops.top_languages(tracked_events(s, d), AS_OF),
    "q_velocity": _velocity,
    "q_velocity_summary": _velocity_summary,
    "q_event_dates": lambda s, d: ops.event_dates(tracked_events(s, d)),
}

_CROSS = (
    "ct AS (SELECT CASE WHEN model_name = '' THEN 'unknown' ELSE model_name END AS model_name, "
    "CASE WHEN language_id = '' THEN 'unknown' ELSE language_id END AS language_id, count(*) AS total_accepted, "
    "CAST(sum(accepted_characters) AS BIGINT) AS total_chars_accepted, round(avg(latency_ms), 4) AS avg_latency_ms "
    "FROM te WHERE event_type = 'completionAccept' GROUP BY 1, 2)"
)
_DAILY = "daily AS (SELECT date, count(*) AS accepted FROM te WHERE event_type = 'completionAccept' GROUP BY date)"
_BASE = (
    "base AS (SELECT avg(accepted) AS mean, stddev_pop(accepted) AS std_dev, count(*) AS sample_size "
    "FROM (SELECT * FROM daily ORDER BY date DESC LIMIT 14) t)"
)
_REPORT = (
    "report AS (SELECT date, accepted, z_score, coalesce(abs(z_score) > 2, false) AS is_anomaly, "
    "CASE WHEN abs(z_score) > 2 THEN CASE WHEN z_score < 0 THEN 'lower' ELSE 'higher' END END AS direction FROM "
    "(SELECT date, accepted, CASE WHEN sample_size >= 2 AND std_dev > 0 AND accepted >= 3 "
    "THEN round((accepted - mean) / std_dev, 2) END AS z_score FROM daily, base WHERE date >= '2024-01-17') t)"
)
_DAILY_STATS = (
    "SELECT date, count(*) FILTER (WHERE event_type = 'completionAccept') AS total_accepted, "
    "CAST(sum(chars_added) AS BIGINT) AS total_chars_added, CAST(sum(chars_deleted) AS BIGINT) AS total_chars_deleted, "
    "CAST(sum(accepted_characters) AS BIGINT) AS total_accepted_characters FROM te GROUP BY date"
)
_VELOCITY = (
    "b AS (SELECT min(ms) AS low, max(ms) AS high FROM te), "
    "w AS (SELECT unnest(generate_series(0, (high - low) // 3600000)) AS win, low FROM b), "
    "c AS (SELECT (ms - low) // 3600000 AS win, "
    "sum(CASE WHEN event_type = 'textChange' THEN chars_added ELSE 0 END) AS chars, "
    "count(*) FILTER (WHERE event_type = 'completionAccept') AS accepted FROM te, b GROUP BY 1), "
    "s AS (SELECT w.low + w.win * 3600000 AS window_ms, coalesce(chars, 0) / 60.0 AS kpm, "
    "coalesce(accepted, 0) AS accepted FROM w LEFT JOIN c USING (win)), "
    "v AS (SELECT *, accepted > 0 AND kpm < (SELECT avg(kpm) FROM s) * 0.6 AS flow_disrupted FROM s)"
)


def _te(*parts: str) -> str:
    return f"WITH {', '.join([TE_SQL, *parts[:-1]])} {parts[-1]}"


ORACLES = {
    "q_model_language": _te(_CROSS, "SELECT * FROM ct"),
    "q_best_model": _te(
        _CROSS,
        "SELECT language_id, model_name, total_accepted FROM (SELECT *, row_number() OVER (PARTITION BY language_id "
        "ORDER BY total_accepted DESC, model_name) AS rn FROM ct) t WHERE rn = 1",
    ),
    "q_sessions": _te("SELECT session_id, min(ms) AS started_ms, max(ms) AS ended_ms FROM te GROUP BY session_id"),
    "q_file_metadata": _te(
        "SELECT file_path, first(language_id ORDER BY ms, seq) AS language_id, "
        "count(*) FILTER (WHERE event_type = 'textChange') AS total_edits, "
        "count(*) FILTER (WHERE event_type = 'completionAccept') AS total_accepted_completions, "
        "CAST(sum(accepted_characters) AS BIGINT) AS total_accepted_characters "
        "FROM te WHERE file_path <> '' GROUP BY file_path"
    ),
    "q_events_by_type": _te(
        "SELECT seq, session_id, ms, language_id, model_name, accepted_characters, latency_ms, file_path FROM te "
        "WHERE event_type = 'completionAccept'"
    ),
    "q_daily_stats": _te(_DAILY_STATS),
    "q_compacted_daily": _te(_DAILY_STATS),
    "q_baseline_14d": _te(
        _DAILY, _BASE, "SELECT round(mean, 4) AS mean, round(std_dev, 4) AS std_dev, sample_size FROM base"
    ),
    "q_anomaly_accepts": _te(_DAILY, _BASE, _REPORT, "SELECT * FROM report"),
    "q_anomaly_banner": _te(
        _DAILY, _BASE, _REPORT,
        "SELECT count(*) FILTER (WHERE is_anomaly) AS anomalies, max(date) FILTER (WHERE is_anomaly) AS latest_date, "
        "arg_max(z_score, date) FILTER (WHERE is_anomaly) AS latest_z FROM report",
    ),
    "q_usage_summary": _te(
        "SELECT CAST(14 AS BIGINT) AS days, count(*) AS total_accepted, "
        "CAST(sum(accepted_characters) AS BIGINT) AS total_chars_accepted FROM te "
        "WHERE event_type = 'completionAccept' AND date >= '2024-01-17'"
    ),
    "q_top_languages": _te(
        "SELECT CASE WHEN language_id = '' THEN 'unknown' ELSE language_id END AS language, count(*) AS accepted FROM te "
        "WHERE event_type = 'completionAccept' AND date >= '2024-01-17' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
    ),
    "q_velocity": _te(_VELOCITY, "SELECT window_ms, round(kpm, 4) AS kpm, accepted, flow_disrupted FROM v"),
    "q_velocity_summary": _te(
        _VELOCITY,
        "SELECT round(avg(kpm), 4) AS average_kpm, count(*) FILTER (WHERE flow_disrupted) AS disruptions, "
        "count(*) AS windows FROM v",
    ),
    "q_event_dates": _te("SELECT DISTINCT date FROM te"),
}
