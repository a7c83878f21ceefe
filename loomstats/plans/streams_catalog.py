"""Streaming queries over the events table, and exports and snapshots of batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import settings
from ..operators import events, logstats
from ..sources import exports
from ..sources.events import with_row_ids
from ..streaming import compaction, flows
from .adapters import EPISODE_GAP_MS, RAW_SQL, SPARK, TE_COLUMNS, TE_SQL, _BASE, _project, _split, table, tracked_events
from .events_catalog import ORACLES as EVENT_ORACLES
from .logs_catalog import _BY_SESSION, _DAILY, _HOURS, _LL, facts
from .sessions_catalog import _FLAGS, _WALK

C = F.col
# Longer than the span of the data: nothing is late.
NEVER_LATE = "60 days"
# The replayed stream: files of five days each, whose rows lie up to twelve hours on either side.
SLICE_MS, STRAY_MS, LATE = 5 * 86_400_000, 12 * 3_600_000, "6 days"
FILE_ROWS = 100_000


def _scratch(spark, name):
    """A new folder in the shared checkpoint directory."""
    settings.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def event_stream(spark, sf):
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = raw.selectExpr(*_split(_BASE)).selectExpr(*_project(TE_COLUMNS, SPARK))
    return rows.withColumn("ts", C("ts").cast("timestamp"))


def replay(spark, sf, name):
    """The events as files that arrive one after the other, rows out of order within and between them, their schema, the newest
    event and the number of files of a slice of time (the same for all)."""
    folder = _scratch(spark, name)
    events = tracked_events(spark, sf)
    first, last, newest, n = events.agg(F.min("ms"), F.max("ms"), F.max("ts"), F.count(F.lit(1))).first()
    stray = F.pmod(F.hash("seq"), F.lit(2 * STRAY_MS + 1)) - STRAY_MS
    at = F.greatest(F.lit(0), F.least(F.floor((C("ms") - first + stray) / SLICE_MS), F.lit((last - first) // SLICE_MS)))
    slices = (last - first) // SLICE_MS + 1
    files = max(1, round(n / slices / FILE_ROWS))
    # One pass over the events deals them to slices; each slice is then read alone.
    order = F.xxhash64("seq")
    events.withColumn("slice", at).repartition(files, order).write.partitionBy("slice").parquet(f"{folder}/slices")
    for number in range(slices):
        part = spark.read.schema(events.schema).parquet(f"{folder}/slices/slice={number}")
        part.repartition(files, order).sortWithinPartitions(order).write.mode("append").parquet(f"{folder}/in")
    return folder, events.schema, newest, files


def _replayed(spark, sf, name, flow, **conf):
    """Run a flow in append mode over the replayed files, a slice a micro-batch, and close the input behind them."""
    folder, schema, newest, files = replay(spark, sf, name)
    flows.flush(spark, f"{folder}/in", schema, newest, "400 DAYS")
    stream = flows.file_stream(spark, f"{folder}/in", schema, files=files)
    with flows.stateful(spark, **conf):
        return flows.run_available(flow(stream), f"{folder}/out", f"{folder}/checkpoint").drop("batch")


def _run(spark, flow, name, mode):
    folder = _scratch(spark, name)
    return flows.run_available(flow, f"{folder}/out", f"{folder}/checkpoint", mode)


def _rollup(spark, sf):
    result = _run(spark, flows.daily_rollup(event_stream(spark, sf), NEVER_LATE), "rollup", "update")
    return flows.latest(result, ["date"])


def _velocity(spark, sf):
    result = _run(spark, flows.typing_windows(event_stream(spark, sf), "1 hour", NEVER_LATE), "velocity", "update")
    return flows.latest(result, ["window_ms"])


def _sessions(spark, sf):
    return _replayed(spark, sf, "sessions", lambda events: flows.session_windows(events, "6 hours", LATE))


def _compaction(spark, sf):
    """Daily rows after all micro-batches, and which days have no raw rows left."""
    folder, schema, _, files = replay(spark, sf, "compaction")
    stream = flows.file_stream(spark, f"{folder}/in", schema, files=files)
    compactor = compaction.compact_stream(stream, f"{folder}/out", f"{folder}/checkpoint")
    return compactor.daily(schema).withColumn("retired", ~C("date").isin(compactor.raw_dates()))


def _dedup(spark, sf):
    stream = event_stream(spark, sf).select("ts", "session_id", "raw_text")
    flow = flows.dedup(stream, ["session_id", "raw_text"], NEVER_LATE).drop("ts")
    return _run(spark, flow, "dedup", "append").drop("batch")


def _ingest(spark, sf):
    folder = _scratch(spark, "ingest")
    # The second start finds nothing new: a replay adds no rows.
    for _ in range(2):
        flows.ingest(event_stream(spark, sf), f"{folder}/table", f"{folder}/checkpoint", True).awaitTermination()
    stored = spark.read.parquet(f"{folder}/table").withColumn("date", C("date").cast("string"))
    return events.daily_stats(stored)


def _episodes(spark, sf):
    return _replayed(
        spark, sf, "episodes", lambda events: flows.episodes(events, EPISODE_GAP_MS, LATE, 24 * flows.HOUR_MS),
        **{flows.STATE_STORE: flows.ROCKSDB},
    )


def _sections(spark, sf):
    log = facts(spark, sf)
    days = logstats.daily(log)
    rate = logstats.rate(C("accepted"), C("shown"))
    return [
        exports.Section(
            "By Date", days,
            {"Date": C("date"), "Shown": C("shown"), "Accepted": C("accepted"), "Rate": exports.percent(rate),
             "Chat": C("chat")}, C("date"),
        ),
        exports.Section(
            "Inline Completion Model", logstats.by_model(log),
            {"Model": C("model"), "Shown": C("shown"), "Accepted": C("accepted"), "Rate": exports.percent(rate)},
            C("model"), C("shown"),
        ),
        exports.Section(
            "Activity by Hour", logstats.hourly24(log),
            {"Hour": C("hour"), "Inline": C("inline"), "Chat": C("chat")}, C("hour"),
        ),
        exports.Section(
            "Sessions", logstats.by_session(log),
            {"Session": C("session_id"), "Shown": C("shown"), "Accepted": C("accepted"), "Rate": exports.percent(rate),
             "Chat": C("chat"), "Errors": C("errors")}, C("session_id"),
        ),
        exports.Section(
            "Errors by Type", logstats.errors_by_type(log), {"Error Type": C("error_type"), "Count": C("n")},
            C("error_type"), C("n"),
        ),
    ]


def _written(spark, lines, name):
    path = f"{_scratch(spark, name)}/report"
    exports.write_report(lines, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _snapshot(spark, sf):
    path = _scratch(spark, "snapshot")
    exports.save_snapshot({"daily": events.daily_stats(tracked_events(spark, sf))}, path)
    return exports.load_snapshot(spark, path, ["daily"])["daily"]


QUERIES = {
    "q_stream_daily_rollup": _rollup,
    "q_stream_velocity": _velocity,
    "q_stream_sessions": _sessions,
    "q_stream_compaction": _compaction,
    "q_stream_dedup": _dedup,
    "q_stream_ingest": _ingest,
    "q_stream_episodes": _episodes,
    "q_export_csv": lambda s, d: _written(s, exports.csv_report(_sections(s, d)), "csv"),
    "q_export_markdown": lambda s, d: _written(s, exports.markdown_report(_sections(s, d)), "markdown"),
    "q_export_json": lambda s, d: _written(s, exports.json_report(_sections(s, d)), "json"),
    "q_snapshot_roundtrip": _snapshot,
    "q_row_ids": lambda s, d: with_row_ids(tracked_events(s, d)).select("id", "seq", "ms"),
}

_RATE = "CASE WHEN shown > 0 THEN printf('%.1f', round(accepted / shown * 100, 1)) || '%' ELSE '' END"
_MODELS = (
    "models AS (SELECT model, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE accepted) AS accepted FROM ll "
    "WHERE shown OR accepted GROUP BY model)"
)
_REPORT = ", ".join([
    RAW_SQL, _LL, _DAILY, _HOURS, _MODELS, "sess AS (" + _BY_SESSION.format("session_id") + ")",
    "errs AS (SELECT err, count(*) AS n FROM ll WHERE err IS NOT NULL GROUP BY err)",
])


SECTIONS = [
    ("By Date", "Date,Shown,Accepted,Rate,Chat", ["date", "shown", "accepted", _RATE, "chat"], "daily"),
    ("Inline Completion Model", "Model,Shown,Accepted,Rate", ["model", "shown", "accepted", _RATE], "models"),
    ("Activity by Hour", "Hour,Inline,Chat", ["hour", "inline", "chat"], "hours"),
    ("Sessions", "Session,Shown,Accepted,Rate,Chat,Errors",
     ["session_id", "shown", "accepted", _RATE, "chat", "errors"], "sess"),
    ("Errors by Type", "Error Type,Count", ["err", "n"], "errs"),
]


def _report(heading: str, header, row) -> str:
    """Report lines in the given notation."""
    parts = []
    for title, columns, cells, source in SECTIONS:
        fixed = [heading + title, *header(columns.split(","))]
        parts += [f"SELECT '{line}' AS line" for line in fixed]
        parts.append(f"SELECT {row(cells)} AS line FROM {source}")
    return f"WITH {_REPORT} " + " UNION ALL ".join(parts)


def _json_report() -> str:
    """All sections as one JSON object per row; texts are quoted, numbers are not, missing cells are left out."""
    texts = {"Date", "Rate", "Model", "Hour", "Session", "Error Type"}
    parts = []
    for title, columns, cells, source in SECTIONS:
        fields = [
            f"'\"{name}\":' || " + (f"'\"' || {cell} || '\"'" if name in texts else cell)
            for name, cell in zip(columns.split(","), cells)
        ]
        row = "concat_ws(',', " + ", ".join(fields) + ")"
        parts.append(f"SELECT '{{\"section\":\"{title}\",\"row\":{{' || {row} || '}}}}' AS line FROM {source}")
    return f"WITH {_REPORT} " + " UNION ALL ".join(parts)


ORACLES = {
    "q_stream_daily_rollup": EVENT_ORACLES["q_daily_stats"],
    "q_stream_velocity": (
        f"WITH {TE_SQL} SELECT (ms // 3600000) * 3600000 AS window_ms, CAST(sum(chars_added) AS BIGINT) AS chars, "
        "count(*) FILTER (WHERE event_type = 'completionAccept') AS accepted FROM te GROUP BY 1"
    ),
    "q_stream_sessions": (
        f"WITH {TE_SQL}, g AS (SELECT session_id, ms, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000, true) "
        "AS opens, seq FROM te WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)), "
        "n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY session_id ORDER BY ms, seq) AS no FROM g) "
        "SELECT session_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS events FROM n GROUP BY session_id, no"
    ),
    "q_stream_compaction": (
        f"SELECT *, date < strftime(max(date::DATE) OVER () - 1, '%Y-%m-%d') AS retired FROM ({EVENT_ORACLES['q_daily_stats']})"
    ),
    "q_stream_dedup": f"WITH {TE_SQL} SELECT DISTINCT session_id, raw_text FROM te",
    "q_stream_ingest": EVENT_ORACLES["q_daily_stats"],
    "q_stream_episodes": (
        f"WITH RECURSIVE {TE_SQL}, {_FLAGS}, {_WALK} SELECT session_id, seq, ep AS episode_no FROM walk"
    ),
    "q_export_csv": _report(
        "# ", lambda names: [",".join(names)], lambda cells: "concat_ws(',', " + ", ".join(cells) + ")"
    ),
    "q_export_markdown": _report(
        "## ", lambda names: ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)],
        lambda cells: "'| ' || concat_ws(' | ', " + ", ".join(
            f"replace({c}, '_', '&#95;')" if c == "err" else c for c in cells) + ") || ' |'",
    ),
    "q_export_json": _json_report(),
    "q_snapshot_roundtrip": EVENT_ORACLES["q_daily_stats"],
    "q_row_ids": f"WITH {TE_SQL} SELECT row_number() OVER (ORDER BY ms, seq) - 1 AS id, seq, ms FROM te",
}
