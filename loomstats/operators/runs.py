"""Permissions, multi-phase runs, subagents and other diagnostics of CLI sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .ordered import Sequence
from .usage import first_per_key, known_sum

C = F.col

# What a run's completion is reconciled on.
RUN_FIELDS = ["request_count", "input_tokens", "output_tokens", "cached_tokens", "cache_write_tokens", "nano"]
HUMAN, POLICY = "human_response", "host_policy"


# --- Permissions -----------------------------------------------------------------------------------------------------


def permissions(events: DataFrame, tool_names: DataFrame) -> DataFrame:
    """One row per permission request, from the first request and the first response event of its id.

    `events`: session_id, request_id, time, seq, kind (request, response), ms (nullable), permission_kind, call_id,
    tool_name, decision_source, result. `tool_names`: session_id, call_id, time, seq, tool_name.
    """
    at = F.struct("time", "seq")
    asked, told = C("kind") == "request", C("kind") == "response"
    request = F.min_by(F.struct("ms", "permission_kind", "call_id", "tool_name"), F.when(asked, at))
    response = F.min_by(F.struct("ms", "call_id", "decision_source", "result"), F.when(told, at))
    grouped = events.groupBy("session_id", "request_id").agg(
        request.alias("q"), response.alias("a"),
        F.min(F.when(asked, at)).alias("asked_at"), F.min(F.when(told, at)).alias("told_at"),
    )
    # A request sets the call, also over an earlier response; a later response only fills in a missing one.
    call_id = F.when(C("asked_at") > C("told_at"), C("q.call_id")).otherwise(F.coalesce("q.call_id", "a.call_id"))
    rows = grouped.select(
        "session_id", "request_id", C("q.permission_kind").alias("permission_kind"), call_id.alias("call_id"),
        C("q.tool_name").alias("own_name"), C("q.ms").alias("requested_ms"), C("a.ms").alias("responded_ms"),
        F.when(C("a.decision_source").isin(HUMAN, POLICY), C("a.decision_source")).alias("decision_source"),
        F.when(C("a.result").isin("approved", "cancelled"), C("a.result")).alias("result"),
        C("asked_at").isNotNull().alias("request_recorded"), C("told_at").isNotNull().alias("response_recorded"),
    )
    last_names = tool_names.where(C("call_id").isNotNull() & C("tool_name").isNotNull()).groupBy(
        "session_id", "call_id"
    ).agg(F.max_by("tool_name", at).alias("seen_name"))
    # Requests without a call take no part in the join, where they would all meet in one task.
    has_call = C("call_id").isNotNull()
    named = rows.where(has_call).join(last_names, ["session_id", "call_id"], "left").unionByName(
        rows.where(~has_call), allowMissingColumns=True
    )
    return named.withColumn("tool_name", F.coalesce("own_name", "seen_name")).drop("own_name", "seen_name")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Time between two moments; null if one is missing or they are in reverse order."""
    return F.when(end >= start, end - start)


def _day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def _inside(ms: Column, start: str | None, end: str | None) -> Column:
    inside = ms.isNotNull()
    if start:
        inside = inside & (_day(ms) >= start)
    if end:
        inside = inside & (_day(ms) <= end)
    return inside


def permission_summary(
    records: DataFrame, keys: list[str], start: str | None = None, end: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Decisions, observed sessions and median response time, overall (`keys=[]`) or e.g. per project."""
    responded = C("response_recorded") & _inside(C("responded_ms"), start, end)
    human = F.coalesce(responded & (C("decision_source") == HUMAN), F.lit(False))
    policy = F.coalesce(responded & (C("decision_source") == POLICY), F.lit(False))
    observed = _inside(C("requested_ms"), start, end) | _inside(C("responded_ms"), start, end)
    # Sessions first: distinct sessions are then plain counts.
    per_session = records.groupBy(*keys, "session_id").agg(
        F.count_if(human).alias("human"), F.count_if(policy).alias("policy"), F.bool_or(observed).alias("observed")
    )
    sums = [
        F.coalesce(F.sum("human"), F.lit(0)).alias("human"), F.coalesce(F.sum("policy"), F.lit(0)).alias("host_policy"),
        F.count_if("observed").alias("observed_sessions"), F.count_if(C("human") > 0).alias("human_sessions"),
    ]
    waits = records.where(human).withColumn("wait", elapsed_ms(C("requested_ms"), C("responded_ms")))
    middle = quantiles.median(waits.select(*keys, "wait"), keys, "wait", "median_ms", block_rows)
    if not keys:
        summary = per_session.agg(*sums)
        return summary.withColumns({c: middle.select(c).scalar() for c in middle.columns})
    return per_session.groupBy(*keys).agg(*sums).join(middle, keys, "left").na.fill(0, ["median_ms_samples"])


def permission_kinds(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Human decisions per permission kind."""
    human = C("response_recorded") & (C("decision_source") == HUMAN) & _inside(C("responded_ms"), start, end)
    return records.where(human).groupBy(F.coalesce("permission_kind", F.lit("Unknown")).alias("permission_kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


def dated_events(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Steering messages and user stops with a valid time (columns: session_id, kind, ms), counted per kind."""
    return events.where(_inside(C("ms"), start, end)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- Multi-phase runs ------------------------------------------------------------------------------------------------


def first_phases(phases: DataFrame) -> DataFrame:
    """Phases of the runs, the first event per phase id (columns: run_id, phase_id, time, seq, ...)."""
    rest = [c for c in phases.columns if c not in ("run_id", "phase_id")]
    first = F.min_by(F.struct(*rest), F.struct("time", "seq")).alias("first")
    return phases.where(C("phase_id").isNotNull()).groupBy("run_id", "phase_id").agg(first).select(
        "run_id", "phase_id", "first.*"
    )


def runs(phases: DataFrame, completions: DataFrame, moments: DataFrame) -> DataFrame:
    """One row per run: time, path of phase kinds, judged and repaired flags, reconciliation of the totals.

    `completions`: run_id and RUN_FIELDS; `moments`: run_id and ms of every event of a run. The path holds one entry per
    phase of a single run.
    """
    kind = F.coalesce("kind", F.lit("unknown"))
    path = F.transform(
        F.array_sort(F.collect_list(F.struct("time", "seq", kind.alias("kind")))), lambda p: p["kind"]
    )
    fields = [known_sum(C(f)).alias(f"sum_{f}") for f in RUN_FIELDS]
    by_phase = phases.groupBy("run_id").agg(
        F.array_join(path, " → ").alias("path"), F.bool_or(kind == "judge").alias("judged"),
        F.bool_or(kind == "repair").alias("has_repair"), *fields,
    )
    started = moments.groupBy("run_id").agg(F.min("ms").alias("started_ms"))
    done = completions.withColumn("completed", F.lit(True))
    joined = started.join(by_phase, "run_id", "left").join(done, "run_id", "left")
    differs = F.lit(False)
    missing = F.lit(False)
    for field in RUN_FIELDS:
        differs = differs | F.coalesce(C(f"sum_{field}") != C(field), F.lit(False))
        missing = missing | C(f"sum_{field}").isNull() | C(field).isNull()
    state = (
        F.when(C("completed").isNull() | C("path").isNull(), "unavailable")
        .when(differs, "mismatch").when(missing, "unavailable").otherwise("match")
    )
    return joined.select(
        "run_id", "started_ms", F.coalesce("path", F.lit("No phases observed")).alias("path"),
        F.coalesce("judged", F.lit(False)).alias("judged"),
        F.coalesce(C("judged") & C("has_repair"), F.lit(False)).alias("repaired"), state.alias("reconciliation"),
    )


def run_attributes(events: DataFrame) -> DataFrame:
    """What a run was resolved to and how it ended (columns: run_id, time, seq, kind, and the attributes below).

    The last `resolved` event gives mode, pattern and plan, the last `completed` one final model, final phase, duration and
    outcome; a mode or pattern that is not resolved is the first one a completion names.
    """
    at = F.struct("time", "seq")
    resolved, completed = (F.when(C("kind") == k, at) for k in ("resolved", "completed"))
    named = lambda c: F.min_by(c, F.when((C("kind") == "completed") & C(c).isNotNull(), at))
    ends = F.struct("final_model", "final_phase", "duration_ms", "outcome")
    found = events.groupBy("run_id").agg(
        F.max_by(F.struct("mode", "pattern", "plan"), resolved).alias("asked"), F.max_by(ends, completed).alias("end"),
        named("mode").alias("end_mode"), named("pattern").alias("end_pattern"),
    )
    return found.select(
        "run_id", F.coalesce("asked.mode", "end_mode").alias("mode"), F.coalesce("asked.pattern", "end_pattern").alias("pattern"),
        "asked.plan", "end.final_model", "end.final_phase", "end.duration_ms", "end.outcome",
    )


def run_paths(runs_: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    visible = runs_.where(_inside(C("started_ms"), start, end))
    return visible.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def run_summary(runs_: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    inside = _inside(C("started_ms"), start, end)
    return runs_.agg(
        F.count_if(inside).alias("runs"), F.count_if(inside & C("judged")).alias("judged"),
        F.count_if(inside & C("repaired")).alias("repaired"), F.count_if(C("started_ms").isNull()).alias("undated"),
    )


def run_roles(phases: DataFrame, runs_: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Credits per kind of phase over the visible runs; unknown if one phase does not report them."""
    visible = runs_.where(_inside(C("started_ms"), start, end)).select("run_id")
    kind = F.coalesce("kind", F.lit("unknown"))
    return phases.join(visible, "run_id", "left_semi").groupBy(kind.alias("kind")).agg(
        known_sum(C("nano")).alias("nano"), F.count(F.lit(1)).alias("phases")
    )


# --- Diagnostics -----------------------------------------------------------------------------------------------------


def first_events(events: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("time", "seq")) -> DataFrame:
    """Drop repeated events of the same id (the first in `order` stays); events without an id stay."""
    return first_per_key(events, [], key, list(order))


def subagents(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Started subagents with the last valid duration of a later completion of the same call.

    `events`: session_id, call_id, time, seq, kind (started, completed), agent_name, parent_id, model, duration_ms.
    A completion belongs to the first start of its call; events without a call id belong to none.
    """
    events = events.where(C("call_id").isNotNull())
    rows = Sequence(events, ["session_id", "call_id"], "time", ["seq"], block_rows=block_rows)
    started = C("kind") == "started"
    rows = rows.running_sum({"start_no": started.cast("long")})
    valid = (C("kind") == "completed") & (C("start_no") > 0) & (C("duration_ms") >= 0)
    at = F.struct("time", "seq")
    last = rows.frame().groupBy("session_id", "call_id").agg(
        F.max_by("duration_ms", F.when(valid, at)).alias("last_duration")
    )
    begun = rows.frame().where(started)
    duration = F.when(C("start_no") == 1, C("last_duration"))
    return begun.drop("duration_ms").join(last, ["session_id", "call_id"], "left").select(
        "session_id", "call_id", "seq", F.coalesce("agent_name", F.lit("Unknown")).alias("agent_name"), "parent_id",
        "model", duration.alias("duration_ms"),
    )


def compactions(events: DataFrame) -> DataFrame:
    """Context compactions with the share of tokens they removed."""
    valid = lambda c: F.when(C(c) >= 0, C(c))
    before, after = valid("before_tokens"), valid("after_tokens")
    return events.select(
        "session_id", "seq", "trigger", "success", before.alias("before_tokens"), after.alias("after_tokens"),
        F.when(before > 0, 1 - after / before).alias("reduction"),
    )


def attach_once(threads: DataFrame, details: DataFrame) -> DataFrame:
    """Give the per-session details only to the first thread of each session (columns: session_id, position)."""
    first = threads.groupBy("session_id").agg(F.min("position").alias("position")).join(details, "session_id", "left")
    return threads.join(first, ["session_id", "position"], "left")
