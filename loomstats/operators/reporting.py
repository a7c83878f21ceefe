"""All sections of the usage reports, from log facts, CLI records and tracked events.

Tables that count the same thing from several sources are unions that are summed once, so each section costs one shuffle of
already aggregated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import text
from ..sources.exports import Entry, Listing, Section, credits_text, one_decimal, percent
from . import events as event_ops
from . import logstats
from .usage import TOKENS, usage_by, usage_sums

C = F.col
MODEL_ROWS = 20
# Facts that the sections read.
FACTS = [
    "file", "session_id", "date", "hour", "outcome", "source", "rule", "model", "intent", "error_type", "latency_ms",
    "session_shown", "session_error", "json_outcome",
]
# Titles of the feature sections in CSV and Markdown, and their names in JSON.
FEATURES = {
    "browser": ("Browser Tool Signals", "Browser Tools", "browserTools"),
    "plugin": ("Plugin Or Skill Signals", "Plugins / Skills", "pluginOrSkills"),
    "memory": ("Session Memory Signals", "Session Memory / Compact", "memoryManagement"),
    "debug": ("Agent Debug Signals", "Agent Debug", "agentDebug"),
}


@dataclass
class Usage:
    """What a report is made of. `log`: facts of log lines; `features`: `loglines.feature_counts`; `records`: CLI usage
    records without repeats; `prompts`: session_id, date, prompts; `threads`: session_id, title, started_ms; `events`:
    tracked events; `window_ms`: window of the typing velocity."""

    log: DataFrame
    features: DataFrame
    records: DataFrame
    prompts: DataFrame
    threads: DataFrame
    events: DataFrame
    window_ms: int = event_ops.MINUTE_MS


def prepared(usage: Usage) -> Usage:
    """The same inputs with all that several sections read stored once: each log line is parsed, and repeated records are
    removed, in one pass for the whole report."""
    stored = {name: settings.stored(getattr(usage, name)) for name in ("features", "records", "prompts")}
    return replace(usage, log=settings.stored(usage.log.select(*FACTS)), **stored)


def _whole(value: Column) -> Column:
    """Rounded to a whole number; unknown is 0."""
    return F.coalesce(F.round(value), F.lit(0)).cast("long")


def _metrics(row: DataFrame, position: int, values: dict[str, Column]) -> DataFrame:
    """(position, metric, value) for each named value of a one-row table."""
    entries = [
        F.struct(F.lit(position + i).alias("position"), F.lit(name).alias("metric"), value.cast("string").alias("value"))
        for i, (name, value) in enumerate(values.items())
    ]
    return row.select(F.inline(F.array(*entries)))


def totals(usage: Usage) -> DataFrame:
    """One row: counters, rate, mean latencies and number of files of the log."""
    log = usage.log
    files = log.agg(F.count_distinct("file").alias("files")).select("files").scalar()
    return logstats.totals(log).withColumn("files", files)


def percentiles(usage: Usage) -> DataFrame:
    """One row with the percentiles of both kinds, 0 without latencies."""
    found = logstats.latency_percentiles(usage.log)
    return found.agg(*[
        _whole(F.max(F.when(C("kind") == kind, C(p)))).alias(f"{kind}_{p}")
        for kind in ("inline", "chat") for p in ("p50", "p95", "p99")
    ])


def cli_totals(usage: Usage) -> DataFrame:
    """Calls, tokens and credits over all records; no row without records."""
    return usage.records.agg(*usage_sums(usage.records, True)).where(C("calls") > 0)


def summary(usage: Usage) -> DataFrame:
    """Metrics in their order: log counters, latencies, CLI totals if there are any."""
    row = totals(usage)
    counts = _metrics(row, 0, {
        "Total Shown": C("shown"), "Total Accepted": C("accepted"), "Total Rejected": C("rejected"),
        "Acceptance Rate": percent(C("acceptance_rate")), "Total Chat": C("chat"),
        "Avg Latency (ms)": _whole(C("avg_latency_ms")),
    })
    ranks = _metrics(percentiles(usage), 10, {"Latency P50 (ms)": C("inline_p50"), "Latency P95 (ms)": C("inline_p95")})
    rest = _metrics(row, 20, {
        "Chat Avg Latency (ms)": _whole(C("avg_chat_latency_ms")), "Total Errors": C("errors"), "Log Files Parsed": C("files"),
    })
    cli = _metrics(cli_totals(usage), 30, {
        "CLI Input Tokens": C("input_tokens"), "CLI Output Tokens": C("output_tokens"),
        "CLI Total Tokens": C("input_tokens") + C("output_tokens"), "CLI AI Credits": credits_text(C("nano")),
    })
    return counts.unionByName(ranks).unionByName(rest).unionByName(cli)


def by_date(usage: Usage) -> DataFrame:
    """Completions, chat, CLI prompts, tokens and credits per date that any of them has; `spent` tells dates with CLI usage."""
    calls = usage_by(usage.records.where(C("call_date").isNotNull()), "call_date", wide=True).select(
        C("call_date").alias("date"), "input_tokens", "output_tokens", "nano", F.lit(True).alias("spent")
    )
    prompts = usage.prompts.where(C("date").isNotNull()).groupBy("date").agg(F.sum("prompts").alias("prompts"))
    rows = logstats.daily(usage.log).unionByName(prompts, True).unionByName(calls, True)
    counts = ["shown", "accepted", "chat", "prompts", "input_tokens", "output_tokens"]
    return rows.groupBy("date").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
        F.max("nano").alias("nano"), F.coalesce(F.max("spent"), F.lit(False)).alias("spent"),
    )


def cli_models(usage: Usage) -> DataFrame:
    """Tokens and credits per model; counters that the records do not have are 0."""
    found = usage_by(usage.records, "model", wide=True)
    return found.withColumns({c: F.lit(0) for c in TOKENS if c not in found.columns})


def cli_threads(usage: Usage) -> DataFrame:
    """Title, start, prompts, tokens and credits per CLI session; a session without records has spent nothing."""
    spent = usage_by(usage.records, "session_id").withColumn("spent", F.lit(True)).drop("calls")
    asked = usage.prompts.groupBy("session_id").agg(F.sum("prompts").alias("prompts"))
    rows = usage.threads.select("session_id", "title", "started_ms").unionByName(asked, True).unionByName(spent, True)
    return rows.groupBy("session_id").agg(
        F.max("title").alias("title"), F.min("started_ms").alias("started_ms"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompts", "input_tokens", "output_tokens")],
        F.when(F.max("spent"), F.max("nano")).otherwise(0).alias("nano"),
    )


def feature_rows(usage: Usage, category: str) -> DataFrame:
    """Subtypes of a feature category with their counts; none unless something counts toward the category's total."""
    rows = usage.features.where(C("category") == category)
    counted = rows.where(C("in_total") > 0).select("category").distinct()
    return rows.join(counted, "category", "left_semi")


def _rate() -> Column:
    return percent(logstats.rate(C("accepted"), C("shown")))


def _started() -> Column:
    return text.iso_text(F.timestamp_millis("started_ms"))


def csv_sections(usage: Usage) -> list[Section]:
    """The blocks of the CSV export in their order."""
    credits, known = credits_text(C("nano")), F.coalesce(C("nano"), F.lit(-1))
    tokens = {"Input Tokens": C("input_tokens"), "Output Tokens": C("output_tokens")}
    log, shown = usage.log, {"Shown": C("shown"), "Accepted": C("accepted"), "Rate": _rate()}
    fixed = [
        Section("Summary", summary(usage), {"Metric": C("metric"), "Value": C("value")}, C("metric"), -C("position")),
        Section("By Date", by_date(usage), {
            "Date": C("date"), **shown, "Chat": C("chat"), "CLI Prompts": C("prompts"),
            "CLI Tokens": C("input_tokens") + C("output_tokens"), "CLI AI Credits": F.when(C("spent"), credits),
        }, C("date")),
        Section("CLI Model Usage", cli_models(usage), {
            "Model": C("model"), **tokens, "Cache Read Tokens": C("cache_read_tokens"),
            "Cache Write Tokens": C("cache_write_tokens"), "Reasoning Tokens": C("reasoning_tokens"), "AI Credits": credits,
        }, C("model"), known, True),
        Section("CLI Threads", cli_threads(usage), {
            "Session": C("session_id"), "Title": C("title"), "Started At": _started(), "Prompts": C("prompts"), **tokens,
            "AI Credits": credits,
        }, C("session_id"), F.coalesce("started_ms", F.lit(0)), True),
        Section("Inline Completion Model", logstats.by_model(log), {"Model": C("model"), **shown}, C("model"), C("shown"), True),
        Section("Chat Model", logstats.chat_models(log), {"Model": C("model"), "Count": C("n")}, C("model"), C("n"), True),
        Section("Chat Intent", logstats.chat_intents(log), {"Intent": C("name"), "Count": C("n")}, C("name"), C("n"), True),
        Section("Activity by Hour", logstats.hourly24(log), {"Hour": C("hour"), "Inline": C("inline"), "Chat": C("chat")}, C("hour")),
        Section("Sessions", logstats.by_session(log), {
            "Session": C("session_id"), **shown, "Chat": C("chat"), "Errors": C("errors"),
        }, C("session_id"), optional=True, descending=True),
        Section("Errors by Type", logstats.errors_by_type(log), {"Error Type": C("error_type"), "Count": C("n")}, C("error_type"), C("n"), True),
    ]
    return fixed + [
        Section(title, feature_rows(usage, category), {"Type": C("subtype"), "Count": C("seen")}, C("subtype"), C("seen"), True)
        for category, (title, _, _) in FEATURES.items()
    ]


def markdown_sections(usage: Usage) -> list[Section | Listing]:
    """The parts of the Markdown report in their order."""
    unknown = "Unavailable"
    credits = credits_text(C("nano"), 6, unknown)
    row = totals(usage)
    facts = _metrics(row, 0, {
        "Suggestions Shown": F.when(C("shown") > 0, C("shown")),
        "Suggestions Accepted": F.when((C("shown") > 0) | (C("accepted") > 0), C("accepted")),
        "Acceptance Rate": F.when(C("shown") > 0, percent(C("acceptance_rate"))).otherwise(unknown),
        "Chat Requests": C("chat"),
        "Avg Latency": F.when(C("avg_latency_ms") > 0, F.concat(_whole(C("avg_latency_ms")).cast("string"), F.lit("ms"))).otherwise("—"),
        "Errors": C("errors"), "Log Files Parsed": C("files"),
    }).where(C("value").isNotNull())
    spent = _metrics(cli_totals(usage).withColumns({c: F.lit(0) for c in TOKENS if c not in usage.records.columns}), 0, {
        "Input Tokens": C("input_tokens"), "Output Tokens": C("output_tokens"), "Cache Read Tokens": C("cache_read_tokens"),
        "Cache Write Tokens": C("cache_write_tokens"), "AI Credits": credits,
    })
    table = {"Metric": C("metric"), "Value": C("value")}
    cross = event_ops.model_language(usage.events)
    top = cross.orderBy(C("total_accepted").desc(), "model_name", "language_id").limit(MODEL_ROWS)
    flow = event_ops.velocity_summary(event_ops.velocity(usage.events, usage.window_ms))
    bold = lambda name, value: F.concat(F.lit("- **"), text.markdown_safe(name), F.lit("**: "), value.cast("string"))
    observed = [
        Listing(title, rows.groupBy().agg(F.sum("in_total").alias("seen")).where(C("seen") > 0).select(
            F.lit("Total Observed Events").alias("subtype"), "seen", F.lit(1).alias("total"),
        ).unionByName(rows.select("subtype", "seen", F.lit(0).alias("total"))), bold(C("subtype"), C("seen")), C("subtype"),
            C("total") * float(1 << 53) + C("seen"), heading="### ")
        for category, (_, title, _) in FEATURES.items() for rows in [feature_rows(usage, category)]
    ]
    return [
        Section("Executive Summary", facts, table, C("metric"), -C("position")),
        *observed,
        Section("CLI Token and AI Credit Usage", spent, table, C("metric"), -C("position"), True),
        Section("CLI Models", cli_models(usage), {
            "Model": C("model"), "Input Tokens": C("input_tokens"), "Output Tokens": C("output_tokens"), "AI Credits": credits,
        }, C("model"), F.coalesce(C("nano"), F.lit(-1)), True),
        Section("CLI Thread Totals", cli_threads(usage), {
            "Thread": F.coalesce("title", "session_id"), "Prompts": C("prompts"), "Tokens": C("input_tokens") + C("output_tokens"),
            "AI Credits": credits,
        }, C("session_id"), F.coalesce("started_ms", F.lit(0)), True),
        Section("Model Performance", top, {
            "Model": C("model_name"), "Language": C("language_id"), "Accepted": C("total_accepted"),
            "Chars": C("total_chars_accepted"), "Avg Latency": F.concat(_whole(C("avg_latency_ms")).cast("string"), F.lit("ms")),
        }, F.concat_ws(" ", "model_name", "language_id"), C("total_accepted"), True),
        Listing("Best Model per Language", event_ops.best_model(cross), bold(C("language_id"), text.markdown_safe(C("model_name"))),
                C("language_id"), heading="### "),
        Listing("Velocity & Flow Analysis", _metrics(flow.where(C("windows") > 0), 0, {
            "Average KPM": F.concat(one_decimal(C("average_kpm")), F.lit(" keystrokes/min")),
            "Flow Disruptions": F.concat(C("disruptions").cast("string"), F.lit(" windows")),
            "Data Points": F.concat(C("windows").cast("string"), F.lit(" windows")),
        }), bold(C("metric"), C("value")), C("metric"), -C("position")),
    ]


def json_entries(usage: Usage) -> list[Entry]:
    """The members of the JSON export in their order."""
    row = totals(usage).select(
        C("shown").alias("totalShown"), C("accepted").alias("totalAccepted"), C("rejected").alias("totalRejected"),
        F.coalesce(F.round("acceptance_rate", 1), F.lit(0.0)).alias("acceptanceRate"),
        (C("shown") > 0).alias("acceptanceRateAvailable"), C("chat").alias("totalChat"),
        _whole(C("avg_latency_ms")).alias("avgLatencyMs"), _whole(C("avg_chat_latency_ms")).alias("chatAvgLatencyMs"),
        C("errors").alias("totalErrors"), C("files").alias("logFilesFound"),
    )
    ranks = percentiles(usage).select(
        C("inline_p50").alias("latencyP50"), C("inline_p95").alias("latencyP95"), C("inline_p99").alias("latencyP99"),
        C("chat_p50").alias("chatLatencyP50"), C("chat_p95").alias("chatLatencyP95"),
    )
    whole = lambda df: F.struct(*df.columns)
    tokens = [C("input_tokens").alias("inputTokens"), C("output_tokens").alias("outputTokens")]
    nano = C("nano").alias("totalNanoAiu")
    dates, count, log = by_date(usage), C("n"), usage.log
    features = [
        Entry(name, usage.features.where(C("category") == category), C("seen"), C("subtype"))
        for category, (_, _, name) in FEATURES.items()
    ]
    return [
        Entry("summary", row, whole(row)),
        Entry("latency", ranks, whole(ranks)),
        Entry("cliUsage", cli_totals(usage), F.struct(*tokens, (C("input_tokens") + C("output_tokens")).alias("totalTokens"), nano)),
        Entry("byDate", dates, F.struct("shown", "accepted", "chat"), C("date")),
        Entry("cliUsageByDate", dates.where(C("spent") | (C("prompts") > 0)), F.struct("prompts", *tokens, nano), C("date")),
        Entry("cliUsageByModel", cli_models(usage), F.struct(*tokens, nano), C("model")),
        Entry("cliThreads", cli_threads(usage), F.struct(
            C("session_id").alias("sessionId"), "title", _started().alias("startedAt"), "prompts", *tokens, nano,
        ), order=C("session_id")),
        Entry("byModel", logstats.by_model(log), F.struct("shown", "accepted"), C("model")),
        Entry("byChatModel", logstats.chat_models(log), count, C("model")),
        Entry("byChatIntent", logstats.chat_intents(log), count, C("name")),
        Entry("byHour", logstats.hourly24(log), C("inline"), C("hour")),
        Entry("chatByHour", logstats.hourly24(log), C("chat"), C("hour")),
        Entry("errorsByType", logstats.errors_by_type(log), count, C("error_type")),
        *features,
        Entry("sessions", logstats.by_session(log), F.struct(
            C("session_id").alias("sessionId"), "shown", "accepted", "chat", "errors",
        ), order=C("session_id"), descending=True),
    ]
