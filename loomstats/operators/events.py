"""Aggregates over the tracked-events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

C = F.col
MINUTE_MS = 60_000
SPINE_BLOCK = 100_000  # windows of the velocity series that one row gives

# Thresholds of the anomaly report and the velocity analysis.
Z_THRESHOLD = 2
BASELINE_DAYS = 14
MIN_ACCEPTS = 3
DISRUPTION_FACTOR = 0.6


def accepts() -> Column:
    return C("event_type") == "completionAccept"


def sessions(events: DataFrame) -> DataFrame:
    """First and last event of each session."""
    return events.groupBy("session_id").agg(F.min("ms").alias("started_ms"), F.max("ms").alias("ended_ms"))


def file_metadata(events: DataFrame) -> DataFrame:
    """Edits, accepted completions and accepted characters per file; the language is the first one seen."""
    return (
        events.where(C("file_path") != "")
        .groupBy("file_path")
        .agg(
            F.min_by("language_id", F.struct("ms", "seq")).alias("language_id"),
            F.count_if(C("event_type") == "textChange").alias("total_edits"),
            F.count_if(accepts()).alias("total_accepted_completions"),
            F.sum(F.when(accepts(), C("accepted_characters")).otherwise(0)).alias("total_accepted_characters"),
        )
    )


def events_by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(C("event_type") == event_type)


def daily_stats(events: DataFrame) -> DataFrame:
    """Daily rollup of accepts and characters."""
    return events.groupBy("date").agg(
        F.count_if(accepts()).alias("total_accepted"),
        F.sum("chars_added").alias("total_chars_added"),
        F.sum("chars_deleted").alias("total_chars_deleted"),
        F.sum(F.when(accepts(), C("accepted_characters")).otherwise(0)).alias("total_accepted_characters"),
    )


def compact(events: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """Split into daily rows for events before the cutoff and the raw events from it on."""
    return daily_stats(events.where(C("ms") < cutoff_ms)), events.where(C("ms") >= cutoff_ms)


def merge_daily(*parts: DataFrame) -> DataFrame:
    """Add up daily rows that were rolled up in several rounds."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    names = [c for c in total.columns if c != "date"]
    return total.groupBy("date").agg(*[F.sum(c).alias(c) for c in names])


def daily_accepts(events: DataFrame, rolled_up: DataFrame | None = None) -> DataFrame:
    """Accepted completions per date from raw events and already compacted days."""
    counts = events.where(accepts()).groupBy("date").agg(F.count(F.lit(1)).alias("accepted"))
    if rolled_up is not None:
        counts = counts.unionByName(rolled_up.select("date", C("total_accepted").alias("accepted")))
        counts = counts.groupBy("date").agg(F.sum("accepted").alias("accepted"))
    return counts


def baseline(daily: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    """Mean and population deviation of the last `days` observed dates (one row)."""
    recent = daily.orderBy(C("date").desc()).limit(days)
    return recent.agg(
        F.coalesce(F.avg("accepted"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop("accepted"), F.lit(0.0)).alias("std_dev"),
        F.count(F.lit(1)).alias("sample_size"),
    )


def anomaly_report(daily: DataFrame, as_of: str, days: int = BASELINE_DAYS) -> DataFrame:
    """Z-score of each recent day against the baseline of the last observed days."""
    base = baseline(daily, days)
    mean, spread, size = (base.select(c).scalar() for c in ("mean", "std_dev", "sample_size"))
    recent = daily.where(C("date") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("string"))
    usable = (size >= 2) & (spread > 0) & (C("accepted") >= MIN_ACCEPTS)
    scored = recent.withColumn("z_score", F.when(usable, F.round((C("accepted") - mean) / spread, 2)))
    flagged = F.coalesce(F.abs("z_score") > Z_THRESHOLD, F.lit(False))
    return scored.select(
        "date", "accepted", "z_score", flagged.alias("is_anomaly"),
        F.when(flagged, F.when(C("z_score") < 0, "lower").otherwise("higher")).alias("direction"),
    )


def latest_anomaly(report: DataFrame) -> DataFrame:
    """Number of anomalous days and the latest of them."""
    return report.agg(
        F.count_if("is_anomaly").alias("anomalies"),
        F.max(F.when(C("is_anomaly"), C("date"))).alias("latest_date"),
        F.max_by("z_score", F.when(C("is_anomaly"), C("date"))).alias("latest_z"),
    )


def usage_summary(events: DataFrame, as_of: str, days: int = BASELINE_DAYS) -> DataFrame:
    """Accepted completions and characters of the last `days` days."""
    return _recent_accepts(events, as_of, days).agg(
        F.lit(_checked(days)).cast("long").alias("days"),
        F.count(F.lit(1)).alias("total_accepted"),
        F.coalesce(F.sum("accepted_characters"), F.lit(0)).alias("total_chars_accepted"),
    )


def top_languages(events: DataFrame, as_of: str, days: int = BASELINE_DAYS, limit: int = 10) -> DataFrame:
    recent = _recent_accepts(events, as_of, days)
    counts = recent.groupBy(text.or_else(C("language_id"), F.lit("unknown")).alias("language")).count()
    return counts.withColumnRenamed("count", "accepted").orderBy(C("accepted").desc(), "language").limit(limit)


def _checked(days: int) -> int:
    if days < 1:
        raise ValueError("days must be 1 or more")
    return int(days)


def _recent_accepts(events: DataFrame, as_of: str, days: int) -> DataFrame:
    first = F.date_sub(F.lit(as_of).cast("date"), _checked(days)).cast("string")
    return events.where(accepts() & (C("date") >= first))


def model_language(events: DataFrame) -> DataFrame:
    """Accepts, characters and mean latency per model and language."""
    unknown = F.lit("unknown")
    return (
        events.where(accepts())
        .groupBy(
            text.or_else(C("model_name"), unknown).alias("model_name"),
            text.or_else(C("language_id"), unknown).alias("language_id"),
        )
        .agg(
            F.count(F.lit(1)).alias("total_accepted"),
            F.sum("accepted_characters").alias("total_chars_accepted"),
            F.avg("latency_ms").alias("avg_latency_ms"),
        )
    )


def best_model(cross_tab: DataFrame) -> DataFrame:
    """Model with the most accepts per language (ties: name)."""
    best = F.min_by(F.struct("model_name", "total_accepted"), F.struct(-C("total_accepted"), C("model_name")))
    return cross_tab.groupBy("language_id").agg(best.alias("best")).select(
        "language_id", "best.model_name", "best.total_accepted"
    )


def velocity(events: DataFrame, window_ms: int = MINUTE_MS) -> DataFrame:
    """Typing speed in windows anchored at the first event; windows without events are kept."""
    bounds = events.agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    low = bounds.select("low").scalar()
    counts = events.groupBy(F.floor((C("ms") - low) / window_ms).alias("window")).agg(
        F.sum(F.when(C("event_type") == "textChange", C("chars_added")).otherwise(0)).alias("chars"),
        F.count_if(accepts()).alias("accepted"),
    )
    # The spine is built in blocks that are spread first, so one stray timestamp does not make one huge row.
    last = F.floor((C("high") - C("low")) / window_ms)
    blocks = bounds.where(C("low").isNotNull()).select(
        "low", "high", last.alias("last"), F.explode(F.sequence(F.lit(0), F.floor(last / SPINE_BLOCK))).alias("block")
    )
    first = C("block") * SPINE_BLOCK
    spine = blocks.repartition("block").select(
        "low", "high", F.explode(F.sequence(first, F.least("last", first + (SPINE_BLOCK - 1)))).alias("window")
    )
    # A span shorter than one window is a single window of at least a minute.
    short = (C("high") - C("low")) < window_ms
    minutes = F.when(short, F.greatest((C("high") - C("low")) / MINUTE_MS, F.lit(1.0))).otherwise(
        F.lit(window_ms / MINUTE_MS)
    )
    series = spine.join(counts, "window", "left").select(
        (C("low") + C("window") * window_ms).alias("window_ms"),
        (F.coalesce("chars", F.lit(0)) / minutes).alias("kpm"),
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
        short.alias("short"),
    )
    average = series.agg(F.avg("kpm")).scalar()
    disrupted = ~C("short") & (C("accepted") > 0) & (C("kpm") < average * DISRUPTION_FACTOR)
    return series.withColumn("flow_disrupted", disrupted).drop("short")


def velocity_summary(series: DataFrame) -> DataFrame:
    return series.agg(
        F.coalesce(F.avg("kpm"), F.lit(0.0)).alias("average_kpm"),
        F.count_if("flow_disrupted").alias("disruptions"),
        F.count(F.lit(1)).alias("windows"),
    )


def event_dates(events: DataFrame) -> DataFrame:
    return events.select("date").distinct()
