"""Counters, percentiles, trends and insights over log facts (operators/loglines.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings
from ..functions import events as ev
from ..functions import text
from . import quantiles
from .loglines import is_chat

C = F.col

# Histogram buckets (label, upper bound) and the acceptance-rate anomaly thresholds.
LATENCY_BUCKETS = [
    ("0-100ms", 100), ("100-200ms", 200), ("200-500ms", 500), ("500ms-1s", 1000), ("1-2s", 2000), ("2-5s", 5000),
    ("5s+", None),
]
MIN_SHOWN = 10
BASELINE_DAYS = 14
Z_THRESHOLD = 2


def _shown() -> Column:
    return F.coalesce(C("outcome") == "shown", F.lit(False))


def _accepted() -> Column:
    return F.coalesce(C("outcome") == "accepted", F.lit(False))


def _shown_accepted() -> list[Column]:
    return [F.count_if(_shown()).alias("shown"), F.count_if(_accepted()).alias("accepted")]


def rate(accepted: Column, shown: Column) -> Column:
    """Acceptance rate in percent; null where nothing was shown."""
    return F.when(shown > 0, accepted / shown * 100)


def daily(facts: DataFrame) -> DataFrame:
    """Shown, accepted and chat requests per date."""
    used = _shown() | _accepted() | is_chat()
    return facts.where(used & (C("date") != "")).groupBy("date").agg(
        *_shown_accepted(), F.count_if(is_chat()).alias("chat")
    )


def hourly24(facts: DataFrame) -> DataFrame:
    """Inline and chat activity for each of the 24 hours."""
    counts = facts.where(C("hour") != "").groupBy("hour").agg(
        F.count_if(_shown() | _accepted()).alias("inline"), F.count_if(is_chat()).alias("chat")
    )
    spine = facts.sparkSession.range(24).select(F.lpad(C("id").cast("string"), 2, "0").alias("hour"))
    return spine.join(counts, "hour", "left").na.fill(0, ["inline", "chat"])


def hour_intensity(hours: DataFrame) -> DataFrame:
    """Activity of each hour relative to the busiest one (24 rows)."""
    every = Window.partitionBy()
    peak = lambda c: F.greatest(F.max(c).over(every), F.lit(1))
    return hours.select(
        "hour", (C("inline") / peak("inline")).alias("inline_intensity"), (C("chat") / peak("chat")).alias("chat_intensity")
    )


def by_model(facts: DataFrame) -> DataFrame:
    """Shown and accepted completions per normalised model name."""
    used = facts.where(_shown() | _accepted()).withColumn("model", text.normalize_model(C("model")))
    return used.where(C("model") != "").groupBy("model").agg(*_shown_accepted())


def merge_models(stats: DataFrame) -> DataFrame:
    """Re-merge per-model counters whose names normalise to the same model."""
    counters = [c for c in stats.columns if c != "model"]
    named = stats.withColumn("model", text.normalize_model(C("model"))).where(C("model") != "")
    return named.groupBy("model").agg(*[F.sum(c).alias(c) for c in counters])


def by_session(facts: DataFrame) -> DataFrame:
    """Counters per session; a failed completion request counts as shown and as an error."""
    shown = F.coalesce(C("session_shown"), F.lit(False))
    accepted = F.coalesce(C("source") == "inline-accepted", F.lit(False))
    counted = shown | accepted | is_chat() | C("session_error")
    return facts.where(counted & (C("session_id") != "")).groupBy("session_id").agg(
        F.count_if(shown).alias("shown"), F.count_if(accepted).alias("accepted"),
        F.count_if(is_chat()).alias("chat"), F.count_if("session_error").alias("errors"),
    )


def errors_by_type(facts: DataFrame) -> DataFrame:
    return facts.where(C("error_type").isNotNull()).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def chat_intents(facts: DataFrame) -> DataFrame:
    """Requests per display name of the known intents."""
    named = facts.where(C("intent") != "").withColumn("name", ev.intent_name(C("intent")))
    return named.where(C("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def totals(facts: DataFrame) -> DataFrame:
    """One row of totals, acceptance rate and mean latencies."""
    inline = (_shown() | _accepted()) & (C("latency_ms") > 0)
    chat = is_chat() & (C("latency_ms") > 0)
    sums = facts.agg(
        *_shown_accepted(),
        F.count_if(C("outcome") == "rejected").alias("rejected"),
        F.count_if(is_chat()).alias("chat"),
        F.count("error_type").alias("errors"),
        F.avg(F.when(inline, C("latency_ms"))).alias("avg_latency_ms"),
        F.avg(F.when(chat, C("latency_ms"))).alias("avg_chat_latency_ms"),
    )
    return sums.withColumn("acceptance_rate", rate(C("accepted"), C("shown")))


def latencies(facts: DataFrame) -> DataFrame:
    """Positive latencies of inline completions and chat requests."""
    kind = F.when(is_chat(), "chat").when(_shown() | _accepted(), "inline")
    return facts.where(C("latency_ms") > 0).select(kind.alias("kind"), "latency_ms").where(C("kind").isNotNull())


def latency_percentiles(facts: DataFrame) -> DataFrame:
    return quantiles.nearest_rank(
        latencies(facts), ["kind"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )


def latency_histogram(facts: DataFrame) -> DataFrame:
    """Latencies in fixed buckets, empty ones included."""
    names = [name for name, _ in LATENCY_BUCKETS]
    position = ev.choose(
        [(C("latency_ms") < top, i) for i, (_, top) in enumerate(LATENCY_BUCKETS) if top], len(LATENCY_BUCKETS) - 1
    )
    counts = latencies(facts).groupBy("kind", position.alias("position")).agg(F.count(F.lit(1)).alias("n"))
    spine = (
        facts.sparkSession.range(len(names))
        .select(C("id").cast("int").alias("position"), F.explode(F.array(F.lit("inline"), F.lit("chat"))).alias("kind"))
        .withColumn("bucket", F.element_at(F.array(*map(F.lit, names)), C("position") + 1))
    )
    return spine.join(counts, ["kind", "position"], "left").na.fill(0, ["n"])


def token_totals(facts: DataFrame) -> DataFrame:
    """Token totals and mean prompt tokens per shown completion or chat request."""
    sums = facts.agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.count_if(_shown() | is_chat()).alias("requests"),
    )
    average = F.when(C("requests") > 0, F.floor(C("prompt_tokens") / C("requests") + 0.5)).otherwise(0)
    return sums.select(
        "prompt_tokens", "completion_tokens", (C("prompt_tokens") + C("completion_tokens")).alias("total_tokens"),
        average.alias("avg_prompt_tokens"),
    )


def tokens_by_model(facts: DataFrame, limit: int | None = None) -> DataFrame:
    used = facts.where((C("model") != "") & (C("prompt_tokens") + C("completion_tokens") > 0))
    sums = used.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
    if limit is None:
        return sums
    return sums.orderBy((C("prompt_tokens") + C("completion_tokens")).desc(), "model").limit(limit)


def counters(facts: DataFrame) -> DataFrame:
    """All single-key counters in one pass: (dimension, key, n)."""
    inline = _shown() | _accepted()
    dated, houred = C("date") != "", C("hour") != ""
    model = text.normalize_model(C("model"))
    entries = [
        (_shown() & dated, "shown_by_date", C("date")),
        (_accepted() & dated, "accepted_by_date", C("date")),
        (is_chat() & dated, "chat_by_date", C("date")),
        (inline & houred, "inline_by_hour", C("hour")),
        (is_chat() & houred, "chat_by_hour", C("hour")),
        (_shown() & (model != ""), "shown_by_model", model),
        (_accepted() & (model != ""), "accepted_by_model", model),
        (C("error_type").isNotNull(), "error", C("error_type")),
        (C("finish_reason").isNotNull() & (C("finish_reason") != ""), "finish_reason", C("finish_reason")),
        (C("command").isNotNull(), "command", C("command")),
        (ev.intent_name(C("intent")).isNotNull(), "chat_intent", ev.intent_name(C("intent"))),
    ]
    found = F.array_compact(
        F.array(*[F.when(cond, F.struct(F.lit(name).alias("dimension"), key.alias("key"))) for cond, name, key in entries])
    )
    return facts.select(F.inline(found)).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def chat_models(facts: DataFrame) -> DataFrame:
    """Chat requests per model; a JSON line without a completion outcome also counts as chat use of its model."""
    json_use = (C("rule") == "json") & C("json_outcome").isNull()
    used = facts.where(is_chat() | json_use).withColumn("model", text.normalize_model(C("model")))
    return used.where(C("model") != "").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def top_chat_model(models: DataFrame) -> DataFrame:
    return models.orderBy(C("n").desc(), "model").limit(1)


def subagent_requests(facts: DataFrame) -> DataFrame:
    """Subagent requests by short intent and model."""
    used = facts.where((C("intent") != "") & ev.is_subagent_intent(C("intent")))
    short = F.element_at(F.split("intent", "/"), -1)
    return used.groupBy(short.alias("tool"), "model").agg(F.count(F.lit(1)).alias("n"))


def chat_session_states(facts: DataFrame) -> DataFrame:
    """Turns and code acceptance per conversation."""
    return facts.where(C("chat_session_id").isNotNull()).groupBy("chat_session_id").agg(
        F.count_if("chat_turn").alias("turns"), F.bool_or("code_action").alias("accepted")
    )


def shares(counts: DataFrame, name: str) -> DataFrame:
    """Share of each value in percent of all (few rows: one per distinct value)."""
    counts = settings.cut_lineage(counts)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(name, "n", (C("n") / total * 100).alias("share"))


def finish_reasons(facts: DataFrame) -> DataFrame:
    seen = facts.where(F.coalesce("finish_reason", F.lit("")) != "")
    return shares(seen.groupBy("finish_reason").agg(F.count(F.lit(1)).alias("n")), "finish_reason")


def command_usage(facts: DataFrame) -> DataFrame:
    return facts.where(C("command").isNotNull()).groupBy("command").agg(F.count(F.lit(1)).alias("n"))


# --- Trends (on one row per date) ------------------------------------------------------------------------------------


def timeline(days: DataFrame) -> DataFrame:
    """Acceptance rate per date with z-score anomalies against the last qualifying days."""
    scored = days.withColumn("rate", rate(C("accepted"), C("shown")))
    recent = scored.where(C("shown") >= MIN_SHOWN).orderBy(C("date").desc()).limit(BASELINE_DAYS)
    stats = recent.agg(
        F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("spread"), F.count(F.lit(1)).alias("size")
    )
    mean, spread, size = (stats.select(c).scalar() for c in ("mean", "spread", "size"))
    usable = (size >= 2) & (spread > 0) & (C("shown") >= MIN_SHOWN)
    scored = scored.withColumns({"z": F.when(usable, (C("rate") - mean) / spread), "off": F.abs(C("rate") - mean)})
    anomalous = F.coalesce(F.abs("z") > Z_THRESHOLD, F.lit(False))
    direction = F.when(C("z") < 0, "lower").otherwise("higher")
    reason = F.format_string(
        "Acceptance rate is %.1f%% %s than usual (z-score: %.2f). Check model changes or environment configuration.",
        F.round("off", 1), direction, F.round("z", 2),
    )
    return scored.select(
        "date", "shown", "accepted", "chat", "rate", anomalous.alias("is_anomaly"),
        F.when(anomalous, reason).alias("anomaly_reason"),
    )


def weekly_trend(days: DataFrame, as_of: str) -> DataFrame:
    """This week (Monday to `as_of`) against the whole previous week."""
    today = F.lit(as_of).cast("date")
    monday = F.date_trunc("week", today).cast("date")
    day = C("date").cast("date")
    this, last = day.between(monday, today), day.between(F.date_sub(monday, 7), F.date_sub(monday, 1))
    sums = days.agg(*[
        F.coalesce(F.sum(F.when(period, C(c))), F.lit(0)).alias(f"{name}_{c}")
        for name, period in (("this", this), ("last", last)) for c in ("shown", "accepted", "chat")
    ])
    for name in ("this", "last"):
        value = F.coalesce(rate(C(f"{name}_accepted"), C(f"{name}_shown")), F.lit(0.0))
        sums = sums.withColumn(f"{name}_rate", value)
    both = (C("this_shown") > 0) & (C("last_shown") > 0)
    return sums.withColumn("rate_diff", F.when(both, C("this_rate") - C("last_rate")).otherwise(0.0))


def day_over_day(days: DataFrame, limit: int = 7) -> DataFrame:
    """Trend of each of the last days against the previous day with completions."""
    recent = days.orderBy(C("date").desc()).limit(limit).withColumn("rate", rate(C("accepted"), C("shown")))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("rate", ignorenulls=True).over(earlier)
    arrow = ev.choose(
        [(C("rate").isNull() | C("before").isNull(), ""), (C("rate") > C("before"), "↑"), (C("rate") < C("before"), "↓")],
        "→",
    )
    return recent.withColumn("before", before).select("date", "shown", "accepted", "chat", "rate", arrow.alias("trend"))


def insights(facts: DataFrame, as_of: str) -> DataFrame:
    """Readable one-line findings."""
    week = weekly_trend(daily(facts), as_of)
    better = C("rate_diff") > 0
    change = F.when(better, F.format_string("rate is +%.1f%% higher", F.round("rate_diff", 1))).otherwise(
        F.format_string("rate is %.1f%% lower", F.round("rate_diff", 1))
    )
    weekly = week.where((C("this_shown") > 0) & (C("last_shown") > 0) & (C("rate_diff") != 0)).select(
        F.lit(1).alias("position"),
        F.format_string(
            "📈 This week's acceptance %s than last week (%.1f%% vs %.1f%%).",
            change, F.round("this_rate", 1), F.round("last_rate", 1),
        ).alias("insight"),
    )
    busiest = hourly24(facts).where(C("inline") > 0).orderBy(C("inline").desc(), "hour").limit(1)
    peak = busiest.select(
        F.lit(2).alias("position"),
        F.format_string("⏰ Most active hour: %s:00 with %d completions.", "hour", "inline").alias("insight"),
    )
    sums = facts.agg(F.count_if(is_chat()).alias("chat"), F.count_if(_shown()).alias("shown"))
    ratio = F.round(C("chat") / (C("chat") + C("shown")) * 100, 1)
    chat = sums.where((C("chat") > 0) & (C("shown") > 0)).select(
        F.lit(3).alias("position"),
        F.format_string("💬 Chat usage ratio: %.1f%% of all interactions are chat requests.", ratio).alias("insight"),
    )
    return weekly.unionByName(peak).unionByName(chat)


def available_range(days: DataFrame) -> DataFrame:
    return days.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def recorded_period(days: DataFrame, length: int) -> DataFrame:
    """The last `length` days up to the latest recorded date."""
    end = F.max("date")
    return days.agg(F.date_sub(end.cast("date"), length - 1).cast("string").alias("start"), end.alias("end"))


def context_sources(entries: DataFrame) -> DataFrame:
    """Prompts and prompt characters per context source (columns: source, text)."""
    return entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.length("text") > 0).alias("prompts"),
        F.sum(F.length("text")).alias("prompt_chars"),
    )
