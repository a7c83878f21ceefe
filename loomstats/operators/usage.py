"""Token and credit accounting of CLI sessions.

Credits are nano-credits in a nullable long: null means unknown, and a sum with an unknown part is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import text
from .ordered import Sequence

C = F.col
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
WIDE = "decimal(20,0)"  # any long


def known_sum(value: Column, applies: Column | None = None, wide: bool = False) -> Column:
    """Sum that is null if any contributing value is null; 0 if nothing contributes.

    It is added up as a decimal, since nano-credits of many records do not fit a long; `wide` sums stay decimals. What is
    unknown is not made a long, however large its known part is.
    """
    applies = F.lit(True) if applies is None else applies
    unknown = F.count_if(applies & value.isNull())
    total = F.sum(F.when(applies, value).cast(WIDE))
    return F.when(unknown == 0, F.coalesce(total if wide else total.cast("long"), F.lit(0).cast("long")))


def first_per_key(records: DataFrame, keys: list[str], dedup_key: str, order: list[str]) -> DataFrame:
    """Keep the first row per key; rows without a key are all kept. `order` tells all rows apart.

    The first row is found by a combinable minimum, so a key with very many copies is reduced before the shuffle.
    """
    # What orders the rows is exchanged once: it is not part of the rest.
    rest = [c for c in records.columns if c not in (*keys, dedup_key, *order)]
    place = F.struct(*order)
    first = [F.min_by(F.struct(*rest), place).alias("__first")] if rest else []
    # A row without a key is a group of its own.
    own = F.when(C(dedup_key).isNull(), place).alias("__own")
    found = records.groupBy(*keys, dedup_key, own).agg(F.min(place).alias("__place"), *first)
    placed = [f"__place.{c}" for c in order if c not in (*keys, dedup_key)]
    return found.select(*keys, dedup_key, *placed, *(["__first.*"] if rest else [])).select(*records.columns)


def dedup_key(source: Column, usage_id: Column, sequence: Column, event_id: Column) -> Column:
    """Identity of a usage record: source and usage id, else source and sequence, else the event id, else none."""
    return F.coalesce(
        F.concat(source, F.lit(":"), usage_id), F.concat(source, F.lit(":"), sequence.cast("string")), event_id
    )


def usage_sums(records: DataFrame, wide: bool = False) -> list[Column]:
    tokens = [F.sum(c).alias(c) for c in TOKENS if c in records.columns]
    return [F.count(F.lit(1)).alias("calls"), *tokens, known_sum(C("nano"), wide=wide).alias("nano")]


def usage_by(records: DataFrame, *keys: str, wide: bool = False) -> DataFrame:
    """Calls, tokens and credits per key columns (model, date, session, project ...)."""
    return records.groupBy(*keys).agg(*usage_sums(records, wide))


def top_models(by_model: DataFrame, limit: int = 5) -> DataFrame:
    """Models by credits (unknown last), then tokens."""
    tokens = C("input_tokens") + C("output_tokens")
    ranked = by_model.orderBy(C("nano").desc_nulls_last(), tokens.desc(), "model").limit(limit)
    return ranked.select("model", tokens.alias("total_tokens"), text.credits(C("nano")).alias("credits"))


def project_rollup(records: DataFrame) -> DataFrame:
    """Usage per project and, as one more row, over all projects, with the share of all tokens."""
    sums = records.rollup("project").agg(*usage_sums(records, True), F.grouping("project").alias("is_total"))
    sums = settings.cut_lineage(sums)
    tokens = C("input_tokens") + C("output_tokens")
    total = sums.where(C("is_total") == 1).select(tokens).scalar()
    return sums.select(
        F.when(C("is_total") == 1, "All projects").otherwise(text.basename(C("project"))).alias("name"),
        "project", (C("is_total") == 1).alias("is_total"), "input_tokens", "output_tokens",
        text.credits(C("nano")).alias("credits"), text.share_text(tokens, total).alias("share"),
    )


def period_range(period: str, as_of: str) -> tuple[Column, Column] | None:
    """First and last date (text) of a reporting period: all, week, lastWeek, month, or a number of days."""
    today = F.lit(as_of).cast("date")
    monday = F.date_trunc("week", today).cast("date")
    if period == "all":
        return None
    if period == "lastWeek":
        start, end = F.date_sub(monday, 7), F.date_sub(monday, 1)
    elif period == "week":
        start, end = monday, today
    elif period == "month":
        start, end = F.trunc(today, "month"), today
    else:
        start, end = F.date_sub(today, int(period) - 1), today
    return start.cast("string"), end.cast("string")


def projects_in_period(records: DataFrame, period: str, as_of: str) -> DataFrame:
    """Usage per project recomputed from the days of the period; projects without such a day are left out."""
    bounds = period_range(period, as_of)
    if bounds:
        records = records.where(C("call_date").between(*bounds))
    return usage_by(records, "project")


def in_range(date: Column, start: str | None, end: str | None) -> Column:
    """Inclusive date range with open ends; rows without a date are outside."""
    inside = date.isNotNull()
    if start:
        inside = inside & (date >= start)
    if end:
        inside = inside & (date <= end)
    return inside


def model_call_timing(calls: DataFrame) -> DataFrame:
    """Mean duration and time to first token per model, each over the calls that report it."""
    return calls.groupBy("model").agg(
        F.avg("duration_ms").alias("duration_ms"), F.count("duration_ms").alias("duration_samples"),
        F.avg("first_token_ms").alias("first_token_ms"), F.count("first_token_ms").alias("first_token_samples"),
    )


# --- Checkpoints -----------------------------------------------------------------------------------------------------
#
# `usage_events`: session_id, time, ties..., part and kind:
#   record    model, tokens, nano, source, sequence
#   model     one model of a checkpoint: tokens (null = not reported), nano
#   snapshot  the checkpoint itself: total_nano, complete
#   watermark source, sequence: records of the source up to the sequence are part of the checkpoint
# `part` orders the rows of one checkpoint (models, then snapshot and watermarks).


def by_session(events: DataFrame, order: list[str], block_rows: int | None = None) -> Sequence:
    """Usage events in order. If no session is too large for one task, none of its models or sources is."""
    return Sequence(events, ["session_id"], order[0], order[1:], block_rows=block_rows)


def uncovered(events: DataFrame, order: list[str], parent: Sequence) -> DataFrame:
    """Usage events without the records that an earlier checkpoint already contains."""
    sourced = C("kind").isin("record", "watermark") & C("source").isNotNull()
    rows = Sequence(events.where(sourced), ["session_id", "source"], order[0], order[1:], parent=parent)
    rows = rows.last({"mark": F.when(C("kind") == "watermark", C("sequence"))})
    covered = (C("kind") == "record") & (C("sequence") <= C("mark"))
    live = rows.frame().where(~F.coalesce(covered, F.lit(False))).drop("mark")
    return live.unionByName(events.where(~sourced))


def _model_rows(events: DataFrame, order: list[str], parent: Sequence) -> Sequence:
    models = events.where(C("kind").isin("record", "model"))
    return Sequence(models, ["session_id", "model"], order[0], order[1:], parent=parent)


def model_totals(events: DataFrame, order: list[str], block_rows: int | None = None, kept: bool = False) -> DataFrame:
    """Tokens and credits per session and model: the last checkpoint value plus the uncovered records after it. `kept`: the
    events are checkpointed already, since the caller reads them, too."""
    tokens = [c for c in TOKENS if c in events.columns]
    is_record, is_model = C("kind") == "record", C("kind") == "model"
    # Read three times (size check, watermarks, rest); written once, the records are not deduplicated each time.
    events = events if kept else settings.cut_lineage(events)
    parent = by_session(events, order, block_rows)
    rows = _model_rows(uncovered(events, order, parent), order, parent)
    later = {f"{c}_later": F.when(is_model & C(c).isNotNull(), F.lit(True)) for c in tokens}
    rows = rows.next({**later, "nano_later": F.when(is_model, F.lit(True))})
    position = F.struct(*order)
    sums = [
        (
            F.coalesce(F.max_by(C(c), F.when(is_model & C(c).isNotNull(), position)), F.lit(0))
            + F.coalesce(F.sum(F.when(is_record & C(f"{c}_later").isNull(), C(c))), F.lit(0))
        ).alias(c)
        for c in tokens
    ]
    last_nano = F.max_by("nano", F.when(is_model, position))
    base = F.when(F.count_if(is_model) > 0, last_nano).otherwise(0)
    after = known_sum(C("nano"), is_record & C("nano_later").isNull())
    return rows.frame().groupBy("session_id", "model").agg(*sums, (base + after).alias("nano"))


def session_credits(events: DataFrame, order: list[str], block_rows: int | None = None) -> DataFrame:
    """Credits per session.

    A snapshot with a valid total (or one marked incomplete, which makes the total unknown) sets the running value.
    Otherwise the checkpoint moves it by the change of each model, which is unknown if the old or new value is.
    """
    events = settings.cut_lineage(events)
    parent = by_session(events, order, block_rows)
    live = uncovered(events, order, parent)
    is_record, is_model = C("kind") == "record", C("kind") == "model"
    known, unknown = F.coalesce("nano", F.lit(0)), C("nano").isNull().cast("long")
    rows = _model_rows(live, order, parent)
    rows = rows.running_sum({
        "added": F.when(is_record, known).otherwise(0), "unknown": F.when(is_record, unknown).otherwise(0),
    })
    rows = rows.last({"was": F.when(is_model, F.struct("nano", "added", "unknown"))})
    first = C("was").isNull()
    missing = F.when(first, C("unknown") > 0).otherwise(
        C("was.nano").isNull() | (C("unknown") > C("was.unknown"))
    )
    before = F.when(first, C("added")).otherwise(C("was.nano") + C("added") - C("was.added"))
    change = F.when(is_record, C("nano")).otherwise(F.when(~missing, C("nano") - before))
    changes = rows.frame().select("session_id", *order, F.lit(False).alias("is_reset"), change.alias("amount"))
    resets = live.where((C("kind") == "snapshot") & (C("total_nano").isNotNull() | ~C("complete"))).select(
        "session_id", *order, F.lit(True).alias("is_reset"), F.when(C("complete"), C("total_nano")).alias("amount")
    )
    steps = Sequence(changes.unionByName(resets), ["session_id"], order[0], order[1:], parent=parent)
    steps = steps.next({"later": F.when(C("is_reset"), F.lit(True))})
    position = F.struct(*order)
    base = F.when(
        F.count_if("is_reset") > 0, F.max_by("amount", F.when(C("is_reset"), position))
    ).otherwise(0)
    after = known_sum(C("amount"), ~C("is_reset") & C("later").isNull())
    return steps.frame().groupBy("session_id").agg((base + after).alias("nano"))


def unattributed(cumulative: DataFrame, dated: DataFrame) -> DataFrame:
    """Part of the cumulative usage that no dated call accounts for; `filled_credits` takes unknown credits as none.

    Each table is read once, for both.
    """
    sums = lambda df, part: df.agg(
        F.sum(C("input_tokens") + C("output_tokens")).alias(f"{part}_tokens"), known_sum(C("nano"), wide=True).alias(f"{part}_nano"),
        known_sum(F.coalesce("nano", F.lit(0)), wide=True).alias(f"{part}_filled"),
    )
    both = sums(cumulative, "all").crossJoin(sums(dated, "dated"))
    return both.select(
        (C("all_tokens") - C("dated_tokens")).alias("unattributed_tokens"),
        text.credits(C("all_nano") - C("dated_nano")).alias("unattributed_credits"),
        text.credits(C("all_filled") - C("dated_filled")).alias("filled_credits"),
    )


def daily_prompts(prompts: DataFrame, usage: DataFrame) -> DataFrame:
    """Prompts and output tokens per date; recorded usage replaces the message counts session by session.

    `prompts`: session_id, date, prompts, output_tokens. `usage`: session_id, date, usage_output.
    """
    both = prompts.unionByName(usage, allowMissingColumns=True).groupBy("session_id", "date").agg(
        F.sum("prompts").alias("prompts"), F.sum("output_tokens").alias("legacy"), F.sum("usage_output").alias("usage")
    )
    return both.groupBy("date").agg(
        F.coalesce(F.sum("prompts"), F.lit(0)).alias("prompts"),
        F.sum(F.coalesce("usage", "legacy", F.lit(0))).alias("output_tokens"),
    )
