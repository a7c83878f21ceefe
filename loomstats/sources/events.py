"""Event files: one JSON object per line in `events/YYYY-MM-DD.jsonl`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import Sequence

C = F.col


def position() -> Column:
    """Order of a row inside the input: file, start of its split, row inside the split."""
    return F.struct(
        C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def normalise(raw: DataFrame) -> DataFrame:
    """Heterogeneous events as one wide row with defaults for missing fields (raw field names, plus `seq`)."""
    text = lambda name: F.coalesce(C(name), F.lit(""))
    count = lambda name: F.coalesce(C(name), F.lit(0))
    ts = F.try_to_timestamp("timestamp")
    return raw.select(
        "seq", C("sessionId").alias("session_id"), C("timestamp").alias("raw_timestamp"), ts.alias("ts"),
        F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd").alias("date"), C("eventType").alias("event_type"),
        text("languageId").alias("language_id"), count("charsAdded").alias("chars_added"),
        count("charsDeleted").alias("chars_deleted"), count("acceptedCharacters").alias("accepted_characters"),
        text("modelName").alias("model_name"), count("latencyMs").alias("latency_ms"),
        F.coalesce("isPartialAccept", F.lit(False)).alias("is_partial_accept"), text("filePath").alias("file_path"),
        F.coalesce("isSubagent", F.lit(False)).alias("is_subagent"), text("intent").alias("intent"),
        text("signalType").alias("signal_type"), text("actor").alias("actor"), text("phase").alias("phase"),
        text("rawText").alias("raw_text"), F.coalesce("success", F.lit(True)).alias("success"),
    )


def _field(name: str, kind: str) -> Column:
    """A field of the parsed line; null if it is missing or of another kind, whatever the other fields are."""
    if kind == "bigint":  # whole numbers may be written 3.0 or "3"
        return F.try_variant_get("event", f"$.{name}", "double").cast("bigint")
    return F.try_variant_get("event", f"$.{name}", kind)


def parse_events(lines: DataFrame) -> DataFrame:
    """Raw fields of JSON lines (column `value`, plus `seq`). Only lines that are no JSON object are dropped."""
    parsed = lines.withColumn("event", F.try_parse_json("value"))
    parsed = parsed.where(F.schema_of_variant("event").startswith("OBJECT"))
    fields = {f.name: _field(f.name, f.dataType.simpleString()) for f in schemas.EVENT_FIELDS}
    return parsed.select("seq", *[c.alias(name) for name, c in fields.items()])


def read_events(
    spark: SparkSession, path: str, since: str | None = None, on: str | None = None, dated: bool = True,
    files: str = "*.jsonl",
) -> DataFrame:
    """Events of the JSON lines in `files` below `path`. `since` and `on` prune files by the date in their name.

    Fields of a wrong kind get their default, the event stays. Events without a readable timestamp have no place in any
    order; they come with null `ts`, `ms` and `date` if `dated` is false.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path)
    if since:
        raw = raw.where(C("_metadata.file_name") >= f"{since}.jsonl")
    if on:
        raw = raw.where(C("_metadata.file_name") == f"{on}.jsonl")
    events = normalise(parse_events(raw.withColumn("seq", position())))
    return events.where(C("ms").isNotNull()) if dated else events


def read_stored_events(
    spark: SparkSession, path: str, since: str | None = None, on: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Events that `write_events` wrote; `since` and `on` prune its date folders."""
    events = spark.read.format(fmt).load(path).withColumn("date", C("date").cast("string"))
    if since:
        events = events.where(C("date") >= since)
    return events.where(C("date") == on) if on else events


def with_row_ids(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Number the events from 0 in (ms, seq) order."""
    everything = events.withColumn("__all", F.lit(1))
    rows = Sequence(everything, ["__all"], "ms", ["seq"], block_rows=block_rows).row_number("id")
    return rows.frame().withColumn("id", C("id") - 1).drop("__all")


def write_events(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append events, partitioned by date so that readers prune by it."""
    events.write.mode("append").partitionBy("date").format(fmt).save(path)
