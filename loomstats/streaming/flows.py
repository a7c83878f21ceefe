"""Structured Streaming flows over tracked events.

Each flow is a streaming DataFrame; `run_available` drives one to the end of its input and keeps the result as files, so
nothing passes through the driver and a restart with the same checkpoint adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import events as ev
from ..operators.events import accepts
from ..operators.sessions import EPISODE_GAP_MS

C = F.col
DAY = "24 hours"
TRIGGER = "5 seconds"
HOUR_MS = 3_600_000
KEEP_MS = 30 * 24 * HOUR_MS
# Groups of sessions whose episodes are numbered together.
GROUPS = 256
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS, MIN_PARTITIONS = "spark.sql.shuffle.partitions", 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_rollup(events: DataFrame, late: str = DAY) -> DataFrame:
    """Daily rows of accepts and characters; events later than `late` behind the newest one are dropped."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    sums = days.agg(
        F.count_if(accepts()).alias("total_accepted"), F.sum("chars_added").alias("total_chars_added"),
        F.sum("chars_deleted").alias("total_chars_deleted"),
        F.sum("accepted_characters").alias("total_accepted_characters"),
    )
    return sums.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), *sums.columns[1:])


def typing_windows(events: DataFrame, width: str = "1 minute", late: str = DAY) -> DataFrame:
    """Typed characters and accepts per tumbling window."""
    sums = events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(
        F.sum("chars_added").alias("chars"), F.count_if(accepts()).alias("accepted")
    )
    return sums.select(F.unix_millis("window.start").alias("window_ms"), "chars", "accepted")


def session_windows(events: DataFrame, gap: str = "5 minutes", late: str = DAY) -> DataFrame:
    """Activity windows of each session that end after `gap` without an event.

    In append mode a window is given out, and its state dropped, when the watermark has passed its end.
    """
    sums = events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )
    return sums.select("session_id", "first_ms", "last_ms", "events")


def dedup(records: DataFrame, keys: list[str], late: str = DAY) -> DataFrame:
    """First record per key within the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def number_episodes(state: tuple, rows: dict[str, np.ndarray], gap_ms: int) -> tuple[np.ndarray, tuple]:
    """Episode numbers of rows in order, and the state after them: number, last_ms, moved, stopped, closed.

    Goes from opening to opening: the next one is the first row that must open one whatever came before it, the first plan
    after an action, or the first request after a stopped loop.
    """
    number, last_ms, moved, stopped, closed = state
    ms, n = rows["ms"], len(rows["ms"])
    forced = np.append(closed or ms[0] - last_ms > gap_ms, rows["boundary"][:-1] | (np.diff(ms) > gap_ms))
    at = {name: np.flatnonzero(rows[name]) for name in ("moves", "plan", "stop", "request")} | {"forced": np.flatnonzero(forced)}

    def first(name: str, least: int) -> int:
        k = np.searchsorted(at[name], least)
        return int(at[name][k]) if k < len(at[name]) else n

    openings, here = [], -1
    while True:
        seen = [-1 if carried and here < 0 else first(name, max(here, 0)) for name, carried in (("moves", moved), ("stop", stopped))]
        following = min(first("forced", here + 1), first("plan", seen[0] + 1), first("request", seen[1] + 1))
        if following >= n:
            break
        openings.append(following)
        here = following
    numbers = number + np.searchsorted(openings, np.arange(n), "right")
    since = max(here, 0)
    moved, stopped = (bool(rows[name][since:].any() or (carried and here < 0)) for name, carried in (("moves", moved), ("stop", stopped)))
    return numbers, (int(number + len(openings)), int(ms[-1]), moved, stopped, bool(rows["boundary"][-1]))


NEW = (0, 0, False, False, True)
FLAGS = ("moves", "plan", "stop", "request", "boundary")


class EpisodeNumbers(StatefulProcessor):
    """Numbers the episodes of sessions in the order of their events, whatever the order of their arrival.

    A key is a group of sessions, so that the calls to the state store grow with groups and buckets, not with sessions.
    Rows wait in chunks, one per bucket of time and micro-batch, until the watermark has passed the bucket; then no earlier
    row can come, and the bucket is ordered, numbered and forgotten. What stays is one small entry per session, until the
    watermark is `keep_ms` past its last event: a session that comes back after that starts from 1 again, forgotten or not.
    A group has one timer, for the first bucket that waits. A task holds the rows of one bucket of one group at a time.
    """

    def __init__(self, gap_ms: int = EPISODE_GAP_MS, bucket_ms: int = HOUR_MS, keep_ms: int = KEEP_MS):
        self.gap_ms, self.bucket_ms, self.keep_ms = gap_ms, bucket_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState(
            "episodes", "session array<string>, number array<long>, last_ms array<long>, moved array<boolean>, "
            "stopped array<boolean>, closed array<boolean>",
        )
        self.chunks = handle.getValueState("chunks", "timer long, next long, bucket array<long>, chunk array<long>")
        self.waiting = handle.getMapState(
            "waiting", "bucket long, chunk long", "session array<string>, ms array<long>, seq array<long>, flags array<int>"
        )

    def _wait(self, timer: int, wanted: int, following: int, index: list) -> None:
        """Keep the list of chunks and the one timer (0: none)."""
        if timer != wanted:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        buckets, chunks = (list(c) for c in zip(*index)) if index else ([], [])
        self.chunks.update((wanted, following, buckets, chunks))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, following, buckets, chunks = self.chunks.get() or (0, 0, [], [])
        index = list(zip(buckets, chunks))
        for part in rows:
            flags = sum(part[name].to_numpy(np.int32) << bit for bit, name in enumerate(FLAGS))
            columns = [part["session_id"].to_numpy(), part["ms"].to_numpy(), part["seq"].to_numpy(), flags]
            for bucket, at in part.groupby(part["ms"] // self.bucket_ms).indices.items():
                self.waiting.updateValue((int(bucket), following), tuple(c[at].tolist() for c in columns))
                index.append((int(bucket), following))
                following += 1
        self._wait(timer, (min(index)[0] + 1) * self.bucket_ms, following, index)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, following, buckets, chunks = self.chunks.get()
        end = timerValues.getCurrentWatermarkInMs() // self.bucket_ms  # buckets before it are complete
        index = sorted(zip(buckets, chunks))
        names, *values = self.sessions.get() or ([], [], [], [], [], [])
        episodes = dict(zip(names, zip(*values)))
        for bucket, group in groupby((k for k in index if k[0] < end), key=lambda k: k[0]):
            group = list(group)
            session, ms, seq, flags = (np.concatenate(c) for c in zip(*(map(np.array, self.waiting.getValue(k)) for k in group)))
            for k in group:
                self.waiting.removeKey(k)
            codes, present = pd.factorize(session, use_na_sentinel=False)
            present = [None if pd.isna(name) else name for name in present]  # rows without a session are one
            order = np.lexsort((seq, ms, codes))
            bounds = np.flatnonzero(np.diff(codes[order], prepend=-1, append=-1))
            ms, flags = ms[order], flags[order]
            rows = {"ms": ms} | {name: (flags >> bit & 1).astype(bool) for bit, name in enumerate(FLAGS)}
            numbers = np.empty(len(ms), np.int64)
            for name, low, high in zip(present, bounds[:-1].tolist(), bounds[1:].tolist()):
                own = {k: v[low:high] for k, v in rows.items()}
                numbers[low:high], episodes[name] = self._number(own, episodes.get(name, NEW))
            yield pd.DataFrame({"session_id": session[order], "seq": seq[order], "episode_no": numbers})
        # No row before `end` can come any more.
        kept = {name: e for name, e in episodes.items() if end * self.bucket_ms - e[1] <= self.keep_ms}
        index = [k for k in index if k[0] >= end]
        if not kept and not index:
            self.sessions.clear()
            self.chunks.clear()
            return
        self.sessions.update((list(kept), *map(list, zip(*kept.values()))) if kept else ([],) * 6)
        following_end = min(index)[0] + 1 if index else max((min(e[1] for e in kept.values()) + self.keep_ms) // self.bucket_ms, end) + 1
        self._wait(0, following_end * self.bucket_ms, following, index)

    def _number(self, rows: dict[str, np.ndarray], episode: tuple) -> tuple[np.ndarray, tuple]:
        """Numbers of a session's rows in order, and its state after them."""
        quiet = np.diff(rows["ms"], prepend=episode[1] if episode[0] else rows["ms"][0]) > self.keep_ms
        if not quiet.any():
            return number_episodes(episode, rows, self.gap_ms)
        numbers, starts = [], [0, *np.flatnonzero(quiet), len(quiet)]
        for low, high in zip(starts[:-1], starts[1:]):
            if quiet[low]:
                episode = NEW
            if high > low:
                part, episode = number_episodes(episode, {k: v[low:high] for k, v in rows.items()}, self.gap_ms)
                numbers.append(part)
        return np.concatenate(numbers), episode

    def close(self) -> None:
        pass


def episodes(
    events: DataFrame, gap_ms: int = EPISODE_GAP_MS, late: str = DAY, bucket_ms: int = HOUR_MS, keep_ms: int = KEEP_MS,
    groups: int = GROUPS,
) -> DataFrame:
    """Episode number of every actionable event (needs the RocksDB state store, see `STATE_STORE`).

    Events later than `late` behind the newest one are dropped; all others are numbered as if they had come in order, once
    the watermark has passed them (rows of the batch right after the one that moved the watermark still count). A session that comes back after `keep_ms` without events starts from 1 again.
    """
    kind, signal = C("signal_type"), ev.is_signal()
    # A condition on `ts` stays above the watermark, which all events move then, not the actionable ones alone.
    rows = events.withWatermark("ts", late).where(F.when(C("ts").isNotNull(), ev.is_actionable())).select(
        "ts", "session_id", "ms", "seq",
        (~signal | C("actor").isin("ai", "human")).alias("moves"),
        (signal & (kind == "plan-proposal")).alias("plan"), (signal & (kind == "tool-loop-stop")).alias("stop"),
        (signal & (kind == "chat-request") & (C("actor") == "ai")).alias("request"),
        (signal & (kind == "memory-boundary")).alias("boundary"),
    )
    group = F.pmod(F.xxhash64("session_id"), F.lit(groups)).alias("group")
    return rows.select("*", group).groupBy("group").transformWithStateInPandas(
        EpisodeNumbers(gap_ms, bucket_ms, keep_ms), "session_id string, seq long, episode_no long", "append", "eventTime"
    )


def file_stream(spark: SparkSession, folder: str, schema, files: int | None = None, size: str | None = None) -> DataFrame:
    """Parquet files of a folder in the order of their arrival; a micro-batch takes at most `files` files or `size` bytes of them."""
    reader = spark.readStream.schema(schema)
    for name, limit in (("maxFilesPerTrigger", files), ("maxBytesPerTrigger", size)):
        reader = reader if limit is None else reader.option(name, limit)
    return reader.parquet(folder)


def flush(spark: SparkSession, folder: str, schema, newest, ahead: str) -> None:
    """Close a finished input: a row without a session, `ahead` of the newest event, moves the watermark past all others."""
    ts = F.lit(newest).cast("timestamp") + F.expr(f"INTERVAL {ahead}")
    row = spark.range(1).select(*[(ts if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.mode("append").parquet(folder)


def ingest(events: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append a stream of events to a table partitioned by date, in small batches and exactly once.

    A batch starts after TRIGGER, and takes no more than the limits of `file_stream`, so it is cut by time or by size.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": TRIGGER}
    return (
        events.writeStream.format("parquet").outputMode("append").partitionBy("date")
        .option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
    )


def run_available(flow: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there. Every batch writes its own folder, so a repeated batch replaces itself.

    The result has the column `batch`: with mode `update` or `complete` a later batch supersedes rows of earlier ones.
    """
    spark = flow.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        flow.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(flow.schema.add("batch", "long")).option("basePath", path).parquet(f"{path}/batch=*")


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each row of an update-mode result."""
    rest = [c for c in results.columns if c not in (*keys, "batch")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def rocksdb_state(spark: SparkSession) -> None:
    """Use the RocksDB state store for the queries started from now on."""
    spark.conf.set(STATE_STORE, ROCKSDB)


@contextmanager
def stateful(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings of the queries started inside. State is kept in few partitions, as each costs a commit in every micro-batch
    and, for a Python operator, a worker."""
    partitions = min(int(spark.conf.get(PARTITIONS)), max(MIN_PARTITIONS, spark.sparkContext.defaultParallelism))
    conf = {PARTITIONS: str(partitions), **conf}
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
