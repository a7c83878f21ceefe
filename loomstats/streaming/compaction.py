"""Daily rollup that retires the raw rows it covers and takes late ones in.

    raw/batch=N/date=D/            rows as they came, until they are covered
    daily/version=N/rows/          the rollup after batch N, one row per date
    daily/version=N/state/         its newest date and its cutoff; written last, so a version is whole or absent

Version N covers the rows of batches up to N with dates before its cutoff, and no others. What it covers is removed after it is
committed. A batch that runs again finds its version and only finishes the removal; one that broke off before that starts
over with the version before it. So no row is lost or counted twice, wherever a run stops.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import daily_stats, merge_daily

C = F.col
KEEP_DAYS = 1
VERSIONS_KEPT = 2


class Compactor:
    """Absorbs micro-batches of events (with a string `date`) into the folder `path`."""

    def __init__(self, spark: SparkSession, path: str, keep_days: int = KEEP_DAYS):
        self.spark, self.path, self.keep_days = spark, path, keep_days
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, prefix: str) -> list[str]:
        """What follows `prefix` in the names of the folders below `folder`."""
        at = self._path(folder)
        found = self._files.listStatus(at) if self._files.exists(at) else []
        names = [re.fullmatch(f"{prefix}=(.+)", status.getPath().getName()) for status in found]
        return [name.group(1) for name in names if name]

    def versions(self) -> list[int]:
        """Committed versions in order."""
        numbers = sorted(int(name) for name in self._names(f"{self.path}/daily", "version"))
        return [n for n in numbers if self._files.exists(self._path(f"{self._version(n)}/state/_SUCCESS"))]

    def _version(self, number: int) -> str:
        return f"{self.path}/daily/version={number}"

    def _state(self, number: int | None) -> tuple[str | None, str]:
        """Newest date and cutoff of a version."""
        if number is None:
            return None, ""
        row = self.spark.read.schema("newest string, cutoff string").json(f"{self._version(number)}/state").first()
        return row["newest"], row["cutoff"] or ""

    def _open_rows(self, schema, number: int | None, cutoff: str) -> DataFrame:
        """Raw rows that version `number` does not cover, its removed or half removed folders aside."""
        names = [f for f in schema.fieldNames() if f not in ("batch", "date")]
        raw = self.spark.read.schema(schema.add("batch", "long")).option("basePath", f"{self.path}/raw").parquet(f"{self.path}/raw")
        covered = F.lit(False) if number is None else (C("batch") <= number) & (C("date") < cutoff)
        return raw.where(~covered).select(*names, "date")

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Store a batch, roll up what is older than the days to keep, and retire it. For `foreachBatch`."""
        done = self.versions()
        if number not in done:
            before = max((n for n in done if n < number), default=None)
            batch.write.mode("overwrite").partitionBy("date").parquet(f"{self.path}/raw/batch={number}")
            newest, cutoff = self._state(before)
            dates = [d for d in (newest, *self._names(f"{self.path}/raw/batch={number}", "date")) if d and d != "__HIVE_DEFAULT_PARTITION__"]
            schema = batch.schema
            rows = self._open_rows(schema, before, cutoff)
            if dates:
                newest = max(dates)
                cutoff = max(cutoff, self.spark.sql(f"SELECT string(date'{newest}' - {self.keep_days})").first()[0])
            daily = daily_stats(rows.where(C("date") < cutoff))
            if before is not None:
                daily = merge_daily(self.spark.read.parquet(f"{self._version(before)}/rows"), daily)
            daily.write.mode("overwrite").parquet(f"{self._version(number)}/rows")
            state = self.spark.createDataFrame([(newest, cutoff)], "newest string, cutoff string")
            state.coalesce(1).write.mode("overwrite").json(f"{self._version(number)}/state")
            done.append(number)
        self._retire(number)
        for old in sorted(done)[:-VERSIONS_KEPT]:
            self._files.delete(self._path(self._version(old)), True)

    def _retire(self, number: int) -> None:
        cutoff = self._state(number)[1]
        for batch in self._names(f"{self.path}/raw", "batch"):
            for date in self._names(f"{self.path}/raw/batch={batch}", "date"):
                if int(batch) <= number and date < cutoff:
                    self._files.delete(self._path(f"{self.path}/raw/batch={batch}/date={date}"), True)

    def raw_dates(self) -> list[str]:
        """Dates that still have raw rows."""
        batches = self._names(f"{self.path}/raw", "batch")
        return sorted({date for batch in batches for date in self._names(f"{self.path}/raw/batch={batch}", "date")})

    def daily(self, schema) -> DataFrame:
        """Rolled up and still raw days together; `schema` is that of the events."""
        last = max(self.versions(), default=None)
        rows = daily_stats(self._open_rows(schema, last, self._state(last)[1]))
        return rows if last is None else merge_daily(self.spark.read.parquet(f"{self._version(last)}/rows"), rows)


def compact_stream(events: DataFrame, path: str, checkpoint: str, keep_days: int = KEEP_DAYS) -> Compactor:
    """Run a stream of events through a compactor to the end of its input."""
    compactor = Compactor(events.sparkSession, path, keep_days)
    query = (
        events.writeStream.foreachBatch(compactor.absorb).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return compactor
