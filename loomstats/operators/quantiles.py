"""Exact quantiles from value counts.

The values are first counted (map-side combined), so a group is never collected; the cumulative count over the distinct
values then gives the value at any rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from .ordered import Sequence


def _cumulative(df: DataFrame, keys: list[str], value: str, block_rows: int | None) -> DataFrame:
    if not keys:
        df = df.withColumn("__all", F.lit(1))
    group = keys or ["__all"]
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    # The counts are read three times below; written once, their input is not evaluated again.
    counts = settings.cut_lineage(counts)
    totals = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
    running = Sequence(counts, group, "__value", block_rows=block_rows).running_sum({"__upto": F.col("__n")}).frame()
    return running.join(totals, group)


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], block_rows: int | None = None
) -> DataFrame:
    """Nearest-rank percentiles: the smallest value whose cumulative count reaches ceil(p * n)."""
    ranked = _cumulative(df, keys, value, block_rows)
    picks = [
        F.min(F.when(F.col("__upto") >= F.greatest(F.ceil(F.col("__total") * F.lit(p)), F.lit(1)), F.col("__value")))
        .alias(name)
        for name, p in probabilities.items()
    ]
    return ranked.groupBy(*keys).agg(*picks) if keys else ranked.agg(*picks)


def median(df: DataFrame, keys: list[str], value: str, name: str, block_rows: int | None = None) -> DataFrame:
    """Median as the mean of the two middle values, with the number of samples."""
    ranked = _cumulative(df, keys, value, block_rows)
    low = F.min(F.when(F.col("__upto") >= F.floor((F.col("__total") + 1) / 2), F.col("__value")))
    high = F.min(F.when(F.col("__upto") >= F.floor(F.col("__total") / 2) + 1, F.col("__value")))
    aggregates = [((low + high) / 2).alias(name), F.coalesce(F.sum("__n"), F.lit(0)).alias(f"{name}_samples")]
    return ranked.groupBy(*keys).agg(*aggregates) if keys else ranked.agg(*aggregates)
