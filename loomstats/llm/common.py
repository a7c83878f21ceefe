"""Small helpers the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstats.settings import ensure_checkpoint_dir

# Fixed values of the contracts: a word is a run of characters outside these.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint directory, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder: lineage is cut, columns stay prunable, sizes are known."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, also where a lambda inside `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(manifest: DataFrame) -> DataFrame:
    """A small stored table over as many tasks as it has rows, or as the cluster can use: each row is much work."""
    most = 16 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(1, min(manifest.count(), most)), *manifest.columns)
