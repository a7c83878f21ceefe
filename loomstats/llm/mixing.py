"""Mixing sources to target weights by systematic sampling.

Every unit of a source expects `target / source size` copies. Units are put in an order, the expected copies are summed up
to each unit, one random offset per source is added, and a unit is taken once for each whole number its interval crosses.
Ordering a source by size makes the sample stratified: what is taken differs from the target by about one document.

Sums are whole numbers of 2**-24 copies, so they do not depend on how rows were partitioned and reruns agree. The order is a
range partitioning; sums of its parts are small and are carried across parts, so one source may hold any share of the rows.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words takes
nothing; rows equal in doc_id, source and text are one unit and share its copies; an empty table gives an empty result;
columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstats.llm.common import word_count
from loomstats.settings import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # of all words that the mix takes: 150 %
MOST = 2  # copies of a source at most
SEED = 17
UNIT = 1 << 24


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """`target` per row of (source, source_size): shares by weight, none above `most` times its size.

    One row per source. Sorted by size over weight, a source is capped as long as its equal share of what earlier capped
    ones leave is above its cap; the rest share what remains.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    num, den = share
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(most).cast("long") * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = num * total - den * F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("capped", left * F.col("weight") > den * F.col("cap") * F.sum("weight").over(rest))
    shared = num * total - den * F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    weights_left = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return rows.withColumn(
        "target",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * shared).cast("double") / (den * weights_left).cast("double")),
    ).select("source", "source_size", "target")


def systematic(units: DataFrame, group: str, order: list[str], expected: str, seed: int = SEED) -> DataFrame:
    """`copies` per unit; `expected` counts 2**-24 copies as a long. `order` must be total within a group."""
    names = units.columns
    placed = cut_lineage(units.repartitionByRange(group, *order)).withColumn("_part", F.spark_partition_id())
    sums = placed.groupBy("_part", group).agg(F.sum(expected).alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", F.col(group).alias("_group"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(group, F.lit(""))).cast("binary")), 1, 6), 16, 10)
    end = F.col("_before") + F.sum(expected).over(within) + offset.cast("long")
    joined = placed.alias("p").join(
        sums.alias("s"), (F.col("p._part") == F.col("s._part")) & F.col(group).eqNullSafe(F.col("_group"))
    ).select("p.*", "_before")
    rows = joined.withColumn("_end", end)
    copies = F.floor(F.col("_end") / UNIT) - F.floor((F.col("_end") - F.col(expected)) / UNIT)
    return rows.select(*names, copies.cast("long").alias("copies"))


def units_of(docs: DataFrame) -> DataFrame:
    """One row per (doc_id, source, text), with its words, a digest of the text and the number of equal rows."""
    slim = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("digest")
    )
    units = slim.groupBy("doc_id", "source", "digest").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    return units.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Copies of each unit of `docs`: doc_id, source, digest, rows, size, source_size, target, copies."""
    units = cut_lineage(units_of(docs))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    plan = targets(sizes, weights, share, most).withColumn(
        "expected",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") * UNIT / F.col("source_size"))).otherwise(0).cast("long"),
    )
    plan = plan.withColumnRenamed("source", "_source")
    rows = units.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    taken = systematic(rows, "source", ["size", "tie", "doc_id", "digest"], "expected", seed)
    return taken.drop("expected", "tie")


def apply_mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    taken = mix(docs, weights, share, most, seed).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest"),
        F.col("copies").alias("_copies"),
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    same = (
        F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & F.col("_doc.source").eqNullSafe(F.col("_source"))
        & F.md5(F.col("_doc.text").cast("binary")).eqNullSafe(F.col("_digest"))
    )
    each = rows.join(taken, same).select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.select("_doc.*")
