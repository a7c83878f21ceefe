"""Ordered analytics per key that survive a key holding a large share of all rows.

A window function sorts one partition key inside one task. `Sequence` keeps that plain form while every key has at most
`block_rows` rows. If a key is larger, its rows are cut into consecutive time blocks, each block is ordered in its own
task, and what must flow from one block into the next (a last value, a running sum) is carried over by a table with one
row per block. That table only holds keys above the limit, so with N rows in total it has in the order of
`OVERSPLIT * N / block_rows` rows, which is the size bound for broadcasting it. Blocks that are still too large (a burst of
rows in a short time) are split again; only rows of the very same time cannot be parted.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings

BLOCK = "__block"
HOT = "__hot"
OVERSPLIT = 2

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, 0)


class Sequence:
    """Rows of `df` ordered by (`time`, `ties`) inside `keys`.

    `time` is a numeric column without nulls (epoch ms for events, the value itself for cumulative counts); `ties` make
    the order total. The methods return a new Sequence with the named columns added.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Seq[str],
        time: str,
        ties: Seq[str] = (),
        block_rows: int | None = None,
        parent: Sequence | None = None,
    ):
        """`parent`: a sequence whose rows were aggregated into `df` under the same keys; if none of its keys needed
        blocks, the fewer rows here cannot either and the size check is skipped."""
        self.keys = list(keys)
        self.time = time
        self.ties = list(ties)
        limit = block_rows or (parent.limit if parent else settings.BLOCK_ROWS)
        self.limit = limit
        if parent is not None and not parent.blocked:
            self.blocked, self.df = False, df
            return
        hot = _oversized(df, self.keys, time, limit)
        # One cheap aggregate decides the plan: usually no key is over the limit and plain windows are used.
        self.blocked = not hot.isEmpty()
        self.df = _with_blocks(df, self.keys, time, hot, limit) if self.blocked else df

    def _copy(self, df: DataFrame) -> Sequence:
        other = object.__new__(Sequence)
        other.__dict__.update(self.__dict__, df=df)
        return other

    @property
    def _partition(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocked else self.keys

    @property
    def _order(self) -> list[str]:
        return [self.time, *self.ties]

    def frame(self) -> DataFrame:
        """The rows with the columns added so far."""
        return self.df.drop(BLOCK, HOT)

    def stored(self) -> Sequence:
        """The same rows written once, for what several results read."""
        return self._copy(settings.stored(self.df))

    def with_columns(self, columns: dict[str, Column]) -> Sequence:
        return self._copy(self.df.withColumns(columns))

    def where(self, condition: Column) -> Sequence:
        return self._copy(self.df.where(condition))

    def select(self, *columns) -> Sequence:
        kept = [BLOCK, HOT] if self.blocked else []
        return self._copy(self.df.select(*columns, *kept))

    def last(self, values: dict[str, Column], inclusive: bool = False) -> Sequence:
        """Last non-null value over the rows before each row (`inclusive`: up to and including it)."""
        return self._carry(values, descending=False, inclusive=inclusive)

    def next(self, values: dict[str, Column], inclusive: bool = False) -> Sequence:
        """First non-null value over the rows after each row (`inclusive`: from the row itself on)."""
        return self._carry(values, descending=True, inclusive=inclusive)

    def running_sum(self, values: dict[str, Column], inclusive: bool = True) -> Sequence:
        """Sum over the rows up to each row; 0 where no row contributes."""
        window = Window.partitionBy(*self._partition).orderBy(*self._order)
        window = window.rowsBetween(*(_UP_TO if inclusive else _BEFORE))
        local = {name: F.coalesce(F.sum(value).over(window), F.lit(0)) for name, value in values.items()}
        if not self.blocked:
            return self._copy(self.df.withColumns(local))
        sums = [F.sum(value).alias(_carried(name)) for name, value in values.items()]
        earlier = Window.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(*_BEFORE)
        carried = self._blocks(sums, {n: F.sum(_carried(n)).over(earlier) for n in values})
        return self._apply(local, carried, values, lambda own, before: own + F.coalesce(before, F.lit(0)))

    def row_number(self, name: str) -> Sequence:
        return self.running_sum({name: F.lit(1).cast("long")})

    def _carry(self, values: dict[str, Column], descending: bool, inclusive: bool) -> Sequence:
        order = [F.col(c).desc() for c in self._order] if descending else self._order
        window = Window.partitionBy(*self._partition).orderBy(*order)
        window = window.rowsBetween(*(_UP_TO if inclusive else _BEFORE))
        local = {name: F.last(value, ignorenulls=True).over(window) for name, value in values.items()}
        if not self.blocked:
            return self._copy(self.df.withColumns(local))
        position = F.struct(*self._order)
        pick = F.min_by if descending else F.max_by
        edges = [pick(v, F.when(v.isNotNull(), position)).alias(_carried(n)) for n, v in values.items()]
        block = F.col(BLOCK).desc() if descending else F.col(BLOCK)
        earlier = Window.partitionBy(*self.keys).orderBy(block).rowsBetween(*_BEFORE)
        carried = self._blocks(edges, {n: F.last(_carried(n), ignorenulls=True).over(earlier) for n in values})
        return self._apply(local, carried, values, lambda own, before: F.coalesce(own, before))

    def _blocks(self, aggregates: list[Column], windows: dict[str, Column]) -> DataFrame:
        per_block = self.df.where(HOT).groupBy(*self.keys, BLOCK).agg(*aggregates)
        outputs = [w.alias(_carried(n)) for n, w in windows.items()]
        # One row per block of an oversized key: cutting the lineage here keeps chained steps linear.
        return settings.cut_lineage(per_block.select(*self.keys, BLOCK, *outputs))

    def _apply(self, local, carried, values, combine) -> Sequence:
        df = self.df.withColumns(local).join(F.broadcast(carried), [*self.keys, BLOCK], "left")
        df = df.withColumns({n: combine(F.col(n), F.col(_carried(n))) for n in values})
        return self._copy(df.drop(*[_carried(n) for n in values]))


def _carried(name: str) -> str:
    return f"__carried_{name}"


def _oversized(df: DataFrame, groups: list[str], time: str, limit: int) -> DataFrame:
    """Groups with more than `limit` rows and how wide their parts shall be."""
    counts = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(time).alias("__low"), F.max(time).alias("__high")
    )
    parts = F.ceil(F.col("__rows") / limit) * OVERSPLIT
    width = (F.col("__high") - F.col("__low")) / parts
    return counts.where(F.col("__rows") > limit).select(*groups, "__low", width.alias("__width"))


def _part(time: str) -> Column:
    width = F.col("__width")
    offset = F.when(width > 0, F.floor((F.col(time) - F.col("__low")) / width))
    return F.coalesce(offset, F.lit(0)).cast("long")


def _with_blocks(df: DataFrame, keys: list[str], time: str, hot: DataFrame, limit: int) -> DataFrame:
    joined = df.join(F.broadcast(settings.cut_lineage(hot)), keys, "left")
    blocks = joined.withColumns({BLOCK: F.array(_part(time)), HOT: F.col("__low").isNotNull()}).drop("__low", "__width")
    while True:
        large = _oversized(blocks.where(HOT), [*keys, BLOCK], time, limit).where(F.col("__width") > 0)
        large = settings.cut_lineage(large)
        if large.isEmpty():
            return blocks
        joined = blocks.join(F.broadcast(large), [*keys, BLOCK], "left")
        blocks = joined.withColumn(BLOCK, F.concat(BLOCK, F.array(_part(time)))).drop("__low", "__width")
