"""Whitening of embeddings by a covariance from variances alone (polarisation).

1. Entries become whole numbers x = floor(STEP * c) + ZERO; the fit list is each distinct x vector once.
2. One pass gives the count n and the sums S. Values are centred at the whole number next to the mean, d = x - round(S / n).
3. A second pass adds, for every dimension, d_i squared, and for every pair of dimensions (d_i + d_j) squared - whole numbers,
   so any order of the tasks gives the same sums. With r_i = sum of d_i, the centred sum of squares is exact:
   n**2 * sum((d_i - r_i / n)**2) = n * sum(d_i**2) - r_i**2, likewise for the pairs.
4. cov_ij = (var(i + j) - var(i) - var(j)) / 2 in whole numbers, divided once; numpy's `eigh` on the small matrix.
5. A third pass over the fit list measures what whitening leaves: the covariance of the whitened rows less the identity.

Each task sends one row per pair of dimensions, so what reaches the driver grows with the dimensions, never with the rows.

Defined cases: null vectors, and ones with null or non-finite entries, are dropped, as are ones with an entry beyond 2**53 / STEP
(their x would not be exact) and ones of another length than the commonest (of equally common lengths the longest counts).
Repeated rows and ids are returned as often as they come but are fitted once. Directions without variance (not above FLAT times
the largest variance) have no components, so few or equal vectors have fewer, down to none, and then no rows; neither has an
empty table. `deviation` is null where it exceeds 64 bits. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstats.llm.common import stored

# Fixed values of the contract.
STEP, ZERO = 64, 1_000_000
COMPONENTS = 16
FLAT = 1e-12
LONG = (1 << 63) - 1

ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
    ("explained", pa.float64()), ("identity_error", pa.float64()),
])
SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])
PRODUCTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])


def whole_numbers(docs: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that take part."""
    entry = lambda c: F.lit(float(STEP)) * c.cast("double")
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(entry(c)) <= float(1 << 53)))
    x = F.transform(vector, lambda c: F.floor(entry(c)).cast("long") + F.lit(ZERO).cast("long"))
    # the test stands inside the value, as conditions may be evaluated in any order
    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, x).alias("x")).where(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("dims")).count()
    common = lengths.agg(F.max(F.struct("count", "dims"))["dims"]).first()[0]
    return rows.where(F.size("x") == F.lit(common or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """64 bits if sums of `most` at their greatest fit in there, else numbers of any size."""
    return values if most < LONG else values.astype(object)


def _batches(total: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if total:
        keys = list(total)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [total[k] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each dimension (i, -1) and the number of rows (-1, -1) of a task."""
    from decimal import Decimal

    total, n = 0, 0
    for batch in batches:
        x = _matrix(batch["x"])
        if len(x):
            x = _exact(x, int(np.abs(x).max()) * len(x))
            total, n = total + x.sum(0).astype(object), n + len(x)
    if n:
        sums = {(i, -1): Decimal(int(v)) for i, v in enumerate(total)} | {(-1, -1): Decimal(n)}
        yield from _batches(sums, SUMS)


def _squares(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of d_i**2 as (i, i) and of (d_i + d_j)**2 as (i, j), i < j, of a task."""
    from decimal import Decimal

    dims = len(centre)
    total = [np.zeros(dims - i, object) for i in range(dims)]
    seen = False
    for batch in batches:
        d = _matrix(batch["x"])
        if not len(d):
            continue
        d, seen = d - centre, True
        d = _exact(d, 4 * int(np.abs(d).max()) ** 2 * len(d))
        for i in range(dims):
            both = d[:, i : i + 1] + d[:, i:]
            both[:, 0] = d[:, i]
            total[i] += (both * both).sum(0).astype(object)
    if seen:
        yield from _batches({(i, i + k): Decimal(int(v)) for i in range(dims) for k, v in enumerate(total[i])}, SUMS)


class Fit:
    """Counts, means and components of a fit list."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], centre: list[int]):
        self.n, self.dims, self.centre = n, len(sums), np.array(centre, np.int64)
        self.rest = [s - n * m for s, m in zip(sums, centre)]
        spread = {
            (i, j): n * q - (self.rest[i] + (self.rest[j] if i != j else 0)) ** 2 for (i, j), q in squares.items()
        }  # n**2 times the variance of x_i, or of x_i + x_j
        self.covariance = np.empty((self.dims, self.dims))
        for (i, j), v in spread.items():
            twice = 2 * v if i == j else v - spread[i, i] - spread[j, j]
            self.covariance[i, j] = self.covariance[j, i] = twice / (2 * n * n)
        values, vectors = np.linalg.eigh(self.covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        some = np.flatnonzero(values > FLAT * max(values[0], 0.0))[:COMPONENTS] if self.dims else np.zeros(0, int)
        vectors = vectors[:, some]
        leading = np.abs(vectors).argmax(0)
        vectors = vectors * np.sign(vectors[leading, np.arange(len(some))])  # one sign on every run
        self.values, self.vectors = values[some], vectors
        trace = sum(spread[i, i] for i in range(self.dims)) / (n * n)
        self.explained = self.values / trace if trace else self.values

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of x."""
        return ((x - self.centre) - np.array(self.rest, float) / self.n) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)**2, as numbers of any size where needed."""
        d, r = x - self.centre, np.array(self.rest, object)
        most = self.n * int(np.abs(d).max(initial=0)) + max((abs(v) for v in self.rest), default=0)
        if most * most * self.dims < LONG:
            away = self.n * d - r.astype(np.int64)
        else:
            away = self.n * d.astype(object) - r
        return (away * away).sum(1)


def _left(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened components of a task."""
    total = 0
    for batch in batches:
        if batch.num_rows:
            w = fit.whiten(_matrix(batch["x"]))
            total = total + w.T @ w
    if isinstance(total, np.ndarray):
        yield from _batches({(i, j): float(v) for (i, j), v in np.ndenumerate(total)}, PRODUCTS)


def fit_list(rows: DataFrame) -> Fit | None:
    """Components of the distinct x of `rows` (a stored table of them); None if there are none."""
    found = rows.mapInArrow(_sums, "i int, j int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    sums = {row["i"]: int(row["total"]) for row in found}
    if not sums:
        return None
    n = sums.pop(-1)
    sums = [sums[i] for i in range(len(sums))]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    found = rows.mapInArrow(partial(_squares, centre=np.array(centre, np.int64)), "i int, j int, total decimal(38,0)")
    squares = {(row["i"], row["j"]): int(row["total"]) for row in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    return Fit(n, sums, squares, centre)


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the covariance of whitened `rows` less the identity."""
    found = rows.mapInArrow(partial(_left, fit=fit), "i int, j int, total double")
    found = found.groupBy("i", "j").agg((F.sum("total") / fit.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("off"))
    return found.agg(F.coalesce(F.max(F.abs("off")), F.lit(0.0))).first()[0]


def _whitened(batches: Iterator[pa.RecordBatch], fit: Fit, error: float) -> Iterator[pa.RecordBatch]:
    k = len(fit.values)
    for batch in batches:
        rows = batch.num_rows
        if not rows or not k:
            continue
        x = _matrix(batch["x"])
        away = [int(v) if v <= LONG else None for v in fit.deviation(x)]
        which = np.repeat(np.arange(rows), k)
        columns = [
            batch["vec_id"].take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * k, fit.n)), pa.array(away, pa.int64()).take(pa.array(which)),
            pa.array(fit.whiten(x).ravel()), pa.array(np.tile(fit.explained, rows)), pa.array(np.full(rows * k, error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=OUT)


def whiten(docs: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened components of every row: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_numbers(docs, id_col, vector)
    distinct = stored(rows.select("x").distinct(), "fit")
    fit = fit_list(distinct)
    if fit is None:
        return docs.sparkSession.createDataFrame([], ROWS)
    return rows.mapInArrow(partial(_whitened, fit=fit, error=identity_error(distinct, fit)), ROWS)
