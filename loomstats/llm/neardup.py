"""Near duplicates among embeddings: tile products of int8 vectors with error bounds, exact where the bounds leave a doubt.

1. Equal vectors of a label are one class (128 bits of hashes tell them apart); classes are compared, not rows.
2. A unit vector v is kept as s * q + r: whole numbers q of 8 bits, a scale s of its own, and r, what rounding left. For two of them
   |v.w - s s' q.q'| <= |s q| |r'| + |r| |s' q'| + |r| |r'| (Cauchy-Schwarz), with the norms of r as measured, not assumed.
3. The classes of a label are cut into cells of bounded bytes; a task takes a pair of cells and multiplies them tile by tile. Products
   of q are whole numbers below 2**24, hence exact in the 32-bit floating point of the matrix product. Pairs whose upper
   bound misses the threshold are done, ones whose lower bound reaches it are linked; only those between are computed anew
   from the vectors as given, in double precision.
4. A task keeps counts of links and a union-find, and returns a row per linked class, never a row per pair. Links between
   classes give components; copies get the counts of their class.

The number of products is quadratic in the vectors of one label, which the method implies; shuffle grows with the number of cells of a
label (CELL_BYTES), memory of a task does not, and a label with a third of all rows is dealt to as many tasks as it has pairs of cells.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite entries link with nothing and are their
own component; vectors of different lengths never link; repeated rows are vectors of their own, linked with each other, and share
what follows from their id (`kept` is true for each if the id is the least); rows without id take part, but a component is named by its
least id that is not null. Columns other than id, label and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstats.llm.common import stored
from loomstats.llm.graph import components

THRESHOLD = 0.93  # fixed value of the contract
CELL_BYTES = 64 << 20  # of vectors of one cell; a task holds two
SPREAD = 2048  # smaller labels stay whole; above, up to four cells let several tasks share a label
TILE = 1024
WIDE = 1024
SLACK = 1e-9  # far above what double precision leaves of the bounds
LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


class Cell:
    """Classes of one cell, in the forms that the comparison needs."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        m, dims = vectors.shape
        self.q = np.empty((m, dims), np.int8)
        self.scale, self.norm, self.rest = np.empty(m), np.empty(m), np.empty(m)
        for at in range(0, m, TILE):
            part = slice(at, at + TILE)
            v = unit(vectors[part])
            scale = np.abs(v).max(1) / 127
            q = np.rint(v / scale[:, None])
            self.q[part], self.scale[part] = q, scale
            self.norm[part] = scale * np.sqrt((q * q).sum(1))
            self.rest[part] = np.sqrt(((v - q * scale[:, None]) ** 2).sum(1))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision, whatever their size."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def whole_products(q: np.ndarray, other: np.ndarray) -> np.ndarray:
    """All products of two sets of 8-bit vectors, exact: WIDE dimensions stay below 2**24, the sum of more is taken in 64 bits."""
    total = None
    for at in range(0, q.shape[1], WIDE):
        part = q[:, at : at + WIDE].astype(np.float32) @ other[:, at : at + WIDE].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def tile_links(a: Cell, b: Cell, rows: slice, columns: slice, least: float, above: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of `a` and of `b` that are linked (`above`: later ones of `b` only), and how many pairs were computed in full precision."""
    product = whole_products(a.q[rows], b.q[columns])
    norm, rest = b.norm[columns].max(), b.rest[columns].max()
    doubt = a.norm[rows] * rest + a.rest[rows] * (norm + rest)  # of any vector of the tile
    product *= b.scale[columns].astype(product.dtype)
    low = (least - doubt) / a.scale[rows]
    i, j = np.nonzero(product >= (low - 1e-6 * np.abs(low) - 1e-30).astype(product.dtype)[:, None])
    if not len(i):
        return i, j, 0
    i, j = i + rows.start, j + columns.start
    if above:
        i, j = i[i < j], j[i < j]
    near, anew = [np.zeros(0, bool)], 0
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        cosine = np.einsum("ij,ij->i", a.q[x].astype(np.int32), b.q[y].astype(np.int32)) * a.scale[x] * b.scale[y]
        doubt = a.norm[x] * b.rest[y] + a.rest[x] * (b.norm[y] + b.rest[y]) + SLACK
        linked = cosine - doubt >= least
        open_ = np.flatnonzero(~linked & (cosine + doubt >= least))
        exact = np.einsum("ij,ij->i", unit(a.vectors[x[open_]]), unit(b.vectors[y[open_]]))
        linked[open_] = exact >= least
        anew += len(open_)
        near.append(linked)
    near = np.concatenate(near)
    return i[near], j[near], anew


class Forest:
    """Union-find over the classes of a task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            higher = self.parent[root]
            if (higher == root).all():
                return root
            root = higher

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        """`x` is sorted; pairs of one row are tied at once."""
        apart = self.find(x) != self.find(y)
        x, y = x[apart], y[apart]
        if not len(x):
            return
        cuts = np.flatnonzero(np.diff(x)) + 1
        for one, others in zip(x[np.concatenate([[0], cuts])], np.split(y, cuts)):
            roots = np.unique(self.find(np.append(others, one)))
            self.parent[roots] = roots[0]


def compare(a: Cell, b: Cell | None, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (copies counted) and root of each class of `a`, followed by those of `b`; without `b`, of `a` with itself."""
    m = len(a.nodes)
    other, shift = (a, 0) if b is None else (b, m)
    total = m + (0 if b is None else len(b.nodes))
    links, forest, anew = np.zeros(total, np.int64), Forest(total), 0
    for top in range(0, m, TILE):
        rows = slice(top, min(top + TILE, m))
        for left in range(top if b is None else 0, len(other.nodes), TILE):
            columns = slice(left, min(left + TILE, len(other.nodes)))
            x, y, n = tile_links(a, other, rows, columns, least, above=b is None and left == top)
            anew += n
            if len(x):
                np.add.at(links, x, other.copies[y])
                np.add.at(links, y + shift, a.copies[x])
                forest.link(x, y + shift)
    return links, forest.find(np.arange(total)), anew


def _tasks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by label, length, pair of cells, and cell."""
    key, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if sum(len(part[1]) for part in held) < 2:
            return
        cell, nodes, copies, vectors = (np.concatenate(column) for column in zip(*held))
        held.clear()
        first = int(np.searchsorted(cell, cell[0], "right"))
        parts = [slice(0, first)] + ([slice(first, len(cell))] if first < len(cell) else [])
        if len(parts) == 1 and key[2] != key[3]:
            return  # one cell of the pair is empty
        cells = [Cell(nodes[p], copies[p], vectors[p]) for p in parts]
        links, root, _ = compare(cells[0], cells[1] if len(cells) > 1 else None, least)
        some = np.flatnonzero(links)
        if len(some):
            columns = [pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(links[some])]
            yield pa.RecordBatch.from_arrays(columns, schema=LINKS)

    for batch in batches:
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("label_key", "dims", "i", "j")]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *changes.tolist(), batch.num_rows] if batch.num_rows else [0]
        for low, high in zip(bounds[:-1], bounds[1:]):
            now = tuple(c[low] for c in columns)
            if now != key:
                yield from done()
                held.clear()
                key = now
            part = batch.slice(low, high - low)
            vectors = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1)
            held.append((*(part[c].to_numpy() for c in ("cell", "node", "copies")), vectors))
    yield from done()


def link_vectors(
    rows: DataFrame, least: float = THRESHOLD, id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
    cell_bytes: int = CELL_BYTES, spread: int = SPREAD,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `rows`."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & whole & F.exists(vector, lambda c: c != 0)
    hashes = [F.xxhash64(F.lit(seed), label, vector) for seed in (17, 71)]
    own = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label_key"), F.col(vector).alias("vector"),
        F.when(F.coalesce(usable, F.lit(False)), F.struct(hashes[0].alias("a"), hashes[1].alias("b"))).alias("class"),
    )
    classes = own.where("class is not null").groupBy("label_key", "class").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id")
    ).select("*", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("node"))
    classes = stored(classes, "classes")
    width = {"double": 8}.get(classes.schema["vector"].dataType.elementType.typeName(), 4)
    most = F.ceil(F.col("count") * F.col("dims") * width / cell_bytes)
    sizes = classes.groupBy("label_key", "dims").count().where(F.col("count") > spread).select(
        F.col("label_key").alias("l"), F.col("dims").alias("d"),
        F.greatest(most, F.least(F.lit(4), F.ceil(F.col("count") / spread))).alias("cells"),
    )
    members = classes.join(sizes, (F.col("label_key") == F.col("l")) & (F.col("dims") == F.col("d")), "left").select(
        "label_key", "dims", "node", "copies", "vector", F.coalesce("cells", F.lit(1)).alias("cells")
    ).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).select(
        "label_key", "dims", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "node", "copies",
        "vector",
    )
    task = ["label_key", "dims", "i", "j"]
    links = members.repartition(*task).sortWithinPartitions(*task, "cell", "node").mapInArrow(
        partial(_tasks, least=least), "node long, root long, links long"
    )
    links = stored(links, "links")
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    of_class = classes.select("class", "node", "copies", "least_id").join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left")
    of_class = of_class.join(counts, F.col("node") == F.col("l_node"), "left").select(
        F.col("class").alias("c"), "least_id", F.coalesce("root", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    names = of_class.groupBy(F.col("component").alias("of")).agg(F.min("least_id").alias("name"))
    of_class = of_class.join(names, F.col("component") == F.col("of")).select("c", "n_links", "name")
    found = own.select("vec_id", "class").join(of_class, F.col("class") == F.col("c"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("c").isNotNull(), F.col("name")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
