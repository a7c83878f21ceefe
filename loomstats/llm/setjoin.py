"""Exact Jaccard self-join of shingle sets by index-level and answer-level skipping of related sets.

1. A set is its texts' distinct shingle hashes; equal sets are one class. Classes, not documents, are joined.
2. Index: the first shingles of each set in a common order - frequent ones last - such that linked sets share one of them.
   Lists are ordered by set size: a probe skips the block where sizes are out of reach, and the ones already tied to it. Two
   sets of a list are tied if their sketches (BITS one-bit min-hashes) differ in at most FAR places; a linked pair differs in
   BITS * 7.5 % on average, and exceeds FAR with a probability below 1e-12, less than that of equal hashes of two words.
   Ties are emitted as a spanning forest of each list, never as its pairs.
3. The connected parts of the ties hold every linked pair. A part is dealt to tasks by cells of bounded numbers of
   shingles (one task per pair of cells), and every task compares exactly: sets are taken in an order that puts related ones
   beside each other, and the overlaps of a set with all others are those of the set before it, changed by the lists of the
   shingles in which the two differ.
4. Links give components; copies and classes are brought back to documents.

The frequent shingles (in at least one of FREQUENT documents) are found by counts that each task reports if they can matter;
there are at most 2 * FREQUENT * mean set size of them whatever the number of documents, and they are broadcast.

Defined cases: null or wordless texts have an empty set, no links and themselves as component; rows with equal ids and texts
are documents of their own, linked with each other; null ids take part, but a component's id is its least id that is not
null; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstats.llm import hashing
from loomstats.llm.common import stored
from loomstats.llm.graph import components

WIDTH, PERCENT = 4, 85
FREQUENT = 200
CELL = 2_000_000  # shingles of a cell; a task has two of them at most
BITS, FAR = 128, 38

COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])
SETS = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())),
     ("prefix", pa.list_(pa.int64()))]
)
TIES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_TURNS = np.random.default_rng(128).integers(1, 1 << 62, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LINKS = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequent_here(batches: Iterator[pa.RecordBatch], width: int, share: int) -> Iterator[pa.RecordBatch]:
    """Shingles in more than one of 2 * `share` documents of this task, with their counts.

    If a shingle is in one of `share` documents of the corpus, the tasks that keep silent about it miss half of that at most.
    """
    known, counts, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    held: list[np.ndarray] = []
    size = 0

    def fold() -> None:
        nonlocal known, counts, held, size
        values, n = np.unique(np.concatenate(held), return_counts=True)
        both, at = np.unique(np.concatenate([known, values]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
        known, held, size = both, [], 0

    for batch in batches:
        for shingles in hashing.shingle_sets(batch.column("text"), width):
            held.append(shingles)
            size += len(shingles)
            docs += 1
            if size > 8_000_000:
                fold()
    if held:
        fold()
    often = counts >= max(2, docs // (2 * share))
    if often.any():
        yield pa.RecordBatch.from_arrays([pa.array(_signed(known[often])), pa.array(counts[often])], schema=COUNTS)


def frequent_shingles(docs: DataFrame, width: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles in at least 1 / `share` of the documents (and some less frequent), and their rank."""
    least = max(8, docs.count() // (2 * share))
    counts = docs.select("text").mapInArrow(partial(_frequent_here, width=width, share=share), "token long, n long")
    rows = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    tokens = rows["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens, n = tokens[order], rows["n"].to_numpy()[order]
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((tokens, n))] = np.arange(len(n))
    return tokens, rank


def prefix_of(shingles: np.ndarray, percent: int, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of the index: of any set of `percent` or more similarity, the index has one of these too."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    if not len(often):
        return shingles[:size]
    at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
    is_often = often[at] == shingles
    rare = shingles[~is_often]
    if len(rare) >= size:
        return rare[:size]
    late = shingles[is_often][np.argsort(rank[at[is_often]])]
    return np.concatenate([rare, late[: size - len(rare)]])


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a = hashing.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = hashing.mix(shingles ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, each of which equals that of another set with probability (1 + Jaccard similarity) / 2."""
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * _TURNS).min(0), out=least)
    return np.packbits(hashing.mix(least) & np.uint64(1) == 1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int, often) -> Iterator[pa.RecordBatch]:
    tokens, rank = often.value
    for batch in batches:
        sigs, sizes, prefixes, sketches = [], [], [], []
        for shingles in hashing.shingle_sets(batch.column("text"), width):
            sizes.append(len(shingles))
            sigs.append(signature(shingles) if len(shingles) else None)
            sketches.append(sketch(shingles).tolist() if len(shingles) else None)
            prefixes.append(_signed(prefix_of(shingles, percent, tokens, rank)) if len(shingles) else None)
        flat = [p for p in prefixes if p is not None]
        ends = np.cumsum([0] + [0 if p is None else len(p) for p in prefixes]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(sketches, pa.list_(pa.int64())), lists],
            schema=SETS,
        )


def tie_list(n: np.ndarray, node: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the ties of one list, which is ordered by size n."""
    ends = np.searchsorted(n, n * 100 // percent, "right")
    label, out = np.arange(len(n)), []
    for i in range(len(n) - 1):
        block = slice(i + 1, ends[i])
        rest = np.flatnonzero(label[block] != label[i]) + i + 1
        if not len(rest):
            continue
        differ = np.bitwise_count(left[rest] ^ left[i]) + np.bitwise_count(right[rest] ^ right[i])
        for j in rest[differ <= FAR].tolist():
            if label[j] != label[i]:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return out


def _ties(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token, n and node; lists of two are tied all at once."""
    held: list[np.ndarray] | None = None

    def tied(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        _, n, node, left, right = columns
        two = starts[ends - starts == 2]
        differ = np.bitwise_count(left[two] ^ left[two + 1]) + np.bitwise_count(right[two] ^ right[two + 1])
        two = two[(differ <= FAR) & (n[two + 1] * percent <= n[two] * 100)]
        pairs = [np.stack([node[two], node[two + 1]], 1)]
        more = ends - starts > 2
        for low, high in zip(starts[more].tolist(), ends[more].tolist()):
            found = tie_list(n[low:high], node[low:high], left[low:high], right[low:high], percent)
            if found:
                pairs.append(np.array(found, np.int64))
        rows = np.unique(np.concatenate(pairs), axis=0)
        rows = rows[rows[:, 0] != rows[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], schema=TIES) if len(rows) else None

    for batch in batches:
        columns = [batch[name].to_numpy() for name in ("token", "n", "node", "left", "right")]
        columns[3:] = [c.view(np.uint64) for c in columns[3:]]  # bits of signed numbers are not counted as they are
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns)]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(columns[0])) + 1, [len(columns[0])]])
        held = [c[bounds[-2] :] for c in columns] if len(bounds) > 1 else columns
        if len(bounds) > 2 and (out := tied(columns, bounds[:-2], bounds[1:-1])) is not None:
            yield out
    if held is not None and len(held[0]) and (out := tied(held, np.array([0]), np.array([len(held[0])]))) is not None:
        yield out


def compare(
    sets: list[np.ndarray], copies: np.ndarray, cells: np.ndarray, percent: int, across: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and the component of each set; `across`: of sets in different cells only."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1  # a shingle of one set alone is in no overlap
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(times)))])
    ends = np.searchsorted(owner, np.arange(m + 1))
    tokens = [token[ends[i] : ends[i + 1]] for i in range(m)]
    links, label = np.zeros(m, np.int64), np.arange(m)

    def lists(of: np.ndarray) -> np.ndarray:
        if len(of) < 64:
            parts = [posting[bounds[t] : bounds[t + 1]] for t in of.tolist()]
            return np.bincount(np.concatenate(parts), minlength=m) if parts else np.zeros(m, np.int64)
        low, n = bounds[of], bounds[of + 1] - bounds[of]
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        return np.bincount(posting[at], minlength=m)

    last, overlap = None, np.zeros(m, np.int64)
    for i in sorted(range(m), key=lambda k: (sets[k][0], sizes[k])):
        mine = tokens[i]
        gone = more = None
        if last is not None:
            more = np.setdiff1d(mine, last, assume_unique=True)
            gone = np.setdiff1d(last, mine, assume_unique=True)
        if more is None or len(more) + len(gone) >= len(mine):
            overlap = lists(mine)
        else:
            overlap = overlap + lists(more) - lists(gone)
        last = mine
        near = 100 * overlap >= percent * (sizes[i] + sizes - overlap)
        near[i] = False
        if across:
            near &= cells != cells[i]
        found = np.flatnonzero(near)
        if len(found):
            links[i] += int(copies[found].sum())
            labels = np.unique(np.append(label[found], label[i]))
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    return links, label


def _compare_tasks(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; each task's sets are compared when its last row has come."""
    task, nodes, sets, copies, cells = None, [], [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            links, label = compare(sets, np.array(copies), np.array(cells), percent, task[1] != task[2])
            roots = np.array(nodes)[label]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(links)], schema=LINKS)

    for batch in batches:
        keys = zip(batch["part"].to_pylist(), batch["i"].to_pylist(), batch["j"].to_pylist())
        rest = (batch["node"].to_pylist(), batch["copies"].to_pylist(), batch["cell"].to_pylist())
        for key, node, n, cell, shingles in zip(keys, *rest, hashing.shingle_sets(batch["text"], width)):
            if key != task:
                yield from done()
                task, nodes, sets, copies, cells = key, [], [], [], []
            if not nodes or nodes[-1] != node:  # rows with equal ids and texts come as often as they are
                nodes.append(node)
                sets.append(shingles)
                copies.append(n)
                cells.append(cell)
    yield from done()


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, component, n_shingles, component_id, n_links: one row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    often = spark.sparkContext.broadcast(frequent_shingles(rows, width, FREQUENT))
    sets = stored(
        rows.mapInArrow(
            partial(_sets, width=width, percent=percent, often=often),
            "doc_id long, text_hash long, sig binary, n long, sketch array<long>, prefix array<long>",
        ),
        "sets",
    )
    classes = sets.where("sig is not null").groupBy("sig").agg(
        F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("at"),
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    at = classes.select("node", F.col("sig").alias("at_sig"), F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash"))
    # both joins of wide rows are merge joins at every size, as they must be where no side can be broadcast
    first = (F.col("sig") == F.col("at_sig")) & F.col("doc_id").eqNullSafe(F.col("at_id"))
    first &= F.col("text_hash").eqNullSafe(F.col("at_hash"))
    index = sets.join(at.hint("merge"), first).select(
        "n", "node", F.get("sketch", F.lit(0)).alias("left"), F.get("sketch", F.lit(1)).alias("right"), F.explode("prefix").alias("token")
    )
    ties = index.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(
        partial(_ties, percent=percent), "u long, v long"
    )
    parts = components(stored(ties.distinct(), "ties")).withColumnRenamed("root", "part")
    parts = stored(parts.join(classes, "node").select("node", "part", "n", "copies", "at"), "parts")
    sizes = parts.groupBy("part").agg(F.ceil(F.sum("n") / CELL).alias("cells"))
    members = parts.join(sizes, "part").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    members = members.select(
        "part", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "node", "copies", "cell",
        F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash"),
    )
    texts = rows.join(
        members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("at_id")) & F.col("text_hash").eqNullSafe(F.col("at_hash"))
    ).select("part", "i", "j", "node", "copies", "cell", "text")
    links = texts.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node").mapInArrow(
        partial(_compare_tasks, width=width, percent=percent), "node long, root long, links long"
    )
    links = stored(links, "links")
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    of_class = classes.join(roots, "node", "left").select(
        "sig", "node", "copies", "least_id", F.coalesce("root", "node").alias("component")
    )  # a class without links is its own root
    ids = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = links.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    of_class = of_class.join(ids, "component").join(linked, F.col("node") == F.col("l_node"), "left").select(
        F.col("sig").alias("c_sig"), "component", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return sets.join(of_class, F.col("sig") == F.col("c_sig"), "left").select(
        "doc_id", "text_hash", "component", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` per component, the one with the least doc_id, with all its columns.

    Rows without words stay. Of rows with the least id of their component (equal ids), the one whose text has the least
    hash stays; equal rows are one then. A component whose ids are all null keeps the row of the least text hash.
    """
    found = join(docs, width, percent)
    groups = found.where("n_shingles > 0").groupBy("component", "component_id").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("text_hash"))).alias("_hash")
    )
    # Plain equality of keys without nulls: what the join has brought together then needs no second exchange to lose its copies.
    key = ["_null", "_id", "_hash"]
    first = groups.select(*_row_key("component_id"), "_hash").distinct()
    all_of = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(
        all_of, F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"),
        *_row_key("doc_id"), F.xxhash64("text").alias("_hash"),
    )
    chosen = rows.where("_words").join(first.hint("merge"), key, "left_semi").dropDuplicates(key)
    return chosen.select("_doc.*").union(rows.where("not _words").select("_doc.*"))


def _row_key(name: str) -> tuple[Column, Column]:
    doc_id = F.col(name).cast("long")
    return doc_id.isNull().alias("_null"), F.coalesce(doc_id, F.lit(0)).alias("_id")
