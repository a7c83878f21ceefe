"""Benchmark decontamination with an FM-index per training shard.

Each task gathers documents into shards of about SHARD words and indexes, per block of benchmark items, the runs of words
that occur in those items (other words end a run: no phrase goes across them; runs shorter than the shortest phrase are left
out, as no phrase fits). All phrases are searched backwards at once through wavelet ranks, occurrences are located from
sampled suffix positions, and their word spans are merged per document. Documents are read once and never shuffled.

Benchmark items go to the tasks through a Parquet file in the shared folder, read in blocks of BLOCK items, so neither
driver nor task holds all of them.

Defined cases: null or wordless texts have no words and no hits; wordless items have no phrases; items with equal ids are one
item, a null item id is named "null"; an empty benchmark leaves all documents clean; equal rows are judged alike; only
doc_id and text, item_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstats.llm import hashing, storage
from loomstats.llm.common import scratch
from loomstats.llm.fmindex import FMIndex

WINDOW = 10
SHARD = 4_000_000  # words
BLOCK = 2_000  # items
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def _item_blocks(folder: str) -> Iterator[tuple[list[str], pa.Array]]:
    system, path = storage.resolve(folder)
    from pyarrow.fs import FileSelector

    for info in sorted(system.get_file_info(FileSelector(path)), key=lambda f: f.path):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(BLOCK, columns=["item", "text"]):
                    if len(batch):
                        yield batch.column("item").to_pylist(), batch.column("text")


class Phrases:
    """The distinct phrases of a block of items as rows of symbols, and the items of each."""

    def __init__(self, items: list[str], texts: pa.Array, window: int):
        per_item: list[np.ndarray] = []
        for _, hashes, bounds in hashing.words(texts, hashing.ALPHANUMERIC):
            per_item += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.names, number = np.unique(np.array(items, object).astype(str), return_inverse=True)
        self.vocabulary = np.unique(np.concatenate(per_item))
        rows, lengths, owner = [], [], []
        for item, hashes in zip(number.tolist(), per_item):
            symbols = np.searchsorted(self.vocabulary, hashes) + 1
            width = min(window, len(symbols))
            for at in range(len(symbols) - width + 1) if width else ():
                rows.append(np.pad(symbols[at : at + width], (0, window - width)))
                lengths.append(width)
                owner.append(item)
        self.least = min(lengths, default=0)
        if rows:
            self.patterns, which = np.unique(np.stack(rows), axis=0, return_inverse=True)
            self.lengths = np.count_nonzero(self.patterns, axis=1)
            pairs = np.unique(np.stack([which.ravel(), np.array(owner)], 1), axis=0)
            self.owner = pairs[:, 1]
            self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the intervals, and which interval each is of."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n), which


def find(hashes: np.ndarray, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of phrases in the words of a shard: first word, words, phrase. `bounds` are those of its documents."""
    none = np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    edges = bounds[(bounds < len(known))]
    begins[edges] = known[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        return none, none, none
    ends = known.copy()
    ends[:-1] &= ~known[1:]
    ends[edges[edges > 0] - 1] = known[edges[edges > 0] - 1]
    size = np.flatnonzero(ends) + 1 - start
    start, size = start[size >= phrases.least], size[size >= phrases.least]
    if not len(start):
        return none, none, none
    word, run = _expand(start, start + size + 1)  # one place more per run, for the zero after it
    text = np.zeros(len(word), np.int64)
    last = np.cumsum(size + 1) - 1
    inside = np.ones(len(word), bool)
    inside[last] = False
    text[inside] = at[word[inside]] + 1
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.patterns, phrases.lengths)
    rows, phrase = _expand(low, np.maximum(low, high))
    return word[index.locate(rows)], phrases.lengths[phrase], phrase


def _search_shard(docs: pa.Array, hashes: np.ndarray, bounds: np.ndarray, folder: str, window: int) -> pa.RecordBatch:
    cover = np.zeros(len(hashes) + 1, np.int64)
    found: dict[int, set[str]] = {}
    for items, texts in _item_blocks(folder):
        phrases = Phrases(items, texts, window)
        if not phrases.least:
            continue
        word, size, phrase = find(hashes, bounds, phrases)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + size, -1)
        doc = np.searchsorted(bounds, word, "right") - 1
        entry, which = _expand(phrases.bounds[phrase], phrases.bounds[phrase + 1])
        pairs = np.unique(doc[which] * np.int64(len(phrases.names)) + phrases.owner[entry])
        for d, item in zip((pairs // len(phrases.names)).tolist(), (pairs % len(phrases.names)).tolist()):
            found.setdefault(d, set()).add(str(phrases.names[item]))
    hit = np.cumsum(cover[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(hit)])
    n_hit = before[bounds[1:]] - before[bounds[:-1]]
    spans = [[] for _ in range(len(docs))]
    for d in np.flatnonzero(n_hit).tolist():
        own = np.diff(np.concatenate([[0], hit[bounds[d] : bounds[d + 1]].astype(np.int8), [0]]))
        spans[d] = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [docs, pa.array(np.diff(bounds)), pa.array(n_hit), pa.array([sorted(found.get(d, ())) for d in range(len(docs))], pa.list_(pa.string())),
         pa.array(spans, pa.list_(span))],
        names=["_doc", "n_words", "n_hit", "items", "spans"],
    )


def _search(batches: Iterator[pa.RecordBatch], folder: str, window: int) -> Iterator[pa.RecordBatch]:
    docs, hashes, sizes, words = [], [], [], 0

    def done() -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        return _search_shard(pa.concat_arrays(docs), np.concatenate(hashes), bounds, folder, window)

    for batch in batches:
        for first, part, bounds in hashing.words(batch["_text"], hashing.ALPHANUMERIC):
            docs.append(batch["_doc"].slice(first, len(bounds) - 1))
            hashes.append(part)
            sizes.append(np.diff(bounds))
            words += len(part)
            if words >= SHARD:
                yield done()
                docs, hashes, sizes, words = [], [], [], 0
    if docs:
        yield done()


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns `keep` in struct `_doc`; words, hit words, items found, and merged spans of words to remove."""
    folder = scratch(docs.sparkSession, "items")
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    benchmark.select(item.alias("item"), "text").write.parquet(folder)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), F.col("text").alias("_text"))
    schema = f"_doc {rows.schema['_doc'].dataType.simpleString()}, {FOUND}"
    return rows.mapInArrow(partial(_search, folder=folder, window=window), schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a hit."""
    return scan(docs, benchmark, docs.columns, window).where("n_hit = 0").select("_doc.*")
