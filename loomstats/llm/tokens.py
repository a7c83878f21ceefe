"""Token ids of documents as compressed binary files, in ascending document order.

Documents are partitioned by ranges of doc_id, tokenized where they then lie, and each task writes one file: frequency table,
then segments of whole documents, each segment a run of rANS blocks (see rans.py). The manifest, one row per segment with
file, offsets and counts, holds the checkpoints from which segments are decoded in parallel. A segment ends with the first
document that fills it; a longer document is one segment, read block by block.

File: b"LTOK1\\n", table, and per segment: documents (u32 count, then per document i64 id, u8 1 if the id is null, u64 ids),
blocks. All numbers are little-endian.

Defined cases: a null text is the empty one, of which only the end id is written; null doc_ids come first; rows with the same
doc_id are kept in the order of their texts, null first; no documents give no segments; only doc_id and text are looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstats.llm import rans, storage
from loomstats.llm.common import scratch, spread, stored

MAGIC = b"LTOK1\n"
END_ID = 2
FILE_IDS = 1 << 26  # ids after which a file ends, at the next document
SEGMENT = 1 << 21  # ids after which a segment ends at the next document
MEMO = 1_200_000  # words a worker remembers; those not asked for in the last half of it are forgotten, at the next text
DOC = struct.Struct("<qBQ")
MANIFEST = (
    "part int, segment int, uri string, table_size long, offset long, length long, documents long, tokens long"
)
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
HEAD_CHARS = 64  # of a text, by which rows of one id are dealt to tasks


class Words(dict):
    """Word -> number of its entry in `pool`; a missing word is tokenized by the library when asked for.

    Space is dropped by this tokenizer and nothing it does looks across space, so a text's ids are those of its words. Plain
    words (letters below U+0180, then stops and signs) are one or two pieces for the library's model; all others go through its
    whole pipeline.
    """

    PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([.,;:!?|#$%&*]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        level = str(self.tokenizer.pre_tokenizer)
        self.plain = "ByteLevel" in level and "Removed" in level
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.past: tuple[dict, np.ndarray, np.ndarray, np.ndarray] = ({}, *[np.zeros(0, np.int64)] * 3)
        self.stops: dict[str, list[int]] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new_ids: list[int] = []
        self.new_sizes: list[int] = []
        self.used = self.entries = 0

    def age(self) -> None:
        """The words so far become the older half: those asked for again are taken over, the rest goes the next time."""
        past = dict(self), self.pool, self.start, self.size
        self.clear()
        self.past = past

    def ids_of(self, word: str) -> list[int]:
        plain = self.PLAIN.fullmatch(word.lower()) if self.plain else None
        if plain is None:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        letters, stops = plain.groups()
        ids = []
        if letters:
            ids = self._remembered(letters) if letters != word else None  # without its stop, or with a capital
            if ids is None:
                ids = [t.id for t in self.tokenizer.model.tokenize(letters if letters.isascii() else letters.translate(self.letters))]
        if stops:
            known = self.stops.get(stops)
            if known is None:
                known = self.stops[stops] = [t.id for t in self.tokenizer.model.tokenize(stops)]
            ids = ids + known
        return ids

    def _remembered(self, word: str) -> list[int] | None:
        """Ids of a word of either half, if it is in the arrays."""
        known, pool, start, size = self.get(word), self.pool, self.start, self.size
        if known is None or known >= self.entries:
            words, pool, start, size = self.past
            known = words.get(word)
        return None if known is None else pool[start[known] : start[known] + size[known]].tolist()

    def __missing__(self, word: str) -> int:
        ids = self._remembered(word)
        if ids is None:
            ids = self.ids_of(word)
        k = self.entries + len(self.new_sizes)
        self.new_ids += ids
        self.new_sizes.append(len(ids))
        self[word] = k
        return k

    def _settle(self) -> None:
        """Put new entries into the arrays, which grow by doubling."""
        ids, sizes = np.array(self.new_ids, np.uint32), np.array(self.new_sizes, np.int64)
        self.new_ids, self.new_sizes = [], []
        starts = self.used + np.cumsum(sizes) - sizes
        self.pool = _put(self.pool, self.used, ids)
        self.start = _put(self.start, self.entries, starts)
        self.size = _put(self.size, self.entries, sizes)
        self.used += len(ids)
        self.entries += len(sizes)

    def encode(self, text: str) -> np.ndarray:
        for space in "\n\t\r":
            text = text.replace(space, " ")
        out = [self._encode(part) for part in _pieces(text, 1 << 18)]
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _encode(self, text: str) -> np.ndarray:
        words = text.split(" ")
        if len(self) > MEMO // 2:
            self.age()
        known = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new_sizes:
            self._settle()
        size = self.size[known]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[known] - (ends - size), size)
        return self.pool[at]


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    if at + len(values) > len(array):
        grown = np.zeros(max(2 * len(array), at + len(values), 1024), array.dtype)
        grown[:at] = array[:at]
        array = grown
    array[at : at + len(values)] = values
    return array


_WORDS: dict[str, Words] = {}


def _pieces(text: str, most: int) -> Iterator[str]:
    """Parts of at most about `most` characters, cut at spaces; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at, at + most)
        cut = cut if cut > at else text.find(" ", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def words_of(path: str) -> Words:
    """One memo per worker process and vocabulary."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def _write_part(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, file_ids: int
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, words = TaskContext.get().partitionId(), words_of(path)
    ends = np.array([end_id], np.uint32)
    docs: list[tuple[int | None, int]] = []
    chunks: list[np.ndarray] = []
    held, segments = 0, 0
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for doc_id, text in zip(ids, texts):
            coded = words.encode(text.as_py() or "")
            # ids below 2**16 take half the memory until the file is written
            chunks.append(np.concatenate([coded, ends]).astype(np.uint16 if coded.max(initial=0) < 1 << 16 else np.uint32))
            docs.append((doc_id, len(coded) + 1))
            held += len(coded) + 1
            if held >= file_ids:
                rows = _write_file(folder, part, segments, docs, chunks, end_id)
                docs, chunks, held, segments = [], [], 0, segments + len(rows)
                yield _batch(rows, MANIFEST_ARROW)
    if docs:
        yield _batch(_write_file(folder, part, segments, docs, chunks, end_id), MANIFEST_ARROW)


def _write_file(folder: str, part: int, segments: int, docs: list, chunks: list[np.ndarray], end_id: int) -> list[tuple]:
    """A file with a frequency table of its own; its segments' rows of the manifest, numbered from `segments` on."""
    counts = np.zeros(end_id + 1, np.int64)
    for block in _blocks(chunks):  # of many documents at once: a count is as long as the vocabulary
        seen = np.bincount(block, minlength=len(counts))
        seen[: len(counts)] += counts
        counts = seen
    coder = rans.Table.of_counts(counts)
    uri, stream = storage.create(folder, ".ltok")
    rows = []
    with stream:
        head = MAGIC + coder.pack()
        stream.write(head)
        offset, first = len(head), 0
        while first < len(docs):
            last, size = first, 0
            while last < len(docs) and size < SEGMENT:
                size += docs[last][1]
                last += 1
            index = struct.pack("<I", last - first) + b"".join(
                DOC.pack(d or 0, d is None, n) for d, n in docs[first:last]
            )
            stream.write(index)
            length = len(index)
            for block in _blocks(chunks[first:last]):
                data = rans.encode(block, coder)
                stream.write(data)
                length += len(data)
            rows.append((part, segments + len(rows), uri, len(head), offset, length, last - first, size))
            offset, first = offset + length, last
    return rows


def _blocks(chunks: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The ids of the chunks in blocks of rans.BLOCK."""
    held: list[np.ndarray] = []
    size = 0
    for chunk in chunks:
        while size + len(chunk) >= rans.BLOCK:
            cut = rans.BLOCK - size
            yield np.concatenate([*held, chunk[:cut]])
            held, size, chunk = [], 0, chunk[cut:]
        if len(chunk):
            held.append(chunk)
            size += len(chunk)
    if held:
        yield np.concatenate(held)


MANIFEST_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("uri", pa.string())]
    + [(n, pa.int64()) for n in ("table_size", "offset", "length", "documents", "tokens")]
)
READ_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), field.type) for column, field in zip(zip(*rows), schema)], schema=schema
    )


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents; returns the stored manifest. `vocabulary` is a tokenizers file on every machine.

    A task holds `file_ids` ids, and those of one document more, whatever the size of its partition.
    """
    folder = scratch(docs.sparkSession, "tokens")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, HEAD_CHARS).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    return stored(ordered.mapInArrow(partial(_write_part, folder=folder, path=vocabulary, end_id=end_id, file_ids=file_ids), MANIFEST), "manifest")


def decode_segment(uri: str, table_size: int, offset: int, length: int) -> Iterator[tuple[int | None, int, Iterator]]:
    """(doc_id, n_tokens, parts of its ids) per document; one block is in memory at a time. Parts must be used in turn."""
    with storage.open_file(uri) as stream:
        head = stream.read(table_size)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        coder = rans.Table.unpack(head[len(MAGIC) :])
        stream.seek(offset)
        (n,) = struct.unpack("<I", stream.read(4))
        index = stream.read(n * DOC.size)
        left = np.zeros(0, np.uint32)

        def parts(size: int) -> Iterator[np.ndarray]:
            nonlocal left
            while size:
                if not len(left):
                    block = stream.read(rans.HEAD.size)
                    left = rans.decode(block, stream.read(rans.body_size(block)), coder)
                now, left = left[:size], left[size:]
                size -= len(now)
                yield now

        for doc_id, null, size in DOC.iter_unpack(index):
            yield (None if null else doc_id), size, parts(size)


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            out = []
            segment = decode_segment(row["uri"], row["table_size"], row["offset"], row["length"])
            start = row["start"]
            for doc_id, size, parts in segment:
                check = 0
                for ids in parts:
                    check = zlib.crc32(ids.astype("<u4").tobytes(), check)
                out.append((doc_id, start, size, check))
                start += size
            if out:
                yield _batch(out, READ_ARROW)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. Segments are decoded in parallel.

    The start of a segment is summed up over the manifest, which has a row per two million ids or more, and handed to the task that
    reads the segment; no table of documents is joined or ordered.
    """
    before = W.orderBy("part", "segment").rowsBetween(W.unboundedPreceding, -1)
    segments = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return spread(segments).mapInArrow(_read_segments, READ)


def token_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of all documents, read them back."""
    return read_tokens(write_tokens(docs, vocabulary or token_file()))
