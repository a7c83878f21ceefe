"""WARC archives through a table of chunks.

A payload becomes rows (record, chunk number, bytes of at most CHUNK), which a task streams into a gzip member per record:
only a chunk is in the writer's memory. Reading streams members again and gives chunk rows that carry the SHA-1 of all bytes
so far, so the digest of a record is the one of its last chunk; a response whose digest differs from its header is an error.
The manifest has a row per run of records, which are the units of parallel reading.

Of records with equal payloads (by length and SHA-256) of at least LEAST bytes, that with the largest page_id is the
response and the others revisit it.

Defined cases: null html is the empty payload; null page_ids lose against any other, and are responses if there is no other;
rows with equal page_id and payload are alike (all responses, or all revisits) and share a record id; a null url is left out
of the record; line breaks in urls are percent-encoded; no rows give no archives; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstats.llm import storage
from loomstats.llm.common import scratch, spread, stored

CHUNK = 1 << 16
LEAST = 1000
RUN = 8 << 20  # payload bytes of a manifest row, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])
CHUNKS = pa.schema(
    [("uri", pa.string()), ("offset", pa.int64()), ("record", pa.int64()), ("chunk", pa.int64()), ("page_id", pa.int64()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("said_bytes", pa.int64()), ("said_digest", pa.string()),
     ("bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())]
)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, size, sha1, record_type, refers_to of every page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "key": F.sha2("payload", 256)})
    groups = rows.where(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select("key", "size", "first"), "payloads")
    rows = rows.join(groups, ["key", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", "payload", "size", F.sha1("payload").alias("sha1"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def chunk_table(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row per chunk, those of a record one after the other; revisits and empty payloads have one without bytes."""
    n = F.when(F.col("record_type") == "response", F.greatest(F.lit(1), F.ceil(F.col("size") / chunk))).otherwise(1).cast("int")
    begins = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * chunk + 1)
    cut = rows.withColumn("last", n - 1).select("*", F.posexplode(begins).alias("number", "begin"))
    data = F.when(F.col("record_type") == "response", F.substring("payload", F.col("begin"), F.lit(chunk))).otherwise(F.lit(b""))
    return cut.select("page_id", "url", "size", "sha1", "record_type", "refers_to", "number", "last", data.alias("data"))


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page:{page_id}'.encode()).hexdigest())}>"


def _head(row: dict, date: str) -> bytes:
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {row['size']}\r\n\r\n"
    response = row["record_type"] == "response"
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _id(row["page_id"])), ("WARC-Date", date),
        ("WARC-Target-URI", None if row["url"] is None else quote(row["url"], safe="".join(map(chr, range(33, 127))))),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
        ("WARC-Profile", None if response else PROFILE),
        ("WARC-Refers-To", None if response else _id(row["refers_to"])),
        ("X-Page-ID", row["page_id"]), ("X-Refers-To-Page-ID", row["refers_to"]), ("X-Payload-Length", row["size"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (row["size"] if response else 0)),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{lines}\r\n{http}".encode()


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    out, uri, packer = None, "", None
    runs: list[tuple] = []
    offset = begin = payload = count = 0

    def put(data: bytes) -> None:
        nonlocal offset
        if data:
            out.write(data)
            offset += len(data)

    for batch in batches:
        data = batch["data"]
        heads = batch.drop_columns(["data"])
        for k in range(len(batch)):
            row = {name: heads[name][k].as_py() for name in heads.schema.names}
            if out is None:
                uri, out = storage.create(folder, ".warc.gz")
            if row["number"] == 0:
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                put(packer.compress(_head(row, date)))
            body = data[k].as_py()
            put(packer.compress(body))
            payload += len(body)
            if row["number"] == row["last"]:
                put(packer.compress(b"\r\n\r\n") + packer.flush())
                count += 1
                if payload >= RUN:
                    runs.append((uri, begin, offset - begin, count))
                    begin, payload, count = offset, 0, 0
    if count:
        runs.append((uri, begin, offset - begin, count))
    if out is not None:
        out.close()
        yield _rows(runs, MANIFEST)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def write_archives(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; returns the stored manifest."""
    folder = scratch(pages.sparkSession, "warc")
    chunks = chunk_table(records(pages, least), chunk)
    schema = "uri string, offset long, length long, records long"
    return stored(chunks.mapInArrow(partial(_write, folder=folder, date=date), schema), "manifest")


class _Members:
    """The gzip members of a stretch of a file, each as pieces of bounded size."""

    def __init__(self, stream, length: int, piece: int):
        self.stream, self.left, self.piece, self.raw = stream, length, piece, b""

    def _more(self) -> bool:
        if not self.raw and self.left:
            self.raw = self.stream.read(min(self.piece, self.left))
            self.left -= len(self.raw)
        return bool(self.raw)

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self._more():
            yield self._pieces()

    def _pieces(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not self._more():
                raise ValueError("archive ends inside a record")
            piece = unpack.decompress(self.raw, self.piece)
            self.raw = unpack.unconsumed_tail or unpack.unused_data
            if piece:
                yield piece


def _until_blank(pieces: Iterator[bytes], held: bytes) -> tuple[bytes, bytes]:
    while (end := held.find(b"\r\n\r\n")) < 0:
        held += next(pieces)
    return held[:end], held[end + 4 :]


def read_record(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str]]:
    """Header fields, bytes and SHA-1 so far for each chunk of a record's payload; at least one."""
    head, held = _until_blank(pieces, b"")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, held = _until_blank(pieces, held)
    left = int(fields["Content-Length"]) - len(http) - 4
    digest, any_yet = hashlib.sha1(), False
    while left or not any_yet:
        if left and not held:
            held = next(pieces)
        now, held = held[:left], held[left:]
        left -= len(now)
        digest.update(now)
        any_yet = True
        yield fields, now, digest.hexdigest()
    rest = held + b"".join(pieces)
    if rest != b"\r\n\r\n":
        raise ValueError("WARC record: bad end")


def _read(batches: Iterator[pa.RecordBatch], data: bool, piece: int) -> Iterator[pa.RecordBatch]:
    whole = lambda text: None if text is None else int(text)
    for batch in batches:
        for run in batch.to_pylist():
            with storage.open_file(run["uri"]) as stream:
                stream.seek(run["offset"])
                rows, held, count = [], 0, 0
                for number, pieces in enumerate(_Members(stream, run["length"], piece)):
                    count += 1
                    for chunk, (fields, body, digest) in enumerate(read_record(pieces)):
                        said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append(
                            (run["uri"], run["offset"], number, chunk, whole(fields.get("X-Page-ID")), fields["WARC-Type"],
                             whole(fields.get("X-Refers-To-Page-ID")), int(fields["X-Payload-Length"]), said, len(body), digest,
                             body if data else None)
                        )
                        held += len(body) if data else 100
                        if held >= 1 << 22:
                            yield _rows(rows, CHUNKS)
                            rows, held = [], 0
                    if fields["WARC-Type"] == "response" and digest != said:
                        raise ValueError(f"{run['uri']}: payload digest differs")
                if count != run["records"]:
                    raise ValueError(f"{run['uri']}: {count} records instead of {run['records']}")
                if rows:
                    yield _rows(rows, CHUNKS)


def read_chunks(manifest: DataFrame, data: bool = True, piece: int = CHUNK) -> DataFrame:
    """The chunk table read back from archives; without `data` the bytes are counted and digested only."""
    schema = (
        "uri string, offset long, record long, chunk long, page_id long, record_type string, refers_to long, "
        "said_bytes long, said_digest string, bytes long, digest string, data binary"
    )
    return spread(manifest).mapInArrow(partial(_read, data=data, piece=piece), schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    rows = read_chunks(manifest, data=False).groupBy("uri", "offset", "record").agg(
        *[F.first(c).alias(c) for c in ("page_id", "record_type", "refers_to", "said_bytes", "said_digest")],
        F.sum("bytes").alias("bytes"), F.max_by("digest", "chunk").alias("digest"),
    )
    response = F.col("record_type") == "response"
    return rows.select(
        "page_id", F.when(response, F.col("bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("said_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
