"""Secret scans with multipart credential linking.

Base rules find assignments, access identifiers and long hexadecimal strings. The method adds weak candidates - user or client
names, tokens of mixed characters, endpoints - which say little alone: a scope is the text between two blank lines, and the
parts' intervals are joined with the scopes' intervals, however far apart the parts stand in one. A name is reported if there is
a secret in its scope, a token if there is an access identifier or a name, an endpoint if there are both. A text is scanned
whole, by itself, over its UTF-8 bytes; nothing is shuffled, and parts are counted by scope, so many parts in one text cost their sorting.

Defined cases: null text is empty and has no spans; equal rows get equal results; a span that overlaps a base span is not
added; only doc_id and text are looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "linked_name", "linked_secret", "linked_endpoint")
ENTROPY = 3.2  # bits per character of a token at least

# Fixed values of the contract, over text whose A-Z are lower case (assign) or as it is.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # runs of 24 and more: a run begins where the leftmost match does

NAME = re.compile(
    rb"""\b(?:access[_-]?key[_-]?id|client[_-]?id|user[_-]?name|user|login|account|tenant)["']?\x20*[:=]\x20*["']?([a-z0-9@+/_.-]{3,})"""
)
NAME_WORDS = (b"access", b"client", b"user", b"login", b"account", b"tenant")
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]*://[^\x00-\x20\"'<>]+")
BLANK = re.compile(rb"\n[\x20\t\r]*\n")

FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
     ("base_sha256", pa.string()), ("spans", pa.string())]
)
Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(data: bytes) -> list[Span]:
    """In bytes, by start, then kind."""
    low = data.lower()
    spans = []
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(spans)


def _mixed(token: bytes) -> bool:
    """Letters and digits, spread as in a key rather than a word."""
    if not (re.search(rb"[0-9]", token) and re.search(rb"[A-Za-z]", token)):
        return False
    counts = Counter(token)
    return -sum(n / len(token) * log2(n / len(token)) for n in counts.values()) >= ENTROPY


class Parts:
    """Intervals of one role, by scope."""

    def __init__(self, spans: list[tuple[int, int]], breaks: list[int]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.breaks = breaks
        self.own = set(self.spans)
        self.in_scope = Counter(bisect_right(breaks, start) for start in self.starts)

    def near(self, start: int, end: int) -> bool:
        """Is there a part, other than this interval, in the scope of the interval?"""
        return self.in_scope[bisect_right(self.breaks, start)] > ((start, end) in self.own)


def linked_spans(data: bytes, base: list[Span]) -> list[Span]:
    """Weak candidates whose complementary parts are in their scope."""
    low = data.lower()
    names = [m.span() for m in NAME.finditer(low)] if any(word in low for word in NAME_WORDS) else []
    identifiers = [(s, e) for s, k, e in base if k == 1] + names
    if not identifiers:
        return []
    taken, ends = [s for s, _, _ in base], [e for _, _, e in base]
    longest = max((e - s for s, _, e in base), default=0)

    def free(start: int, end: int) -> bool:
        low_at = bisect_left(taken, start - longest)
        return all(ends[k] <= start for k in range(low_at, bisect_left(taken, end)))

    breaks = [m.end() for m in BLANK.finditer(data)]
    names = [(s, e) for s, e in names if free(s, e)]
    ends_of_names = Parts(names, breaks)
    endpoints = [m.span() for m in ENDPOINT.finditer(low)]
    inside = Parts(endpoints, breaks)

    def outside(start: int, end: int, parts: Parts) -> bool:
        at = bisect_right(parts.starts, start) - 1
        before = at >= 0 and parts.spans[at][1] > start
        return not before and (at + 1 >= len(parts.spans) or parts.spans[at + 1][0] >= end)

    tokens = [
        m.span() for m in TOKEN.finditer(data)
        if free(*m.span()) and outside(*m.span(), ends_of_names) and outside(*m.span(), inside) and _mixed(m[0])
    ]
    ids = Parts(identifiers, breaks)
    secrets = Parts([(s, e) for s, k, e in base if k != 1] + tokens, breaks)
    spans = [(s, 3, e) for s, e in names if secrets.near(s, e)]
    spans += [(s, 4, e) for s, e in tokens if ids.near(s, e)]
    spans += [(s, 5, e) for s, e in endpoints if free(s, e) and ids.near(s, e) and secrets.near(s, e)]
    return spans


def _joined(spans: list[Span], data: bytes) -> str:
    """kind:start:end in code points."""
    if not spans:
        return ""
    if data.isascii():
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    later = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)  # bytes that begin no character
    point = lambda at: at - int(later[at - 1]) if at else 0
    return ",".join(f"{KINDS[k]}:{point(s)}:{point(e)}" for s, k, e in spans)


def scan_text(data: bytes, link: bool = True) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text's bytes."""
    base = base_spans(data)
    return base, sorted(base + linked_spans(data, base)) if link else base


def _scan(batches: Iterator[pa.RecordBatch], link: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].cast(pa.large_binary()):
            data = text.as_py() or b""
            base, spans = scan_text(data, link)
            kinds = Counter(k for _, k, _ in base)
            digest = hashlib.sha256(_joined(base, data).encode()).hexdigest()
            rows.append((kinds[0], kinds[1], kinds[2], digest, _joined(spans, data)))
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), list(FOUND)[1:])] if rows else [pa.array([], f.type) for f in list(FOUND)[1:]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], schema=FOUND)


def scan(docs: DataFrame, link: bool = True) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(partial(_scan, link=link), schema)
