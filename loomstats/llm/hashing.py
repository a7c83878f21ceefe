"""Hashes of the words of many texts at once, over the bytes of an Arrow column.

A word's hash is the difference of two prefix sums of weighted byte values, brought back to a common origin and mixed, all
modulo 2**64; words are told apart by 64 bits. Works in pieces of PIECE bytes, so a text of any length takes bounded memory
beside the hashes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_ROLES = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Fixed values of the contracts: which bytes belong to words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)
        ]
    return _powers


def _piece_words(data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and begins of the words in `data`; no word crosses a position of `starts`."""
    inside = kind[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[starts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[starts[starts > 0] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * power[: len(data)], out=sums[1:])
    raw = (sums[end] - sums[begin]) * inverse[begin]
    return mix(raw ^ ((end - begin).astype(np.uint64) * _ROLES[0])), begin


def words(texts: pa.Array, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: (first text, word hashes of the run, bounds of each text in them). Null texts have no words."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1
        last = min(n, max(last, first + 1))
        low, high = int(offsets[first]), int(offsets[last])
        hashes, begins, at = [], [], low
        while at < high:
            cut = high
            if high - at > PIECE:  # one long text: cut it before a byte outside words
                outside = np.flatnonzero(~kind[data[at + 1 : at + PIECE]])
                if len(outside):
                    cut = at + 1 + int(outside[-1])
                else:
                    later = np.flatnonzero(~kind[data[at + PIECE : high]])
                    cut = at + PIECE + int(later[0]) if len(later) else high
            inner = offsets[first:last]
            inner = np.unique(inner[(inner >= at) & (inner < cut)] - at)
            h, b = _piece_words(data[at:cut], inner, kind)
            hashes.append(h)
            begins.append(b + at)
            at = cut
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        b = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        yield first, h, np.searchsorted(b, offsets[first : last + 1])
        first = last


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of hashes, order counting."""
    total = np.zeros_like(parts[0])
    for role, part in zip(_ROLES[1:], parts):
        total = total + part * role
    return mix(total + np.uint64(len(parts) * int(_ROLES[15]) % (1 << 64)))


def stretches(tokens: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the `span` tokens from each place of `at` on: differences of prefix sums, weighted by powers, like those of words."""
    power, inverse = _tables(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens) * power[: len(tokens)], out=sums[1:])
    return mix((sums[at + span] - sums[at]) * inverse[at])


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text in turn; fewer words than `width` make one shingle, none make none."""
    for _, hashes, bounds in words(texts, NOT_SPACE):
        n = len(hashes) - width + 1
        grams = combine([hashes[k : k + n] for k in range(width)]) if n > 0 else np.zeros(0, np.uint64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield combine([hashes[k : k + 1] for k in range(a, b)])
            else:
                yield np.zeros(0, np.uint64)
