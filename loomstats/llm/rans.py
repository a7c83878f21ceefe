"""Static range ANS for token ids, vectorised over interleaved lanes with numpy.

One frequency table serves all blocks of a file. Token i of a block belongs to lane i mod lanes; each lane is a coder of its
own with a 64-bit state that gives off 32-bit words, and all lanes share one word stream, so a step codes one token of every
lane at once. Coding runs backwards, decoding forwards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
WORD = np.uint64(32)
MASK = np.uint64((1 << 32) - 1)
BLOCK = 1 << 20  # tokens of a block
LANES = 4096
HEAD = struct.Struct("<IIIII")  # tokens, lanes, words, crc32 of the ids, crc32 of the payload


class Table:
    """Frequencies of the symbols that occur, scaled to a power of two."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.symbols, self.freqs, self.bits = symbols.astype(np.uint32), freqs.astype(np.uint32), bits
        top = int(symbols[-1]) + 1 if len(symbols) else 1
        ends = np.cumsum(freqs, dtype=np.uint64)
        self.freq = np.ones(top, np.uint64)
        self.cum = np.zeros(top, np.uint64)
        self.freq[symbols] = freqs
        self.cum[symbols] = ends - freqs.astype(np.uint64)
        self.slot = np.repeat(self.symbols, freqs)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Table":
        """Every symbol that occurs keeps at least one slot."""
        symbols = np.flatnonzero(counts)
        if not len(symbols):
            return cls(symbols, np.zeros(0, np.int64), 12)
        bits = min(24, max(12, int(np.ceil(np.log2(len(symbols)))) + 3))
        size, seen = 1 << bits, counts[symbols].astype(np.float64)
        freqs = np.maximum(1, np.floor(seen * (size / seen.sum()))).astype(np.int64)
        spare = size - int(freqs.sum())
        order = np.argsort(-freqs, kind="stable")
        while spare < 0:  # symbols held at one slot took too many: give back from the largest
            give = np.minimum(freqs[order] - 1, np.maximum(1, freqs[order] * -spare // size))
            give = give * (np.cumsum(give) <= -spare)
            if not give.any():
                give[0] = min(int(freqs[order[0]]) - 1, -spare)
            freqs[order] -= give
            spare = size - int(freqs.sum())
        freqs[order[0]] += spare
        return cls(symbols, freqs, bits)

    def pack(self) -> bytes:
        body = zlib.compress(np.diff(self.symbols, prepend=0).astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes(), 6)
        return struct.pack("<III", self.bits, len(self.symbols), len(body)) + body

    @classmethod
    def unpack(cls, data: bytes) -> "Table":
        bits, n, size = struct.unpack_from("<III", data)
        raw = np.frombuffer(zlib.decompress(data[12 : 12 + size]), "<u4")
        return cls(np.cumsum(raw[:n], dtype=np.int64), raw[n:].astype(np.int64), bits)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block: header, lane states, words."""
    n, lanes = len(ids), max(1, min(LANES, len(ids) // 64))
    states = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.cum[ids]
    bits = np.uint64(table.bits)
    limit = freq << np.uint64(63 - table.bits)
    words: list[np.ndarray] = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        f, m = freq[at : at + lanes], min(lanes, n - at)
        x = states[:m]
        over = x >= limit[at : at + lanes]
        if over.any():
            words.append((x[over] & MASK).astype("<u4"))
            x = np.where(over, x >> WORD, x)
        quotient = x // f
        states[:m] = (quotient << bits) + (x - quotient * f) + start[at : at + lanes]
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    payload = states.astype("<u8").tobytes() + stream.tobytes()
    check = zlib.crc32(ids.astype("<u4").tobytes())
    return HEAD.pack(n, lanes, len(stream), check, zlib.crc32(payload)) + payload


def body_size(head: bytes) -> int:
    _, lanes, words, _, _ = HEAD.unpack(head)
    return 8 * lanes + 4 * words


def decode(head: bytes, payload: bytes, table: Table) -> np.ndarray:
    """The ids of a block; both checksums are compared."""
    n, lanes, _, check, crc = HEAD.unpack(head)
    if zlib.crc32(payload) != crc:
        raise ValueError("token block: payload checksum differs")
    states = np.frombuffer(payload, "<u8", lanes).copy()
    stream = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.uint64)
    ids = np.empty(n, np.uint32)
    bits, low_bits = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    at_word = 0
    for at in range(0, n, lanes):
        m = min(lanes, n - at)
        x = states[:m]
        slot = x & low_bits
        symbol = table.slot[slot]
        ids[at : at + m] = symbol
        x = table.freq[symbol] * (x >> bits) + slot - table.cum[symbol]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << WORD) | stream[at_word : at_word + len(need)]
            at_word += len(need)
        states[:m] = x
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("token block: id checksum differs")
    return ids
