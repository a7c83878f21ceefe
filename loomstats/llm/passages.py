"""Substring dedup with compact windows.

1. A document's tokens are its five-word shingles. Under each of HASHES hash functions, a node of the Cartesian tree over the
   tokens' hashes stands for a compact window: every stretch inside that holds the node's token has the same min-hash. Only
   nodes whose window spans SPAN tokens can hold a passage of that length, about 2 / SPAN per token; they are the runs of
   equal values among the minima of all stretches of SPAN tokens, so they are read off sliding minima without a tree.
2. Windows of equal min-hash are tied to the one in the least document (a combinable minimum, joined back; never pairs of a
   group). Ties of the same two documents are joined as intervals: on about one diagonal, overlapping, and by at least NEED
   hash functions they make a candidate.
3. A candidate is verified on the texts: matching shingles with gaps of at most GAP are passages if they have at least SPAN
   shingles and the two sides a Jaccard similarity of PERCENT or more.
4. The least document need not have the passage that two others share around the same shingle. So in a second round, the
   windows of one hash function whose value comes in several documents are cut into all their stretches of SPAN shingles, but
   for those that lie in a verified exact copy of a lesser document; equal stretches are tied to the one in the least
   document, and are verified like the others. That document has the whole stretch.
5. Similar passages need neither share a window's value nor have a common least document. But of SPAN shingles or more, with
   PERCENT of them in common, they share a run of RUN: each break costs both sides together WIDTH + 3 shingles at least, and
   there is room for one break in SPAN shingles, for two in 64, and so on. So in a third round the tokens are stretches of SEED
   shingles, and the compact windows those that hold RUN - SEED + 1 of them: documents with a run of RUN shingles in common have a
   window of equal minimum on it. All pairs of different documents of such a minimum are candidates, but that a place inside a
   verified exact copy stands for itself by the place it is a copy of, and that passages already found are not looked at again. A
   shingle that follows itself counts as one here, so the repeats of one word that many texts have tie none of them. What is a
   passage by such repeats has stretches of fewer than RUN shingles, which are equal in both documents or not: each is tied to
   the least document that has it.

A passage of more than WORDS words that two documents share is found, or, if it lies in exact copies of lesser documents, those
copies and what their originals have in common. What one shingle repeated inside a passage hides of its runs is left to the first
round, where each hash function agrees with the probability of the passages' similarity.

Defined cases: null, empty and short texts have no passages; rows with equal doc_id and text are one document; rows with
equal ids and other texts, or without id, are documents of their own; repeats inside one document are not reported; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstats.llm import hashing
from loomstats.llm.common import stored

WIDTH, PERCENT = 5, 80
WORDS = 50  # passages have more words
HASHES, NEED = 4, 2
GAP = 12  # shingles without a match inside a passage: two edits
DRIFT = 16  # words by which edits may shift one side
RUN, SEED = 21, 14  # shingles that similar passages share in one run, and of the tokens of the third round
ROWS = 1000  # candidates whose shingles a task holds at once
AROUND = 2 * (WORDS + 2 - WIDTH)  # shingles looked at on either side of a shared token of the third round

WINDOWS = pa.schema([("value", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("reach", pa.int64()), ("seed", pa.bool_())])
CANDIDATES = pa.schema([(n, pa.int64()) for n in ("a_key", "b_key", "a_start", "a_end", "b_start", "b_end")])
SLICES = pa.schema([(n, pa.int64()) for n in ("a_key", "b_key", "b_id", "a_start", "a_end", "b_start")] + [("shingles", pa.binary())])
FOUND = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "end", "other_doc_id", "other_start", "other_end")] + [("similarity", pa.float64())]
)
CHECKED = pa.schema([*FOUND, ("a_key", pa.int64()), ("b_key", pa.int64()), ("exact", pa.binary())])
STRETCHES = pa.schema([("stretch", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])
COPIES = pa.schema([(n, pa.int64()) for n in ("b_key", "a_key", "low", "high", "shift")])
_SEEDS = np.random.default_rng(55).integers(1, 1 << 62, HASHES, dtype=np.uint64)


def span_of(words: int = WORDS, width: int = WIDTH) -> int:
    """Shingles of the shortest passage."""
    return words + 1 - width + 1


def sliding_minima(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each stretch of `span` values, and its first place there: of the tail of one block and the head of the next."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks, at = padded.reshape(-1, span), np.arange(len(padded)).reshape(-1, span)
    head = np.minimum.accumulate(blocks, 1)
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1]
    lower = np.ones(blocks.shape, bool)  # where the minimum so far begins
    lower[:, 1:] = head[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(lower, at, 0), 1).ravel()[span - 1 : n]
    tail_at = np.minimum.accumulate(np.where(blocks == tail, at, len(padded))[:, ::-1], 1)[:, ::-1].ravel()[: n - span + 1]
    head, tail = head.ravel()[span - 1 : n], tail.ravel()[: n - span + 1]
    return np.minimum(tail, head), np.where(tail <= head, tail_at, head_at)


def compact_windows(values: np.ndarray, bounds: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Value, document, place of the minimum, first and last token of each window, tokens counted within documents."""
    empty = np.zeros(0, np.int64)
    if len(values) < span:
        return values[:0], empty, empty, empty, empty
    minima, places = sliding_minima(values, span)
    at = np.arange(len(minima))
    doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + span <= bounds[doc + 1]
    at, doc, minima = at[inside], doc[inside], minima[inside]
    if not len(at):
        return values[:0], empty, empty, empty, empty
    new = np.concatenate([[True], (minima[1:] != minima[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    first, last, doc, minima = at[begin], at[end] + span - 1, doc[begin], minima[begin]
    place = places[at[end]]  # the minimum lies in the last stretch of its run (and in the first)
    start = bounds[doc]
    return minima, doc, place - start, first - start, last - start


def _token_runs(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts with their shingles, repeated ones too, and the bounds of each text."""
    for first, words, bounds in hashing.words(texts, hashing.NOT_SPACE):
        n = len(words) - width + 1
        grams = hashing.combine([words[k : k + n] for k in range(width)]) if n > 0 else words[:0]
        sizes = np.maximum(np.diff(bounds) - width + 1, 0)
        ends = np.cumsum(sizes)
        keep = np.repeat(bounds[:-1] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        yield first, grams[keep], np.concatenate([[0], ends])


def _windows(batches: Iterator[pa.RecordBatch], width: int, span: int, run: int) -> Iterator[pa.RecordBatch]:
    """The windows of the first round and the seeds of the third: each text is cut into shingles once."""
    for batch in batches:
        keys = batch["key"].to_numpy()
        for first, tokens, bounds in _token_runs(batch["text"], width):
            for number, seed in enumerate(_SEEDS):
                hashes = hashing.mix(tokens ^ seed)
                value, doc, place, low, high = compact_windows(hashes, bounds, span)
                value = (value & ~np.uint64(HASHES - 1)) | np.uint64(number)
                reach = ((place - low) << 32) | (high - place)
                yield _placed(value, keys[first + doc], place, reach, False)
            for value, doc, place, brief in seeds(tokens, bounds, run, span):
                yield _placed(value, keys[first + doc], place, brief, True)


def _placed(value: np.ndarray, keys: np.ndarray, places: np.ndarray, reach: np.ndarray, seed: bool) -> pa.RecordBatch:
    columns = [value.view(np.int64), keys, places, reach, np.full(len(value), seed)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=WINDOWS)


def seeds(tokens: np.ndarray, bounds: np.ndarray, run: int, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash, document, place of the minima of all stretches of `run` shingles, the tokens being stretches of SEED shingles; a
    shingle that follows itself counts once. Stretches of fewer shingles that stand for `span` with their repeats, or for GAP
    less, come as they are. The last column is the number that those stand for, 0 for the others."""
    if not len(tokens):
        return
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    new[bounds[:-1][bounds[:-1] < len(tokens)]] = True
    at = np.flatnonzero(new)
    tokens, inner = tokens[at], np.searchsorted(at, bounds)
    if len(tokens) >= run:
        hashes = hashing.stretches(tokens, np.arange(len(tokens) - SEED + 1), SEED)
        sizes = np.maximum(np.diff(inner) - SEED + 1, 0)  # of each text, without the stretches that leave it
        ends = np.cumsum(sizes)
        keep = np.repeat(inner[:-1] - (ends - sizes), sizes) + np.arange(ends[-1])
        value, doc, place, _, _ = compact_windows(hashes[keep], np.concatenate([[0], ends]), run - SEED + 1)
        yield value, doc, at[inner[doc] + place] - bounds[doc], np.zeros(len(value), np.int64)
    at = np.append(at, bounds[-1])
    end = np.repeat(inner[1:], np.diff(inner))  # of the text of each token
    last = np.minimum(np.arange(len(tokens)) + run - 1, end)
    begin = np.flatnonzero(at[last] - at[:-1] >= span - GAP)
    for n in range(1, run):
        here = begin[begin + n <= end[begin]]
        here = here[at[here + n] - at[here] >= span - GAP]
        if len(here):
            doc = np.searchsorted(inner, here, "right") - 1
            yield hashing.stretches(tokens, here, n) ^ np.uint64(n), doc, at[here] - bounds[doc], at[here + n] - at[here]


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact runs of verified passages, a row each."""
    for batch in batches:
        out = [
            (b_key, a_key, *run)
            for a_key, b_key, data in zip(*(batch[n].to_pylist() for n in ("a_key", "b_key", "exact")))
            for run in np.frombuffer(data, np.int64).reshape(-1, 3).tolist()
        ]
        if out:
            yield _rows(out, COPIES)


def candidates(ties: np.ndarray, pairs: np.ndarray, span: int, need: int = NEED) -> np.ndarray:
    """Pair and ranges on both sides from the ties of pairs of documents: rows of hash number, place and reach left and right,
    twice, and the number of each row's pair, ascending."""
    number, a, a_left, a_right, b, b_left, b_right = ties.T
    left, right = np.minimum(a_left, b_left), np.minimum(a_right, b_right)
    keep = left + right + 1 >= span - GAP
    if not keep.any():
        return np.zeros((0, 5), np.int64)
    pair, shift, low, high, number = (c[keep] for c in (pairs, b - a, b - left, b + right, number))
    order = np.lexsort((shift, pair))
    pair, shift, low, high, number = (c[order] for c in (pair, shift, low, high, number))
    diagonal = np.cumsum((np.diff(shift, prepend=shift[0]) > DRIFT) | (np.diff(pair, prepend=pair[0]) > 0))
    order = np.lexsort((low, diagonal))
    pair, shift, low, high, number, diagonal = (c[order] for c in (pair, shift, low, high, number, diagonal))
    reached = np.maximum.accumulate(high + diagonal * (1 << 40)) - diagonal * (1 << 40)  # end of the intervals so far
    new = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (low[1:] > reached[:-1])])
    begin = np.flatnonzero(new)
    found = np.bitwise_count(np.bitwise_or.reduceat(1 << number, begin)) >= need
    least, most = np.minimum.reduceat(shift, begin), np.maximum.reduceat(shift, begin)
    low, high = np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
    ranges = [pair[begin], np.maximum(0, low - most - DRIFT), high - least + DRIFT, low, high]
    return np.stack([c[found] for c in ranges], 1)


def _candidates(batches: Iterator[pa.RecordBatch], span: int, need: int = NEED) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by the two documents; those of the last pair of a batch wait for the next one."""
    names = ("a_key", "b_key", "value", "a_place", "a_reach", "b_place", "b_reach")
    mask = (1 << 32) - 1
    held = []  # rows, whole batches of one pair as they came

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        a, b, value, a_place, a_reach, b_place, b_reach = rows.T
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        ties = np.stack([value & (HASHES - 1), a_place, a_reach >> 32, a_reach & mask, b_place, b_reach >> 32, b_reach & mask], 1)
        out = candidates(ties, np.cumsum(new) - 1, span, need)
        if len(out):
            at = np.flatnonzero(new)[out[:, 0]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[at], b[at], *out[:, 1:].T)], schema=CANDIDATES)

    for batch in batches:
        rows = np.stack([batch[n].to_numpy() for n in names], 1)
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
        cut = last[-1] + 1 if len(last) else 0
        if held and (cut or (held[-1][-1, :2] != rows[0, :2]).any()):
            yield from found(np.concatenate([*held, rows[:cut]]))
            held = []
        elif cut:
            yield from found(rows[:cut])
        held.append(rows[cut:])
    if held:
        yield from found(np.concatenate(held))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ROWS at most."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _tokens_of(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Shingles of each row's text; a text that comes again is not read again."""
    keys = batch["key"].to_numpy()
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    texts = batch["text"].filter(pa.array(new))
    runs = (tokens[a:b] for _, tokens, bounds in _token_runs(texts, width) for a, b in zip(bounds[:-1], bounds[1:]))
    tokens = None
    for fresh in new.tolist():
        tokens = next(runs) if fresh else tokens
        yield tokens


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The second side of each candidate as shingles."""
    for batch in _parts(batches):
        out = []
        rest = zip(*(batch[n].to_pylist() for n in ("a_key", "key", "doc_id", "a_start", "a_end", "b_start", "b_end")))
        for tokens, (a_key, b_key, doc_id, a_start, a_end, b_start, b_end) in zip(_tokens_of(batch, width), rest):
            out.append((a_key, b_key, doc_id, a_start, a_end, b_start, tokens[b_start : b_end + 1].tobytes()))
        if out:
            yield _rows(out, SLICES)


def _index(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, all places by value (number of the value times more than all places, plus place), and the place
    before each of the same value, -1 if there is none."""
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    before = np.full(len(tokens), -1)
    again = np.flatnonzero(~new)
    before[order[again]] = order[again - 1]
    return ordered[new], (np.cumsum(new) - 1) * (len(tokens) + 1) + order, before


def _same(index: tuple[np.ndarray, np.ndarray, np.ndarray], start: int, end: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `b` its first place in the indexed tokens from `start` to `end`, counted from `start`, and if there is one."""
    values, places, before = index
    number = np.minimum(np.searchsorted(values, b), len(values) - 1)
    base = number * (len(before) + 1)
    at = places[np.minimum(np.searchsorted(places, base + start), len(places) - 1)] - base
    return at - start, (values[number] == b) & (at >= start) & (at < end)


def _middle(values: np.ndarray) -> int:
    """The median, as a whole number."""
    half = len(values) // 2
    values = np.sort(values)
    return int(values[half]) if len(values) % 2 else int((int(values[half - 1]) + int(values[half])) / 2)


def verify(a: np.ndarray, b: np.ndarray, span: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Passages in two stretches of shingles: begin and end on either side (ends exclusive), similarity."""
    index = _index(a)
    return _passages(a, index[2], b, *_same(index, 0, len(a), b), span, percent)


def _passages(
    a: np.ndarray, a_before: np.ndarray, b: np.ndarray, place: np.ndarray, same: np.ndarray, span: int, percent: int
) -> list[tuple[int, int, int, int, float]]:
    hit = np.flatnonzero(same)
    if not len(hit) or hit[-1] + 1 - hit[0] < span:
        return []
    # Of the shingles of a range, those whose value did not come before in it are the different ones.
    b_before = None
    out: list[tuple[int, int, int, int, float]] = []

    def look(part: np.ndarray, gap: int) -> None:
        """Parts of matching shingles; one that is not similar as a whole is looked at with smaller gaps."""
        nonlocal b_before
        cuts = np.flatnonzero(part[1:] - part[:-1] > gap + 1) + 1
        bounds = [0, *cuts.tolist(), len(part)]
        for left, right in zip(bounds[:-1], bounds[1:]):
            low, high = int(part[left]), int(part[right - 1]) + 1
            if high - low < span:
                continue
            piece = part[left:right]
            where = place[piece]
            away = where - piece
            middle = _middle(away)  # of shingles that come twice, those on the passage's own diagonal count
            near = where[np.abs(away - middle) <= max(DRIFT, (high - low) // 8)]
            begin = int(near.min()) if len(near) else 0
            b_before = _index(b)[2] if b_before is None else b_before
            firsts = b_before[low:high] < low
            n_right = int(np.count_nonzero(firsts))
            for end in (int(near.max(initial=0)) + 1, begin + high - low):  # the second: one shingle over and over
                n_left = int(np.count_nonzero(a_before[begin:end] < begin))
                both = _common(begin, min(end, len(a)), low, high, firsts)
                either = n_left + n_right - both
                if 100 * both >= percent * either and min(end, len(a)) - begin >= span - GAP:
                    out.append((begin, min(end, len(a)), low, high, both / either))
                    break
            else:
                if gap:
                    look(piece, gap // 2 if gap > 3 else 0)

    def _common(begin: int, end: int, low: int, high: int, firsts: np.ndarray) -> int:
        """Different shingles of b[low:high] that a[begin:end] has."""
        mine = firsts & same[low:high]
        where = place[low:high][mine]
        inside = (where >= begin) & (where < end)
        count = int(np.count_nonzero(inside))
        earlier = where[where < begin]  # their first place is before, another one may be inside
        if len(earlier):
            known = np.isin(a[begin:end], a[earlier])
            count += int(np.count_nonzero(known & (a_before[begin:end] < begin)))
        return count

    look(hit, GAP)
    return out


def exact_runs(where: np.ndarray, same: np.ndarray, low: int, high: int, span: int) -> list[tuple[int, int, int]]:
    """Begins and ends of stretches of b[low:high], of `span` shingles or more, that stand in `a` as they are, and how far they
    lie behind their places there; `where` and `same` as of `_same`."""
    hit = np.flatnonzero(same[low:high]) + low
    if len(hit) < span:
        return []
    at = where[hit]
    breaks = np.flatnonzero((hit[1:] - hit[:-1] != 1) | (at[1:] - at[:-1] != 1)) + 1
    bounds = [0, *breaks.tolist(), len(hit)]
    return [
        (int(hit[first]), int(hit[last - 1]) + 1, int(hit[first]) - int(at[first]))
        for first, last in zip(bounds[:-1], bounds[1:]) if last - first >= span
    ]


def _verify(batches: Iterator[pa.RecordBatch], width: int, span: int, percent: int) -> Iterator[pa.RecordBatch]:
    more = width - 1  # a stretch of shingles has these words more
    whole, looked = None, 0
    index = None  # of the whole document, once more than its length was looked at
    for batch in _parts(batches):
        out = []
        rest = zip(*(batch[n].to_pylist() for n in ("doc_id", "key", "b_key", "b_id", "a_start", "a_end", "b_start", "shingles")))
        for tokens, (a_id, a_key, b_key, b_id, a_start, a_end, b_start, data) in zip(_tokens_of(batch, width), rest):
            a, b = tokens[a_start : a_end + 1], np.frombuffer(data, np.uint64)
            if tokens is not whole:
                whole, looked, index = tokens, 0, None
            if len(a) and len(b):
                looked += len(a)
                index = _index(tokens) if index is None and looked > len(tokens) else index
                here, start = (_index(a), 0) if index is None else (index, a_start)
                where, same = _same(here, start, start + len(a), b)
                before = here[2][start : start + len(a)] - start
                for a_low, a_high, low, high, similarity in _passages(a, before, b, where, same, span, percent):
                    runs = np.array(exact_runs(where, same, low, high, span), np.int64).reshape(-1, 3) + [b_start, b_start, b_start - a_start]
                    out.append(
                        (b_id, b_start + low, b_start + high + more, a_id, a_start + a_low, a_start + a_high + more, similarity,
                         a_key, b_key, runs.tobytes())
                    )
        if out:
            yield _rows(out, CHECKED)


def _stretches(batches: Iterator[pa.RecordBatch], width: int, span: int) -> Iterator[pa.RecordBatch]:
    """Each stretch of `span` shingles inside the given windows of a document, but for those inside exact runs."""
    for batch in batches:
        keys, settled = batch["key"].to_pylist(), batch["settled"].to_pylist()
        windows, lists = batch["windows"].flatten(), batch["windows"].value_lengths().to_numpy()
        place, reach = (windows.field(n).to_numpy() for n in ("place", "reach"))
        first, last = place - (reach >> 32), place + (reach & ((1 << 32) - 1)) - span + 2
        ends = np.cumsum(lists)
        for row, tokens in enumerate(_tokens_of(batch, width)):
            n = len(tokens) - span + 1
            take = np.zeros(n + 1, np.int64)  # changes of the number of windows around a stretch
            own = slice(ends[row] - lists[row], ends[row])
            np.add.at(take, first[own], 1)
            np.subtract.at(take, last[own], 1)
            take = np.cumsum(take[:n]) > 0
            for data in settled[row] or []:
                for low, high, _ in np.frombuffer(data, np.int64).reshape(-1, 3).tolist():
                    take[low : high - span + 1] = False
            at = np.flatnonzero(take)
            total = hashing.stretches(tokens, at, span)
            total, firsts = np.unique(total, return_index=True)  # a stretch that comes again in the text counts once
            if len(at):
                columns = [total.view(np.int64), np.full(len(total), keys[row], np.int64), at[firsts]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=STRETCHES)


def _runs(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Ranges of equal stretches; rows come sorted by the two documents, diagonal and place."""
    held = None
    for batch in batches:
        out = []
        for a_key, b_key, shift, place in zip(*(batch[n].to_pylist() for n in ("a_key", "b_key", "shift", "place"))):
            if held and held[:3] == (a_key, b_key, shift) and place <= held[4] + 1:
                held = (*held[:4], place)
                continue
            if held:
                out.append(held)
            held = (a_key, b_key, shift, place, place)
        if out:
            yield _ranges(out, span)
    if held:
        yield _ranges([held], span)


def _ranges(runs: list[tuple], span: int) -> pa.RecordBatch:
    rows = [(a, b, low - shift, high - shift + span - 1, low, high + span - 1) for a, b, shift, low, high in runs]
    return _rows(rows, CANDIDATES)


def _checked(found: DataFrame, rows: DataFrame, width: int, span: int, percent: int) -> DataFrame:
    """The passages of candidates, with the key of the document and its exact runs."""
    slices = found.join(rows, F.col("b_key") == F.col("key")).select(
        "a_key", "doc_id", "a_start", "a_end", "b_start", "b_end", "key", "text"
    ).mapInArrow(
        partial(_slices, width=width), "a_key long, b_key long, b_id long, a_start long, a_end long, b_start long, shingles binary"
    )
    return slices.join(rows, F.col("a_key") == F.col("key")).select(
        "doc_id", "b_key", "b_id", "a_start", "a_end", "b_start", "shingles", "key", "text"
    ).mapInArrow(
        partial(_verify, width=width, span=span, percent=percent),
        "doc_id long, start long, end long, other_doc_id long, other_start long, other_end long, similarity double, a_key long, b_key long, exact binary",
    )


def _single(rows: DataFrame) -> DataFrame:
    """Rows without those whose key came before; the texts of keys that stand once are not exchanged."""
    often = stored(rows.groupBy("key").count().where("count > 1").select("key"), "repeated")
    if often.isEmpty():
        return rows
    again = rows.join(often, "key", "left_semi").dropDuplicates(["key"]).select(rows.columns)
    return rows.join(often, "key", "left_anti").select(rows.columns).unionByName(again)


def repeats(docs: DataFrame, words: int = WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, start, end, other_doc_id, other_start, other_end (words, ends exclusive), similarity of each repeated passage.

    Passages that many documents share come once per document, tied to a document of the least key among them.
    """
    span = span_of(words, width)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    # Equal rows are one document: one text each goes on, and joins by key find one row. Only keys are exchanged for this.
    rows = _single(rows)
    windows = stored(
        rows.select("key", "text").mapInArrow(
            partial(_windows, width=width, span=span, run=RUN), "value long, key long, place long, reach long, seed boolean"
        ),
        "windows",
    )
    seeds = windows.where("seed").select(F.col("value").alias("stretch"), "key", "place", F.col("reach").alias("brief"))
    windows = windows.where("not seed").drop("seed")
    least = windows.groupBy("value").agg(
        F.min(F.struct("key", "place", "reach")).alias("a"), F.max("key").alias("last")
    ).where(F.col("a.key") < F.col("last"))
    shared = windows.withColumnRenamed("value", "b_value").join(
        least.select("value", F.col("a.key").alias("a_key"), F.col("a.place").alias("a_place"), F.col("a.reach").alias("a_reach")),
        F.col("b_value") == F.col("value"),
    ).where((F.col("key") != F.col("a_key")) | (F.col("value").bitwiseAND(HASHES - 1) == 0))
    shared = stored(shared.select("a_key", "key", "value", "a_place", "a_reach", "place", "reach"), "shared")
    ties = shared.where("key <> a_key").select("a_key", F.col("key").alias("b_key"), "value", "a_place", "a_reach", F.col("place").alias("b_place"), F.col("reach").alias("b_reach"))
    found = ties.repartition("a_key", "b_key").sortWithinPartitions("a_key", "b_key").mapInArrow(
        partial(_candidates, span=span), "a_key long, b_key long, a_start long, a_end long, b_start long, b_end long"
    )
    first = stored(_checked(stored(found, "candidates"), rows, width, span, percent), "passages")

    around = shared.where(F.col("value").bitwiseAND(HASHES - 1) == 0).groupBy("key").agg(
        F.collect_list(F.struct("place", "reach")).alias("windows")  # of one document
    )
    settled = first.where(F.length("exact") > 0).groupBy("b_key").agg(F.collect_set("exact").alias("settled"))
    marked = around.join(settled, F.col("key") == F.col("b_key"), "left").select(F.col("key").alias("_key"), "windows", "settled")
    stretches = stored(
        marked.join(rows, F.col("_key") == F.col("key")).select("key", "text", "windows", "settled").mapInArrow(
            partial(_stretches, width=width, span=span), "stretch long, key long, place long"
        ),
        "stretches",
    )
    leaders = stretches.groupBy("stretch").agg(F.min(F.struct("key", "place")).alias("a"), F.max("key").alias("last")).where(
        F.col("a.key") < F.col("last")
    ).select(F.col("stretch").alias("a_stretch"), F.col("a.key").alias("a_key"), F.col("a.place").alias("a_place"))
    equal = stretches.join(leaders, F.col("stretch") == F.col("a_stretch")).where("key <> a_key").select(
        "a_key", F.col("key").alias("b_key"), (F.col("place") - F.col("a_place")).alias("shift"), "place"
    )
    again = equal.repartition("a_key", "b_key").sortWithinPartitions("a_key", "b_key", "shift", "place").mapInArrow(
        partial(_runs, span=span), "a_key long, b_key long, a_start long, a_end long, b_start long, b_end long"
    )
    known = first.union(stored(_checked(stored(again, "candidates"), rows, width, span, percent), "passages"))
    third = _checked(stored(_similar(seeds, known, width, span), "candidates"), rows, width, span, percent)
    return known.union(third).drop("a_key", "b_key", "exact").distinct()


def _similar(seeds: DataFrame, known: DataFrame, width: int, span: int) -> DataFrame:
    """Candidates of all documents with a run of RUN shingles in common, but where passages are known."""
    of_value = Window.partitionBy("stretch")
    several = F.min("key").over(of_value) < F.max("key").over(of_value)
    shared = stored(seeds.withColumn("several", several).where("several").drop("several"), "seeds")
    whole = shared.where("brief = 0").drop("brief")
    copies = known.where(F.length("exact") > 0).select("a_key", "b_key", "exact").mapInArrow(
        _copies, "b_key long, a_key long, low long, high long, shift long"
    ).distinct()
    within = (F.col("key") == F.col("b_key")) & (F.col("place") >= F.col("low")) & (F.col("place") + SEED <= F.col("high"))
    original = F.min(F.struct("a_key", (F.col("place") - F.col("shift")).alias("a_place"))).alias("a")
    places = stored(
        whole.join(copies, within, "left").groupBy("stretch", "key", "place").agg(original).select(
            "stretch", F.coalesce("a.a_key", "key").alias("key"), F.coalesce("a.a_place", "place").alias("place")
        ).distinct(),
        "places",
    )
    a, b = (places.select("stretch", F.col("key").alias(f"{n}_key"), F.col("place").alias(f"{n}_place")) for n in "ab")
    ties = a.join(b, "stretch").where("a_key < b_key")
    # Equal brief stretches are all similar: each is tied to the least one; those that are too short to be the second side, also
    # to the greatest that is not.
    brief = shared.where("brief > 0")
    place = F.struct("key", "place")
    ends = brief.groupBy("stretch").agg(F.min(place).alias("least"), F.max(F.when(F.col("brief") >= span, place)).alias("most"))
    brief = brief.join(ends, "stretch")
    equal = brief.where(F.col("brief") >= span).select("stretch", F.col("least").alias("a"), place.alias("b")).unionByName(
        brief.where(F.col("brief") < span).select("stretch", place.alias("a"), F.col("most").alias("b"))
    ).where("a.key < b.key").select("stretch", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in ("key", "place")])
    ties = ties.unionByName(equal)
    found = known.groupBy("a_key", "b_key").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    inside = F.exists("found", lambda p: (p["start"] <= F.col("b_place")) & (F.col("b_place") + SEED + width - 1 <= p["end"]))
    ties = ties.join(found, ["a_key", "b_key"], "left").where(~F.coalesce(inside, F.lit(False)))
    reach = lambda left: F.shiftleft(left.cast("long"), 32).bitwiseOR(F.lit(AROUND + SEED).cast("long"))
    ties = ties.select(
        "a_key", "b_key", F.col("stretch").alias("value"), "a_place", reach(F.lit(AROUND)).alias("a_reach"), "b_place",
        reach(F.least("b_place", F.lit(AROUND))).alias("b_reach"),
    )
    return ties.repartition("a_key", "b_key").sortWithinPartitions("a_key", "b_key").mapInArrow(
        partial(_candidates, span=span, need=1), "a_key long, b_key long, a_start long, a_end long, b_start long, b_end long"
    )
