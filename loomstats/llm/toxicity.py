"""Toxicity by noisy-channel deobfuscation: restore disguised words, then score what the text says.

1. A character model: counts of letter trigrams over all documents (boundaries are letters of a kind). Its table has a fixed
   size, 64**3, whatever the corpus.
2. A word that looks disguised (digits or signs among, before, behind or instead of letters, spaced letters, letters twice or
   more in a row; signs that end a sentence aside) becomes a lattice: each
   character stands for the letters it may replace, for itself, or for nothing, at channel costs (CHANNEL); a letter left out as a
   repeat is charged the price of an average letter, so paths of different length compare fairly. The Viterbi path
   under the character model is the restored word. Many tokens are decoded at once as arrays, each different one once.
   Plain words have one path only, and are taken as they are. A doubled letter among plain ones (`stuupid`) is a repeat only if the
   word without it is one of the model's, and RARE times as frequent in the labelled sample as the one that stands there.
3. A logistic model over words, learned from at most TRAIN labelled documents (those with the least hashes of their ids,
   none with crc32(id) mod 5 = 0). Candidate words are those clearly more frequent in toxic than in other documents, each
   group of near copies counted once.
4. Every document is scored by the distinct words it has, read or restored; one pass without a shuffle.

Defined cases: null and empty texts have no words and get the score of the intercept; a null doc_id counts as the empty text
(held out); equal rows score alike; without labels, or without toxic ones, all scores are about 1e-13; only doc_id and text, labels'
doc_id and toxic are looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstats.llm import hashing
from loomstats.llm.common import stored

TRAIN = 20_000  # labelled documents learned from at most; this bounds the words of the model, too
RARE = 10  # a doubled letter is a repeat if the other spelling is this many times as frequent
CODES = 64
OTHER = 63  # letters beyond Latin-1
FOLDS = 5

# What a sign may stand for, and what that costs (natural logarithms).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~'"
CHANNEL = {"leet": -1.0, "drop": -0.5, "repeat": -0.7, "mask": -math.log(26) - 1.0}

PLAIN = re.compile(r"[^\W\d_]+")
INSIDE = re.compile(r"[^\W\d_][0-9@$!|+(€£*._~'-]+[^\W\d_]")  # signs among letters
BEFORE = re.compile(r"[@$!|+(€£\d][^\W\d_]")
SIGN = re.compile(r"[0-9@$|+(€£*]|!(?=[^!])")  # wherever it stands
HELD = re.compile(r"[^\W_]|[@$!|+(€£]")
TWICE = re.compile(r"([^\W\d_])\1")
THRICE = re.compile(r"([^\W\d_])\1\1")
STOPS = ".,;:!?'\"-)]}…"  # behind a word
OPENINGS = "'\"[{"
SPACED = re.compile(r"(?<![^\W_])(?:[\w@$!|+][ .\-_*~]{1,2}){2,}[\w@$!|+](?![^\W_])")  # letters or signs one by one
ENDS_SPACED = re.compile(r"[ .\-_*~][\w@$!|+][ .\-_*~]{1,2}[\w@$!|+](?![^\W_])")  # the last two of such, all have them


def core(token: str) -> str:
    """Without the signs that may stand around a word in a sentence."""
    word = token.rstrip(STOPS)
    return word.lstrip(OPENINGS + "(" if ")" in token[len(word) :] else OPENINGS)


def disguised(word: str) -> bool:
    if TWICE.search(word) or INSIDE.search(word) or BEFORE.search(word):
        return True
    return len(word) > 1 and bool(SIGN.search(word) and HELD.search(word))


def shortened(word: str) -> list[str]:
    """A word with one letter of some or all of its doubled letters left out; of more than four doubled ones each alone, or all."""
    places = [m.start() for m in TWICE.finditer(word)]
    some = range(1, len(places) + 1) if len(places) <= 4 else (1, len(places))
    out = []
    for size in some:
        for left in combinations(places, size):
            out.append("".join(c for k, c in enumerate(word) if k not in left))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@lru_cache(1)
def _codes() -> np.ndarray:
    """Code of each code point below U+0180: 0 for a boundary, 1-26 for a-z, then Latin-1 letters."""
    table = np.zeros(0x180, np.int64)
    table[0x61:0x7B] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 60)
    table[[0xF7]] = 0
    table[0x100:] = OTHER
    return table


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 0x180, _codes()[np.minimum(points, 0x17F)], np.where(points >= 0x2000, 0, OTHER))


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CODES**3, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py()
            for at in range(0, len(text or ""), 1 << 20):
                c = np.concatenate([[0], codes_of(text[at : at + (1 << 20)].lower()), [0]])
                counts += np.bincount(c[:-2] * CODES**2 + c[1:-1] * CODES + c[2:], minlength=CODES**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a letter after two others, of all documents; interpolated with the letter's own frequency."""
    rows = docs.select("text").mapInArrow(_count_letters, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CODES**3)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(CODES, CODES, CODES)
    single = counts.sum((0, 1)) + 0.1
    pair = counts.sum(0) + 2 * single / single.sum()
    pair /= pair.sum(1, keepdims=True)
    three = counts + 2 * pair[None]
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def _code(char: str) -> int:
    point = ord(char)
    return int(_codes()[point]) if point < 0x180 else OTHER


@lru_cache(100_000)
def choices(char: str, repeated: bool) -> list[tuple[str, float, float]]:
    """What a character may stand for: text, its channel cost, and how many letters' price it goes without.

    A letter that is dropped as a repeat is charged the price of an average letter (`average_price`), so that a path does not win
    by having fewer letters.
    """
    out: list[tuple[str, float, float]] = []
    if PLAIN.fullmatch(char):
        out.append((char, 0.0, 0))
        if repeated:
            out.append(("", CHANNEL["repeat"], 1))
    elif char in LEET:
        out += [(letter, CHANNEL["leet"], 0) for letter in LEET[char]]
        if repeated:
            out.append(("", CHANNEL["repeat"], 1))
        out.append((" ", CHANNEL["drop"] * 8, 0))
    elif char in SEPARATORS:
        out.append(("", CHANNEL["drop"], 0))
        if char == "*":
            out += [(chr(c), CHANNEL["mask"], 0) for c in range(97, 123)]
        elif char != " ":
            out.append((" ", CHANNEL["drop"] * 8, 0))
    else:
        out.append((" ", 0.0, 0))
    return out


def average_price(model: np.ndarray) -> float:
    """Mean cost of a letter in text that the model itself would write: letters after pairs, weighted by how often pairs come up."""
    step = np.exp(model.astype(float))
    pairs = np.full((CODES, CODES), 1 / CODES**2)
    for _ in range(30):
        pairs = np.einsum("ab,abc->bc", pairs, step)
    weight = pairs[:, :, None] * step
    weight[:, :, 0] = 0
    return float((weight * model).sum() / weight.sum())


def stretches(token: str) -> Iterator[tuple[str, str]]:
    """A token cut behind every two letters that can only be themselves: the two letters before a stretch, and the stretch.

    The state there is known, so each stretch is decoded by itself, and one that comes behind the same letters in many tokens once.
    """
    start, last, sure = 0, "", False
    for k, char in enumerate(token):
        now = char != last and PLAIN.fullmatch(char) is not None
        if now and sure:
            yield token[max(0, start - 2) : start], token[start : k + 1]
            start = k + 1
        last, sure = char, now
    if start < len(token):
        yield token[max(0, start - 2) : start], token[start:]


def restore_all(tokens: list[str], model: np.ndarray, known: dict | None = None) -> list[str]:
    """The likeliest word or words behind each disguised one. `known` holds stretches from call to call."""
    known = {} if known is None else known
    cut = [list(stretches(t.lower())) for t in tokens]
    new = sorted({s for part in cut for s in part} - known.keys(), key=lambda s: ("*" in s[1], len(s[1]), s))
    price, part, weight = average_price(model) if new else 0.0, [], 0
    for stretch in new:
        # a mask leaves 26 letters in either place of a state, and 27 choices for the next
        weight += (18_000 if "*" in stretch[1] else 64) * len(stretch[1])
        part.append(stretch)
        if weight > CHUNK:
            known.update(zip(part, _decode(part, model, price)))
            part, weight = [], 0
    if part:
        known.update(zip(part, _decode(part, model, price)))
    return ["".join(known[s] for s in part) for part in cut]


def _decode(parts: list[tuple[str, str]], model: np.ndarray, price: float) -> list[str]:
    """Viterbi over the lattices of stretches, character by character for all at once.

    A row is a stretch and a state, the last two letters; of rows with one stretch and state the cheapest stays.
    """
    tokens, before = [t for _, t in parts], [b for b, _ in parts]
    kinds: dict[tuple[str, bool], int] = {}
    sizes = np.array([len(t) for t in tokens])
    table = np.zeros((len(tokens), int(sizes.max(initial=0))), np.int32)
    for row, token in enumerate(tokens):
        last = before[row][-1:]
        for k, char in enumerate(token):
            table[row, k] = kinds.setdefault((char, char == last), len(kinds))
            last = char
    options = [choices(*kind) for kind in kinds]
    number = np.array([len(o) for o in options], np.int64)
    first = np.cumsum(number) - number
    texts = [text for o in options for text, _, _ in o]
    codes = np.array([-1 if not t else 0 if t == " " else _code(t) for t in texts], np.int64)
    costs = np.array([cost + letters * price for o in options for _, cost, letters in o])

    token, cost = np.arange(len(tokens)), np.zeros(len(tokens))
    state = np.array([_code(b[0]) * CODES + _code(b[1]) if b else 0 for b in before], np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    ends: list[tuple[int, int]] = [(0, 0)] * len(tokens)
    for at in range(table.shape[1] + 1):
        done = np.flatnonzero(sizes[token] == at)
        if len(done):
            total = cost[done] + model[state[done] // CODES, state[done] % CODES, 0]
            order = np.lexsort((-total, token[done]))
            best = order[np.unique(token[done][order], return_index=True)[1]]
            for row in done[best].tolist():
                ends[token[row]] = (at, row)
        going = np.flatnonzero(sizes[token] > at)
        if not len(going):
            break
        kind = table[token[going], at]
        many = number[kind]
        source = np.repeat(going, many)
        option = np.arange(len(source)) + np.repeat(first[kind] - (np.cumsum(many) - many), many)
        code, value, origin = codes[option], cost[source] + costs[option], state[source]
        says = code >= 0
        value[says] += model[origin[says] // CODES, origin[says] % CODES, code[says]]
        after = np.where(says, origin % CODES * CODES + code, origin)
        key = token[source] * CODES**2 + after
        order = np.lexsort((-value, key))
        best = order[np.append(True, key[order][1:] != key[order][:-1])]
        steps.append((source[best], option[best]))
        token, state, cost = token[source[best]], after[best], value[best]
    out = []
    for at, row in ends:
        letters = []
        while at:
            at -= 1
            source, option = steps[at]
            letters.append(texts[option[row]])
            row = source[row]
        out.append("".join(reversed(letters)))
    return out


def restore(token: str, model: np.ndarray) -> str:
    return restore_all([token], model)[0]


SEEN = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("cluster", pa.int64()), ("word", pa.string())])
CHUNK = 1 << 21  # readings the decoder looks at in one go, at most (those of one stretch aside)
TEXTS = 512  # texts read at once
KNOWN = 50_000  # decoded tokens a worker keeps
ROWS = 100_000  # rows a task of the training words holds


class Reader:
    """The distinct words of texts, read or restored; each different token of the texts is decoded once."""

    def __init__(self, model: np.ndarray, repeats: dict[str, frozenset[str]] | None = None):
        """`repeats`: words behind which a doubled letter may be a repeat, and for each the spellings that are words as they
        stand; without it, all words with a doubled letter are decoded like other disguised ones."""
        self.model, self.repeats = model, repeats
        self.restored: dict[str, tuple[str, ...]] = {}
        self.known: dict[tuple[str, str], str] = {}
        self.core = lru_cache(KNOWN)(self._core)

    def _core(self, token: str) -> str:
        """What is to be decoded of a token between spaces; empty for one read as it is."""
        word = core(token)
        if self.repeats is not None and PLAIN.fullmatch(word) and not THRICE.search(word):
            if TWICE.search(word):
                forms = [f for f in shortened(word) if f in self.repeats and word not in self.repeats[f]]
                if forms:
                    self.restored[word] = tuple(forms)
                    return word
            return ""
        return word if disguised(word) else ""

    def _decode(self, tokens: set[str]) -> None:
        new = sorted(tokens - self.restored.keys())
        self.restored.update((t, tuple(PLAIN.findall(r))) for t, r in zip(new, restore_all(new, self.model, self.known)))

    def read(self, texts: list[str | None]) -> Iterator[tuple[set[str], dict[str, tuple[str, ...]]]]:
        """Per text its plain words, and what the disguised tokens in it hide."""
        for at in range(0, len(texts), TEXTS):
            if len(self.restored) > KNOWN:
                self.restored.clear()
                self.core.cache_clear()
            if len(self.known) > 4 * KNOWN:
                self.known.clear()
            plain, hidden = [], []
            for text in texts[at : at + TEXTS]:
                text = (text or "").lower()
                plain.append(set(PLAIN.findall(text)))
                found = {word for word in map(self.core, set(text.split())) if word}
                if ENDS_SPACED.search(text):
                    found.update(m[0] for m in SPACED.finditer(text))
                hidden.append(found)
            self._decode(set().union(*hidden))
            for words, tokens in zip(plain, hidden):
                yield words, {token: self.restored[token] for token in tokens}

    def words(self, text: str | None) -> set[str]:
        """All words of a text."""
        for plain, hidden in self.read([text]):
            return plain.union(*hidden.values())


_reader_of: list = []


def _reader(letters, repeats: dict[str, frozenset[str]]) -> Reader:
    """One per worker process and model."""
    model = letters.value
    if not _reader_of or _reader_of[0].model is not model or _reader_of[0].repeats != repeats:
        _reader_of[:] = [Reader(model, repeats)]
    return _reader_of[0]


def _training_words(batches: Iterator[pa.RecordBatch], letters) -> Iterator[pa.RecordBatch]:
    """(row, toxic, cluster, word): near copies mostly share the least hash of their word triples."""
    reader = _reader(letters, {})
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), SEEN)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, schema=SEEN)

    for batch in batches:
        keys, toxic, texts = batch["key"].to_pylist(), batch["toxic"].to_pylist(), batch["text"].to_pylist()
        sets = hashing.shingle_sets(batch["text"], 3)
        for key, label, (plain, hidden), shingles in zip(keys, toxic, reader.read(texts), sets):
            cluster = int(shingles[0].view(np.int64)) if len(shingles) else 0
            rows += [(key, label, cluster, word) for word in plain.union(*hidden.values())]
            if len(rows) > ROWS:
                yield out()
    if rows:
        yield out()


def _spellings(batches: Iterator[pa.RecordBatch], names: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """(spelling, word) of words with a doubled letter that leads to one of `names`."""
    for batch in batches:
        pairs = [(w, f) for w in batch["spelling"].to_pylist() for f in shortened(w) if f in names]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs)], names=["spelling", "word"])


def repeats_of(words: DataFrame, names: frozenset[str]) -> dict[str, frozenset[str]]:
    """For each of `names` the spellings with doubled letters that are words of their own: not RARE times rarer in the sample.

    There are at most as many of them as different words in the sample.
    """
    counts = words.groupBy("word").agg(F.countDistinct("key").alias("n"))
    doubled = counts.where(F.col("word").rlike(r"(\p{L})\1")).select(F.col("word").alias("spelling"), F.col("n").alias("of"))
    pairs = doubled.select("spelling").mapInArrow(partial(_spellings, names=names), "spelling string, word string")
    found = pairs.join(doubled, "spelling").join(counts, "word").where(RARE * F.col("of") > F.col("n")).select("word", "spelling")
    out: dict[str, set[str]] = {name: set() for name in names}
    for row in found.collect():
        out[row["word"]].add(row["spelling"])
    return {name: frozenset(spellings) for name, spellings in out.items()}


def fit(docs: DataFrame, labels: DataFrame, letters) -> tuple[dict[str, float], float, dict[str, frozenset[str]]]:
    """Weights of words, the intercept, and which spellings with doubled letters are words of their own (`repeats_of`)."""
    sample = (
        labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("key"))
        .orderBy("key", "l_id", "toxic")
        .limit(TRAIN)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))
    words = stored(
        rows.select("key", "toxic", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            partial(_training_words, letters=letters), "key long, toxic int, cluster long, word string"
        ),
        "words",
    )
    docs_of = words.groupBy("key").agg(F.max("toxic").alias("toxic")).toArrow()
    keys, toxic = docs_of["key"].to_numpy(), docs_of["toxic"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    keys, toxic = keys[order], toxic[order]
    n_bad, n_good = float(toxic.sum()), float(len(toxic) - toxic.sum())
    if not n_bad or not n_good:
        return {}, -30.0, {}
    once = words.select("word", "cluster", "toxic").distinct()
    counts = once.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rate, expected = F.col("bad") / n_bad - F.col("good") / n_good, (F.col("bad") + F.col("good")) / (n_bad + n_good)
    z = rate / F.sqrt(expected * (1 / n_bad + 1 / n_good))
    chosen = counts.where((F.col("bad") >= 4) & (z > 4)).select("word")
    pairs = words.join(F.broadcast(chosen), "word").select("key", "word").distinct().toArrow()
    names, column = np.unique(np.array(pairs["word"].to_pylist(), object).astype(str), return_inverse=True)
    row = np.searchsorted(keys, pairs["key"].to_numpy())
    weights, bias = _logistic(row, column, toxic, len(names))
    return {str(n): float(w) for n, w in zip(names, weights)}, bias, repeats_of(words, frozenset(map(str, names)))


def _logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, width: int, rounds: int = 3000) -> tuple[np.ndarray, float]:
    """Logistic regression with a small L1 price, by accelerated proximal gradient steps."""
    share = 1 / len(y)
    w, v, bias, v_bias, price = np.zeros(width), np.zeros(width), 0.0, 0.0, 1e-5
    often = np.bincount(row, minlength=len(y)).max(initial=1) + 1
    step = 4.0 / often
    for k in range(rounds):
        margin = np.bincount(row, v[column], len(y)) + v_bias
        error = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        new = v - step * np.bincount(column, error[row], width)
        new = np.sign(new) * np.maximum(np.abs(new) - step * price, 0)
        new_bias = v_bias - step * error.sum()
        v = new + k / (k + 3) * (new - w)
        v_bias = new_bias + k / (k + 3) * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


def _score(
    batches: Iterator[pa.RecordBatch], letters, weights: dict[str, float], bias: float, repeats: dict[str, frozenset[str]]
) -> Iterator[pa.RecordBatch]:
    reader = _reader(letters, repeats)
    for batch in batches:
        scores = []
        for plain, hidden in reader.read(batch["text"].to_pylist()):
            margin = bias + math.fsum(weights[w] for w in plain.union(*hidden.values()) & weights.keys())
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    letters = spark.sparkContext.broadcast(letter_model(rows))  # 64**3 numbers
    weights, bias, repeats = fit(rows, labels, letters)
    scored = rows.mapInArrow(partial(_score, letters=letters, weights=weights, bias=bias, repeats=repeats), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
