"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor again.

1. Words of all texts are counted; each task adds up its own before the shuffle.
2. Two words differ by one edit if the composition of the acceptor with the transducer and the acceptor accepts the pair. The
   edit has one place: the length of the longest common prefix. The composition is cut by the state it starts from:
   for pairs whose longer word has m characters, a window [low, high) of places stands for all words that agree on what lies before
   `low` and behind `high`; that context is the initial state, and only the middles are read on. Every word starts in four windows
   (as the longer and as the shorter one; first and second half). A window with more than GROUP words is halved, its context grows on
   either side, until none is left; a window of one place has as many words as there are letters, so this ends.
3. A task builds, for each initial state, the minimised acceptors of the longer and of the shorter middles in one register, and
   composes them: up to the edit both sides read the same letters; a replacement goes on in the meet of the states behind two
   different letters, a deletion in the meet of the state behind the deleted letter and the one before it without that letter.
   Meets are acceptors of the same register, kept once, without dead ends. So each pair is found once, in one window.
4. A word's near words are added up in its task (count, and the most frequent one) and again over its windows.
5. Forms are at least TIMES as frequent as their word, so a chain has at most log10 of the largest count of steps; roots take
   its logarithm in joins.

Defined cases: null and wordless texts have no words; a null doc_id is written as nothing in the text that is hashed; repeated
rows count as often as they come; ties of frequency go to the smallest word in code-point order; very long words are
words like others (nothing recurses); an empty table gives no rows. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstats.llm.common import stored

# Fixed values of the contract.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES, EVERY = 7, 2, 10, 31
RUN = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")  # a shorter run leaves no word, with or without a letter less
LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}

GROUP = 20_000  # most words of an initial state; larger ones are split
HELD = 500_000  # different words a task holds before it hands their counts on
LONG_TEXT = 1 << 22
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
EMPTY = 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=COUNTS)
        counts.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            if not text:
                continue
            runs = RUN.findall(text) if len(text) < LONG_TEXT else (m.group() for m in RUN.finditer(text))
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, times in Counter(runs).items():
                word = run if run.islower() else run.translate(LOWER)
                h = zlib.crc32(word.encode(), start)
                if h % EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < SHORTEST:
                        continue
                counts[word] = counts.get(word, 0) + times
            if len(counts) > HELD:
                yield out()
    if counts:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words that occur at least LEAST times."""
    rows = docs.select(F.col("doc_id"), "text")
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Register:
    """States of minimised acceptors: equal languages are one state. State EMPTY accepts nothing."""

    def __init__(self):
        self.final, self.edges = [False], [{}]
        self.known: dict[tuple, int] = {(False,): EMPTY}
        self.meets: dict[tuple[int, int], int] = {}

    def state(self, final: bool, edges: dict[str, int]) -> int:
        """The state with these live edges."""
        key = (final, *sorted(edges.items()))
        if key not in self.known:
            self.known[key] = len(self.final)
            self.final.append(final)
            self.edges.append(edges)
        return self.known[key]

    def acceptor(self, words: list[str]) -> int:
        """Initial state of the minimised acceptor of sorted, distinct words."""
        if not words:
            return EMPTY
        path: list[tuple[list[bool], dict[str, int], list[str]]] = [([False], {}, [])]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges, _ = path.pop()
                path[-1][1][path[-1][2][0]] = self.state(final[0], edges)

        last = ""
        for word in words:
            depth, most = 0, min(len(last), len(word))
            while depth < most and last[depth] == word[depth]:
                depth += 1
            close(depth)
            for letter in word[depth:]:
                path[-1][2][:] = [letter]
                path.append(([False], {}, []))
            path[-1][0][0] = True
            last = word
        close(0)
        return self.state(path[0][0][0], path[0][1])

    def meet(self, s: int, t: int) -> int:
        """State that accepts what both accept."""
        todo = [(s, t)]
        while todo:
            a, b = pair = todo[-1]
            if pair in self.meets:
                todo.pop()
            elif a == b or EMPTY in pair:
                self.meets[pair] = a if a == b else EMPTY
            else:
                few, many = sorted((self.edges[a], self.edges[b]), key=len)
                both = {c: (self.edges[a][c], self.edges[b][c]) for c in few if c in many}
                waiting = [p for p in both.values() if p not in self.meets]
                todo += waiting
                if not waiting:
                    edges = {c: self.meets[p] for c, p in both.items() if self.meets[p] != EMPTY}
                    self.meets[pair] = self.state(self.final[a] and self.final[b], edges)
        return self.meets[s, t]

    def without(self, s: int, letter: str) -> int:
        """State that accepts what `s` does, less the words that begin with `letter`."""
        if letter not in self.edges[s]:
            return s
        return self.state(self.final[s], {c: t for c, t in self.edges[s].items() if c != letter})

    def words(self, s: int) -> Iterator[str]:
        """All words that a state accepts."""
        todo = [(s, None)]
        while todo:
            state, read = todo.pop()
            if self.final[state]:
                yield _spelled(read)
            todo += [(t, (read, c)) for c, t in self.edges[state].items()]


def _spelled(read: tuple | None) -> str:
    letters = []
    while read is not None:
        read, letter = read
        letters.append(letter)
    return "".join(reversed(letters))


def compose(longer: list[str], shorter: list[str], behind: str = "") -> Iterator[tuple[str, str]]:
    """Pairs one edit apart, each once: replacements among `longer`, and deletions that lead from there to `shorter`.

    All words of `longer` have one length, `shorter` ones one less. Behind each of them stands `behind`; a pair whose common
    prefix reaches into that belongs to another window.
    """
    register = Register()
    todo = [(register.acceptor(sorted(longer)), register.acceptor(sorted(shorter)), None)]
    while todo:
        s, t, read = todo.pop()
        edges, others = register.edges[s], register.edges[t]
        letters = sorted(edges)
        head = None
        for k, a in enumerate(letters):
            for b in letters[k + 1 :]:
                rest = register.meet(edges[a], edges[b])
                if rest != EMPTY:
                    head = _spelled(read) if head is None else head
                    for tail in register.words(rest):
                        yield head + a + tail, head + b + tail
            if t != EMPTY:
                rest = register.meet(edges[a], register.without(t, a))
                if rest != EMPTY:
                    head = _spelled(read) if head is None else head
                    for tail in register.words(rest):
                        if tail or not behind.startswith(a):
                            yield head + a + tail, head + tail
            todo.append((edges[a], others.get(a, EMPTY), (read, a)))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by initial state; one row per word of it that has near words."""
    key, group = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if len(group) < 2:
            return
        m, low, high, _ = key
        of = {word[low : len(word) - (m - high)]: (word, n) for word, n in group}
        behind = group[0][0][len(group[0][0]) - (m - high) :] if m > high else ""
        sides: tuple[list, list] = ([], [])
        for middle in of:
            sides[len(middle) < high - low].append(middle)
        found: dict[str, list] = {}
        for pair in compose(*sides, behind):
            for (word, _), (other, n) in ((of[pair[0]], of[pair[1]]), (of[pair[1]], of[pair[0]])):
                mine = found.setdefault(word, [0, 0, ""])
                mine[0] += 1
                if n > mine[1] or (n == mine[1] and other < mine[2]):
                    mine[1:] = n, other
        if found:
            columns = [list(found), *map(list, zip(*found.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NEAR)], schema=NEAR)

    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("m", "low", "high", "context")))
        for now, word, n in zip(keys, batch["word"].to_pylist(), batch["n"].to_pylist()):
            if now != key:
                yield from done()
                key, group = now, []
            group.append((word, n))
    yield from done()


STATE = ["m", "low", "high", "context"]


def _windows(rows: DataFrame, windows: Column) -> DataFrame:
    """A row per window of each (word, n, m), with the context the window leaves."""
    rows = rows.select("word", "n", "m", F.explode(windows).alias("w")).select("word", "n", "m", "w.low", "w.high")
    ahead = F.substring("word", F.lit(1), F.col("low"))
    behind = F.right("word", F.col("m") - F.col("high"))
    return rows.withColumn("context", F.concat(ahead, behind))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"))
    return F.array(pair(low, middle), pair(middle, high))


def initial_states(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows (word, n, initial state) such that no state has more than `group` words."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    rows = stored(_windows(words.select("word", "n", sizes), _halves(F.lit(0), F.col("m"))), "states")
    settled = None
    while True:
        large = rows.groupBy(*STATE).count().where((F.col("count") > group) & (F.col("high") - F.col("low") > 1)).drop("count")
        large = stored(large, "large")
        if large.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        fine = rows.join(large, STATE, "left_anti")
        settled = fine if settled is None else settled.unionByName(fine)
        split = rows.join(large, STATE, "left_semi").select("word", "n", "m", _halves(F.col("low"), F.col("high")).alias("windows"))
        rows = stored(_windows(split, F.col("windows")), "states")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best_n, best of the words of (word, n) that have near words."""
    rows = initial_states(words, group).select(*STATE, "word", "n")
    found = rows.repartition(*STATE).sortWithinPartitions(*STATE).mapInArrow(
        _near, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best")
    )


def variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs`."""
    words = stored(vocabulary(docs), "words")
    near = near_words(words, group).withColumnRenamed("word", "of")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    rows = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    rows = stored(rows, "forms")
    most = rows.agg(F.max("n")).first()[0] or LEAST
    steps = max(1, math.floor(math.log(most / LEAST, TIMES) + 1e-9))
    chains = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        on = chains.select(F.col("word").alias("via"), F.col("root").alias("further"))
        chains = stored(chains.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root")), "chains")
    chains = chains.withColumnRenamed("word", "of")
    return rows.join(chains, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
