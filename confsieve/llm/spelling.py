"""Spelling variants: words of a corpus that are one edit apart, by finite-state composition.

Near words are the pairs accepted by ``A o T o A``: A is the minimised acceptor of the vocabulary, T copies its input but for one inserted,
deleted or replaced code point. A state of the composition is (state of A, edits made, state of A).

* Words are cut into blocks by the state that their first code points lead to (*initial state*): there both sides of a pair are in the same
  state with no edit made. A block's acceptor is built, minimised and composed in one task.
* Pairs with their edit before that state share their end. They come from the same composition over reversed words, where at most
  ``START - 1`` code points may follow the edit.
* A block of more than ``BLOCK`` words is cut by its next code point. The composed states that leave it with an edit accept exactly the
  pairs whose rest is equal; a shuffle by that rest enumerates them, in groups no larger than the alphabet.

An edit stands at the first code point in which the words differ, so that each pair is found once; only counts and the best form leave a block.

Defined cases: null texts have no words. A null id stands as an empty text before the colon. Rows that share an id, repeated rows too, each
count. Ties in ``n`` go to the form first in code-point order. An empty table has no words. Other columns are not looked at.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.llm.common import pick, slices
from confsieve.session import cut_lineage

MIN_CHARS, MIN_TIMES, TIMES_AS_OFTEN, TYPO = 7, 2, 10, 31
#: Code points that lead to a block; words a task composes at once; distinct words a task counts before it hands them on.
START, BLOCK, FOLD_WORDS = 3, 50_000, 200_000


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, typo: int = TYPO) -> DataFrame:
    """(word, n) over whole texts: runs of letters, A-Z in lower case, one code point gone where the hash of id and run says so."""
    # U+00C0 to U+00FF are the bytes C3 80 to C3 BF. Shorter runs cannot give a word and are passed over.
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % min_chars)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch, texts in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), texts):
                start = crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for run, n in Counter(runs.findall((text or b"").lower())).items():
                    h = crc32(run, start)
                    if not h % typo:
                        letters = run.decode()
                        at = h % len(letters)
                        if len(letters) == min_chars:
                            continue
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    counts[run] += n
                if len(counts) >= FOLD_WORDS:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return pick(docs, "doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimised acyclic acceptor of sorted, distinct words: equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.shortest: list[int] = []  # the shortest word accepted from a state
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states not yet settled, along the last word
        before = ""

        def settle(down_to: int) -> None:
            while len(path) > down_to + 1:
                arcs, final = path.pop()
                path[-1][0][before[len(path) - 1]] = self._state(known, arcs, final[0])

        for word in words:
            shared = 0
            while shared < len(before) and shared < len(word) and before[shared] == word[shared]:
                shared += 1
            settle(shared)
            path.extend(({}, [False]) for _ in range(len(word) - shared))
            path[-1][1][0] = True
            before = word
        settle(0)
        self.root = self._state(known, path[0][0], path[0][1][0])

    def _state(self, known: dict[tuple, int], arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.shortest.append(0 if final else 1 + min((self.shortest[x] for x in arcs.values()), default=sys.maxsize >> 1))
        return state


class OneEdit:
    """The composition of an acceptor, the one-edit transducer, and the acceptor. Nothing recurses: words can be very long."""

    def __init__(self, acceptor: Acceptor, after: int = sys.maxsize):
        self.a, self.after = acceptor, after  # at most ``after`` code points follow the edit
        self._meet: dict[tuple[int, int], bool] = {}

    def _onward(self, pair: tuple[int, int]) -> Iterator[tuple[int, int]]:
        a, b = self.a.arcs[pair[0]], self.a.arcs[pair[1]]
        if len(b) < len(a):
            a, b = b, a
        for c, x in a.items():
            y = b.get(c)
            if y is not None:
                yield (x, y) if x < y else (y, x)

    def meets(self, x: int, y: int) -> bool:
        """Whether two states accept a common rest: pairs of states that do not are no part of the composition."""
        pair = (x, y) if x < y else (y, x)
        found, final = self._meet, self.a.final
        if x == y or (final[x] and final[y]):
            return True
        if pair in found:
            return found[pair]
        trail = [(pair, self._onward(pair))]
        while trail:
            pair, onward = trail[-1]
            for step in onward:
                if step[0] == step[1] or (final[step[0]] and final[step[1]]) or found.get(step):
                    found.update((p, True) for p, _ in trail)
                    return True
                if step not in found:
                    trail.append((step, self._onward(step)))
                    break
            else:
                found[pair] = False
                trail.pop()
        return False

    def rests(self, x: int, y: int, without: str | None = None) -> Iterator[str]:
        """The rests that both states accept, no longer than may follow an edit and not starting with ``without``."""
        final, arcs, path = self.a.final, self.a.arcs, []
        todo = [(0, "", x, y)]
        while todo:
            depth, c, x, y = todo.pop()
            path[max(depth - 1, 0) :] = [c] if depth else []
            if final[x] and final[y]:
                yield "".join(path)
            if depth < self.after:
                a, b = arcs[x], arcs[y]
                todo += [(depth + 1, d, a[d], b[d]) for d in (a if len(a) <= len(b) else b) if d in a and d in b and (depth or d != without) and self.meets(a[d], b[d])]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """The pairs of rests of a state that differ by one edit right here."""
        found: list[tuple[str, str]] = []
        if self.a.shortest[state] <= self.after + 1:
            arcs = sorted(self.a.arcs[state].items())
            for i, (c, x) in enumerate(arcs):
                for d, y in arcs[i + 1 :]:
                    if self.meets(x, y):
                        found += [(c + rest, d + rest) for rest in self.rests(x, y)]
                if self.meets(x, state):
                    found += [(c + rest, rest) for rest in self.rests(x, state, c)]
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every accepted pair once. States are numbered from the ends of words, so that a state follows all it leads to."""
        edits = [self.edits(state) for state in range(len(self.a.arcs))]
        alive = [bool(x) for x in edits]
        for state, arcs in enumerate(self.a.arcs):
            alive[state] = alive[state] or any([alive[x] for x in arcs.values()])
        copied: list[str] = []
        todo = [(0, "", self.a.root)]
        while todo:
            depth, c, state = todo.pop()
            copied[max(depth - 1, 0) :] = [c] if depth else []
            if edits[state]:
                start = "".join(copied)
                for a, b in edits[state]:
                    yield start + a, start + b
            todo += [(depth + 1, d, x) for d, x in self.a.arcs[state].items() if alive[x]]


class Found:
    """For each word of a block: its near words, and the best of them."""

    def __init__(self, times: dict[str, int]):
        self.times, self.near, self.best = times, Counter(), {}

    def add(self, a: str, b: str) -> None:
        for word, other in ((a, b), (b, a)):
            self.near[word] += 1
            offer = (-self.times[other], other)
            if word not in self.best or offer < self.best[word]:
                self.best[word] = offer

    def rows(self) -> pa.RecordBatch:
        words = list(self.near)
        best = [self.best[w] for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([self.near[w] for w in words], pa.int64()), pa.array([-n for n, _ in best], pa.int64()), pa.array([w for _, w in best], pa.string())], names=["word", "n_near", "best_n", "best"])


NEAR = "word string, n_near long, best_n long, best string"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (side, key, ...) of a sorted partition, one block at a time."""
    block: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if block and row[:2] != block[0][:2]:
                yield block
                block = []
            block.append(row)
    if block:
        yield block


def _compose(start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches):
            back = block[0][0]
            written = [r[2] for r in block]
            turn = (lambda w: w[::-1]) if back else (lambda w: w)
            found = Found({turn(r[2]): r[3] for r in block})
            for a, b in OneEdit(Acceptor(written), start - 1 if back else sys.maxsize).pairs():
                a, b = turn(a), turn(b)
                if not back or a[:start] != b[:start]:  # else the pair is in a block of the other side
                    found.add(a, b)
            if found.near:
                yield found.rows()

    return run


def _equal_rests(start: int):
    """Pairs with their edit at the end of the key: equal rests behind a code point (``cut``), or from the key on (no ``cut``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches):
            back, (_, rest) = block[0][0], block[0][1].values()
            turn = (lambda w: w[::-1]) if back else (lambda w: w)
            members = [(cut, turn(s)) for _, _, cut, s, _ in block]
            found = Found({turn(s): n for *_, s, n in block})
            for i, (c, a) in enumerate(members):
                for d, b in members[:i]:
                    later = (c is None and d == rest[:1]) or (d is None and c == rest[:1])  # the words differ further on only
                    if not later and (not back or a[:start] != b[:start]):
                        found.add(a, b)
            if found.near:
                yield found.rows()

    return run


def near_words(vocabulary: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best: its near word of largest n) for every word of (word, n) that has a near word."""
    start = min(START, (min_chars - 1) // 2)
    ends = min_chars - start  # code points at the end that a pair shares where it does not share its first ``start``
    forward = vocabulary.select(F.lit(False).alias("back"), F.substring("word", 1, start).alias("key"), F.col("word").alias("s"), "n")
    backward = vocabulary.select(F.lit(True).alias("back"), F.reverse(F.substring("word", -ends, ends)).alias("key"), F.reverse("word").alias("s"), "n")
    words, length, found = forward.unionByName(backward), {False: start, True: ends}, []
    while True:
        sizes = words.groupBy("back", "key").agg(F.count(F.lit(1)).alias("words"))
        large = cut_lineage(sizes.filter(F.col("words") > block).select("back", "key"), "large-blocks")
        if large.isEmpty():
            return _together([*found, _blocks(words, start)])
        small = words.join(large, ["back", "key"], "left_anti")
        found.append(_blocks(small, start))
        split = cut_lineage(words.join(large, ["back", "key"], "left_semi"), "split-blocks")
        here = F.length("key")
        cut = split.filter(F.length("s") > here).select("back", "key", _from("s", here + 2).alias("rest"), F.substring("s", here + 1, F.lit(1)).alias("cut"), "s", "n")
        whole = split.select("back", "key", _from("s", here + 1).alias("rest"), F.lit(None).cast("string").alias("cut"), "s", "n")
        rests = cut.unionByName(whole).repartition("back", "key", "rest").sortWithinPartitions("back", "key", "rest")
        found.append(rests.select("back", F.struct("key", "rest").alias("at"), "cut", "s", "n").mapInArrow(_equal_rests(start), NEAR))
        words = split.filter(F.length("s") > here).select("back", F.substring("s", F.lit(1), here + 1).alias("key"), "s", "n")


def _from(name: str, position: Column) -> Column:
    return F.substring(F.col(name), position, F.length(name))


def _blocks(words: DataFrame, start: int) -> DataFrame:
    return words.repartition("back", "key").sortWithinPartitions("back", "key", "s").mapInArrow(_compose(start), NEAR)


def _together(found: list[DataFrame]) -> DataFrame:
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form of the chain, by doubling. A chain is short, as every form is many times as frequent."""
    at = cut_lineage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut_lineage(moved, "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, times_as_often: int = TIMES_AS_OFTEN, typo: int = TYPO, block: int = BLOCK) -> DataFrame:
    """Each word of at least ``min_chars`` code points seen ``min_times``: word, n, n_near, form (a near word ``times_as_often`` as frequent), form_n, root."""
    vocabulary = cut_lineage(word_counts(docs, min_chars, typo).filter(F.col("n") >= min_times), "vocabulary")
    near = vocabulary.join(near_words(vocabulary, min_chars, block), "word", "left")
    often = F.col("best_n") >= times_as_often * F.col("n")
    formed = cut_lineage(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
