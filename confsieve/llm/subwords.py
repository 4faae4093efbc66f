"""Words and character n-grams as arrays: what the text classifiers share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a worker keeps its results for before it starts anew.
WORDS_KEPT = 300_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows at most of each value of ``label``, chosen by the hash of ``doc_id``; and what share of each value was taken."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = {k: min(1.0, most / n) for k, n in counts.items()}
    if not share:
        return rows, share
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col(label))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(spot < limit), share


class WordTable(dict):
    """Numbers words as they come; ``work`` gives the result rows of new ones, many at a time."""

    def __init__(self, work: Callable[[list[str]], np.ndarray], width: int):
        self.work, self.width, self.new = work, width, []
        self.rows = np.zeros((0, width))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def results(self) -> np.ndarray:
        """A row of results for every number handed out so far."""
        if self.new:
            if len(self) > len(self.rows):
                grown = np.zeros((max(len(self), 2 * len(self.rows)), self.width))
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            start = len(self) - len(self.new)
            for at in range(0, len(self.new), 20_000):
                some = self.new[at : at + 20_000]
                self.rows[start + at : start + at + len(some)] = self.work(some)
            self.new = []
        return self.rows

    def tidy(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()
            self.new, self.rows = [], np.zeros((0, self.width))


def ngrams(words: list[str], low: int, high: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word number, order) of the character n-grams of ``<word>`` from ``low`` to ``high`` characters, sorted by word within an order.

    ``whole`` adds the word with its marks as a feature of order 0. Hashes are 64 bits over code points.
    """
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in marked], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the end of the word
    first = np.flatnonzero(left == np.repeat(size, size))
    hashes, owners, orders = [], [], []
    rolling, step = chars.copy(), np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, high + 1):
        if n > 1:
            rolling = rolling[: len(chars) - n + 1] * step + chars[n - 1 :] if len(chars) >= n else rolling[:0]
        if n < low:
            continue
        at = np.flatnonzero(left[: len(rolling)] >= n)
        hashes.append(rolling[at] + np.uint64(n))
        owners.append(word[at])
        orders.append(np.full(len(at), n))
    if whole and len(words):
        powers = np.cumprod(np.full(int(size.max()), step, np.uint64))
        hashes.append(np.add.reduceat(chars * powers[left - 1], first))
        owners.append(np.arange(len(words)))
        orders.append(np.zeros(len(words), np.int64))
    empty = np.array([], np.int64)
    flat = np.concatenate([empty.astype(np.uint64), *hashes])
    flat = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return flat ^ (flat >> np.uint64(32)), np.concatenate([empty, *owners]), np.concatenate([empty, *orders])


def windows(counts: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of windows over texts of so many words laid end to end; every word is in one, every text has at least one."""
    number = np.maximum(-(-np.maximum(counts - width, 0) // step) + 1, 1)
    document = np.repeat(np.arange(len(counts)), number)
    begin = np.cumsum(counts) - counts
    start = begin[document] + (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * step
    return start, np.minimum(start + width, (begin + counts)[document]), document
