"""Words a pattern cannot match without, so that a plain search decides where a pattern has to be tried at all."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # not a public module: without it every pattern is simply tried
    from re import _constants as kinds
    from re import _parser as parser
except ImportError:
    kinds = parser = None


def needles(pattern: str, least: int = 3) -> list[str]:
    """Words, in lower case, of which every text that ``pattern`` matches holds at least one; empty if none of ``least`` characters can be told.

    Of all plain runs and choices in the pattern the one whose shortest word is longest is taken.
    """
    if parser is None:
        return []
    try:
        found = _best(parser.parse(pattern))
    except (re.error, OverflowError):  # another dialect; the pattern is then always tried
        return []
    return sorted({w.lower() for w in found}) if found and all(len(w) >= least and w.isascii() for w in found) else []


def _best(sequence) -> list[str]:
    return max(_choices(sequence), key=lambda words: (min(map(len, words)), -len(words)), default=[])


def _choices(sequence) -> list[list[str]]:
    """Lists of words, of each of which one is met whatever way a match takes. Optional parts end a run of literals."""
    out, run = [], ""
    for kind, value in sequence:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        if kind is kinds.AT:  # anchors and word bounds take no character
            continue
        out.append([run])
        run = ""
        if kind is kinds.SUBPATTERN:
            out += _choices(value[3])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] > 0:
            out += _choices(value[2])
        elif kind is kinds.BRANCH:
            ways = [_best(way) for way in value[1]]
            if all(ways):
                out.append([w for way in ways for w in way])
    return [words for words in [*out, [run]] if all(words)]


def matches(text: Column, low: Column | None, pattern: str) -> Column:
    """``text.rlike(pattern)``, tried only where ``low``, the text in lower case, holds a word that the pattern cannot match without."""
    words = needles(pattern) if low is not None else []
    if not words:
        return text.rlike(pattern)
    held = F.contains(low, F.lit(words[0]))
    for word in words[1:]:
        held = held | F.contains(low, F.lit(word))
    return held & text.rlike(pattern)
