"""Many markers in one pass over a text: an Aho-Corasick automaton with token borders, over Arrow batches.

A substring search per marker costs as many passes as there are markers. Here the length of the text and the number of hits count, so that
a catalogue of a hundred families costs about as much as one of ten. Hits of a batch are one 0/1 matrix, a column a marker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa

from confsieve.functions.text import is_word_marker

_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Markers:
    """Markers, in lower case, to look for in texts in lower case. Word markers count as whole runs of [a-z0-9] only."""

    def __init__(self, markers: Sequence[str]):
        self.markers = sorted(set(markers) - {""})
        self.index = {m: i for i, m in enumerate(self.markers)}
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {"markers": self.markers, "index": self.index, "_automaton": None}

    def _built(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, m in enumerate(self.markers):
                self._automaton.add_word(m, (i, len(m) if is_word_marker(m) else 0))
            self._automaton.make_automaton()
        return self._automaton

    def found(self, text: str) -> set[int]:
        """The numbers of the markers a text holds."""
        seen: set[int] = set()
        if not self.markers:
            return seen
        last = len(text) - 1
        for end, (i, word) in self._built().iter(text):
            if i not in seen and not (word and ((end < last and text[end + 1] in _TOKEN) or (end >= word and text[end - word] in _TOKEN))):
                seen.add(i)
        return seen

    def hits(self, texts: pa.Array) -> np.ndarray:
        """One row a text, one column a marker: 1 where it is found."""
        out = np.zeros((len(texts), len(self.markers)), np.float32)
        for row, text in enumerate(texts):
            if text.is_valid and (found := self.found(text.as_py())):
                out[row, list(found)] = 1
        return out

    def columns(self, markers: Sequence[str]) -> list[int]:
        return [self.index[m] for m in markers]

    def lister(self) -> Callable[[pa.Array], pa.Array]:
        """For an Arrow function: the markers of each text, in order."""

        def listed(texts: pa.Array) -> pa.Array:
            rows = [sorted(self.found(t.as_py())) if t.is_valid else [] for t in texts]
            names = [self.markers[i] for r in rows for i in r]
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(names, pa.string()))

        return listed
