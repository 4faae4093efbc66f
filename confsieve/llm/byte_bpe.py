"""Byte-level BPE: text to token ids and back, exactly as merging by rank would give them, in time linear in the text.

Every match of the vocabulary's pattern is encoded for itself. An Aho-Corasick automaton over the tokens, whose bytes are read as
Latin-1, gives the longest token that starts at each byte. The encoder takes the longest token, moves on, and steps back to a shorter
one where the token before does not go with it. Two neighbours go together when merging by rank would leave the boundary between them
alone; that is decided from their merge trees and remembered. A prefix of a text has one encoding only, so a position from which no
token fits is never tried again, which keeps the work linear.

Defined cases: a null text has no ids, like an empty one; null ids decode to null. An id outside the vocabulary raises an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from confsieve.llm.common import extended, map_texts, with_columns, without

#: Encodings and neighbour decisions a worker remembers before it starts anew.
PIECES_KEPT, PAIRS_KEPT = 120_000, 250_000
_PAIR = 1 << 32
#: White space as the pattern's ``\s`` means it, stated because Python's also takes U+001C to U+001F. Fixed values.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 and number per line; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, inside and outside character classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(UNICODE_SPACE if inside and two == r"\s" else f"[{'^' * (two == r'\S')}{UNICODE_SPACE}]")
            i += 2
            continue
        inside = (pattern[i] == "[" or inside) and pattern[i] != "]"
        step = 2 if pattern[i] == "\\" else 1
        out.append(pattern[i : i + step])
        i += step
    return regex.compile("".join(out))


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging by rank, lowest first and leftmost among equals, with tokens ranked under ``below`` only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] >= below:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def merge_tree(ranks: dict[bytes, int]) -> np.ndarray:
    """For each id the ids of the two tokens it is merged from; its own id twice for a byte, -1 for what merging never yields."""
    tree = np.full((max(ranks.values()) + 1, 2), -1, np.int32)
    for token, rank in ranks.items():
        if len(token) == 1:
            tree[rank] = rank
            continue
        parts = merged(token, ranks, rank)
        if len(parts) == 2:
            tree[rank] = [ranks[p] for p in parts]
    return tree


class Encoder:
    """Encodes pieces of text; holds the automaton and what it has worked out so far."""

    def __init__(self, ranks: dict[bytes, int], tree: np.ndarray, pattern: str):
        self.ranks, self.find = ranks, compiled(pattern).findall
        self.tree = tree.tolist()
        self.token: list[bytes] = [b""] * len(self.tree)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank] = token
            if self.tree[rank][0] >= 0:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.token]
        self.table = ByteTable([t or None for t in self.token])
        self.joined = {(a, b): rank for rank, (a, b) in enumerate(self.tree) if a >= 0 and a != rank}
        self.shorter = lru_cache(None)(self._shorter)
        self.edge = lru_cache(None)(self._edge)
        self.pieces: dict[str, tuple[int, ...]] = _Pieces(self)
        self.fits: dict[int, bool] = _Fits(self)  # by left * _PAIR + right

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        text = self.token[token]
        for n in range(len(text) - 1, 0, -1):
            rank = self.ranks.get(text[:n], -1)
            if rank >= 0 and self.tree[rank][0] >= 0:
                return rank
        return -1

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one end of ``token`` as it is merged, each with the id of what takes it in."""
        out, into = [(token, len(self.tree))], token
        while self.tree[into][0] != into:
            out.append((self.tree[into][side], into))
            into = self.tree[into][side]
        return out

    def together(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the boundary: no pair across it may be merged before both sides have grown on.

        Of equal ranks the leftmost goes first: a merge inside the left token is before one across, a merge inside the right one after.
        """
        for x, x_into in self.edge(left, 1):
            for y, y_into in self.edge(right, 0):
                across = self.joined.get((x, y))
                if across is not None and across < x_into and across <= y_into:
                    return False
        return True

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        n, size, shorter, fits = len(data), self.size, self.shorter, self.fits
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # of one start, later ends are longer
        ids: list[int] = []
        at, closed, token = 0, bytearray(n + 1), longest[0]
        while at < n:
            while token >= 0 and (closed[at + size[token]] or ids and not fits[ids[-1] * _PAIR + token]):
                token = shorter(token)
            if token >= 0:
                ids.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            elif ids:
                closed[at] = 1
                at -= size[ids[-1]]
                token = shorter(ids.pop())
            else:
                raise ValueError("the vocabulary does not hold every byte of the text")
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def length(self, text: str) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.find(text))))

    def tidy(self) -> None:
        """Bounds what is remembered; called between slices."""
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        if len(self.fits) > PAIRS_KEPT:
            self.fits.clear()


class _Pieces(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, text: str) -> tuple[int, ...]:
        self[text] = ids = self.encoder.piece(text)
        return ids


class _Fits(dict):
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, pair: int) -> bool:
        self[pair] = yes = self.encoder.together(*divmod(pair, _PAIR))
        return yes


_BUILT: dict[str, Encoder] = {}


class Vocabulary:
    """A vocabulary sent to the tasks; each worker builds one encoder from it. Its size is that of the file: fixed, about 1 MB."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = load_ranks(path)
        self.key, self.sent = f"{path}\n{pattern}", spark.sparkContext.broadcast((ranks, merge_tree(ranks), pattern))

    def encoder(self) -> Encoder:
        if self.key not in _BUILT:
            _BUILT[self.key] = Encoder(*self.sent.value)
        return _BUILT[self.key]


def _flat(lists: list[list[int]]) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists)))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text`` (array of int); on demand also with ``decoded``, the bytes the ids stand for,
    in the same pass. Columns of these names are replaced."""
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    names = ["ids", "decoded"] if decoded else ["ids"]
    docs = without(docs, *names)

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        encoder = vocabulary.encoder()
        ids = _flat([encoder.encode(t.decode()) if t else [] for t in texts])
        encoder.tidy()
        return with_columns(batch, ids=ids, **({"decoded": encoder.table.decode(ids)} if decoded else {}))

    fields = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]
    return map_texts(docs, extended(docs, *fields[: len(names)]), run)


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``n_tokens``, the number of token ids of ``text``. A column of that name is replaced."""
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    docs = without(docs, "n_tokens")

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        encoder = vocabulary.encoder()
        counts = [encoder.length(t.decode()) if t else 0 for t in texts]
        encoder.tidy()
        return with_columns(batch, n_tokens=pa.array(counts, pa.int32()))

    return map_texts(docs, extended(docs, StructField("n_tokens", IntegerType())), run)


class ByteTable:
    """The bytes of all tokens end to end, to look many ids up at once."""

    def __init__(self, tokens: list[bytes | None]):
        self.size = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
        self.start = np.cumsum(np.r_[0, np.maximum(self.size, 0)])[:-1]
        self.bytes = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)

    def decode(self, column: pa.Array) -> pa.Array:
        """Lists of ids to bytes; null stays null."""
        ids, counts = column.flatten().to_numpy(zero_copy_only=False), pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        if len(ids) and (ids.dtype.kind != "i" or ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids.astype(np.int64)]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids.astype(np.int64)] - (ends - size), size)
        data, cuts = self.bytes[at].tobytes(), np.r_[0, ends][np.cumsum(np.r_[0, counts])]
        return pa.array([None if null else data[a:b] for a, b, null in zip(cuts, cuts[1:], column.is_null().to_pylist())], pa.binary())


def decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``decoded``, the bytes that ``ids`` stand for. A column of that name is replaced."""
    tokens = {rank: token for token, rank in load_ranks(path).items()}
    sent = docs.sparkSession.sparkContext.broadcast([tokens.get(i) for i in range(max(tokens) + 1)])
    docs = without(docs, "decoded")

    def run(batches):
        table = ByteTable(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield with_columns(batch, decoded=table.decode(batch.column(batch.schema.get_field_index("ids"))))

    return docs.mapInArrow(run, extended(docs, StructField("decoded", BinaryType())))
