"""Quality rules: lines that many documents of a host share are removed, and documents that lose most of themselves are rejected.

1. One pass over whole texts measures each document and hashes its normalised lines (white space at both ends gone, A-Z in lower case;
   128 bits). Only counts and hashes are written, never texts, so that what follows moves a few bytes a line.
2. (host, hash) pairs are counted, each once a document, partly before the shuffle. A line is above the limits when at least ``MIN_DOCS``
   documents of the host, and more than ``MAX_PERCENT`` of a hundred of them, hold it.
3. Lines above the limits meet the documents again. The pairs of a line are spread over ``SALT`` keys, as one line can be in a third of all documents.
4. A document is rejected if it fails the base rules, if over half of its word characters are in removed lines, or if fewer than
   ``MIN_WORDS`` words are left.

The base rules: at least ``MIN_WORDS`` words, and at most ``MAX_REPEATED`` of a hundred words in 8-word windows that the text holds twice or more.

Defined cases: null texts have no words and no lines that count; lines without a word never count. Null hosts are one host. Every row is a
document, also where rows share an id or are repeated. An empty table gives no rows. Columns with names of results are passed over
(:func:`judged`) or kept as they came (:func:`cleaned`).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from confsieve.llm.common import SPACE, extended, map_texts, pick, same, with_columns
from confsieve.session import cut_lineage

MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
MIN_DOCS, MAX_PERCENT, SALT = 20, 1, 16
SYMBOLS = b"#*$%&|<>"
_SPACE = SPACE.encode()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINE = StructType([StructField("hash", BinaryType()), StructField("words", LongType()), StructField("chars", LongType())])


def normalised(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def line_hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(normalised(line))


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """For each list of words: how many stand in windows of ``window`` words that the same list holds twice or more.

    Window hashes are compared for all lists at once; those that repeat are then compared word by word."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(texts)), np.uint64)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    covered = np.zeros(len(ids) + window, np.int64)
    if len(ids) >= window:
        inside = own[: len(ids) - window + 1] == own[window - 1 :]
        hashes = own[: len(inside)].astype(np.uint64)
        for j in range(window):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(inside)] + np.uint64(1)
            hashes ^= hashes >> np.uint64(29)
        starts = np.flatnonzero(inside)
        order = np.sort(hashes[starts])
        starts = starts[np.isin(hashes[starts], order[1:][order[1:] == order[:-1]])]
        if len(starts):
            rows = np.column_stack([own[starts].astype(np.uint64), *[ids[starts + j] for j in range(window)]])
            _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            starts = starts[times[which.reshape(-1)] > 1]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + window, -1)
    return np.bincount(own, np.cumsum(covered)[: len(ids)] > 0, len(texts)).astype(np.int64).tolist()


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """A written table, one row a document: doc (the columns named, else all), row, host, the counts, and lines (hash, words, chars)."""
    columns = pick(docs, *keep) if keep else docs
    text, host = pick(docs, "text", "source").columns
    have = {c.lower(): F.col(f"`{c}`") for c in docs.columns}
    base = docs.select(F.struct(*[have.get(c.lower(), F.lit(None)).alias(c) for c in columns.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), have.get(host, F.lit(None)).cast("string").alias("host"), have.get(text, F.lit(None)).cast("string").alias("text"))
    fields = [StructField(c, LongType()) for c in COUNTS] + [StructField("lines", ArrayType(LINE))]

    def measure(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        words = [(t or b"").split() for t in texts]
        found: dict[str, list] = {c: [] for c in COUNTS}
        lines, counts = [], repeated_words(words)
        for text, own, repeated in zip(texts, words, counts):
            text, seen, sizes, doubled = text or b"", set(), {}, 0
            for line in text.split(b"\n"):
                if parts := line.split():
                    doubled += line in seen
                    seen.add(line)
                    size = sizes.setdefault(line_hash(line), [0, 0])
                    size[0] += len(parts)
                    size[1] += len(b"".join(parts).decode())
            for name, value in zip(COUNTS, (len(own), len(b"".join(own).decode()), len(text) - len(text.translate(None, SYMBOLS)), doubled, repeated)):
                found[name].append(value)
            lines.append([{"hash": h, "words": w, "chars": c} for h, (w, c) in sizes.items()])
        batch = batch.drop_columns(["text"])
        return with_columns(batch, **{c: pa.array(v, pa.int64()) for c, v in found.items()}, lines=pa.array(lines, pa.list_(pa.struct([("hash", pa.binary()), ("words", pa.int64()), ("chars", pa.int64())]))))

    return cut_lineage(map_texts(base, extended(base.drop("text"), *fields), measure), "measured")


def frequent_lines(table: DataFrame, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT) -> DataFrame:
    """(host, hash, docs) of the lines above the limits."""
    held = table.select("host", F.explode("lines.hash").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    salt = F.array(*[F.lit(i) for i in range(SALT)])
    hosts = table.groupBy("host").agg(F.count(F.lit(1)).alias("all_docs")).select(F.col("host").alias("h"), "all_docs", F.explode(salt).alias("s"))
    held = held.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALT)).cast("int"))
    over = held.join(hosts, same(F.col("host"), F.col("h")) & (F.col("salt") == F.col("s"))).filter(F.col("docs") * 100 > F.col("all_docs") * max_percent)
    return cut_lineage(over.select("host", "hash", "docs"), "frequent-lines")


def removed_lines(table: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, hash, words, chars): what each document loses."""
    salt = F.array(*[F.lit(i) for i in range(SALT)])
    lines = table.select("row", "host", F.inline("lines")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))
    limits = frequent.select(F.col("host").alias("h"), F.col("hash").alias("x"), F.explode(salt).alias("s"))
    return lines.join(limits, same(F.col("host"), F.col("h")) & (F.col("hash") == F.col("x")) & (F.col("salt") == F.col("s"))).select("row", "hash", "words", "chars")


def _judge(table: DataFrame, removed: DataFrame) -> DataFrame:
    lost = removed.groupBy("row").agg(F.sum("words").alias("lost_words"), F.sum("chars").alias("lost_chars"), F.count(F.lit(1)).alias("lost_lines"), F.collect_list("hash").alias("gone"))
    zero = F.lit(0).cast("long")
    all_of = table.drop("lines").join(lost, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("lost_words", "lost_chars", "lost_lines")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = (2 * F.col("lost_chars") > F.col("word_chars")) | (F.col("n_words") - F.col("lost_words") < MIN_WORDS)
    return all_of.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT) -> DataFrame:
    """doc_id, the counts, base_failed, lost_lines, lost_words, lost_chars (in lines above the limits) and kept, for every row of ``docs``."""
    table = measured(docs, "doc_id")
    lines = removed_lines(table, frequent_lines(table, min_docs, max_percent))
    return _judge(table, lines).select("doc.doc_id", *COUNTS, "base_failed", "lost_lines", "lost_words", "lost_chars", "kept")


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: float = MAX_PERCENT) -> DataFrame:
    """The documents that are kept, with the columns they came with, their texts without the lines above the limits."""
    table = measured(docs)
    lines = removed_lines(table, frequent_lines(table, min_docs, max_percent))
    kept = _judge(table, lines).filter("kept")
    text = next(c for c in docs.columns if c.lower() == "text")
    work = kept.select("doc", "gone", F.col(f"doc.`{text}`").alias("text"))

    def rewrite(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        out = []
        for text, gone in zip(texts, batch.column(1).to_pylist()):
            gone = set(gone or ())
            out.append(b"\n".join(x for x in text.split(b"\n") if line_hash(x) not in gone) if gone else text)
        return with_columns(batch, text=pa.array(out, pa.binary()).cast(pa.string()))

    done = map_texts(work, work.schema, rewrite)
    return done.select(*[(F.col("text") if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
