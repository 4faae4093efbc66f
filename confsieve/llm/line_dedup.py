"""Line dedup with two Bloom filters.

A line's key is the line without white space at both ends, A-Z in lower case. A key of at least ``min_chars`` code points that at
least ``min_docs`` documents hold is dropped everywhere but in the document with the largest id holding it.

1. Every task folds the key hashes of its texts into two Bloom filters, *seen once* and *seen twice*. They have one hash function and
   64 bits a key, so they are nearly empty and travel as lists of set bits (a compressed Bloom filter is smallest with one function).
2. The filters are merged page by page: ``twice = twice | other.twice | (once & other.once)``, ``once = once | other.once``.
3. A second reading keeps the lines whose bit is set in *twice*. Only those suspects are shuffled: the keys themselves are counted, so
   a false alarm of the filter costs a few bytes and changes nothing.
4. The keys to drop go back to their documents.

The *twice* filter goes to all tasks when its measured size is within ``max_filter_bytes``; else bits and lines meet in a join.

Defined cases: a null or empty text is one empty line. A null id is an id of its own below all others. Rows that share an id are one
document. Columns of the input named like a result (``n_lines``, ``n_dropped``) are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from confsieve.llm.common import SPACE, extended, map_texts, pick, same, slices, unused, with_columns, without
from confsieve.session import cut_lineage

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a filter for each key there can be; hashes a task gathers before it hands out a filter; size up to which *twice* is sent to all.
BITS_PER_KEY, FOLD_KEYS, MAX_FILTER_BYTES = 64, 1 << 20, 32 << 20
_SPACE = SPACE.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def keys_of(text: bytes | None, min_chars: int) -> set[bytes]:
    """The keys of a text that are long enough, each once."""
    out = set()
    for line in (text or b"").split(b"\n"):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                out.add(key)
    return out


def _pages(bits: int) -> int:
    """log2 of the bits of a page: about 4096 pages, each from 8 KB to 16 MB were it written out."""
    return min(max(bits - 12, 16), 27)


def seen_twice(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """The *twice* filter: (page, twice: the set bits of the page as sorted uint32, n: their number)."""
    page_bits = _pages(bits)

    def rows(hashes: array) -> pa.RecordBatch:
        where, times = np.unique(np.frombuffer(hashes, np.uint64) >> np.uint64(64 - bits), return_counts=True)
        page = (where >> np.uint64(page_bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        low, again = (where & np.uint64((1 << page_bits) - 1)).astype(np.uint32), times > 1
        ends = np.r_[starts[1:], len(page)]
        return pa.RecordBatch.from_arrays([
            pa.array(page[starts]),
            pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([low[a:b][again[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ], names=["page", "once", "twice"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = array("Q")
        for _, texts in slices(batches):
            for text in texts:
                hashes.extend(map(xxhash.xxh64_intdigest, keys_of(text, min_chars)))
            if len(hashes) >= FOLD_KEYS:
                yield rows(hashes)
                hashes = array("Q")
        if hashes:
            yield rows(hashes)

    def merge(key, group):
        once, times = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in group["once"]]), return_counts=True)
        twice = np.unique(np.concatenate([once[times > 1], *[np.frombuffer(x, np.uint32) for x in group["twice"]]]))
        group = group.iloc[:1][["page"]].copy()
        group["twice"], group["n"] = [twice.tobytes()], [len(twice)]
        return group

    partial = pick(docs, "text").mapInArrow(fold, "page long, once binary, twice binary")
    return partial.groupBy("page").applyInPandas(merge, "page long, twice binary, n long").filter("n > 0")


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc, key) of the lines whose hash the *twice* filter holds; each pair once for a row of ``docs``."""
    spark = docs.sparkSession
    chars = pick(docs, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((int(chars) // (min_chars + 1) + 1) * BITS_PER_KEY - 1, 1 << 16).bit_length(), 62)
    pages, page_bits = cut_lineage(seen_twice(docs, bits, min_chars), "line-filter"), _pages(bits)
    size = pages.agg(F.sum("n")).first()[0] or 0
    narrow = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "doc")
    fields = f"doc {narrow.schema['doc'].dataType.simpleString()}, key string"

    def lines(batch: pa.RecordBatch, texts: list, keep=None) -> pa.RecordBatch:
        rows, keys, hashes = [], [], array("Q")
        for i, text in enumerate(texts):
            own = keys_of(text, min_chars)
            rows += [i] * len(own)
            keys += own
        hashes.extend(map(xxhash.xxh64_intdigest, keys))
        bit = (np.frombuffer(hashes, np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        rows, keys = np.array(rows, np.int64), pa.array(keys, pa.binary()).cast(pa.string())
        if keep is not None:
            at = np.searchsorted(keep, bit)
            found = np.flatnonzero((at < len(keep)) & (keep[np.minimum(at, len(keep) - 1)] == bit)) if len(keep) else np.array([], np.int64)
            rows, keys = rows[found], keys.take(pa.array(found))
        ids = batch.column(0).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([ids, keys] + ([pa.array(bit)] if keep is None else []), names=["doc", "key"] + (["bit"] if keep is None else []))

    if size * 8 <= max_filter_bytes:
        found = [np.frombuffer(r.twice, np.uint32).astype(np.int64) + (r.page << page_bits) for r in pages.select("page", "twice").toLocalIterator()]
        sent = spark.sparkContext.broadcast(np.sort(np.concatenate([np.array([], np.int64), *found])))
        return map_texts(narrow, fields, lambda batch, texts: lines(batch, texts, sent.value))
    every = map_texts(narrow, fields + ", bit long", lines)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(twice, np.uint32).astype(np.int64) + (page << page_bits))], names=["bit"])

    return every.join(pages.select("page", "twice").mapInArrow(spell, "bit long"), "bit", "left_semi").drop("bit")


def shared_keys(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keeper) of the keys that at least ``min_docs`` documents hold, and the largest id among them."""
    return found.select("key", "doc").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.max("doc").alias("keeper")).filter(F.col("holders") >= min_docs).drop("holders")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``docs`` with the lines left in ``text``, and ``n_lines`` (before) and ``n_dropped``."""
    found = cut_lineage(suspects(docs, min_chars, max_filter_bytes), "line-suspects")
    shared = cut_lineage(shared_keys(found, min_docs), "line-shared")
    docs = without(docs, "n_lines", "n_dropped")
    gone_name, doc_name = unused(docs, "gone", "doc")
    drops = found.join(shared, "key").filter(~same(F.col("doc"), F.col("keeper"))).groupBy("doc").agg(F.collect_set("key").alias(gone_name)).withColumnRenamed("doc", doc_name)
    joined = docs.join(drops, same(docs["doc_id"], drops[doc_name]), "left").drop(doc_name)
    added = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]

    def rewrite(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        out, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts, batch.column(batch.schema.get_field_index(gone_name)).to_pylist()):
            lines = (text or b"").split(b"\n")
            gone = {k.encode() for k in drop or ()}
            kept = [x for x in lines if line_key(x) not in gone] if gone else lines
            out.append(b"\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        batch = batch.drop_columns([gone_name])
        return with_columns(batch, text=pa.array(out, pa.binary()).cast(pa.string()), n_lines=pa.array(n_lines, pa.int64()), n_dropped=pa.array(n_dropped, pa.int64()))

    return map_texts(joined, extended(docs, *added), rewrite)
