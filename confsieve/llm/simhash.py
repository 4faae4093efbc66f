"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprint: 64 bits over the hashes of the 3-word shingles of the lower-cased text, a bit being set when more than half the hashes have
it. Documents link when their fingerprints differ in at most 3 bits; components of links are the groups.

1. Equal fingerprints are one node, so exact copies cost nothing further.
2. Bits that vary together over the nodes are put into the same of four blocks of 16 bits (or two of 32 when there are so many nodes that a
   block of 16 would no longer tell them apart).
3. Two fingerprints within 3 bits agree, in some block i, up to t_i bits, for any thresholds with ``sum (t_i + 1) = 4``. For each node dynamic
   programming chooses the thresholds (-1 leaves a block out) with the fewest expected candidates, from exact counts of all block values.
   A value that very many nodes share is so left to the other blocks.
4. Nodes and probes meet by block value and are verified on the whole fingerprint. A value with many nodes is cut into parts, and pairs
   of parts are dealt to tasks. A task hands out no more links than hold its nodes together (a spanning forest), never all pairs.

Defined cases: a text with 1 or 2 words is one shingle; one without words, or null, has fingerprint 0. A null id never is the smallest;
a group of null ids only has a null component. Rows that repeat stay, with equal results. Result columns replace input columns of their name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from confsieve.llm.common import map_texts, pick, unused, without
from confsieve.llm.components import components
from confsieve.session import cut_lineage

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Nodes from which on two blocks of 32 bits are cheaper than four of 16: 4 N / 2^16 candidates then exceed the probes of one-bit variants.
WIDE_FROM = 4_000_000
#: What a probe costs against one candidate; nodes of a block value in one part; rows of a value that are compared pair by pair.
PROBE_COST, PART_ROWS, SMALL = 16.0, 1024, 16


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(len(words) - SHINGLE + 1, 1)
    ends = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())), "<u8", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long with the bits of the fingerprint."""
    narrow = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    schema = StructType([StructField("doc_id", narrow.schema["doc_id"].dataType), StructField("text_hash", LongType()), StructField("fp", LongType())])

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values)], names=["doc_id", "text_hash", "fp"])

    return map_texts(narrow, schema, run)


def bit_order(nodes: DataFrame) -> list[int]:
    """The 64 bits, those that vary together next to each other: each block starts with the bit most correlated to those left and takes its nearest."""

    def count(batches):
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both, n = both + (bits.T @ bits).astype(np.int64), n + len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.r_[both.ravel(), n])], names=["at", "n"])

    sums = nodes.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for at, n in sums:
        flat[at] = n
    total, both = max(flat[-1], 1), flat[:-1].reshape(64, 64)
    one = np.diag(both) / total
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    near = np.abs(both / total - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    left, order = list(range(64)), []
    for _ in range(4):
        block = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        while len(block) < 16:
            block.append(max((b for b in left if b not in block), key=lambda b: (near[b, block].sum(), -b)))
        order += block
        left = [b for b in left if b not in block]
    return order


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """(n, 4) of uint16: the blocks of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u2")


def spheres(counts: np.ndarray) -> np.ndarray:
    """(4 distances, 65536): how many nodes have a block value exactly so many bits from each value."""
    values, out = np.arange(65536), [counts.astype(np.float32)]
    for d in (1, 2, 3):
        total = np.zeros(65536, np.float32)
        for bits in combinations(range(16), d):
            total += out[0][values ^ sum(1 << b for b in bits)]
        out.append(total)
    return np.array(out)


def variants(width: int) -> list[np.ndarray]:
    """For each number of bits up to the distance, the masks that flip exactly so many."""
    return [np.array([sum(1 << b for b in bits) for bits in combinations(range(width), d)], np.int64) for d in range(DISTANCE + 1)]


def allocate(near: np.ndarray, width: int) -> np.ndarray:
    """Thresholds (n, blocks) from -1 up by dynamic programming; ``near`` is (n, blocks, 4), candidates at each distance."""
    n, blocks, _ = near.shape
    probes = np.cumsum([len(v) for v in variants(width)]).astype(np.float32)
    cost = np.concatenate([np.zeros((n, blocks, 1), np.float32), np.cumsum(near, axis=2) + PROBE_COST * probes], axis=2)
    best, taken = cost[:, 0, :], []
    for i in range(1, blocks):
        options = np.stack([np.stack([best[:, j - u] + cost[:, i, u] if u <= j else np.full(n, np.inf, np.float32) for u in range(DISTANCE + 2)]) for j in range(DISTANCE + 2)])
        taken.append(options.argmin(axis=1))
        best = options.min(axis=1).T
    out, left = np.empty((n, blocks), np.int64), np.full(n, DISTANCE + 1)
    for i in range(blocks - 1, 0, -1):
        out[:, i] = taken[i - 1][left, np.arange(n)]
        left = left - out[:, i]
    out[:, 0] = left
    return out - 1


def probe_rows(nodes: DataFrame, order: list[int], counts: np.ndarray, wide: bool) -> DataFrame:
    """(block, value, fp, probe): every node under each of its block values, and as a probe under the variants its thresholds ask for."""
    width, total = (32, 2) if wide else (16, 4)
    sent = nodes.sparkSession.sparkContext.broadcast(np.stack([spheres(c) for c in counts]))  # 4 x 4 x 65536 floats, 4 MB at any size

    def run(batches):
        near_by, masks, n_nodes = sent.value, variants(width), max(float(counts[0].sum()), 1.0)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                part = permuted(fp, order)
                near = np.stack([near_by[i][:, part[:, i]].T for i in range(4)], axis=1)
                value = part.astype(np.int64)
                if wide:  # two blocks of 16 bits make one; their distances add up, taken as independent
                    near = np.stack([np.stack([sum(near[:, a, k] * near[:, a + 1, d - k] for k in range(d + 1)) / n_nodes for d in range(4)], axis=1) for a in (0, 2)], axis=1)
                    value = np.stack([value[:, a] | value[:, a + 1] << 16 for a in (0, 2)], axis=1)
                bound = allocate(near, width)
                for i in range(total):
                    yield _rows(i, value[:, i], fp, bound[:, i] >= 0)
                    for d in range(1, DISTANCE + 1):
                        who = np.flatnonzero(bound[:, i] >= d)
                        for k in range(0, len(who), max(1, 65536 // len(masks[d]))):
                            some = who[k : k + max(1, 65536 // len(masks[d]))]
                            yield _rows(i, (value[some, i][:, None] ^ masks[d]).ravel(), np.repeat(fp[some], len(masks[d])), np.ones(len(some) * len(masks[d]), bool), index=False)

    return nodes.select("fp").mapInArrow(run, "bucket long, fp long, probe boolean, stored boolean")


def _rows(block: int, value: np.ndarray, fp: np.ndarray, probe: np.ndarray, index: bool = True) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(value | block << 32), pa.array(fp), pa.array(probe), pa.array(np.full(len(fp), index))], names=["bucket", "fp", "probe", "stored"])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.atleast_1d(a ^ b).view(np.uint64))


def _forest(fp: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Verified links that hold together what the probes link among ``fp``: a breadth-first search that never looks at a row twice."""
    links, open_ = [], np.ones(len(fp), bool)
    for seed in np.flatnonzero(probe):
        if not open_[seed]:
            continue
        open_[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(open_ if probe[at] else open_ & probe)
            if not len(rest):
                continue
            found = rest[_differ(fp[rest], fp[at]) <= distance]
            open_[found] = False
            links += [(at, int(x)) for x in found]
            queue += found.tolist()
    return links


def _links(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by bucket. Small buckets are compared pair by pair, all of them at once; larger ones are searched."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[starts, len(bucket)])
    a, b = [], []
    left = np.repeat(np.where(size <= SMALL, starts + size, 0), size)  # end of the row's small bucket
    rows = np.arange(len(bucket))
    for step in range(1, SMALL):
        i = rows[rows + step < left]
        if not len(i):
            break
        i = i[(probe[i] | probe[i + step]) & (fp[i] != fp[i + step])]
        i = i[_differ(fp[i], fp[i + step]) <= distance]
        a.append(fp[i])
        b.append(fp[i + step])
    for s, n in zip(starts[size > SMALL], size[size > SMALL]):
        own, where = np.unique(fp[s : s + n], return_inverse=True)
        asks = np.zeros(len(own), bool)
        np.logical_or.at(asks, where, probe[s : s + n])
        pairs = np.array(_forest(own, asks, distance), np.int64).reshape(-1, 2)
        a.append(own[pairs[:, 0]])
        b.append(own[pairs[:, 1]])
    return np.concatenate([np.array([], np.int64), *a]), np.concatenate([np.array([], np.int64), *b])


def links(nodes: DataFrame, distance: int = DISTANCE, wide_from: int = WIDE_FROM, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): verified links that hold together every pair of ``nodes`` (distinct fp) within ``distance`` bits. ``distance`` is at most 3."""
    order = bit_order(nodes)

    def values(batches):
        total = np.zeros((4, 65536), np.int64)
        for batch in batches:
            part = permuted(batch.column(0).to_numpy(zero_copy_only=False), order)
            for i in range(4):
                total[i] += np.bincount(part[:, i], minlength=65536)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    # At most 4 x 65536 rows, however many nodes there are.
    found = nodes.select("fp").mapInArrow(values, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(4 * 65536, np.int64)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    counts = counts.reshape(4, 65536)
    rows = probe_rows(nodes, order, counts, counts[0].sum() >= wide_from)
    heavy = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("probe").cast("int")).alias("asked")).filter((F.col("n") > part_rows) & (F.col("asked") > 0))
    heavy = cut_lineage(heavy.select("bucket", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "simhash-heavy")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = rows.join(heavy, "bucket", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    dealt = dealt.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "probe").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "fp")

    def verify(frames):
        carried = None
        for frame in frames:
            frame = frame if carried is None else pd.concat([carried, frame], ignore_index=True)
            key = frame[["bucket", "p", "q"]].to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cut = change[-1] if len(change) else 0
            carried = frame.iloc[cut:]
            yield judged(frame.iloc[:cut], key[:cut])
        if carried is not None:
            yield judged(carried, carried[["bucket", "p", "q"]].to_numpy())

    def judged(frame, key):
        group = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(axis=1))] if len(frame) else np.array([], np.int64)
        a, b = _links(group, frame["fp"].to_numpy(np.int64), frame["probe"].to_numpy(bool), distance)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(verify, "a long, b long").filter("a <> b")


def grouped_prints(prints: DataFrame, distance: int = DISTANCE, wide_from: int = WIDE_FROM, part_rows: int = PART_ROWS) -> DataFrame:
    """(fp, first_id, root): each fingerprint, the smallest document that has it, and the component it is in."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes, distance, wide_from, part_rows))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, wide_from: int = WIDE_FROM, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``."""
    prints = cut_lineage(fingerprints(docs), "simhash")
    grouped = grouped_prints(prints, distance, wide_from, part_rows)
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(grouped.join(cut_lineage(smallest, "simhash-smallest"), "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the smallest id, of its rows the smallest fingerprint, of those the smallest hash of the text, and
    of equal rows any one. Rows that share an id but hold different texts are told apart. Documents without an id cannot be named by a group
    and all stay.

    Fingerprints are taken once, into a narrow table in which the rows to keep are found; the texts meet those rows in one semi join."""
    prints = cut_lineage(fingerprints(docs), "simhash")
    grouped = grouped_prints(prints)
    named = prints.filter("doc_id is not null").join(grouped.select("fp", "root"), "fp")
    doc, text, times = unused(docs, "keep_doc", "keep_text", "keep_rows")
    rows = named.groupBy("root", "doc_id", "fp", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "text_hash", "n")).alias("k"))
    keepers = cut_lineage(first.select(F.col("k.doc_id").alias(doc), F.col("k.text_hash").alias(text), F.col("k.n").alias(times)), "simhash-keepers")
    same_row = (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text))
    kept = docs.join(keepers.filter(F.col(times) == 1), same_row, "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    again = keepers.filter(F.col(times) > 1)
    if again.isEmpty():
        return kept
    # Rows that are there several times, same id and same text, have to be told apart.
    (rank,) = unused(docs, "keep_rank")
    order = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return kept.unionByName(without(docs.join(again, same_row, "left_semi").withColumn(rank, order).filter(F.col(rank) == 1), rank))
