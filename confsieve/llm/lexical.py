"""Ranked lexical search over a term-partitioned index: bundles of items visit the owners of their terms one after the other.

1. Items become terms, bundles of ``ITEMS`` items become units of work. One pass over whole texts counts every document's terms and keeps the
   occurrences of those that items hold. A written table has (row, doc_id, n, terms); ``row >> 12`` is a document's block, its low bits its place.
2. Terms get integer weights, and *owners*: terms are laid in order of weight and cut where the number of postings is even. The owner of
   the rarest terms comes first. A posting carries its whole contribution as one integer.
3. A bundle carries, for each block of documents, a sparse list of (item, place, sum) and the terms it has yet to meet. In stage *s*
   a ``cogroup`` brings it together with the postings that owner *s* has of its block; contributions are added.
4. A sum that cannot reach the tenth of its block even with all that is to come is dropped, and no new sum is begun where none could: owners
   of frequent terms, whose lists are long, then add to few documents. Both bounds are exact; equal scores stay.
5. After the last owner each block hands on ten documents an item; the best ten of all follow.

No group is larger than a block: 4096 documents times the terms, or the items, of a bundle.

Defined cases: a null or empty text has no term, such an item no rows and such a document no score. Every row of ``documents`` is a document
and every different row of ``benchmark`` an item, also where ids repeat or are null; null ids come last among equals. Empty tables give
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confsieve.llm.common import map_texts, pick, with_columns
from confsieve.session import cut_lineage, run_folder

TOP, ITEMS, OWNERS, BLOCK_BITS = 10, 256, 6, 12
#: Distinct terms of all items up to which the set is sent to the tasks; beyond, all occurrences meet the items' terms in a join.
MAX_SENT = 1 << 20
#: Bytes of a term: digits, A-Z, a-z and everything outside ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
DOC = "row long, doc_id long, n long, terms array<string>, times array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").lower())


def item_terms(items: DataFrame, size: int = ITEMS) -> DataFrame:
    """(bundle, item, item_id, term, times): the items numbered inside bundles of at most ``size``."""
    base = cut_lineage(pick(items, "item_id", "text").distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    # Rows are numbered inside their partition; the sizes of the partitions before give the number in the table.
    part, sizes, before = F.shiftright("key", 33), [], 0
    for r in base.groupBy(part.alias("part")).count().orderBy("part").collect():
        sizes.append((r.part, before))
        before += r["count"]
    starts = items.sparkSession.createDataFrame(sizes, "part long, before long")
    dense = base.withColumn("part", part).join(starts, "part").withColumn("dense", F.col("before") + F.col("key").bitwiseAND(F.lit((1 << 33) - 1)))
    bundles = dense.select((F.col("dense") % size).cast("int").alias("item"), F.floor(F.col("dense") / size).alias("bundle"), "item_id", "text")

    def split(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        found = [Counter(terms_of(t)) for t in texts]
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        out = batch.select(["bundle", "item", "item_id"]).take(at)
        terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*out.columns, terms, pa.array([n for f in found for n in f.values()], pa.int64())], names=["bundle", "item", "item_id", "term", "times"])

    return cut_lineage(map_texts(bundles, f"bundle long, item int, item_id {base.schema['item_id'].dataType.simpleString()}, term string, times long", split), "items")


def counted(docs: DataFrame, wanted: DataFrame, max_sent: int = MAX_SENT) -> DataFrame:
    """A written table of the documents that have terms: row, doc_id, n (all terms), and those of ``wanted`` (term) with their occurrences."""
    terms = [r.term.encode() for r in wanted.limit(max_sent + 1).collect()]
    sent = frozenset(terms) if len(terms) <= max_sent else None
    base = pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())

    def count(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        all_terms = [terms_of(t) for t in texts]
        found = [Counter(t if sent is None else filter(sent.__contains__, t)) for t in all_terms]
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        names = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
        times = pa.array([n for f in found for n in f.values()], pa.int32())
        out = with_columns(batch.select(["row", "doc_id"]), n=pa.array([len(t) for t in all_terms], pa.int64()), terms=pa.ListArray.from_arrays(offsets, names), times=pa.ListArray.from_arrays(offsets, times))
        return out.filter(pa.compute.greater(out.column(2), 0))

    return cut_lineage(map_texts(base, DOC, count), "documents")


def weights(table: DataFrame, wanted: DataFrame, n_docs: int, owners: int = OWNERS) -> DataFrame:
    """(term, w, bound, owner) of the terms that documents hold; ``bound`` is no less than any contribution of the term."""
    held = table.select(F.explode(F.arrays_zip("terms", "times")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.max("p.times").cast("long").alias("most"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)))
    found = held.join(wanted, "term", "left_semi").withColumn("w", w)
    # m is 25 at least, and a contribution grows with tf.
    found = cut_lineage(found.withColumn("bound", F.col("w") * F.expr("(1000000000 * most) div (1000 * most + 200)")), "terms")
    # Weights are integers below 1000 ln(2 N + 2), so that their table is small at any size.
    steps = found.groupBy("w").agg(F.sum("df").alias("postings")).orderBy(F.desc("w")).collect()
    total, before, last = sum(r.postings for r in steps), 0, []
    for r in steps:
        before += r.postings
        if before * owners >= total * (len(last) + 1):
            last.append(r.w)  # the smallest weight of an owner
            while before * owners >= total * (len(last) + 1) and len(last) < owners:
                last.append(r.w)
    owner = F.lit(len(last))
    for s in range(len(last) - 1, -1, -1):
        owner = F.when(F.col("w") >= last[s], s).otherwise(owner)
    return found.withColumn("owner", owner.cast("int"))


def postings(table: DataFrame, terms: DataFrame, numbers: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(bundle, block, owner, term: number, place, amount): each occurrence with its whole contribution."""
    wide = "decimal(38,0)"
    m = 100 - 75 + F.expr(f"(75 * cast(n as {wide}) * {n_docs}) div {n_terms}")
    each = table.select(F.shiftright("row", BLOCK_BITS).alias("block"), F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("place"), m.alias("m"), F.explode(F.arrays_zip("terms", "times")).alias("p"))
    each = each.select("block", "place", "m", F.col("p.terms").alias("term"), F.col("p.times").cast("long").alias("tf"))
    found = each.join(terms.join(numbers, "term"), "term").withColumn("amount", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))"))
    return found.filter("amount > 0").select("bundle", "block", "owner", "number", "place", "amount")


#: What a bundle carries: the places and ids of its block; (item) and sum on each place met; what is to come: item, term number, times, bound, owner.
STATE = "bundle long, block long, places array<int>, ids array<long>, at_item array<int>, at_place array<int>, sums array<long>, item array<int>, number array<int>, times array<long>, bound array<long>, owner array<int>"


def _values(table: pa.Table, name: str) -> np.ndarray:
    """The list in the only row of a column."""
    return table.column(name).combine_chunks().flatten().to_numpy().astype(np.int64)


def visit(stage: int, items: int, top: int):
    """One stage: adds what the owner has, and drops sums that can no longer be among the best ``top`` of the block."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        at_item, at_place, sums = (_values(left, c) for c in ("at_item", "at_place", "sums"))
        item, number, times, bound, owner = (_values(left, c) for c in ("item", "number", "times", "bound", "owner"))
        size = 1 << BLOCK_BITS
        total = np.zeros((items, size), np.int64)
        total[at_item, at_place] = sums
        to_come = np.bincount(item, times * bound, items).astype(np.float64)  # below 2^53 or rounded by far less than one part in 10^9
        mine = owner == stage
        if right.num_rows:
            term, place, amount = (right.column(c).to_numpy() for c in ("number", "place", "amount"))
            order = np.argsort(term, kind="stable")
            term, place, amount = term[order], place[order], amount[order]
            starts = np.searchsorted(term, number[mine]), np.searchsorted(term, number[mine], "right")
            floor = _worst(total, top)
            begun = to_come * (1 + 1e-9) >= floor  # a document that is met only now can still get in
            for i, k, a, b in zip(item[mine].tolist(), times[mine].tolist(), *[x.tolist() for x in starts]):
                if a < b:
                    line, where = total[i], place[a:b]
                    if begun[i]:
                        line[where] += k * amount[a:b]
                    else:
                        met = line[where] > 0
                        line[where[met]] += k * amount[a:b][met]
        rest = np.bincount(item[~mine], (times * bound)[~mine], items)
        stays = (total > 0) & (total * (1 + 1e-9) + rest[:, None] * (1 + 1e-9) >= _worst(total, top)[:, None])
        at_item, at_place = np.nonzero(stays)
        out = {"at_item": at_item, "at_place": at_place, "sums": total[at_item, at_place], "item": item[~mine], "number": number[~mine], "times": times[~mine], "bound": bound[~mine], "owner": owner[~mine]}
        for name, values in out.items():
            field = left.schema.field(name)
            one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, field.type.value_type))
            left = left.set_column(left.schema.get_field_index(name), pa.field(name, one.type), one)
        return left

    return add


def _worst(total: np.ndarray, top: int) -> np.ndarray:
    """For each item the ``top``-th greatest sum so far: no final place among the best is below it."""
    return np.partition(total, total.shape[1] - top, axis=1)[:, total.shape[1] - top] if top < total.shape[1] else np.zeros(len(total), np.int64)


def best_of_block(top: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = dict(zip(row["places"], row["ids"]))
                table = pd.DataFrame({"item": row["at_item"], "score": row["sums"], "doc_id": pd.array([ids[p] for p in row["at_place"]], "Int64")})
                table = table.sort_values(["item", "score", "doc_id"], ascending=[True, False, True]).groupby("item").head(top)
                if len(table):
                    yield pa.RecordBatch.from_arrays([pa.array([row["bundle"]] * len(table), pa.int64()), pa.array(table["item"], pa.int32()), pa.array(table["doc_id"], pa.int64()), pa.array(table["score"], pa.int64())], names=["bundle", "item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, size: int = ITEMS, owners: int = OWNERS, max_sent: int = MAX_SENT) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``top`` documents of every item."""
    asked = item_terms(items, size)
    wanted = cut_lineage(asked.select("term").distinct(), "wanted")
    table = counted(docs, wanted, max_sent)
    n_docs, n_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter(F.lit(False))
    terms = weights(table, wanted, n_docs, owners)
    asked = asked.join(terms.select("term", "bound", "owner"), "term")
    # Terms are numbered inside a bundle by their order in the array of its terms.
    names = asked.groupBy("bundle").agg(F.array_sort(F.collect_set("term")).alias("names"))
    numbers = cut_lineage(names.select("bundle", F.posexplode("names").alias("number", "term")), "numbers")
    lists = asked.join(numbers, ["bundle", "term"]).groupBy("bundle").agg(F.collect_list(F.struct("item", "number", "times", "bound", "owner")).alias("a"))
    lists = cut_lineage(lists.select("bundle", *[F.col(f"a.{c}").alias(c) for c in ("item", "number", "times", "bound", "owner")]), "bundles")
    path = run_folder(docs.sparkSession, "index")
    postings(table, terms.select("term", "w", "owner"), numbers, n_docs, n_terms).write.partitionBy("owner").parquet(path)
    reader = docs.sparkSession.read.schema("bundle long, block long, number int, place int, amount long, owner int")
    place = F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    blocks = table.groupBy(F.shiftright("row", BLOCK_BITS).alias("block")).agg(F.collect_list(F.struct(place.alias("place"), "doc_id")).alias("d"))
    none_yet = {"at_item": "array<int>", "at_place": "array<int>", "sums": "array<long>"}
    state = reader.parquet(path).select("bundle", "block").distinct().join(blocks.select("block", F.col("d.place").alias("places"), F.col("d.doc_id").alias("ids")), "block").join(lists, "bundle")
    order = [f.strip().split(" ")[0] for f in STATE.split(", ")]
    state = state.withColumns({c: F.array().cast(t) for c, t in none_yet.items()}).select(*order)
    for stage in range(owners):
        own = reader.parquet(path).filter(F.col("owner") == stage).drop("owner")
        state = state.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInArrow(visit(stage, size, top), STATE)
    found = state.mapInArrow(best_of_block(top), "bundle long, item int, doc_id long, score long")
    by = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    names = asked.select("bundle", "item", "item_id").distinct()
    return found.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
