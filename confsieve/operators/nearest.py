"""The best match of every query among many entries, without comparing all with all.

Queries climb down a ladder of thresholds. At a rung, a query is looked up by its rarest grams only: as many as it takes for what the rest
could add to stay below the rung. Every entry at or above the rung is then among the candidates, so that a query whose best candidate beats
the rung is answered, and only the others go on. Common grams are thus met only by queries that nothing resembles.

A gram's list of entries is cut into blocks of about ``BLOCK``, each a join key of its own. The last queries meet the entries in tiles:
two bounded blocks of rows and three matrix products a task, of which one row a query comes out.

Entries that fit one task (``HELD_ENTRIES``, ``HELD_GRAMS``) are sent to all tasks as lists by gram (:class:`Lists`) when the queries are more
than ``LISTED``: a query is then answered where it is stored, and neither its grams nor any candidates are written or shuffled.

Two measures are known: ``cosine`` of weighted grams and ``jaccard`` of gram sets. Grams are whole numbers.

Queries: pool, qid, ids and w (ascending ids), rare (ids, rarest first) and mass (the share each can add: of the squared length, or of the set), qsize.
Entries: pool, eid, ids, a, b (ascending ids), esize. A query is compared with the entries of its pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.functions.numbers import round_half_up
from confsieve.session import cut_lineage

LADDER = (0.9, 0.7, 0.55, 0.35)
BLOCK, TILE, CHUNK = 1000, 512, 2048
#: Entries and their grams that all tasks may hold; queries up to which candidates are listed all the same; cells and list items met at a time.
HELD_ENTRIES, HELD_GRAMS, LISTED, MET = 4096, 1_500_000, 1000, 2_000_000


def _flat(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *column]).astype(kind)


def _shared(left_ids: pd.Series, left_weights: pd.Series, right_ids: pd.Series, right_a: pd.Series, right_b: pd.Series) -> pd.DataFrame:
    """For each pair: sum of w * a, sum of b, and number of the shared ids; one search over all pairs of a batch."""
    n = len(left_ids)
    left, right = _flat(left_ids, np.int64), _flat(right_ids, np.int64)
    ids, code = np.unique(np.concatenate([left, right]), return_inverse=True)
    pair = np.repeat(np.arange(n), left_ids.map(len)), np.repeat(np.arange(n), right_ids.map(len))
    x, y = pair[0] * len(ids) + code[: len(left)], pair[1] * len(ids) + code[len(left) :]
    if not len(x) or not len(y):
        return pd.DataFrame({"dot": np.zeros(n), "shift": np.zeros(n), "both": np.zeros(n)})
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    found = y[at] == x
    where, at = pair[0][found], at[found]
    return pd.DataFrame({
        "dot": np.bincount(where, _flat(left_weights, np.float64)[found] * _flat(right_a, np.float64)[at], n),
        "shift": np.bincount(where, _flat(right_b, np.float64)[at], n),
        "both": np.bincount(where, minlength=n).astype(np.float64),
    })


def _similarity(measure: str, qsize: Column, esize: Column) -> Column:
    if measure == "cosine":
        return F.col("s.dot") / F.sqrt(qsize * (esize + F.col("s.shift")))
    return F.col("s.both") / (qsize + esize - F.col("s.both"))


def _dense(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[rows, columns] = values
    return out


def tile_best(measure: str, digits: int):
    """For a cogroup of queries and entries: the best entry of the tile for each query."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "eid": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q, e = left.to_pandas(), right.to_pandas().sort_values("eid")
        ids, code = np.unique(np.concatenate([_flat(q["ids"], np.int64), _flat(e["ids"], np.int64)]), return_inverse=True)
        cut = int(q["ids"].map(len).sum())
        rows = np.repeat(np.arange(len(q)), q["ids"].map(len)), np.repeat(np.arange(len(e)), e["ids"].map(len))
        w, a, b = _flat(q["w"], np.float64), _flat(e["a"], np.float64), _flat(e["b"], np.float64)
        dot, shift, both = (np.zeros((len(q), len(e))) for _ in range(3))
        for start in range(0, len(ids), CHUNK):
            qin = (code[:cut] >= start) & (code[:cut] < start + CHUNK)
            ein = (code[cut:] >= start) & (code[cut:] < start + CHUNK)
            qat, eat = (rows[0][qin], code[:cut][qin] - start), (rows[1][ein], code[cut:][ein] - start)
            width = min(CHUNK, len(ids) - start)
            held = _dense(*qat, np.ones(int(qin.sum())), (len(q), width))
            both += held @ _dense(*eat, np.ones(int(ein.sum())), (len(e), width)).T
            if measure == "cosine":
                dot += _dense(*qat, w[qin], (len(q), width)) @ _dense(*eat, a[ein], (len(e), width)).T
                shift += held @ _dense(*eat, b[ein], (len(e), width)).T
        qsize, esize = q["qsize"].to_numpy(np.float64)[:, None], e["esize"].to_numpy(np.float64)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            likeness = dot / np.sqrt(qsize * (esize + shift)) if measure == "cosine" else both / (qsize + esize - both)
        scale = float(10**digits)
        likeness = np.where(both > 0, np.floor(likeness * scale + 0.5) / scale, -1.0)
        at = likeness.argmax(axis=1)  # the first of equals has the smallest id
        value = likeness[np.arange(len(q)), at]
        met = value >= 0
        return pa.table({"qid": pa.array(q["qid"].to_numpy()[met]), "similarity": pa.array(value[met]), "eid": pa.array(e["eid"].to_numpy()[at[met]])})

    return best


class Lists:
    """The entries of one pool by gram, to be met by any number of queries. ``ids`` are the grams, ``df`` is how many entries hold each."""

    def __init__(self, eids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, esize: np.ndarray):
        order = np.argsort(eids)
        place = np.empty(len(eids), np.int64)
        place[order] = np.arange(len(eids))
        self.eids, self.esize = eids[order], esize[order]
        self.ids, code = np.unique(ids, return_inverse=True)
        by_gram = np.argsort(code, kind="stable")
        self.df = np.bincount(code, minlength=len(self.ids))
        self.starts = np.cumsum(self.df) - self.df
        self.entry, self.a, self.b = np.repeat(place, lengths)[by_gram], a[by_gram], b[by_gram]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """The number of each gram, -1 for one that no entry has."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def best(self, starts: np.ndarray, codes: np.ndarray, w: np.ndarray, qsize: np.ndarray, measure: str, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, similarity, eid) of the queries that share a gram with an entry; a query is the grams from its start to the next."""
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
        row, codes, w = row[codes >= 0], codes[codes >= 0], w[codes >= 0]
        met = np.bincount(row, self.df[codes], len(starts)) + len(self.eids)
        piece = ((np.cumsum(met) - met) // MET).astype(np.int64)  # a piece ends with the query that fills it
        cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=piece[-1] + 1 if len(piece) else 0))
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = np.searchsorted(row, [first, last])
            n = self.df[codes[lo:hi]]
            at = np.repeat(self.starts[codes[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shape = (last - first, len(self.eids))
            cell = np.repeat(row[lo:hi] - first, n) * shape[1] + self.entry[at]
            both = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape)
            q = qsize[first:last, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                if measure == "cosine":
                    dot = np.bincount(cell, np.repeat(w[lo:hi], n) * self.a[at], both.size).reshape(shape)
                    shift = np.bincount(cell, self.b[at], both.size).reshape(shape)
                    likeness = dot / np.sqrt(q * (self.esize + shift))
                else:
                    likeness = both / (q + self.esize - both)
            likeness = np.where(both > 0, np.floor(likeness * 10.0**digits + 0.5) / 10.0**digits, -1.0)
            top = likeness.argmax(axis=1)  # the first of equals has the smallest id
            value = likeness[np.arange(shape[0]), top]
            found = value >= 0
            yield np.flatnonzero(found) + first, value[found], self.eids[top[found]]


def lists(entries: DataFrame, queries: int, listed: int = LISTED) -> dict | None:
    """:class:`Lists` by pool, or None where the entries are too many to be held or the queries so few that candidates can be listed."""
    if queries <= listed:
        return None
    size = entries.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("ids")).alias("grams")).first()
    if size["entries"] > HELD_ENTRIES or (size["grams"] or 0) > HELD_GRAMS:
        return None
    held = entries.select("pool", "eid", "ids", "a", "b", "esize").toPandas()
    return {
        pool: Lists(e["eid"].to_numpy(np.int64), e["ids"].map(len).to_numpy(np.int64), _flat(e["ids"], np.int64), _flat(e["a"], np.float64), _flat(e["b"], np.float64), e["esize"].to_numpy(np.float64))
        for pool, e in held.groupby("pool")
    }


ANSWER = "qid long, similarity double, eid long"


def answers(qids: np.ndarray, rows: np.ndarray, similarity: np.ndarray, eids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids[rows], pa.int64()), pa.array(similarity, pa.float64()), pa.array(eids, pa.int64())], ["qid", "similarity", "eid"])


def postings(entries: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pool, gram, block, eid) and (pool, gram, blocks)."""
    lists = entries.select("pool", "eid", F.explode("ids").alias("gram"))
    blocks = lists.groupBy("pool", "gram").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = lists.join(blocks, ["pool", "gram"]).select("pool", "gram", F.pmod(F.xxhash64("eid"), F.col("blocks")).cast("int").alias("block"), "eid")
    return cut_lineage(placed, "postings"), cut_lineage(blocks, "posting-blocks")


def candidates(queries: DataFrame, lists: DataFrame, blocks: DataFrame, limit: float) -> DataFrame:
    """(qid, eid) of the entries that hold one of the grams a query cannot do without: what the others add stays below ``limit``."""
    spared = F.aggregate(
        F.reverse("mass"),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, m: F.when(acc["sum"] + m < limit - 1e-9, F.struct((acc["sum"] + m).alias("sum"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(2.0).alias("sum"), acc["n"].alias("n"))),
    )["n"]
    asked = queries.select("pool", "qid", F.explode(F.slice("rare", F.lit(1), F.size("rare") - spared)).alias("gram"))
    asked = asked.join(blocks, ["pool", "gram"]).select("pool", "gram", "qid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return asked.join(lists, ["pool", "gram", "block"]).select("qid", "eid", "pool").distinct()


def nearest(queries: DataFrame, entries: DataFrame, measure: str, digits: int, ladder: tuple = LADDER, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(qid, similarity rounded to ``digits``, eid) of the best entry, the smallest id of equals. Queries that share nothing have no row."""
    queries, entries = cut_lineage(queries, "asked"), cut_lineage(entries, "entries")
    shared = F.pandas_udf(_shared, "dot double, shift double, both double")
    lists, blocks = postings(entries, block)
    found, left = [], queries
    for rung in ladder:
        if left.isEmpty():
            break
        pairs = candidates(left, lists, blocks, rung * rung if measure == "cosine" else rung)
        both = pairs.join(left.select("qid", F.col("ids").alias("qids"), "w", "qsize"), "qid").join(entries.select("pool", "eid", F.col("ids").alias("eids"), "a", "b", "esize"), ["pool", "eid"])
        scored = both.select("qid", "eid", "qsize", "esize", shared("qids", "w", "eids", "a", "b").alias("s"))
        likeness = round_half_up(_similarity(measure, F.col("qsize"), F.col("esize")), digits)
        best = scored.groupBy("qid").agg(F.max(F.struct(likeness.alias("similarity"), (-F.col("eid")).alias("less"))).alias("m"))
        # What was not looked at is below the rung, and so no more than the rung after rounding.
        answered = cut_lineage(best.filter(F.col("m.similarity") > rung).select("qid", "m.similarity", (-F.col("m.less")).alias("eid")), "answered")
        found.append(answered)
        left = cut_lineage(left.join(answered.select("qid"), "qid", "left_anti"), "unanswered")
    q_tiles, e_tiles = (max(1, -(-df.count() // tile)) for df in (left, entries))
    dealt = left.select("pool", "qid", "ids", "w", "qsize", F.pmod(F.xxhash64("qid"), F.lit(q_tiles)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(e_tiles - 1))).alias("j"))
    against = entries.select("pool", "eid", "ids", "a", "b", "esize", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))).alias("i"), F.pmod(F.xxhash64("eid"), F.lit(e_tiles)).alias("j"))
    against = against.withColumn("j", F.col("j").cast("int")).withColumn("i", F.col("i").cast("long"))
    tiles = dealt.groupBy("pool", "i", "j").cogroup(against.groupBy("pool", "i", "j")).applyInArrow(tile_best(measure, digits), ANSWER)
    best = tiles.groupBy("qid").agg(F.max(F.struct("similarity", (-F.col("eid")).alias("less"))).alias("m"))
    every = best.select("qid", "m.similarity", (-F.col("m.less")).alias("eid"))
    for more in found:
        every = every.unionByName(more)
    return every
