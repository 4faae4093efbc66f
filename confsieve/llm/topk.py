"""Exact top-k by inner product with cover trees over queries and data.

Components become integers, ``floor(1024 x)``, so scores are exact. The vectors are dealt to the nearest of some pivots and those cells to blocks
of about ``BLOCK`` rows. Each block gets one cover tree that indexes its data and its queries together: a node has a centre, the
covering radius of what lies below it, children whose centres keep their distance, and the queries below it. The k best of a query in its own block
are its first bound.

Blocks of data then meet tiles of queries. For a group of queries with centre c, radius r and worst kth score w, and a data node with centre x and
radius s, no pair scores above ``c x + r |x| + s |c| + r s``; below w the pair of nodes is left out with all that hangs on it. Nothing is
approximate: what is left is scored exactly, and a tile hands on a query's k best only.

Defined cases: vectors that are null or hold a null or non-finite component take no part, and neither do rows without an id. Rows with
one id and one vector are one. A query does not find rows of its own id. Shorter vectors are filled with zeros. Scores are 64-bit integers.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confsieve.llm.common import pick
from confsieve.session import cut_lineage

SCALE, K, EVERY = 1024, 10, 100
#: Pivots that deal the vectors to cells; rows of a block; queries of a tile; data blocks of a tile; points of a leaf; children of a node.
PIVOTS, BLOCK, TILE_QUERIES, TILE_BLOCKS, LEAF, WIDEST = 64, 2048, 4096, 8, 64, 96
GROUP = 8


def integers(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, as arrays of whole numbers of equal length."""
    rows = pick(table, "vec_id", vector).select("vec_id", F.col(vector).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")).distinct()
    rows = cut_lineage(rows, "vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v"))).alias("v"))


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floats while every sum stays below 2**53, else in integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    low: int  # the points below are order[low:high]
    high: int
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Points in tree order, and the root over them."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.root = self._node(self.points[0], 0, len(points))
        del self.points

    def _distance(self, centre: np.ndarray, low: int, high: int) -> np.ndarray:
        return np.sqrt(((self.points[self.order[low:high]] - centre) ** 2).sum(axis=1))

    def _node(self, centre: np.ndarray, low: int, high: int) -> Node:
        near = self._distance(centre, low, high)
        node = Node(centre, float(near.max()), low, high)
        if high - low <= LEAF or node.radius == 0:
            return node
        centres, nearest = [centre], np.zeros(high - low, np.int64)
        while near.max() > node.radius / 2:
            if len(centres) == WIDEST:  # no clusters at this scale; the points are scanned together
                return node
            far = self.points[self.order[low + int(near.argmax())]]
            other = self._distance(far, low, high)
            nearest[other < near] = len(centres)
            near = np.minimum(near, other)
            centres.append(far)
        by_child = np.argsort(nearest, kind="stable")
        self.order[low:high] = self.order[low:high][by_child]
        ends = low + np.cumsum(np.bincount(nearest, minlength=len(centres)))
        node.children = [self._node(c, a, b) for c, a, b in zip(centres, np.r_[low, ends[:-1]], ends) if b > a]
        return node


class Best:
    """The k best of each query so far, by score and then smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.own, self.k = ids, k
        self.score: list[np.ndarray] = [np.array([], np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.array([], np.int64)] * len(ids)
        self.worst = np.full(len(ids), -np.inf)

    def offer(self, who: np.ndarray, table: np.ndarray, ids: np.ndarray) -> None:
        for q, row in zip(who, table):
            new = np.flatnonzero((row >= self.worst[q]) & (ids != self.own[q]))
            if not len(new):
                continue
            score, found = np.concatenate([self.score[q], row[new]]), np.concatenate([self.found[q], ids[new]])
            best = np.lexsort((found, -score))[: self.k]
            self.score[q], self.found[q] = score[best], found[best]
            if len(best) == self.k:
                self.worst[q] = max(self.worst[q], score[best[-1]])


def indexed(ids: np.ndarray, points: np.ndarray, every: int, k: int) -> tuple[dict, dict | None]:
    """The data side and the query side of a block, from one tree."""
    tree = CoverTree(points)
    ids, points = ids[tree.order], points[tree.order]
    asks = np.flatnonzero(ids % every == 0)
    data = {"ids": ids, "points": points, "root": tree.root}
    if not len(asks):
        return data, None
    best = Best(ids[asks], k)
    best.offer(np.arange(len(asks)), scores(points[asks], points), ids)
    groups, open_ = [], [tree.root]
    while open_:
        node = open_.pop()
        below = np.flatnonzero((asks >= node.low) & (asks < node.high))
        if len(below) > GROUP and node.children:
            open_ += node.children
        elif len(below):
            reach = float(np.sqrt(((points[asks[below]] - node.centre) ** 2).sum(axis=1)).max())
            groups.append((below, node.centre, reach))
    return data, {"ids": ids[asks], "points": points[asks], "worst": best.worst, "groups": groups}


def searched(blocks: list[dict], asked: list[dict], k: int) -> list[tuple[np.ndarray, np.ndarray, Best]]:
    """Walks each group of queries and each tree together."""
    out = []
    for queries in asked:
        best = Best(queries["ids"], k)
        best.worst = queries["worst"].copy()
        for who, centre, reach in queries["groups"]:
            own, size = queries["points"][who], float(np.linalg.norm(centre))

            def bound(node: Node) -> float:
                most = float(centre @ node.centre) + reach * float(np.linalg.norm(node.centre)) + node.radius * size + reach * node.radius
                return most + 1 + 1e-9 * abs(most)

            for _, _, block in sorted(((-bound(b["root"]), i, b) for i, b in enumerate(blocks)), key=lambda x: x[:2]):
                open_ = [block["root"]]
                while open_:
                    node = open_.pop()
                    if bound(node) < best.worst[who].min():
                        continue
                    if node.children:
                        open_ += sorted(node.children, key=bound)
                    else:
                        best.offer(who, scores(own, block["points"][node.low : node.high]), block["ids"][node.low : node.high])
        out.append((queries["ids"], queries["points"], best))
    return out


def top_k(table: DataFrame, k: int = K, every: int = EVERY, vector: str = "embedding", block: int = BLOCK, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` the k rows with the greatest inner product."""
    vectors = cut_lineage(integers(table, vector), "vectors-even")
    spark = table.sparkSession
    pivots = [r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").collect()]
    sent = spark.sparkContext.broadcast(np.array(pivots, np.float64))

    def celled(batches):
        at = sent.value
        for batch in batches:
            v = batch.column(1)
            points = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
            near = (at**2).sum(axis=1)[None, :] - 2 * points @ at.T
            yield pa.RecordBatch.from_arrays([pa.array(near.argmin(axis=1).astype(np.int64)), batch.column(0).cast(pa.int64()), v], names=["cell", "vec_id", "v"])

    dealt = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(celled, "cell long, vec_id long, v array<bigint>")
    sizes = {r[0]: r[1] for r in dealt.groupBy("cell").count().collect()}  # one row a pivot
    parts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 1) // block)) for c in range(max(len(pivots), 1))]), (F.col("cell") + 1).cast("int"))
    dealt = dealt.withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), parts))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        data, queries = indexed(group["vec_id"].to_numpy(np.int64), matrix(group["v"]), every, k)
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(data)], "queries": [pickle.dumps(queries) if queries else None], "n_queries": [len(queries["ids"]) if queries else 0]})

    trees = cut_lineage(dealt.groupBy("block").applyInPandas(build, "block long, data binary, queries binary, n_queries long"), "cover-trees")
    n_blocks, n_queries = trees.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_queries"), F.lit(0))).first()
    data_tiles, query_tiles = -(-max(n_blocks, 1) // TILE_BLOCKS), -(-max(int(n_queries), 1) // tile_queries)
    spot = lambda n, salt: F.pmod(F.xxhash64("block", F.lit(salt)), F.lit(n))
    every_tile = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = trees.select("data", spot(data_tiles, "data").alias("s"), every_tile(query_tiles).alias("t"))
    asked = trees.filter("n_queries > 0").select("queries", spot(query_tiles, "queries").alias("t"), every_tile(data_tiles).alias("s"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for ids, points, best in searched([pickle.loads(x) for x in left["data"]], [pickle.loads(x) for x in right["queries"]], k):
            for i, (q, point) in enumerate(zip(ids, points)):
                rows.append(pd.DataFrame({"query_id": q, "mark": pd.util.hash_array(point).sum(dtype=np.uint64).astype(np.int64), "vec_id": best.found[i], "score": best.score[i]}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []}, dtype=np.int64)

    found = data.groupBy("s", "t").cogroup(asked.groupBy("s", "t")).applyInPandas(search, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
