"""Source mixing and top-k search against plain versions; the registered queries against their SQL."""

import random
from collections import defaultdict

import pytest
from compare import compare, connect
from conftest import edge_rows

import __spark_entry__ as entry
from confsieve.llm import mixing, queries, topk

FOLDER = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """sizes: source to words. Shares by weight, stops at three times, hands on what is over until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    goal, open_ = {s: total * weight[s] / sum(weight.values()) for s in names}, set(names)
    while over := [s for s in open_ if goal[s] > 3 * sizes[s] + 1e-9]:
        rest = sum(goal[s] - 3 * sizes[s] for s in over)
        open_ -= set(over)
        for s in over:
            goal[s] = 3 * sizes[s]
        for s in open_:
            goal[s] += rest * weight[s] / sum(weight[x] for x in open_)
    return goal


def words(text):
    return len((text or "").encode().split())


def check_mix(rows, mix):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    goal, taken = plain_targets(sizes), defaultdict(int)
    name = lambda src: None if src == "~" else src[1:]
    assert len(mix) == len(rows)
    for r in mix:
        assert r.source_size == sizes[name(r.src)] and abs(r.target - goal[name(r.src)]) <= 1e-6 * (goal[name(r.src)] + 1) and 0 <= r.copies <= 3
        taken[name(r.src)] += r.copies * r.size
    return goal, taken


def test_mix_meets_targets(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 2, 3, 5, 8, 13, 40, 200, 900])), None, None if i % 50 == 0 else rnd.choice(["a", "B", "é", "c", "c", "c", "c"]), 0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    mix = mixing.mix(docs).collect()
    goal, taken = check_mix(rows, mix)
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)
    assert sorted(mix, key=str) == sorted(mixing.mix(docs.repartition(2)).collect(), key=str)
    assert mixing.mixed(docs).count() == sum(r.copies for r in mix)


def test_rates_are_tilted_exponentially(spark):
    import math

    rows = [(i, " ".join(["w"] * (1 + i % 20)), None, "a" if i % 2 else "b", 0) for i in range(400)]
    mix = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    for source in ("=a", "=b"):
        slopes = [math.log(r.rate) / r.size for r in mix if r.src == source and 0 < r.rate < 3]
        assert max(slopes) - min(slopes) < 1e-6


def test_mix_edges(clashing, empty):
    rows = edge_rows()
    check_mix(rows, mixing.mix(clashing).collect())
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns and mixed.filter("doc_id in (7, 8, 9)").count() == 3
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def plain_top(rows, k=10, every=100):
    import math

    good = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def vectors(n=700, dim=6):
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)]) for i in range(n)]
    rows += [(n + i, [0.5] * dim) for i in range(150)]  # one vector many times
    return rows + [(2000, None), (2100, [None] * dim), (2200, [float("nan")] * dim), (2300, [float("inf")] + [0.0] * 5), (None, [1.0] * dim), (2400, [1.0, 2.0]), (5, rows[5][1])]


@pytest.mark.parametrize("block,tile", [(2048, 4096), (100, 3)])
def test_search_is_exact(spark, block, tile):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(table, block=block, tile_queries=tile).collect())
    assert got == plain_top(rows)


def test_search_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, score string, rank string"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1, "x", "y")], schema)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0], 1, "x", "y"), (3, [1.0], 1, "x", "y"), (2, [1.0], 1, "x", "y")], schema)).orderBy("rank").collect()] == [(0, 1, 2, 1 << 20), (0, 2, 3, 1 << 20)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
