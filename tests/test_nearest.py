"""Nearest entries down the ladder: the same answers at any rung, block and tile, and few candidates where entries resemble the queries."""

import random

import pytest

from confsieve.operators import nearest, similarity


def texts(n, seed):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    entries = texts(60, 1)
    queries = [e + " changed" for e in entries[:25]] + texts(20, 2) + entries[:5] + entries[:5] + ["", "zz"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(queries)], "qid_ long, question string")
    return q, spark.createDataFrame([(i, t) for i, t in enumerate(entries)], "eid_ long, answer string")


def answers(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", [{"ladder": (), "tile": 7}, {"ladder": (0.9, 0.5, 0.2), "block": 3, "tile": 5}])
def test_any_way_gives_the_same_answers(tables, how):
    for find in (similarity.nearest_entries, similarity.token_overlap):
        whole = answers(find(*tables, "qid_", "question", "eid_", "answer"))
        assert answers(find(*tables, "qid_", "question", "eid_", "answer", **how)) == whole and len(whole) == tables[0].count()


def test_few_candidates_for_near_copies(spark, monkeypatch):
    """Hundreds of entries, queries that are near copies: a rung compares a small part of all pairs, and each equal text is asked once."""
    entries = texts(300, 5)
    kb = spark.createDataFrame([(i, t) for i, t in enumerate(entries)], "eid_ long, answer string")
    asked = spark.createDataFrame([(i, entries[i % 50] + " x") for i in range(400)], "qid_ long, question string")
    counted, real = [], nearest.candidates

    def counting(*args):
        found = real(*args)
        counted.append((args[0].count(), found.count()))
        return found

    monkeypatch.setattr(nearest, "candidates", counting)
    got = similarity.nearest_entries(asked, kb, "qid_", "question", "eid_", "answer")
    assert all(r.matched_entry == r.qid_ % 50 for r in got.collect())
    assert counted[0][0] == 50 and sum(pairs for _, pairs in counted) < 0.2 * 50 * 300


def test_scopes_fall_back_to_all_entries(spark):
    kb = spark.createDataFrame([(1, "set ssh version two", "a"), (2, "set ssh version two", "b"), (3, "no telnet here", "b")], "eid_ long, answer string, vendor string")
    q = spark.createDataFrame([(1, "set ssh version two", "b"), (2, "set ssh version two", "c"), (3, "no telnet here", None)], "qid_ long, question string, vendor string")
    got = {r.qid_: r.matched_entry for r in similarity.nearest_entries(q, kb, "qid_", "question", "eid_", "answer", "vendor").collect()}
    assert got == {1: 2, 2: 1, 3: 3}


def test_many_queries_meet_few_entries_where_they_are_stored(spark, monkeypatch):
    """More queries than are worth a list of candidates: the same answers, without candidates or tiles; odd characters included."""
    odd = ["\U0001d54f\U0001d550\U0001d551\U0001d552 up", "a\0b cd", "  ", "éa ça", "x"]
    entries = texts(60, 1) + odd
    kb = spark.createDataFrame([(i, t, "abc"[i % 2]) for i, t in enumerate(entries)], "eid_ long, answer string, vendor string")
    asked = [(i, t, "abc"[i % 3]) for i, t in enumerate([e + " changed" for e in entries] + texts(40, 2) + entries + odd)] + [(9000, None, None)]
    q = spark.createDataFrame(asked, "qid_ long, question string, vendor string")
    plain = [answers(find(q, kb, "qid_", "question", "eid_", "answer", ladder=())) for find in (similarity.nearest_entries, similarity.token_overlap)]
    scoped = answers(similarity.nearest_entries(q, kb, "qid_", "question", "eid_", "answer", "vendor", ladder=()))
    many = q.unionByName(spark.range(10_000, 11_200).selectExpr("id AS qid_", "concat('zz', id) AS question", "'c' AS vendor"))

    def unwanted(*args):
        raise AssertionError("candidates were listed")

    monkeypatch.setattr(nearest, "postings", unwanted)
    monkeypatch.setattr(nearest, "MET", 500)
    for find, want in zip((similarity.nearest_entries, similarity.token_overlap), plain, strict=True):
        got = answers(find(many, kb, "qid_", "question", "eid_", "answer"))
        assert len(got) == many.count() and [r for r in got if r[0] < 10_000] == want
    assert [r for r in answers(similarity.nearest_entries(many, kb, "qid_", "question", "eid_", "answer", "vendor")) if r[0] < 10_000] == scoped
