"""Line dedup, fingerprints, SimHash: against plain Python over the same rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import edge_rows

from confsieve.llm import line_dedup, minhash, simhash
from confsieve.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def plain_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(BLANK).translate(UPPER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(r[0])
    keeper = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_lines_equal_plain(clashing, sent):
    got = line_dedup.drop_shared_lines(clashing, max_filter_bytes=sent)
    assert got.columns.count("n_lines") == 1
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == plain_lines(edge_rows())


def test_line_filter_misses_no_repeat(spark):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abcdef ") for _ in range(60)) for _ in range(300)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(20)), None, None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = line_dedup.drop_shared_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == plain_lines(rows)


def test_empty_tables(empty):
    assert line_dedup.drop_shared_lines(empty).count() == 0
    assert minhash.edited(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


def shingles(text, n=5):
    words = text.strip(BLANK).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_edited_texts_and_likeness(spark, edge):
    rows = {r[0]: r for r in edge_rows()}
    ids = sorted(rows, key=lambda x: (x is not None, x))
    got = minhash.edited(edge).collect()
    assert len(got) == len(edge_rows())
    prints = defaultdict(set)
    for r in got:
        text, after = rows[r.doc_id][1] or "", rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]][1] or ""
        k = len(text) // 4
        assert r.n_chars == len(text) and r.text_edited == text[: len(text) - k] + after[:k]
        prints[text.strip(BLANK)].add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({x for v in prints.values() for x in v}) == len(prints)


def test_likeness_estimates_jaccard(spark):
    rnd = random.Random(5)
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for n in (3, 40, 600):
            a = [str(rnd.random()) for _ in range(n)]
            b = a[: int(n * share)] + [str(rnd.random()) for _ in range(n - int(n * share))]
            pairs.append((" ".join(a), " ".join(b)))
    df = minhash.fingerprints(minhash.fingerprints(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
    from pyspark.sql import functions as F

    off = [r.like - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b)) for r in df.withColumn("like", minhash.likeness(F.col("fa"), F.col("fb"))).collect()]
    assert max(map(abs, off)) < 0.13 and abs(np.mean(off)) < 0.03


def test_fingerprints_use_no_python(spark, edge):
    plan = minhash.edited(edge)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_groups_equal_plain(clashing):
    rows = edge_rows()
    prints = [plain_simhash(r[1]) for r in rows]
    groups = plain_groups(prints)
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in set(groups)}
    want = sorted(((r[0], p, smallest[g]) for r, p, g in zip(rows, prints, groups)), key=str)
    got = simhash.near_duplicates(clashing)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()), key=str) == want
    kept = sorted(r.doc_id for r in simhash.deduplicated(clashing).filter("doc_id is not null").collect())
    assert kept == sorted(x for x in smallest.values() if x is not None)


def planted_prints():
    rng = np.random.default_rng(2)
    prints = []
    for centre in rng.integers(0, 2**63, 12):
        for _ in range(30):
            x = int(centre)
            for b in rng.integers(0, 63, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.append(x)
    prints += [(int(x) & ~0xFFFF) | 0x1234 for x in rng.integers(0, 2**63, 200)]  # one value of a block for many
    return sorted(set(prints))


@pytest.mark.parametrize("wide_from,part_rows", [(1 << 40, 1024), (1 << 40, 20), (0, 1024), (0, 20)])
def test_no_link_is_lost(spark, wide_from, part_rows):
    prints = planted_prints()
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(5)
    roots = {r.node: r.root for r in components(simhash.links(nodes, 3, wide_from, part_rows)).collect()}
    got, want = [roots.get(p, p) for p in prints], plain_groups(prints)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_thresholds_add_up():
    near = np.random.default_rng(1).random((50, 4, 4)).astype(np.float32) * 1000
    assert ((simhash.allocate(near, 16) + 1).sum(axis=1) == 4).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4000 + i) for i in range(100)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = lambda x: roots.get(x, x)
    assert {root(i) for i in range(61)} == {0} and {root(1000 + i) for i in range(200)} == {1000} and root(5000) == root(4050) == 4000


def test_digest_matches_hashlib(spark, edge):
    assert hashlib.sha256(b"").hexdigest() == line_dedup.drop_shared_lines(edge).filter("doc_id = 7").selectExpr("sha2(text, 256) as d").first().d


def test_near_copies_leave_one_row_of_each_group_where_ids_repeat(spark):
    """Id 1 has a text near to no other and one near document 2: one row of each group stays."""
    long = " ".join(f"word{i}" for i in range(200))
    other = " ".join(f"else{i * 7}" for i in range(200))
    for lone, shared in ((other, long), (long, other)):
        docs = spark.createDataFrame([(1, lone), (1, shared), (2, shared), (3, shared), (None, lone)], "doc_id long, text string")
        got = sorted((r.doc_id or 0, r.text) for r in simhash.deduplicated(docs).collect())
        assert got == sorted([(0, lone), (1, lone), (1, shared)])


def test_fingerprints_pass_over_clashing_columns(edge, clashing):
    def rows(df):
        return sorted((tuple(str(x) for x in r) for r in minhash.edited(df).select("doc_id", "n_chars", "fingerprint", "edited_fingerprint", "next_fingerprint").collect()))

    assert rows(clashing) == rows(edge)
