"""Spelling variants, quality rules by host lines, ranked search: against plain Python over the same rows."""

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SCHEMA, edge_rows
from pyspark.sql import functions as F

from confsieve.llm import host_lines, lexical, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    form, out = {}, []
    for w, n in words.items():
        others = [(-words[o], o) for o in words if o != w and near(w, o)]
        if others and -min(others)[0] >= 10 * n:
            form[w] = min(others)[1]
        out.append((w, n, len(others)))
    rows = []
    for w, n, k in out:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, n, k, form.get(w), words[form[w]] if w in form else None, root))
    return sorted(rows)


def spelled(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def word_rows(seed=1):
    """Few letters, so that words have many near words; some words are far more frequent than others."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(120)]
    rows = []
    for i in range(60):
        words = [rnd.choice(base) if rnd.random() < 0.5 else base[0] if rnd.random() < 0.7 else base[1] + rnd.choice("ab") for _ in range(40)]
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words), "en", "s", 1))
    return rows


@pytest.mark.parametrize("block", [50_000, 3])
def test_variants_equal_plain(spark, block):
    rows = word_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert spelled(spelling.variants(docs, block=block)) == plain_variants(plain_words(rows))


def test_variants_on_edge_rows(clashing, empty):
    assert spelled(spelling.variants(clashing)) == plain_variants(plain_words(edge_rows()))
    assert spelled(spelling.variants(empty)) == []


def test_composition_finds_each_pair_once():
    rnd = random.Random(4)
    for _ in range(40):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 50))})
        got = [frozenset(p) for p in spelling.OneEdit(spelling.Acceptor(words)).pairs()]
        assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}


def test_acceptor_is_minimal_and_takes_very_long_words():
    assert len(spelling.Acceptor(["abcx", "abdx", "abex"]).arcs) == 5
    long = "ab" * 20_000
    assert list(spelling.OneEdit(spelling.Acceptor(sorted([long, long + "a"])), sys.maxsize).pairs())


def test_chain_of_forms_ends_at_its_last(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {f"w{i}": "w9" for i in range(9)} | {"x": "w9"}


def plain_quality(rows, min_docs, percent):
    key = lambda line: line.strip(BLANK).translate(UPPER)
    split = lambda s: [w for w in re.split("[\x20\x09-\x0d]+", s) if w]
    held, hosts = defaultdict(set), Counter(r[3] for r in rows)
    for i, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if split(line):
                held[r[3], key(line)].add(i)
    over = {k for k, v in held.items() if len(v) >= min_docs and 100 * len(v) > percent * hosts[k[0]]}
    out = []
    for r in rows:
        text = r[1] or ""
        words, seen, doubled = split(text), set(), 0
        lines = [x for x in text.split("\n") if split(x)]
        for line in lines:
            doubled += line in seen
            seen.add(line)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times = Counter(windows)
        repeated = len({i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)})
        lost = [x for x in lines if (r[3], key(x)) in over]
        lost_words, lost_chars = sum(len(split(x)) for x in lost), sum(len("".join(split(x))) for x in lost)
        chars = len("".join(words))
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        kept = not failed and not (2 * lost_chars > chars or len(words) - lost_words < 20)
        out.append((r[0], len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), doubled, repeated, failed, kept))
    return sorted(out, key=str)


def host_rows():
    rnd = random.Random(9)
    line = lambda: " ".join(rnd.choice("red green blue #one two* three |four five".split()) + str(rnd.randint(0, 99)) for _ in range(9))
    footer, menu = line(), line()
    rows = []
    for i in range(90):
        own = [line() for _ in range(rnd.choice([1, 2, 4]))]
        rows.append((i, "\n".join(own + ([footer, "  " + footer.upper()] if i % 2 else []) + ([menu] * 3 if i % 3 == 0 else []) + ["", " "]), "en", "big" if i < 60 else None, 1))
    return rows


@pytest.mark.parametrize("limits", [(5, 1), (20, 40), (1000, 1)])
def test_quality_equals_plain(clashing, spark, limits):
    for rows, docs in ((edge_rows(), clashing), (host_rows(), spark.createDataFrame(host_rows(), SCHEMA).repartition(5))):
        got = host_lines.judged(docs, *limits).drop("lost_lines", "lost_words", "lost_chars").collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_quality(rows, *limits)


def test_cleaned_texts_keep_their_columns(spark):
    rows = host_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("mine"), "lines": F.lit(1), "kept": F.lit(2), "doc": F.lit("x")})
    got = host_lines.cleaned(docs, 5, 1)
    assert got.columns == docs.columns
    want = {r[0] for r in plain_quality(rows, 5, 1) if r[-1]}
    texts = {r.doc_id: r.text for r in got.collect()}
    assert set(texts) == want and len(want) > 10
    footer = rows[1][1].split("\n")[-4].lower().strip()
    assert all(footer not in t.lower() for t in texts.values())


def test_quality_of_empty_table(empty):
    assert host_lines.judged(empty).count() == 0 and host_lines.cleaned(empty).count() == 0


def plain_search(docs, items, top=10):
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (s or "").translate(UPPER))
    bags = [(r[0], terms(r[1])) for r in docs]
    bags = [(i, t, Counter(t)) for i, t in bags if t]
    n_docs, n_terms = len(bags), sum(len(t) for _, t, _ in bags)
    df = Counter(w for _, _, c in bags for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, t, c in bags:
            m = 25 + (75 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def searched(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("size", "owners", "sent", "bits"), [(256, 6, 1 << 20, 12), (4, 3, 0, 3), (2, 1, 1 << 20, 12)])
def test_search_equals_plain(spark, size, owners, sent, bits, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BITS", bits)
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.7)) % 200}" for _ in range(4000)] + ["é1", "日本", "X"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))), "en", "s", 1) for i in range(150)]
    docs += [(200 + i, docs[7][1], "en", "s", 1) for i in range(25)] + [(None, docs[7][1], None, None, None), (300, None, None, None, None)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for i in range(9)] + [(20, docs[7][1]), (21, None), (22, ""), (None, "w1 w1 W2"), (23, "nowhere"), (20, docs[7][1])]
    got = lexical.search(spark.createDataFrame(docs, SCHEMA).repartition(6), spark.createDataFrame(items, "item_id long, text string"), size=size, owners=owners, max_sent=sent)
    assert searched(got) == plain_search(docs, items)


def test_search_on_edge_rows(spark, clashing, empty):
    items = [(1, "a line that five documents share, word for word"), (2, "many words"), (3, "É 日本語のテキスト"), (4, "x" * 300_000)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"bundle": F.lit("mine"), "doc_id": F.lit(1)})
    assert searched(lexical.search(clashing, asked)) == plain_search(edge_rows(), items)
    assert searched(lexical.search(empty, asked)) == []
    assert searched(lexical.search(clashing, asked.filter("false"))) == []
