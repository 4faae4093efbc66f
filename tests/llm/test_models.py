"""Toxicity, language identification, LM scores: held-out accuracy and plain versions."""

import random
import zlib

import numpy as np
import pytest

from confsieve.llm import langid, lm_score, toxicity
from confsieve.llm.subwords import ngrams, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=600, seed=4):
    """Texts in three invented languages; toxic ones hold two forms of bad words, which never share a whole word between halves."""
    rnd = random.Random(seed)
    syllables = {"xa": ["ka", "to", "mi", "ru"], "yb": ["sch", "ung", "ent", "ber"], "zc": ["eau", "oi", "que", "ment"]}
    rows, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), f"gromful{rnd.choice('abcdefgh')}{rnd.choice('stuvw')}")
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, int(bad)))
    return rows, labels


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def taught(spark):
    rows, labels = corpus()
    return rows, spark.createDataFrame(rows, DOCS).repartition(4), dict(labels), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out(spark, taught):
    rows, docs, toxic, labels = taught
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == out(r.doc_id) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    unseen = toxicity.score(spark.createDataFrame([(1, "ka mika gromfulzz toru", None, None, 0), (2, "kato miru toka", None, None, 0)], DOCS), toxicity.fit(docs, labels)).orderBy("doc_id").collect()
    assert unseen[0].score > unseen[1].score


def test_toxicity_ignores_held_out_labels(spark, taught):
    rows, docs, toxic, labels = taught
    lied = spark.createDataFrame([(i, 1 - t if out(i) else t) for i, t in toxic.items()], "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit(docs, labels).weight, toxicity.fit(docs, lied).weight)


def test_toxicity_edges(clashing, empty, taught):
    _, docs, _, labels = taught
    model = toxicity.fit(docs, labels)
    got = toxicity.score(clashing, model)
    assert got.columns.count("score") == 1 and got.count() == clashing.count()
    assert all(abs(r.score - model.base) < 1e-12 for r in got.filter("doc_id in (7, 8, 9)").collect())
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(docs, labels.filter("false"))
    assert {(r.score, r.predicted) for r in toxicity.score(docs, nothing).collect()} == {(0.0, 0)}
    one_class = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert all(r.predicted == 1 for r in toxicity.score(docs, one_class).collect())


def test_language_on_held_out(spark, taught):
    rows, docs, _, _ = taught
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs.drop("lang", "source"), model).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if out(r[0])]) > 0.98
    flipped = spark.createDataFrame([(i, t, "xa" if out(i) else lang, s, n) for i, t, lang, s, n in rows], DOCS)
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(flipped)).collect()} == {k: v.lang_pred for k, v in got.items()}


def test_language_backs_off(spark, taught):
    model = langid.fit(taught[1])
    unseen = model.word_rows(["schungschungschungber", "ququmentmentoioi", "77"])
    assert model.langs[unseen[0, :-1].argmax()] == "yb" and model.langs[unseen[1, :-1].argmax()] == "zc" and unseen[2].tolist() == [0, 0, 0, 0]
    word = next(iter(model.words))
    assert np.array_equal(model.word_rows([word.upper() + "!"])[0, :-1], model.word_logs[model.words[word]])


def test_language_edges(clashing, empty, taught):
    model = langid.fit(taught[1])
    got = {r.doc_id: r for r in langid.predict(clashing, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (7, 8, 9, 17)) and got[14].lang_pred in model.langs
    assert langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(clashing, langid.fit(empty)).collect()} == {"und"}
    assert langid.fit(clashing).langs == sorted({"en", "fr", "de", "ja"} & set(langid.fit(clashing).langs))


def test_ngrams_are_those_of_the_word():
    hashes, owner, order = ngrams(["abc", "ab", "é"], 1, 3, whole=True)
    assert [int((owner[order == n] == 0).sum()) for n in (0, 1, 2, 3)] == [1, 5, 4, 3]
    first, second = (set(hashes[(owner == k) & (order == 3)].tolist()) for k in (0, 1))
    assert len(first & second) == 1  # "<ab"


def test_windows_cover_every_word():
    counts = np.array([0, 1, 8, 9, 30])
    start, end, document = windows(counts, 8, 4)
    assert set(document.tolist()) == set(range(5))
    assert set().union(*[range(a, b) for a, b in zip(start, end)]) == set(range(int(counts.sum())))


def test_repeats_are_judged_in_each_window():
    rng = np.random.default_rng(2)
    rows = np.stack([rng.standard_normal(6), rng.integers(1, 5, 6)], axis=1).astype(float)
    rows[0] = 9.0, 3.0
    texts = [[0], [0] * 8, [0] * 30, [1, 2, 3, 0, 4, 5, 1, 2, 0, 4, 4, 4, 4], [], *[rng.integers(0, 6, rng.integers(1, 40)).tolist() for _ in range(60)]]
    numbers, counts = np.array([w for t in texts for w in t]), np.array([len(t) for t in texts])
    mean, *_ = toxicity.worst_windows(numbers, counts, rows, toxicity.earlier(numbers, counts))

    def plain(text):
        parts = [set(text[a : a + toxicity.WINDOW]) for a in range(0, max(len(text) - toxicity.WINDOW, 0) + toxicity.STEP, toxicity.STEP)]
        return max((sum(rows[w, 0] for w in p) / max(sum(rows[w, 1] for w in p), 1) for p in parts if p or not text), default=0)

    assert np.allclose(mean, [plain(t) for t in texts])
    assert np.allclose(mean[:3], 3.0)


def test_a_toxic_word_said_often_is_as_toxic_as_said_once(spark, taught):
    _, docs, _, labels = taught
    model = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(n, " ".join(["gromfulas"] * n)) for n in (1, 8, 50)], "doc_id long, text string")
    scores = [r.score for r in toxicity.score(asked, model).collect()]
    assert max(scores) - min(scores) < 1e-9 and min(scores) > toxicity.THRESHOLD


def plain_log_prob(params, ids, text):
    line = [lm_score.PAD] * 2 + [ids[w] for w in lm_score.words_of(text)] + [lm_score.PAD] * 2
    total = 0.0
    for t in range(2, len(line) - 2):
        h = np.tanh(params["hidden"] + sum(params["places"][k][line[t + o]] for k, o in enumerate(lm_score.OFFSETS)))
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        c, m = divmod(line[t], lm_score.WIDE)
        total += np.log(soft(h @ params["classes"] + params["class_bias"])[c]) + np.log(soft(h @ params["words"][c] + params["word_bias"][c])[m])
    return total


def test_lm_scores_equal_plain_and_learn(spark, taught):
    rows, docs, _, _ = taught
    frequent, params = lm_score.fit(docs)
    got = {r.doc_id: r for r in lm_score.score(docs, frequent, params).collect()}
    ids = lm_score.Ids(frequent)
    for i, text, *_ in rows[:25]:
        assert got[i].n_words == len(text.split()) and abs(got[i].log_prob - plain_log_prob(params, ids, text.encode())) < 1e-2
    before = lm_score.score(docs, *lm_score.fit(docs, rounds=0)).agg({"log_prob": "sum"}).first()[0]
    assert sum(r.log_prob for r in got.values()) > before


def test_lm_words_of_a_bucket_share_its_probability(spark, monkeypatch):
    """More words than ids: the plain version multiplies in the word's share of its bucket; junk scores below words of the corpus."""
    monkeypatch.setattr(lm_score, "KNOWN", 50)
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 9) for k in range(3000)], k=60)) + ".") for i in range(200)] + [(900, "w800 " * 40), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = lm_score.word_counts(docs)
    frequent, params = lm_score.fit(docs, counted=counted)
    ids, n, rest = lm_score.Ids(frequent), {bytes(r.word): r.n for r in counted.collect()}, {}
    for w, times in n.items():
        rest[ids[w]] = rest.get(ids[w], 1) + times
    asked = docs.union(spark.createDataFrame([(902, "qzx" + " vbnm w2999")], docs.schema))
    got = {r.doc_id: r for r in lm_score.score(asked, frequent, params, counted).collect()}

    def share(w):
        w = w.strip(lm_score.MARKS) or w
        return np.log(n.get(w, 1) / rest.get(ids[w], 1)) if ids[w] >= lm_score.FREQUENT else 0.0

    for i, text in rows[:20] + rows[200:] + [(902, "qzx vbnm w2999")]:
        said = lm_score.words_of((text or "").encode())
        want = plain_log_prob(params, ids, (text or "").encode()) + sum(share(w) for w in said)
        assert got[i].n_words == len(said) and abs(got[i].log_prob - want) < 1e-2
        assert got[i].mean_log_prob == (got[i].log_prob / len(said) if said else None)
    assert any(share(w.encode()) < -1 for w in words)


def test_lm_trains_on_every_position(spark, monkeypatch):
    texts = [b" ".join(b"w%d" % (i * k % 97) for k in range(50)) for i in range(1, 20)]
    line, at, counts = lm_score.laid_out(lm_score.Ids([b"w1", b"w2"]), texts)
    rounds = []
    monkeypatch.setattr(lm_score, "train_round", lambda docs, frequent, params, part: rounds.append(part) or params)
    lm_score.fit(spark.createDataFrame([(t.decode(),) for t in texts], "text string"))
    trained = np.concatenate([lm_score.chosen(line, at, counts, part) for part in rounds])
    assert np.array_equal(np.sort(trained), at)


def test_lm_words_of_a_slice_are_told_as_one_by_one():
    rnd = random.Random(3)
    texts = [None, b"", b" \t\n\r\x0b\x0c ", b" one  One\nTWO ", b"one"] + [bytes(rnd.randrange(256) for _ in range(rnd.randrange(40))) for _ in range(300)] + [bytes([65, c, 66]) for c in range(256)]
    for some in (texts, texts[:3], []):
        places, counts, words = lm_score.words_told(some)
        want = [lm_score.words_of(t) for t in some]
        said = [w for ws in want for w in ws]
        assert counts.tolist() == [len(ws) for ws in want] and [words[i] for i in places] == said and words == list(dict.fromkeys(said))


def test_lm_encoding_looks_up_a_word_once_a_slice():
    """CPU of the ids: not a lookup for each time a word is said."""
    asked = []

    class Asked(lm_score.Codes):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    codes = Asked([b"ab"], {b"ef": 0.5}, np.zeros(lm_score.IDS - lm_score.FREQUENT))
    ids, counts, shares, rare = codes.encode([b"ab cd. ef " * 500, None, b"cd AB"])
    assert sorted(asked) == [b"ab", b"cd", b"cd.", b"ef"]
    cd, ef = (lm_score.Ids([b"ab"])[w] for w in (b"cd", b"ef"))
    assert ids.tolist() == [0, cd, ef] * 500 + [cd, 0] and counts.tolist() == [1500, 0, 2] and shares.tolist() == [250.0, 0, 0]
    times = [sum(r["times"] for r in rs if r["word"] == b"cd") for rs in rare.to_pylist()]
    assert times == [500, 0, 1]


def test_lm_step_equals_plain():
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 90, 15)) for _ in range(12)]
    line, at, _ = lm_score.laid_out(lm_score.Ids([b"w%d" % k for k in range(40)]), texts)
    params = lm_score.start(rng.integers(1, 9, lm_score.IDS).astype(float))
    params = {name: (v + 0.2 * rng.standard_normal(v.shape)).astype(np.float32) for name, v in params.items()}
    grads = {name: np.zeros(v.shape) for name, v in params.items()}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    plain = {name: v.astype(float) for name, v in params.items()}
    for t in at:
        h = np.tanh(plain["hidden"] + sum(plain["places"][k][line[t + o]] for k, o in enumerate(lm_score.OFFSETS)))
        c, m = divmod(int(line[t]), lm_score.WIDE)
        of_class, of_word = soft(h @ plain["classes"] + plain["class_bias"]), soft(h @ plain["words"][c] + plain["word_bias"][c])
        of_class[c] -= 1
        of_word[m] -= 1
        back = (plain["classes"] @ of_class + plain["words"][c] @ of_word) * (1 - h * h)
        for name, i, g in [("classes", ..., np.outer(h, of_class)), ("class_bias", ..., of_class), ("words", c, np.outer(h, of_word)), ("word_bias", c, of_word), ("hidden", ..., back)]:
            grads[name][i] += g / len(at)
        for k, o in enumerate(lm_score.OFFSETS):
            grads["places"][k, line[t + o]] += back / len(at)
    want = {name: plain[name] - 0.3 * g / np.sqrt(1e-4 + g * g) for name, g in grads.items()}
    seen = {name: np.full(v.shape, 1e-4, np.float32) for name, v in params.items()}
    lm_score.step(params, seen, line, at, 0.3)
    for name in params:
        assert np.abs(params[name] - want[name]).max() < 1e-4 and np.abs(seen[name] - 1e-4 - grads[name] ** 2).max() < 1e-6, name


def test_lm_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(6)
    line, at, _ = lm_score.placed(rng.integers(0, lm_score.IDS, 2 * lm_score.BATCH + 100).astype(np.int16), np.array([lm_score.BATCH, 0, lm_score.BATCH + 100]))
    params = lm_score.start(rng.integers(1, 9, lm_score.IDS).astype(float))
    parts = [lm_score.log_probabilities(params, line, some) for some in np.array_split(at, 37)]
    assert np.abs(lm_score.log_probabilities(params, line, at) - np.concatenate(parts)).max() < 1e-4


def test_lm_edges(clashing, empty):
    got = {r.doc_id: r for r in lm_score.score(clashing, *lm_score.fit(clashing)).collect()}
    assert all(got[i].n_words == 0 and got[i].log_prob == 0 and got[i].mean_log_prob is None for i in (7, 8, 9)) and got[15].n_words == 140_000
    assert lm_score.score(empty, *lm_score.fit(empty)).count() == 0


def test_word_counts_cover_all_rows(edge):
    from conftest import edge_rows

    want = {}
    for r in edge_rows():
        for w in lm_score.words_of(None if r[1] is None else r[1].encode()):
            bare = w.strip(lm_score.MARKS) or w
            want[bare] = want.get(bare, 0) + 1
    assert {bytes(r.word): r.n for r in lm_score.count_words(edge).collect()} == want


def test_lm_from_written_ids_equals_lm_from_texts(spark, clashing, empty):
    """The registered path: ids written once. Untrained, so that both have the same parameters."""
    counted = lm_score.word_counts(clashing)
    want = lm_score.score(clashing, *lm_score.fit(clashing, rounds=0, counted=counted), counted)
    got = lm_score.pseudo_likelihood(clashing, rounds=0)
    assert "text" not in got.columns and got.columns.count("log_prob") == 1 and "words" in got.columns

    def rows(df):
        return sorted(((r.doc_id, r.n_words, round(r.log_prob, 6), r.mean_log_prob is None) for r in df.collect()), key=str)

    assert rows(got) == rows(want)
    assert lm_score.pseudo_likelihood(clashing).count() == clashing.count()
    assert lm_score.pseudo_likelihood(empty).count() == 0
    assert lm_score.score(empty, *lm_score.fit(empty), lm_score.word_counts(empty)).count() == 0


def test_large_language_takes_no_room_from_small_ones(spark, monkeypatch):
    """One language with ten times the words of twenty others: each keeps its own most frequent words."""
    monkeypatch.setattr(langid, "KEPT", 30)
    rows, rnd = [], np.random.default_rng(5)
    for k in range(21):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(30)]
        for i in range(200 if k == 0 else 12):
            words = ["".join(rnd.choice(letters, 4)) if k == 0 else "".join(letters[j : j + 4]) for j in rnd.integers(0, 26, 30)]
            rows.append((1000 * k + i, " ".join(words), f"l{k}", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.predict(docs.drop("lang"), langid.fit(docs)).select("doc_id", "lang_pred").collect()
    assert all(r.lang_pred == f"l{r.doc_id // 1000}" for r in got)
