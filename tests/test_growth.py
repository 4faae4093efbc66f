"""Work that must not grow faster than the rows: folds over sparse numbers, groups of alike lines, keyword rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from confsieve.catalog.rules import RULES
from confsieve.operators import cluster, folds, rules, similarity
from confsieve.session import cut_lineage


def test_states_that_meet_are_carried_on_as_one():
    handled = []

    def step(w, event):
        handled.append(len(w))
        return folds.weight_step_numpy(w, event)

    targets = [random.Random(3).choice([2000, 10000]) for _ in range(1000)]
    starts, values = folds._joint_step([{"_starts": [], "target": targets}], step, ["target"])
    state = np.arange(folds.SCALE + 1)
    for t in targets:
        state = folds.weight_step_numpy(state, (t,))
    assert [values[np.searchsorted(starts, s, side="right") - 1] for s in range(0, folds.SCALE + 1, 7)] == state[::7].tolist()
    assert sum(handled) < 0.05 * len(targets) * (folds.SCALE + 1)


def test_numbers_without_gaps(spark):
    rows = spark.createDataFrame([(k * (1 << 20), k % 2 == 0) for k in range(500)] + [(1 << 20, False)] * 3, "at long, good boolean").repartition(7)
    numbered, n = folds.in_order(rows, "at", F.col("good"))
    got = sorted(tuple(r) for r in numbered.select("seq", "at", "good").collect())
    assert n == 503 and [r[0] for r in got] == list(range(503)) and [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_grams_meet_their_frequencies_both_ways(spark):
    """Sent to all tasks or joined, the vectors are the same; grams longer than eight bytes and lines without a word included."""
    lines = ["set \U0001d54f\U0001d550\U0001d551\U0001d552 up", "Set up", "", None, "  ", "a", "ab " * 40]
    nodes = spark.createDataFrame([(k, "v", t, k + 1) for k, t in enumerate(lines)], "node long, vendor string, raw string, copies long")

    def vectors(held):
        return {r.node: [(i, round(w, 12)) for i, w in zip(r.ids, r.weights, strict=True)] for r in similarity.unit_vectors(nodes, "node", "vendor", "raw", "copies", held).collect()}

    found = vectors(1 << 20)
    assert found == vectors(0) and set(found) == {0, 1, 5, 6}
    assert all(abs(sum(w * w for _, w in v) - 1) < 1e-9 for v in found.values())


def test_only_openers_are_sent_to_all_tasks(spark, monkeypatch):
    """Hundreds of alike lines: no line but the openers is compared with the rest, and no candidates are listed."""
    sent, real = [], cluster.hold
    monkeypatch.setattr(cluster, "hold", lambda *a: sent.append(real(*a)) or sent[-1])
    lines = spark.createDataFrame([(k, "v", f"set interface address alpha beta gamma number {k}") for k in range(300)] + [(900, None, "x y"), (901, "v", None)], "seq long, vendor string, raw string")
    got = {r.seq: r.seed for r in cluster.cluster_lines(lines, "vendor", "raw", "seq", 5000).collect()}
    assert set(got) == set(range(300)) and all(got[s] == s <= k for k, s in got.items())
    openers = set(got.values())
    assert len(openers) < 300 and sorted(k for held in sent for h in held.values() for k in h.keys.tolist()) == sorted(openers)


def random_vectors(n, grams, seed):
    """Unit vectors over few frequent and many rare grams: keys, starts, ids, weights, and the same as a table."""
    rnd = np.random.default_rng(seed)
    rows = [np.unique((rnd.random(rnd.integers(3, 40)) ** 3 * grams).astype(np.int64)) for _ in range(n)]
    weights = [(lambda w: w / np.sqrt((w * w).sum()))(rnd.random(len(r)) + 0.1) for r in rows]
    table, lengths = np.zeros((n, grams)), np.array([len(r) for r in rows])
    for k, (r, w) in enumerate(zip(rows, weights, strict=True)):
        table[k, r] = w
    return rnd.permutation(n) * 3, np.cumsum(lengths) - lengths, np.concatenate(rows) * 7, np.concatenate(weights), table


def test_cosines_by_columns_and_lists(monkeypatch):
    """Every cosine with the held vectors, whatever share of the grams are columns and however few rows are met at a time."""
    keys, starts, ids, weights, table = random_vectors(90, 150, 1)
    _, more, others, heavy, asked = random_vectors(70, 200, 2)
    want = asked[:, :150] @ table[np.argsort(keys)].T
    for common, cells, met in ((0.05, 10**6, 10**6), (2.0, 10**6, 200), (0.0, 10**6, 1), (0.0, 900, 500)):
        monkeypatch.setattr(similarity, "COMMON", common), monkeypatch.setattr(similarity, "CELLS", cells), monkeypatch.setattr(similarity, "MET", met)
        held = similarity.Held(keys, starts, ids, weights)
        got = list(held.cosines(more, others, heavy))
        assert [lo for lo, _ in got] == np.cumsum([0, *(len(c) for _, c in got[:-1])]).tolist()
        assert held.keys.tolist() == sorted(keys) and np.allclose(np.vstack([c for _, c in got]), want, atol=1e-12)


def test_bounds_rule_out_no_opener(monkeypatch):
    """The earliest vector at or above the threshold, and the greedy run, by a few columns of grouped grams or many."""
    keys, starts, ids, weights, table = random_vectors(300, 120, 3)
    _, more, others, heavy, asked = random_vectors(80, 150, 4)
    table = table[np.argsort(keys)]
    near = asked[:, :120] @ table.T >= similarity.THRESHOLD
    seed = []
    for k, row in enumerate(table @ table.T >= similarity.THRESHOLD):
        seed.append(next((i for i in range(k) if seed[i] == i and row[i]), k))
    assert 20 < len(set(seed)) < 280
    for groups, met in ((0.1, 10**6), (8, 10**6), (64, 700)):
        monkeypatch.setattr(similarity, "GROUPS", groups), monkeypatch.setattr(similarity, "MET", met)
        held = similarity.Held(keys, starts, ids, weights)
        assert held.first(more, others, heavy).tolist() == np.where(near.any(axis=1), near.argmax(axis=1), -1).tolist()
        assert held.greedy().tolist() == seed


def test_grams_of_any_alphabet():
    rnd = random.Random(5)
    letters = ["ab ", "aé’ñ ", "中文字迿￮ a ", "a\U0001d54f ", "a\0b ", "".join(map(chr, range(0x4E00, 0x9000))) + " "]
    for _ in range(60):
        texts = [" ".join("".join(rnd.choices(rnd.choice(letters), k=rnd.randrange(60))).split()) for _ in range(rnd.randrange(9))]
        rows, starts, ids, counts = similarity.count_grams(texts)
        ends = np.append(starts, len(ids))[1:].tolist()
        got = {r: list(zip(ids[a:b].tolist(), counts[a:b].tolist(), strict=True)) for r, a, b in zip(rows.tolist(), starts.tolist(), ends, strict=True)}
        assert got == {k: similarity._counted_one_by_one(t) for k, t in enumerate(texts) if t}


def test_batches_write_openers_and_who_is_taken(spark, monkeypatch):
    """The lines are stored by their counts and written anew only when many are taken; groups are the same either way."""
    written, real = [], cluster.cut_lineage
    monkeypatch.setattr(cluster, "cut_lineage", lambda df, label="": written.append((label, df.columns)) or real(df, label))
    texts = [f"set unit {chr(97 + k % 26) * 3}{chr(97 + k // 26) * 4} to {k * 7919 % 1000}" for k in range(300)]
    lines = spark.createDataFrame([(k, "v" if k % 3 else "w", t) for k, t in enumerate(texts)], "seq long, vendor string, raw string")
    found = []
    for spent in (0, 1 << 20):
        written.clear()
        found.append({r.seq: r.seed for r in cluster.cluster_lines(lines, "vendor", "raw", "seq", 800, spent).collect()})
        labels = [label for label, _ in written]
        assert all(columns == ["node", "seed"] for label, columns in written if label == "cluster-met") and labels.count("cluster-met") >= 4
        rewritten = labels.count("cluster-left")
    assert found[0] == found[1] and len(found[0]) == 300 and rewritten < labels.count("cluster-met") and "cluster-vectors" not in labels


FACTS = "device_id long, vendor string, field_path string, value_bool boolean, value_int long, value_str string, explicit boolean, confidence double, src_line int, src_raw string, method string, at long"


def evidence_rows(spark):
    rnd, acl = random.Random(4), "access_control.acl_rules[].is_any_any_permit"
    states = [("management.telnet.enabled", None, None, "enabled"), ("management.telnet.enabled", None, None, "disabled"), ("management.ssh.protocol_version", None, 2, None), (acl, True, None, None), (acl, False, None, None), (acl, None, None, None)]
    rows = [(k % 40, "cisco_ios" if k % 3 else None, *rnd.choice(states), rnd.random() < 0.8, rnd.choice([0.5, 0.8, 1.0]), None, None, "m", k) for k in range(150)]
    return rules.pack_evidence(spark.createDataFrame(rows, FACTS), ["device_id", "vendor"], ["at"])


def test_two_rule_versions_meet_without_the_catalogue_in_the_row(spark, monkeypatch):
    """Rules written out one by one decide as the catalogue in the row does; ids of one version only, or twice, included."""
    used = [r for r in RULES if r["field_path"].startswith(("management.", "access_control.acl"))]
    before = [*used[:-1], {**used[0], "expected": "enabled"}, {**used[1], "id": "OLD-1"}]
    after = [{**r, "minimum_confidence": 0.9} if k % 2 else {**r, "operator": {"list_none_true": "list_all_true"}.get(r["operator"], r["operator"])} for k, r in enumerate([*used[1:], used[0], used[0]])]
    packed = cut_lineage(evidence_rows(spark))
    with monkeypatch.context() as m:
        m.setattr(rules, "UNROLLED", 0)
        want = sorted(map(str, rules.re_audit(packed, ["device_id"], before, after).collect()))
    with monkeypatch.context() as m:
        m.setattr(rules, "findings_in_row", None)
        assert sorted(map(str, rules.re_audit(packed, ["device_id"], before, after).collect())) == want and want


def test_confirmed_mappings_in_the_row(spark):
    """As on long evidence: scalars and list items give way, devices without evidence are added, null keys meet nobody."""
    packed = cut_lineage(evidence_rows(spark))
    fields = "device_id long, vendor string, field_path string, value_bool boolean, value_int long, value_str string"
    acl = "access_control.acl_rules[].is_any_any_permit"
    confirmed = spark.createDataFrame([(k, "cisco_ios", "management.telnet.enabled", None, None, "disabled") for k in (1, 2, 5, 900)] + [(2, "cisco_ios", acl, True, None, None), (5, "cisco_ios", "a.new.field", None, 7, None)], fields)
    long = packed.select("device_id", "vendor", F.explode(F.concat("facts", "acl_items")).alias("f")).select("device_id", "vendor", "f.*")
    want = rules.pack_evidence(rules.override_evidence(long, confirmed, ["device_id", "vendor"]), ["device_id", "vendor"], ["confidence"])
    got = rules.override_in_row(packed, confirmed, ["device_id", "vendor"])

    def plain(df):
        return sorted(str((r.device_id, r.vendor, sorted(map(str, r.facts)), sorted(map(str, r.acl_items)))) for r in df.collect())

    assert plain(got) == plain(want)
    assert sorted({r.device_id: sorted(r.confirmed_fields) for r in got.where("size(confirmed_fields) > 0").collect()}.items()) == [(1, ["management.telnet.enabled"]), (2, [acl, "management.telnet.enabled"]), (5, ["a.new.field", "management.telnet.enabled"]), (900, ["management.telnet.enabled"])]
