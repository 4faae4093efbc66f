"""Operators against brute force on small inputs."""

import hashlib
import hmac
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from confsieve.functions.digest import hmac_sha256
from confsieve.functions.text import char_grams, split_lines
from confsieve.operators import cluster, folds, latest, ledger, remediation, report
from confsieve.session import cut_lineage
from confsieve.sources import configs as src


def grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return Counter(out)


def brute_clusters(rows, threshold=0.55):
    tfs = [grams(t) for _, _, t in rows]
    df = Counter(g for tf in tfs for g in tf)
    n = len(rows)
    vecs = []
    for tf in tfs:
        v = {g: c * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({g: x / norm for g, x in v.items()})
    seed = [None] * n
    for i in range(n):
        if seed[i] is not None:
            continue
        seed[i] = i
        for j in range(i + 1, n):
            if seed[j] is None and rows[i][1] == rows[j][1] and sum(x * vecs[j].get(g, 0) for g, x in vecs[i].items()) >= threshold:
                seed[j] = i
    return {rows[i][0]: rows[seed[i]][0] for i in range(n)}


def test_char_grams(spark):
    got = spark.range(1).select(char_grams(F.lit("Set a x1  set"))).first()[0]
    assert Counter(got) == grams("Set a x1  set")


def test_clusters_equal_the_greedy_run(spark):
    rnd = random.Random(5)
    base = ["set system login retry-options tries 5", "aaa authentication login default group radius", "snmp-agent trap enable", "logging remote level info", "radius host key"]
    rows = []
    for i in range(60):
        words = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = rnd.choice(["alpha", "beta9", "10.0.0.1", "vrf", "mgmt"])
        rows.append((i * 3, rnd.choice(["a", "b"]), " ".join(words)))
    want = brute_clusters(rows)
    lines = spark.createDataFrame(rows, "seq bigint, vendor string, raw string")
    for budget in (10**9, 40):
        got = {r.seq: r.seed for r in cluster.cluster_lines(lines, "vendor", "raw", "seq", budget).collect()}
        assert got == want


def test_folds_equal_step_by_step(spark):
    rnd = random.Random(2)
    events, want = [], {}
    for key, n in (("hot", 3000), ("small", 40), ("one", 1)):
        p, status = 5000, "OPEN"
        for seq in sorted(rnd.sample(range(200000), n)):
            weight, supports = rnd.randrange(0, 4000), rnd.random() < 0.55
            events.append((key, seq, weight / 10000, supports))
            if supports:
                p = min(9900, (p * 10000 + weight * (10000 - p) + 5000) // 10000)
                status = "SUPPORTED" if p >= 8500 else status
            else:
                p = max(100, (p * 10000 - weight * p + 5000) // 10000)
                status = "REFUTED" if p <= 1500 else status
        want[key] = (n, p / 10000, status)
    df = spark.createDataFrame(events, "h string, seq bigint, w double, s boolean").repartition(7)
    got = {r.h: (r.events, r.posterior, r.status) for r in folds.posteriors(df, "h", "seq", F.col("s"), F.col("w")).collect()}
    assert got == want


def test_previous_in_order_over_ranges(spark):
    rnd = random.Random(3)
    rows = [(k, o, o * 2) for k in ("a", "b") for o in rnd.sample(range(5000), 300)]
    want = {}
    for k in ("a", "b"):
        before = None
        for _, o, p in sorted(r for r in rows if r[0] == k):
            want[k, o] = before
            before = (o, p)
    df = spark.createDataFrame(rows, "k string, o bigint, p bigint")
    got = {(r.k, r.o): tuple(r.previous) if r.previous else None for r in latest.previous_in_order(df, ["k"], "o", ["p"], size=16).collect()}
    assert got == want


def test_chain_links_and_breaks(spark):
    rows = [("c", i, 1000 + i, "HUMAN_DECISION", f"p{i}") for i in range(0, 900, 2)]
    blocks = ledger.append_blocks(spark.createDataFrame(rows, "c string, seq bigint, ts_us bigint, kind string, payload string"), "c", "seq")
    kept = blocks.orderBy("seq").collect()
    assert kept[0].previous_hash == ledger.NO_PREVIOUS and kept[1].previous_hash == kept[0].block_hash
    clean = ledger.first_fault(ledger.verify_blocks(blocks)).first()
    assert (clean.blocks, clean.faults) == (450, 0)
    bad = blocks.withColumn("payload", F.when(F.col("seq") == 100, "changed").otherwise(F.col("payload")))
    found = ledger.first_fault(ledger.verify_blocks(bad)).first()
    # The block itself, and the anchors of the three segments after it, which cover all before them.
    assert found.first_seq == 100 and found.first_fault == "hash mismatch" and found.faults == 4
    gone = blocks.where("seq <> 300")
    assert ledger.first_fault(ledger.verify_blocks(gone)).first().faults > 0


CHAIN = "c string, seq bigint, ts_us bigint, kind string, payload string"


def chained(spark, numbers, forged=()):
    rows = [("c", i, 1000 + i, "HUMAN_DECISION", f"{'forged' if i in forged else 'p'}{i}") for i in numbers]
    return ledger.append_blocks(spark.createDataFrame(rows, CHAIN), "c", "seq")


def faults(blocks, part=None):
    return ledger.first_fault(ledger.verify_blocks(blocks, part)).first().faults


@pytest.mark.parametrize("numbers", [[0, 1, 2, 1000, 1001, 5000, 200_000], list(range(0, 1300))])
def test_no_segment_goes_unnoticed(spark, numbers):
    blocks = cut_lineage(chained(spark, numbers))
    assert faults(blocks) == 0
    assert [r.block_index for r in blocks.orderBy("seq").collect()] == list(range(len(numbers)))
    segments = sorted({n // ledger.SEGMENT for n in numbers})
    for s in segments[:-1]:
        assert faults(blocks.where(F.col("segment") != s)) > 0
    tip = ledger.tips_of(blocks).first().tip_hash
    assert ledger.tips_of(chained(spark, [n for n in numbers if n // ledger.SEGMENT != segments[0]])).first().tip_hash != tip


def test_a_rewritten_past_is_noticed(spark):
    honest, forged = cut_lineage(chained(spark, range(1024))), cut_lineage(chained(spark, range(1024), forged={5}))
    assert ledger.tips_of(honest).first().tip_hash != ledger.tips_of(forged).first().tip_hash
    for first in (1, 2, 3):
        mixed = forged.where(F.col("segment") < first).unionByName(honest.where(F.col("segment") >= first))
        assert faults(mixed) > 0


def test_late_events_go_to_the_end(spark, tmp_path):
    from confsieve.streaming import audit

    def come(numbers, name):
        rows = [("c", i, 1000 + i, "HUMAN_DECISION", f"p{i}") for i in numbers]
        spark.createDataFrame(rows, CHAIN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        audit.ledger_log(spark.readStream.schema(CHAIN).parquet(str(tmp_path / "in")), "c", "seq", str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return {r.block_hash: r.block_index for r in audit.current_blocks(spark, str(tmp_path / "out")).collect()}

    first = come(range(300, 600), "a")
    both = come([5, 700, 701], "b")
    assert first.items() <= both.items() and sorted(both.values()) == list(range(303))
    blocks = audit.current_blocks(spark, str(tmp_path / "out"))
    assert faults(blocks, "batch") == 0 and faults(blocks.where("segment <> 1 or batch = 1"), "batch") > 0


def test_decay_runs_until_it_rests(spark):
    def plain(value, passes, factor, floor=500):
        for _ in range(passes):
            value = max(floor, (value * factor + 50) // 100)
        return value / 10000

    for factor in (50, 85, 99):
        got = spark.range(1).select(*[folds.decay(F.lit(1.0), F.lit(n), factor).alias(f"n{n}") for n in (0, 1, 60, 100, 400, 5000)]).first()
        assert list(got) == [plain(10000, n, factor) for n in (0, 1, 60, 100, 400, 5000)]


def test_hmac_of_long_keys(spark):
    for key in ("k", "k" * 64, "k" * 65, "ключ" * 40):
        assert spark.range(1).select(hmac_sha256(key, F.lit("message"))).first()[0] == hmac.new(key.encode(), b"message", hashlib.sha256).hexdigest()


def test_hmac(spark):
    got = spark.range(1).select(hmac_sha256("key", F.lit("message"))).first()[0]
    assert got == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()


def test_split_lines_like_a_text_file(spark):
    for text in ("", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb c\x85d"):
        assert spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t"))).first()[0] == text.splitlines()


def test_fixes_see_the_result_before(spark):
    fixes = [("replace", r"transport\s+input\s+telnet", "transport input ssh $1"), ("delete", "nothing", ""), ("append", None, "end")]
    df = spark.createDataFrame([("line vty 0 4\n transport input telnet", fixes)], "t string, f array<struct<action:string,pattern:string,replacement:string>>")
    out = remediation.apply_fixes(df, "f", "t").first()
    assert out.candidate_text == "line vty 0 4\n transport input ssh $1\nend\n" and out.original_hash != out.candidate_hash


def test_section_goes_before_the_last_audit_mark(spark):
    r = "a ## Audit Trail b ## Audit Trail c"
    assert spark.range(1).select(report.insert_section(F.lit(r), F.lit("X "))).first()[0] == "a ## Audit Trail b X ## Audit Trail c"
    assert spark.range(1).select(report.insert_section(F.lit("a"), F.lit("X"))).first()[0] == "a\n\nX"


def test_folder_scan(spark, tmp_path):
    (tmp_path / "a.conf").write_bytes("é\r\nb".encode())
    (tmp_path / "b.cfg").write_bytes(b"\xe9 latin")
    (tmp_path / "c.txt").write_bytes(b"bin\x00ary")
    (tmp_path / "d.exe").write_text("no")
    got = {r.filename: r.raw_text for r in src.discover_configs(spark, str(tmp_path)).collect()}
    assert got == {"a.conf": "é\nb", "b.cfg": "é latin"}


def test_labelled_samples(spark, tmp_path):
    (tmp_path / "s1.meta.json").write_text('{"sample_id": "FW-A-S-001", "vendor": "x"}')
    (tmp_path / "s1.json").write_text("{}")
    (tmp_path / "s1.conf").write_text("hostname a")
    (tmp_path / "s2.meta.json").write_text("{broken")
    (tmp_path / "s2.conf").write_text("x")
    (tmp_path / "s3.meta.json").write_text('{"sample_id": "FW-A-S-003"}')
    rows = src.load_samples(spark, str(tmp_path)).collect()
    assert [(r.sample_id, r.filename, r.raw_text) for r in rows] == [("FW-A-S-001", "s1.conf", "hostname a")]
