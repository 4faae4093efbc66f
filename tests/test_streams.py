"""State and stored tables across restarts: late, repeated and expired keys; buckets that keep their files."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from confsieve.sources import tables
from confsieve.streaming import audit

SCHEMA = "device string, value string, seq long, ts timestamp"
START = datetime(2024, 5, 1, 12)


def put(spark, folder, rows):
    days = [(device, value, seq, START + timedelta(days=day)) for device, value, seq, day in rows]
    spark.createDataFrame(days, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, keep_days=3650, delay="1 day"):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    audit.verdict_table(stream, ["device"], "seq", "ts", str(tmp_path / "out"), str(tmp_path / "checkpoint"), delay, keep_days * 86_400_000).awaitTermination()
    return {r.device: (r.value, r.seq) for r in tables.read_buckets(spark, str(tmp_path / "out"), SCHEMA).collect()}


def test_late_and_repeated_verdicts_after_a_restart(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", "pass", 1, 0), ("b", "fail", 5, 0), ("b", "pass", 4, 1)])
    assert run(spark, tmp_path) == {"a": ("pass", 1), "b": ("fail", 5)}
    put(spark, tmp_path / "in", [("a", "pass", 1, 0), ("b", "pass", 3, 2), ("c", "pass", 7, 2)])
    written = len(list((tmp_path / "out" / "data").glob("batch=*/bucket=*")))
    assert run(spark, tmp_path) == {"a": ("pass", 1), "b": ("fail", 5), "c": ("pass", 7)}
    assert len(list((tmp_path / "out" / "data").glob("batch=*/bucket=*"))) == written + 1  # only c changed anything
    put(spark, tmp_path / "in", [("a", "fail", 9, 3)])
    assert run(spark, tmp_path)["a"] == ("fail", 9)


def test_keys_expire_by_event_time(spark, tmp_path):
    def changes():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        spark.conf.set(*audit.STATE_STORE)
        try:
            out = audit.verdict_changes(stream, ["device"], "seq", "ts", "0 seconds", 2 * 86_400_000)
            out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "log")).awaitTermination()
        finally:
            spark.conf.unset(audit.STATE_STORE[0])
        return sorted((r.device, r.seq, r.kind) for r in spark.read.parquet(str(tmp_path / "log")).collect())

    put(spark, tmp_path / "in", [("a", "pass", 1, 0), ("b", "pass", 2, 0)])
    assert changes() == [("a", 1, "set"), ("b", 2, "set")]
    put(spark, tmp_path / "in", [("b", "fail", 3, 9)])
    seen = changes()
    assert ("a", 1, "expired") in seen and ("b", 3, "set") in seen
    put(spark, tmp_path / "in", [("a", "late", 4, 1), ("c", "pass", 5, 12)])  # a is long forgotten, and its row too late
    seen = changes()
    assert ("c", 5, "set") in seen and all(r[:2] != ("a", 4) for r in seen)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "device string, value string, seq long"

    def rows(*x):
        return spark.createDataFrame(list(x), schema)

    tables.upsert_buckets(rows(*[(f"d{i}", "old", i) for i in range(200)]), root, 0, ["device"], "seq", buckets=8)
    before = {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
    tables.upsert_buckets(rows(("d3", "new", 500), ("d3", "older", 1), ("d5", "stale", 2)), root, 1, ["device"], "seq", buckets=8)
    tables.upsert_buckets(rows(("d3", "new", 500), ("d3", "older", 1), ("d5", "stale", 2)), root, 1, ["device"], "seq", buckets=8)  # the batch again
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    touched = {p.name for p in (Path(root) / "data" / "batch=1").glob("bucket=*")}
    assert 1 <= len(touched) <= 2
    got = {r.device: (r.value, r.seq) for r in tables.read_buckets(spark, root, schema).collect()}
    assert len(got) == 200 and got["d3"] == ("new", 500) and got["d5"] == ("old", 5)
    assert tables.drop_superseded(spark, root) == len(touched)
    assert tables.read_buckets(spark, root, schema).count() == 200
    tables.upsert_buckets(rows(), root, 2, ["device"], "seq", buckets=8)
    assert tables.read_buckets(spark, str(tmp_path / "none"), schema).count() == 0


class Store:
    """A state store of one slot that counts its calls."""

    def __init__(self):
        self.rows, self.timers, self.updates = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows

    def update(self, rows):
        self.rows, self.updates = rows, self.updates + 1

    def clear(self):
        self.rows = None

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.watermark


def test_a_slot_of_keys_is_one_entry_of_the_store(spark):
    """Hundreds of keys, null ones too, in several frames and batches: the store is written once a batch, and each key has its own verdict and time."""
    day, rnd = 86_400_000, random.Random(8)
    rest = [StructField("value", DoubleType()), StructField("seq", LongType()), StructField("ts", TimestampType())]
    state = StructType([StructField("k0", StringType()), StructField("k1", StringType()), *rest, StructField("_due", LongType())])
    slot, store = audit.LatestVerdict(state, ["k0", "k1"], ["value", "seq", "ts"], "seq", "ts", 2 * day), Store()
    slot.init(store)
    want, number = {}, 0
    for batch in range(3):
        frames, before = [], dict(want)
        for _ in range(4):
            rows = []
            for _ in range(150):
                number += 1
                rows.append((rnd.choice([None, *map(str, range(100))]), rnd.choice(["a", None]), rnd.choice([None, 0.5, 2.0]), rnd.randint(1, 900), START + timedelta(hours=rnd.randint(0, 20))))
            frames.append(pd.DataFrame(rows, columns=["k0", "k1", "value", "seq", "ts"]))
            for k0, k1, value, seq, _ in rows:
                if (k0, k1) not in want or seq > want[k0, k1][1]:
                    want[k0, k1] = value, seq
        out = pd.concat(slot.handleInputRows((0,), iter(frames), Clock(0))).astype(object)
        got = {(r.k0, r.k1): (None if pd.isna(r.value) else r.value, r.seq) for r in out.where(out.notna(), None).itertuples()}
        assert got == {k: v for k, v in want.items() if before.get(k) != v} and store.updates == batch + 1 and len(store.timers) == 1
    due = int(pd.Timestamp(START).timestamp() * 1000) + 2 * day
    early = list(slot.handleExpiredTimer((0,), Clock(0), Clock(due - 1)))
    gone = pd.concat(slot.handleExpiredTimer((0,), Clock(0), Clock(due + 20 * day)))
    assert not early and len(gone) == len(want) and set(gone["kind"]) == {"expired"} and store.rows is None


def test_a_batch_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "device string, seq long").mapInArrow(count, "device string, seq long")
    tables.upsert_buckets(rows, str(tmp_path / "t"), 0, ["device"], "seq", buckets=4)
    assert seen.value == 2
