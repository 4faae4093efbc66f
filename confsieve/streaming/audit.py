"""Structured Streaming forms: incremental audit, verdicts, ledger, live counters.

Each query runs until stopped or, with ``available_now``, until its input is used up. State lives in the checkpoint and in the written
tables, so a restart continues where the last batch ended; every table row carries its batch, and a repeated batch overwrites its own
folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, BooleanType, DateType, FractionalType, IntegralType, LongType, StringType, StructField, StructType

from confsieve.operators.latest import latest_per_key
from confsieve.operators.ledger import append_blocks, tips_of
from confsieve.sources.tables import upsert_buckets


def _start(stream: DataFrame, write: Callable, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _batch_path(root: str, batch: int) -> str:
    return f"{root.rstrip('/')}/batch={batch:09d}"


def ingest_configs(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, keys: list[str], available_now: bool = True) -> StreamingQuery:
    """Audits every arriving configuration and keeps one finding a key: a later arrival replaces it, in the buckets it falls in.

    ``audit`` is stateless (configuration rows to finding rows with ``arrival``)."""
    def write(batch: DataFrame, number: int) -> None:
        upsert_buckets(audit(batch), root, number, keys, "arrival")

    return _start(stream, write, checkpoint, available_now=available_now)


#: Verdicts are held in so many groups of keys. The number belongs to the checkpoint; a group should hold some thousands of keys at most.
SLOTS = 1024
#: Types of keys that go through the frames as text, which loses neither digits nor the difference of null and NaN.
_AS_TEXT = (IntegralType, FractionalType, BooleanType, DateType)


class LatestVerdict(StatefulProcessor):
    """One verdict per key in the state store: a later one replaces it, a repeated or older one changes nothing and is not handed on.

    A key that hears nothing for ``keep_ms`` of event time is forgotten by a timer, and says so with a row of kind ``expired``. A row older than
    the watermark by more than that is too late to open a key again. The state holds one table for each slot of keys, with the time each is due,
    and a timer for the first of them: the store is called once a slot and batch, not for every key."""

    def __init__(self, state: StructType, keys: list[str], names: list[str], order: str, time: str, keep_ms: int):
        # Times are kept as the frames have them, without a zone.
        self.arrow = pa.schema([pa.field(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type) for f in to_arrow_schema(state)])
        self.keys, self.names, self.order, self.time, self.keep_ms = keys, names, order, time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("verdicts", StructType([StructField("rows", BinaryType())]))

    def _held(self) -> pd.DataFrame:
        if self.state.exists():
            with pa.ipc.open_stream(self.state.get()[0]) as stored:
                return stored.read_all().to_pandas()
        return self.arrow.empty_table().to_pandas()

    def _keep(self, held: pd.DataFrame) -> None:
        if not len(held):
            self.state.clear()
            return
        table, out = pa.Table.from_pandas(held[self.arrow.names], self.arrow, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.arrow) as writer:
            writer.write_table(table)
        self.state.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(held["_due"].min()))

    def _best(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        """A row per key: the first of its greatest order, with the latest time heard."""
        rows = pd.concat(frames, ignore_index=True)
        heard = rows.groupby(self.keys, dropna=False, sort=False)["_heard"].transform("max")
        return rows.assign(_heard=heard).sort_values(self.order, ascending=False, kind="stable").drop_duplicates(self.keys)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, found, watermark = self._held(), None, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame = frame[[*self.keys, *self.names]].assign(_heard=_millis(frame[self.time]))
            if watermark > 0:
                known = frame[self.keys].merge(held[self.keys].assign(_known=True), on=self.keys, how="left")["_known"].notna().to_numpy()
                frame = frame[known | (frame["_heard"] + self.keep_ms > watermark).to_numpy()]
            if len(frame):
                found = self._best([frame] if found is None else [found, frame])
        if found is None:
            return
        both = [held.assign(_new=False), found.assign(_new=True)] if len(held) else [found.assign(_new=True, _due=0)]
        rows = pd.concat(both, ignore_index=True)
        heard = rows.groupby(self.keys, dropna=False, sort=False)["_heard"].transform("max")
        rows = rows.assign(_heard=heard).sort_values(self.order, ascending=False, kind="stable").drop_duplicates(self.keys)  # of equals the one held
        due = np.maximum(rows["_heard"].fillna(0), _millis(rows[self.time])).astype("int64") + self.keep_ms
        rows["_due"] = rows["_due"].where(rows["_heard"].isna(), due).astype("int64")
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self._keep(rows)
        changed = rows[rows["_new"].astype(bool)]
        if len(changed):
            yield self._out(changed, "set")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        gone = held["_due"] <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        if gone.any():
            self._keep(held[~gone])
            yield self._out(held[gone], "expired")

    def _out(self, rows: pd.DataFrame, kind: str) -> pd.DataFrame:
        return rows[[*self.keys, *self.names]].assign(kind=kind)

    def close(self) -> None:
        pass


def _millis(times: pd.Series) -> pd.Series:
    """Milliseconds since 1970; 0 for none."""
    at = pd.to_datetime(times)
    return ((at - pd.Timestamp(0, tz=at.dt.tz)) // pd.Timedelta(milliseconds=1)).fillna(0).astype("int64")


def verdict_changes(stream: DataFrame, keys: list[str], order: str, time: str, delay: str, keep_ms: int, slots: int = SLOTS) -> DataFrame:
    """The changes of the verdict per key, as they come: keys, the other columns, and ``kind`` (set or expired). Needs the RocksDB state store."""
    rest = [f for f in stream.schema.fields if f.name not in keys]
    kinds = {k: StringType() if isinstance(stream.schema[k].dataType, _AS_TEXT) else stream.schema[k].dataType for k in keys}
    own = [StructField(f"k{i}", kinds[k]) for i, k in enumerate(keys)]
    out = StructType([*own, *rest, StructField("kind", StringType())])
    names = [f.name for f in rest]
    processor = LatestVerdict(StructType([*own, *rest, StructField("_due", LongType())]), [f.name for f in own], names, order, time, keep_ms)
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("_slot")
    dealt = stream.withWatermark(time, delay).select(slot, *[F.col(k).cast(kinds[k]).alias(f"k{i}") for i, k in enumerate(keys)], *names)
    changes = dealt.groupBy("_slot").transformWithStateInPandas(processor, out, "Append", "EventTime")
    return changes.select(*[F.col(f"k{i}").cast(stream.schema[k].dataType).alias(k) for i, k in enumerate(keys)], *names, "kind")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def verdict_table(stream: DataFrame, keys: list[str], order: str, time: str, root: str, checkpoint: str, delay: str = "1 day", keep_ms: int = 10 * 365 * 86_400_000, available_now: bool = True) -> StreamingQuery:
    """The latest verdict of every key as a table of buckets; batches write only the verdicts that changed."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        def write(batch: DataFrame, number: int) -> None:
            upsert_buckets(batch.where("kind = 'set'").drop("kind"), root, number, keys, order)

        return _start(verdict_changes(stream, keys, order, time, delay, keep_ms), write, checkpoint, available_now=available_now)
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE[0])
        else:
            spark.conf.set(STATE_STORE[0], before)


def ledger_log(stream: DataFrame, chain: str, seq: str, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the decisions of each batch to the ledger as one part of it.

    A batch links on to the last block of each chain, so a decision that comes late goes to the end, in order of arrival, and no block that
    was written changes. Only the ends of the chains are read again: a narrow table, one row for each chain and batch that touched it.
    """
    blocks_root, tips_root = f"{root.rstrip('/')}/blocks", f"{root.rstrip('/')}/tips"
    tip_schema = f"chain {stream.schema[chain].dataType.simpleString()}, tip_hash string, tip_blocks bigint, batch bigint"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Only batches before this one: a repeat after a failure must see what the first try saw.
        tips = None
        if number > 0:
            earlier = spark.read.schema(tip_schema).parquet(tips_root).where(F.col("batch") < number)
            tips = latest_per_key(earlier, ["chain"], ["batch"])
        append_blocks(batch, chain, seq, tips).write.mode("overwrite").parquet(_batch_path(blocks_root, number))
        tips_of(spark.read.parquet(_batch_path(blocks_root, number))).write.mode("overwrite").parquet(_batch_path(tips_root, number))

    return _start(stream, write, checkpoint, available_now=available_now)


def current_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The ledger; ``batch`` tells its parts apart."""
    return spark.read.parquet(f"{root.rstrip('/')}/blocks")


def live_counters(stream: DataFrame, by: list[str], root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Running counts per group; the state holds one row per group, and each batch writes the whole small table."""
    counts = stream.groupBy(*by).agg(F.count("*").alias("findings"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(root, number))

    return _start(counts, write, checkpoint, "complete", available_now)


def current_counters(spark: SparkSession, root: str) -> DataFrame:
    table = spark.read.parquet(root)
    return table.where(F.col("batch") == table.agg(F.max("batch")).scalar()).drop("batch")


def with_arrival(configs: DataFrame, order: Column) -> DataFrame:
    return configs.withColumn("arrival", order)
