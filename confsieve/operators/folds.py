"""Ordered folds over event logs of any length, one state per key.

Updates such as ``w += 0.08 * (target - w)`` with rounding after every step depend on order, so a key's events cannot simply be
summed. But every update is a monotone step on whole ten-thousandths (0 .. 10000), and steps compose: a run of events is itself such a
step, written as the positions where its value changes. So a key's log is cut into blocks by event number, each block becomes one step,
and neighbouring blocks are merged level by level. No task ever holds more than one block of one key, whatever the key's share of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.session import cut_lineage

SCALE = 10000
BLOCK = 256
RAW_EVENTS = 512
# A step may also leave a tag (say, a status) behind: it returns state + TAG * tag, and tag 0 keeps the one before.
TAG = 100000

StepNumpy = Callable[[np.ndarray, tuple], np.ndarray]
StepColumn = Callable[[Column, Column], Column]


def _joint_step(parts: list, step: StepNumpy, args: list[str]) -> tuple[list[int], list[int]]:
    """Blocks of one key in order as one step: the states at which its result changes, and the results.

    Neighbouring states that have come together stay together, so only one of them is carried on; updates draw states together fast.
    """
    starts = state = np.arange(SCALE + 1, dtype=np.int64)
    tag = np.zeros(SCALE + 1, dtype=np.int64)
    for part in parts:
        if len(part["_starts"]):
            at = np.searchsorted(np.asarray(part["_starts"]), state, side="right") - 1
            moved = [np.asarray(part["_values"], dtype=np.int64)[at]]
        else:
            moved = zip(*[[int(x) for x in part[a]] for a in args], strict=True)
        for m in moved:
            after = m if isinstance(m, np.ndarray) else step(state, m)
            state, tag = after % TAG, np.where(after >= TAG, after // TAG, tag)
            if len(state) > 1:
                kept = np.append(True, (state[1:] != state[:-1]) | (tag[1:] != tag[:-1]))
                starts, state, tag = starts[kept], state[kept], tag[kept]
    return starts.tolist(), (state + TAG * tag).tolist()


def _composer(step: StepNumpy, args: list[str], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [_joint_step(list(parts), step, args) for parts in batch["_parts"]]
            out = batch.drop(columns="_parts").assign(_starts=[s for s, _ in steps], _values=[v for _, v in steps])
            for a in args:
                out[a] = [[] for _ in steps]
            yield out[columns]

    return compose


def _merge_level(level: DataFrame, keys: list[str], step: StepNumpy, args: list[str]) -> DataFrame:
    """BLOCK neighbouring blocks become one. Few events stay events, which never leaves the JVM; more become a joint step."""
    names = ["_block", "_n", *args, "_starts", "_values"]
    gathered = level.groupBy(*keys, F.floor(F.col("_block") / BLOCK).cast("bigint").alias("_up")).agg(
        F.sum("_n").alias("_total"), F.array_sort(F.collect_list(F.struct(*names))).alias("_parts")
    )
    ready = gathered.select(*keys, F.col("_up").alias("_block"), F.col("_total").alias("_n"), "_parts")
    empty = F.array().cast("array<bigint>")
    few = ready.where(F.col("_n") <= RAW_EVENTS).select(
        *keys, "_block", "_n", *[_joined(a) for a in args], empty.alias("_starts"), empty.alias("_values")
    )
    many = ready.where(F.col("_n") > RAW_EVENTS).mapInPandas(_composer(step, args, few.columns), few.schema)
    return few.unionByName(many)


def _joined(name: str) -> Column:
    return F.flatten(F.transform("_parts", lambda p: p[name])).alias(name)


def _argument(name: str) -> Column:
    return F.transform("_events", lambda e: e[name].cast("bigint")).alias(name)


def ordered_fold(
    events: DataFrame,
    keys: list[str],
    seq: str,
    args: list[str],
    initial: Column,
    step: StepColumn,
    step_numpy: StepNumpy,
    max_seq: int | None = None,
) -> DataFrame:
    """Final state per key. ``seq`` is a distinct whole number >= 0 per key and event; ``args`` are whole-number event columns.

    ``step`` and ``step_numpy`` are the same update, once on columns and once on an array of states.
    """
    if max_seq is None:
        max_seq = events.agg(F.max(seq)).first()[0] or 0
    packed = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_seq"), *args)))
    blocks = events.groupBy(*keys, F.floor(F.col(seq) / BLOCK).cast("bigint").alias("_block")).agg(packed.alias("_events"))
    if max_seq >= BLOCK:
        level = blocks.select(
            *keys,
            "_block",
            F.size("_events").cast("bigint").alias("_n"),
            *[_argument(a) for a in args],
            F.array().cast("array<bigint>").alias("_starts"),
            F.array().cast("array<bigint>").alias("_values"),
        )
        remaining = max_seq // BLOCK
        while remaining > 0:
            level = _merge_level(level, keys, step_numpy, args)
            remaining //= BLOCK
    else:
        level = blocks.select(
            *keys,
            F.size("_events").cast("bigint").alias("_n"),
            *[_argument(a) for a in args],
            F.array().cast("array<bigint>").alias("_starts"),
            F.array().cast("array<bigint>").alias("_values"),
        )
    start = F.round(initial * SCALE).cast("bigint")
    by_table = F.element_at(F.col("_values"), F.size(F.filter("_starts", lambda s: s <= start)))

    def keep_tag(acc: Column, after: Column) -> Column:
        return F.when(after >= TAG, after).otherwise(after + acc - acc % TAG)

    by_events = F.aggregate(F.arrays_zip(*args), start, lambda acc, e: keep_tag(acc, step(acc % TAG, e).cast("bigint")))
    final = F.when(F.size("_starts") > 0, by_table).otherwise(by_events)
    out = level.select(*keys, F.col("_n").alias("events"), final.alias("_final"))
    return out.select(*keys, "events", ((F.col("_final") % TAG).cast("double") / SCALE).alias("state"), F.floor(F.col("_final") / TAG).alias("tag"))


def in_order(rows: DataFrame, order: str, *then: Column) -> tuple[DataFrame, int]:
    """Adds ``seq``, 0, 1, 2, ... in the order of a column (equal ones by ``then``), and tells how many rows there are.

    Numbers without gaps fill the blocks of a fold; each level of blocks over a sparse number would shuffle all events again for nothing.
    """
    placed = cut_lineage(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order, *then).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftright("_at", 33)
    # One row for each partition.
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    before = placed.sparkSession.createDataFrame([(r["part"], end) for r, end in zip(sizes, ends[:-1], strict=True)], "_part long, _before long")
    numbered = placed.join(F.broadcast(before), part == F.col("_part")).withColumn("seq", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return numbered.drop("_at", "_part", "_before"), ends[-1]


def weight_step(w: Column, e: Column) -> Column:
    """w += 0.08 * (target - w) in ten-thousandths, half up. ``target`` is in ten-thousandths as well."""
    return F.floor((w * 92 + e["target"] * 8 + 50) / 100)


def weight_step_numpy(w: np.ndarray, event: tuple) -> np.ndarray:
    return (w * 92 + event[0] * 8 + 50) // 100


def token_weights(verdicts: DataFrame, token: str, seq: str, passed: Column, max_seq: int | None = None) -> DataFrame:
    """Learned weight per token from its verdicts in order; unseen tokens start at one half. Targets 1.0 and 0.2."""
    events = verdicts.select(token, seq, F.when(passed, SCALE).otherwise(2000).cast("bigint").alias("target"))
    return ordered_fold(events, [token], seq, ["target"], F.lit(0.5), weight_step, weight_step_numpy, max_seq).withColumnRenamed("state", "weight").drop("tag")


def evidence_step(p: Column, e: Column) -> Column:
    """Supporting evidence moves p towards one, refuting evidence towards zero; capped at 0.99 and floored at 0.01."""
    up = F.least(F.lit(9900), F.floor((p * SCALE + e["weight"] * (SCALE - p) + SCALE / 2) / SCALE))
    down = F.greatest(F.lit(100), F.floor((p * SCALE - e["weight"] * p + SCALE / 2) / SCALE))
    return F.when(e["supports"] == 1, up + F.when(up >= 8500, TAG).otherwise(0)).otherwise(down + F.when(down <= 1500, 2 * TAG).otherwise(0))


def evidence_step_numpy(p: np.ndarray, event: tuple) -> np.ndarray:
    weight, supports = event
    if supports == 1:
        up = np.minimum(9900, (p * SCALE + weight * (SCALE - p) + SCALE // 2) // SCALE)
        return up + TAG * (up >= 8500)
    down = np.maximum(100, (p * SCALE - weight * p + SCALE // 2) // SCALE)
    return down + 2 * TAG * (down <= 1500)


def posteriors(evidence: DataFrame, key: str, seq: str, supports: Column, weight: Column, prior: float = 0.5, max_seq: int | None = None) -> DataFrame:
    """Posterior and status per hypothesis; the status is that of the last crossing: SUPPORTED from .85 up, REFUTED from .15 down."""
    events = evidence.select(key, seq, F.round(weight * SCALE).cast("bigint").alias("weight"), F.when(supports, 1).otherwise(0).cast("bigint").alias("supports"))
    out = ordered_fold(events, [key], seq, ["weight", "supports"], F.lit(prior), evidence_step, evidence_step_numpy, max_seq)
    status = F.when(F.col("tag") == 1, "SUPPORTED").when(F.col("tag") == 2, "REFUTED").otherwise("OPEN")
    return out.select(key, "events", F.col("state").alias("posterior"), status.alias("status"))


def _rounds_to_rest(factor_percent: int, floor: int) -> int:
    """Rounds after which even full confidence stays where it is."""
    value, rounds = SCALE, 0
    while (after := max(floor, (value * factor_percent + 50) // 100)) != value:
        value, rounds = after, rounds + 1
    return rounds


def decay(confidence: Column, passes: Column, factor_percent: int = 85, floor: int = 500) -> Column:
    """``passes`` rounds of confidence * factor, four digits each, never below the floor. Rounds after the value has come to rest are left out."""
    start, rounds = F.round(confidence * SCALE).cast("bigint"), passes.cast("int")
    if factor_percent < 100:
        rounds = F.least(rounds, F.lit(_rounds_to_rest(factor_percent, floor)))
    steps = F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda acc, _: F.greatest(F.lit(floor).cast("bigint"), F.floor((acc * factor_percent + 50) / 100).cast("bigint"))).cast("double") / SCALE
