"""Latest-row-per-key operators. All are one aggregation with a map-side part, so a key with most of the rows costs no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column | str], tie: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate([*order, *(tie or [])])])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(df.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins on ``keys``; at equal ``order`` the incoming row does."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return latest_per_key(both, keys, [order, "_side"]).drop("_side")


def delete_cascade(configs: DataFrame, verdicts: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Removes the configurations named in ``gone`` and the verdicts that belong to them."""
    names = gone.select(key).distinct()
    return configs.join(names, key, "left_anti"), verdicts.join(names, key, "left_anti")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(df.columns)


def previous_in_order(df: DataFrame, keys: list[str], order: str, payload: list[str], size: int = 4096, max_order: int | None = None) -> DataFrame:
    """Adds ``previous``: struct(order, payload) of the row before, per key, null for the first.

    A plain lag would sort all rows of a key in one task. Here a key is cut into ranges of ``order``; the lag runs inside a range, and
    the first row of a range takes the last row of the range before it, which is found the same way one level up. ``order`` is a
    distinct whole number >= 0 per key.
    """
    from pyspark.sql import Window

    if max_order is None:
        max_order = df.agg(F.max(order)).first()[0] or 0
    me = F.struct(order, *payload)
    if max_order < size:
        return df.withColumn("previous", F.lag(me).over(Window.partitionBy(*keys).orderBy(order)))
    # Named after the order column, so that the levels do not get in each other's way.
    part = f"{order}_range"
    ranged = df.withColumn(part, F.floor(F.col(order) / size).cast("bigint"))
    inside = ranged.withColumn("_before", F.lag(me).over(Window.partitionBy(*keys, part).orderBy(order)))
    last = ranged.groupBy(*keys, part).agg(F.max_by(me, order).alias("_last"))
    carried = previous_in_order(last, keys, part, ["_last"], size, max_order // size).select(*keys, part, F.col("previous._last").alias("_carried"))
    return inside.join(carried, [*keys, part]).withColumn("previous", F.coalesce("_before", "_carried")).drop(part, "_before", "_carried")
