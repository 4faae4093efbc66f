"""Helpers shared by the operators of this folder: reading, column names, Arrow batches, words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space of the word and line rules: space and U+0009 to U+000D. ``bytes.split()`` and ``bytes.strip()`` use the same set.
SPACE = " \t\n\x0b\x0c\r"
#: Rows handled at a time inside a batch, so that Python objects of one slice only are alive.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns under exactly these names, whatever else the table holds. A column that is not there is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[n.lower()]}`") if n.lower() in have else F.lit(None)).alias(n) for n in names])


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose names the caller is about to give to its results."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, as given or with underscores added, that ``df`` does not hold yet."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def shielded(df: DataFrame, names: Iterable[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn(df)`` for a ``fn`` that gives its results these names: columns of the input that have them come back as they were."""
    taken = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    away = dict(zip(taken, unused(df, *[f"own_{c}" for c in taken])))
    out = fn(df.withColumnsRenamed(away))
    back = {v: k for k, v in away.items()}
    return out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns]) if back else out.select(*[F.col(f"`{c}`") for c in df.columns])


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def extended(df: DataFrame, *fields: StructField) -> StructType:
    """The schema of ``df`` with further columns at its end."""
    return StructType([*[StructField(f.name, f.dataType, True) for f in df.schema.fields], *fields])


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches cut to a bounded number of rows and bytes, each with its texts as UTF-8. One text is never cut."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary()) if not pa.types.is_null(column.type) else pa.nulls(len(column), pa.large_binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = used = 0
        for i, n in enumerate(sizes):
            if i > start and (used + n > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, used = i, 0
            used += int(n)
        if start < len(sizes):
            yield batch.slice(start), column.slice(start).to_pylist()


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns set: replaced where the name is there, else appended."""
    arrays, names = list(batch.columns), list(batch.schema.names)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            arrays.append(array)
            names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def map_texts(df: DataFrame, schema: StructType | str, fn: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None], text: str = "text") -> DataFrame:
    """Runs ``fn`` over bounded slices of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            out = fn(batch, texts)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
