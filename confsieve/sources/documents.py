"""A data source for files of YAML or JSON documents, several to a file: ``spark.read.format("documents").load(folder)``.

Every file is a partition, read by the task that has it; the driver only lists names, and looks into ``infer_files`` files (8 by default) where no
schema is given. A record is a mapping, or an item of a list that is the whole document, or of the list under ``records``. Fields that
the schema does not name are left out, missing ones are null; a file that cannot be parsed gives one row with ``_error`` where the schema has it, and
fails the read where it has not. Paths are those Python opens on driver and executors: a shared folder. Through other stores, read whole texts
and use :func:`parse_documents`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, LongType, MapType, NullType, StringType, StructField, StructType, TimestampType

ENDINGS = (".yaml", ".yml", ".json", ".jsonl")
ERROR = "_error"


def documents_of(text: str, ending: str) -> Iterator[object]:
    if ending in (".yaml", ".yml"):
        import yaml

        yield from (d for d in yaml.safe_load_all(text) if d is not None)
    elif ending == ".jsonl":
        yield from (json.loads(line) for line in text.splitlines() if line.strip())
    elif text.strip():
        yield json.loads(text)


def records_of(text: str, ending: str, under: str = "records") -> Iterator[dict]:
    for document in documents_of(text, ending):
        if isinstance(document, dict) and isinstance(document.get(under), list):
            document = document[under]
        for record in document if isinstance(document, list) else [document]:
            if isinstance(record, dict):
                yield record


def type_of(value: object) -> DataType:
    if value is None:
        return NullType()
    if isinstance(value, bool):
        return BooleanType()
    if isinstance(value, int):
        return LongType()
    if isinstance(value, float):
        return DoubleType()
    if isinstance(value, datetime):
        return TimestampType()
    if isinstance(value, date):
        return DateType()
    if isinstance(value, list):
        inner: DataType = NullType()
        for item in value:
            inner = merged(inner, type_of(item))
        return ArrayType(inner)
    if isinstance(value, dict):
        return StructType([StructField(str(k), type_of(v)) for k, v in value.items()])
    return StringType()


def settled(t: DataType) -> DataType:
    """What was null wherever it was seen is text."""
    if isinstance(t, StructType):
        return StructType([StructField(f.name, settled(f.dataType)) for f in t.fields])
    if isinstance(t, ArrayType):
        return ArrayType(settled(t.elementType))
    return StringType() if isinstance(t, NullType) else t


def schema_of(records: Iterator[dict]) -> StructType:
    found: DataType = NullType()
    for record in records:
        found = merged(found, type_of(record))
    return settled(found) if isinstance(found, StructType) else StructType([StructField(ERROR, StringType())])


def merged(a: DataType, b: DataType) -> DataType:
    """The type both fit in: numbers widen, structs join their fields, anything else becomes text."""
    if isinstance(a, NullType) or a == b:
        return b
    if isinstance(b, NullType):
        return a
    if {type(a), type(b)} == {LongType, DoubleType}:
        return DoubleType()
    if isinstance(a, StructType) and isinstance(b, StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = merged(fields.get(f.name, NullType()), f.dataType)
        return StructType([StructField(n, t) for n, t in fields.items()])
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(merged(a.elementType, b.elementType))
    return StringType()


def fitted(value: object, wanted: DataType) -> object:
    """A parsed value as the schema wants it; what does not fit is null, and anything fits text."""
    if value is None:
        return None
    if isinstance(wanted, StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in wanted.fields) if isinstance(value, dict) else None
    if isinstance(wanted, ArrayType):
        return [fitted(x, wanted.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(wanted, MapType):
        return {str(k): fitted(v, wanted.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(wanted, StringType):
        return value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False)
    if isinstance(wanted, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(wanted, LongType):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(wanted, DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return value


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DocumentReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, under: str):
        self.paths, self.schema, self.under = paths, schema, under

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        try:
            found = list(records_of(Path(partition.path).read_text(encoding="utf-8"), Path(partition.path).suffix.lower(), self.under))
        except Exception as e:  # noqa: BLE001 - parsers raise errors of their own kinds
            if ERROR not in names:
                raise ValueError(f"{partition.path} cannot be parsed: {e}") from e
            yield tuple(f"{Path(partition.path).name}: {type(e).__name__}" if n == ERROR else None for n in names)
            return
        for record in found:
            yield tuple(fitted(record.get(f.name), f.dataType) for f in self.schema.fields)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def _paths(self) -> list[str]:
        root = Path(self.options["path"].removeprefix("file:"))
        found = [root] if root.is_file() else sorted(root.rglob("*"))
        return [str(p) for p in found if p.suffix.lower() in ENDINGS and not p.name.startswith((".", "_"))]

    def schema(self) -> StructType:
        paths, under = self._paths()[: int(self.options.get("infer_files", "8"))], self.options.get("under", "records")
        return schema_of(r for p in paths for r in records_of(Path(p).read_text(encoding="utf-8"), Path(p).suffix.lower(), under))

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self._paths(), schema, self.options.get("under", "records"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)


def parse_documents(texts: DataFrame, schema: StructType, text: str = "value", ending: str = ".yaml", under: str = "records") -> DataFrame:
    """Records out of a column of whole files, from any store that Spark reads (``spark.read.text(path, wholetext=True)``)."""
    import pyarrow as pa

    arrow = spark_arrow(schema)

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    rows = [{f.name: fitted_dict(r.get(f.name), f.dataType) for f in schema.fields} for r in records_of(value.as_py(), ending, under)]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts.select(F.col(text)).mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str, ending: str = ".yaml", under: str = "records", infer_files: int = 8) -> DataFrame:
    """Documents of a file or folder in any store; the schema comes from the first ``infer_files`` files."""
    texts = spark.read.text(path, wholetext=True)
    schema = schema_of(r for row in texts.limit(infer_files).collect() for r in records_of(row.value, ending, under))
    return parse_documents(texts, schema, ending=ending, under=under)


def fitted_dict(value: object, wanted: DataType) -> object:
    """As :func:`fitted`, with structs as mappings."""
    if isinstance(wanted, StructType):
        return {f.name: fitted_dict(value.get(f.name), f.dataType) for f in wanted.fields} if isinstance(value, dict) else None
    if isinstance(wanted, ArrayType):
        return [fitted_dict(x, wanted.elementType) for x in value] if isinstance(value, list) else None
    return fitted(value, wanted)


def spark_arrow(schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
