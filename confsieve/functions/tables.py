"""Catalogue rows as literals and as small frames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LITERAL_ROWS = 5000


def literal_rows(rows: list, element: str) -> Column:
    """Catalogue rows as one array literal; Spark folds the JSON once while planning.

    A catalogue that outgrows ``MAX_LITERAL_ROWS`` belongs in a table and a join.
    """
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError(f"{len(rows)} catalogue rows are too many for a literal; join a table instead")
    return F.from_json(F.lit(json.dumps(rows)), f"array<{element}>")


def literal_map(pairs: dict, value: str = "string") -> Column:
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string,{value}>")


def small_frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator, so that they are computed once.

    Spark substitutes plain projections into the filters and projections above them, copying an expression to every place that reads
    it; for expressions as large as a grammar that multiplies. A generator is left where it is.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
