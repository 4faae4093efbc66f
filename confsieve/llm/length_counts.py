"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are encoded and counted by length; that table has a row for each length that occurs, however many documents there are.
Sums over all greater lengths (suffix sums) then answer every question: the total, how many documents a limit cuts, what is left of
the total when each text is cut to a limit, and any quantile. The sums are made in two levels, over spans of lengths and within a span, so
that no task holds the whole table.

Defined cases: a null or empty text has length 0 and counts as a document. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confsieve.llm.byte_bpe import lengths
from confsieve.llm.common import pick

#: log2 of the number of lengths in a span.
SPAN_BITS = 8


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    return lengths(pick(docs, "text"), path, pattern).groupBy(F.col("n_tokens").cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds to each length: ``docs_longer`` and ``tokens_longer`` over all greater lengths, ``docs_up_to``, and ``truncated_total``, what all texts hold when cut to it.

    A context limit that no text has as its length is answered by the next smaller row: the texts longer than it are the same.
    """
    own = counts.withColumn("span", F.shiftright("n_tokens", SPAN_BITS)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    spans = own.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    from_start = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("span_docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("span_tokens").over(above), F.lit(0)).alias("tokens_above"), F.coalesce(F.sum("span_docs").over(from_start), F.lit(0)).alias("docs_before"))
    within = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("span").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return own.join(spans, "span").select(
        "n_tokens", "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(up_to)).alias("docs_up_to"),
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("tokens_longer"),
    )


def with_truncation(sums: DataFrame, total_tokens: int) -> DataFrame:
    """What is left when every text is cut to the length of the row: the texts up to it whole, of the others so many tokens each."""
    return sums.withColumn("truncated_total", F.lit(total_tokens) - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer"))


def answer(sums: DataFrame, limit: int) -> tuple[int, int]:
    """For any context limit: the tokens left when every text is cut to it, and how many texts it cuts."""
    row = sums.agg(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("n_docs")).otherwise(limit * F.col("n_docs"))), F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0))).first()
    return int(row[0] or 0), int(row[1] or 0)


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed; null of an empty table."""
    total = sums.agg(F.sum("n_docs")).first()[0]
    return sums.filter(F.col("docs_up_to") >= F.lit(share) * F.lit(total or 0)).agg(F.min("n_tokens")).first()[0]
