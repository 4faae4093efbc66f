"""From raw documents to token ids: the stages of the training-data pipeline over ``documents``.

Toxic documents go, lines that many documents share go, of near copies one stays, the sources are mixed to their weights, and what is
left is encoded. Every stage works on all that the one before kept. There is no SQL for the whole (a trained model, tilted rates and byte
merges are not SQL); ``tests/llm`` compares the run with a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from confsieve.llm.common import read, shielded, without
from confsieve.session import run_folder

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from the labels that are not held out."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return shielded(docs, ["held_out", "score", "predicted"], lambda own: toxicity.score(own, model).filter("predicted = 0"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with four others or more; ``n_chars`` follows the text."""
    kept = shielded(docs, ["n_lines", "n_dropped"], line_dedup.drop_shared_lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, their number, and whether they decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return without(decoded.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": exact}), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages one after the other to ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
