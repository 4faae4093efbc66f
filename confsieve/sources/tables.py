"""Stored tables: append, latest-wins replacement by version or by bucket, learned records, frozen metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.operators.latest import latest_per_key, upsert
from confsieve.session import cut_lineage


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """A table is replaced by writing its next version; readers of the one before are not disturbed."""
    path = f"{root.rstrip('/')}/version={version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version:06d}")


def upsert_version(spark: SparkSession, root: str, version: int, incoming: DataFrame, keys: list[str], order: str) -> str:
    """Version ``version`` plus the incoming rows, last write per key, as the next version."""
    stored = read_version(spark, root, version)
    return write_version(upsert(stored, incoming, keys, order), root, version + 1)


# ---- latest wins by bucket --------------------------------------------------------------------------------------------------------------
# ``data/batch=N/bucket=B`` holds all rows of a bucket as of batch N, one row a key; ``index/batch=N`` names the buckets a batch wrote. A batch
# rewrites only the buckets its keys fall in, into folders of its own: what readers see changes with the index, and a batch that is run again
# after a failure overwrites its own folders and nothing else.

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _folders(spark: SparkSession, root: str, before: int | None, only: list[int] | None = None) -> list[str]:
    """The folder that holds each bucket now, or held it before a batch."""
    if not _exists(spark, f"{root}/index"):
        return []
    index = spark.read.schema("bucket int, batch long").parquet(f"{root}/index")
    index = index if before is None else index.where(F.col("batch") < before)
    index = index if only is None else index.where(F.col("bucket").isin(only))
    return [f"{root}/data/batch={r.batch}/bucket={r.bucket}" for r in index.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()]  # a row a bucket


def upsert_buckets(incoming: DataFrame, root: str, batch: int, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
    """Last write per key wins; buckets without an incoming key keep their files. The number of buckets belongs to the table."""
    spark, root = incoming.sparkSession, root.rstrip("/")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    incoming = cut_lineage(latest_per_key(incoming, keys, [order]), "incoming")  # asked twice: a batch of a stream must not be worked out again
    touched = sorted(r.b for r in incoming.select(bucket.alias("b")).distinct().collect())  # no more than there are buckets
    if not touched:
        return
    held = _folders(spark, root, batch, touched)
    merged = upsert(spark.read.schema(incoming.schema).parquet(*held), incoming, keys, order) if held else incoming
    merged.withColumn("bucket", bucket).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch}")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{root}/index/batch={batch}")


def read_buckets(spark: SparkSession, root: str, schema) -> DataFrame:
    """The table as it is: one row a key, from one folder a bucket."""
    folders = _folders(spark, root.rstrip("/"), None)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def drop_superseded(spark: SparkSession, root: str) -> int:
    """Removes the folders of buckets that a later batch has written anew; returns how many went. For times without readers."""
    root, kept, gone = root.rstrip("/"), set(_folders(spark, root.rstrip("/"), None)), 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in spark.read.schema("bucket int, batch long").parquet(f"{root}/index").select("bucket", "batch").distinct().toLocalIterator():
        path = f"{root}/data/batch={r.batch}/bucket={r.bucket}"
        if path not in kept:
            p = jvm.org.apache.hadoop.fs.Path(path)
            gone += bool(p.getFileSystem(conf).delete(p, True))
    return gone


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """An append-only table as its latest row per key."""
    return latest_per_key(spark.read.parquet(path), keys, order)


def learned_records(verdicts: DataFrame, vendor: Column, command: Column, category: Column, verdict: Column, documentation: Column) -> DataFrame:
    """Verdicts as documents of their own kind: marked as learned and never citable, so that they cannot pass for documentation."""
    head = F.split_part(command, F.lit(" "), F.lit(1))
    return verdicts.select(
        vendor.alias("vendor"),
        F.lit("ActiveLearning").alias("os_name"),
        F.lit("v_learned").alias("os_version"),
        F.lower(category).alias("topic"),
        F.coalesce(F.nullif(documentation, F.lit("")), F.concat(F.lit("Learned "), verdict, F.lit(" directive for "), category)).alias("concept_summary"),
        command.alias("example_commands"),
        F.array(F.struct(head.alias("parameter"), category.alias("description"))).alias("key_parameters"),
        F.array(F.concat(F.lit("show running-config | include "), head)).alias("verification_commands"),
        F.upper(verdict).alias("learned_verdict"),
        F.lit("operator_learned").alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(False).alias("citable"),
    )


def append_learned(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def freeze_baseline(metrics: DataFrame, failures: DataFrame, root: str) -> None:
    """Metrics and failure cases of a run, for later runs to be compared with."""
    metrics.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/metrics")
    failures.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/failures")
