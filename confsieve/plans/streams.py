"""The streaming forms, driven to the end of the given tables; each ends in the state a batch run over the same rows has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.operators import extract as x
from confsieve.operators import fingerprint as fp
from confsieve.operators import rules as ru
from confsieve.plans.adapters import DOC_FIELD_TYPES, DOC_FINDINGS_SQL, DOC_GRAMMAR, DOC_RULES, DOC_SIGNATURES, table
from confsieve.plans.logs import CHAIN_SQL
from confsieve.plans.registry import query
from confsieve.session import run_folder
from confsieve.sources.tables import read_buckets
from confsieve.streaming import audit


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the given tables as a file stream."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _audit(batch: DataFrame) -> DataFrame:
    facts = x.extract(fp.fingerprint(batch, DOC_SIGNATURES), DOC_GRAMMAR)
    return ru.evaluate(facts, ["config_id", "filename", "arrival"], DOC_RULES, DOC_FIELD_TYPES).select("config_id", "filename", "arrival", "rule_id", "severity", "status")


@query("str01_incremental_audit", f"WITH {DOC_FINDINGS_SQL} SELECT config_id, rule_id, status FROM findings")
def incremental(spark: SparkSession, d: str) -> DataFrame:
    docs = stream(spark, d, "documents").select(
        F.col("doc_id").alias("config_id"), F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".conf")).alias("filename"), F.col("text").alias("raw_text"), F.col("doc_id").alias("arrival")
    )
    root = run_folder(spark, "findings")
    audit.ingest_configs(docs, _audit, root, run_folder(spark, "checkpoint"), ["filename", "rule_id"]).awaitTermination()
    return read_buckets(spark, root, "config_id long, filename string, arrival long, rule_id string, severity string, status string").select("config_id", "rule_id", "status")


@query("str02_verdict_stream", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = stream(spark, d, "events").select("user_id", "event_type", "value", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    root = run_folder(spark, "verdicts")
    audit.verdict_table(e, ["user_id", "event_type"], "event_id", "ts", root, run_folder(spark, "checkpoint")).awaitTermination()
    return read_buckets(spark, root, e.schema).select("user_id", "event_type", "value", "event_id")


@query("str03_ledger_stream", f"WITH {CHAIN_SQL} SELECT chain, segment, block_hash FROM blocks")
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = stream(spark, d, "events").select("user_id", "event_id", micros.alias("ts_us"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    root = run_folder(spark, "ledger")
    audit.ledger_log(e, "user_id", "event_id", root, run_folder(spark, "checkpoint")).awaitTermination()
    return audit.current_blocks(spark, root).select("chain", "segment", "block_hash")


@query("str04_live_counters", "SELECT CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'needs_human_review' END AS status, o_orderpriority AS severity, count(*) AS findings FROM orders GROUP BY ALL")
def counters(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("needs_human_review")
    o = stream(spark, d, "orders").select(status.alias("status"), F.col("o_orderpriority").alias("severity"))
    root = run_folder(spark, "counters")
    audit.live_counters(o, ["status", "severity"], root, run_folder(spark, "checkpoint")).awaitTermination()
    return audit.current_counters(spark, root)
