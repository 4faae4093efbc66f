"""Queries from document text to facts, findings and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.functions.numbers import round_half_up
from confsieve.operators import extract as x
from confsieve.operators import findings as fi
from confsieve.operators import fingerprint as fp
from confsieve.operators import rules as ru
from confsieve.plans.adapters import (
    DOC_BASE_SQL, DOC_FACTS_SQL, DOC_FIELD_TYPES, DOC_FINDINGS_SQL, DOC_GRAMMAR, DOC_RULES, DOC_SIGNATURES, PERMISSIVE_SQL, UNKNOWN_SQL,
    configs, rule_number_sql,
)
from confsieve.plans.registry import half_up, query, text


def matched(spark: SparkSession, d: str) -> DataFrame:
    return x.match_lines(fp.fingerprint(configs(spark, d), DOC_SIGNATURES), DOC_GRAMMAR)


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return x.emit_facts(matched(spark, d), DOC_GRAMMAR)


def doc_findings(spark: SparkSession, d: str) -> DataFrame:
    return ru.evaluate(extracted(spark, d), ["config_id", "filename", "truth", "source"], DOC_RULES, DOC_FIELD_TYPES)


@query(
    "fleet_scorecard",
    f"""WITH {DOC_FINDINGS_SQL} SELECT truth, rule_id, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail,
  count(*) FILTER (WHERE status = 'needs_human_review') AS n_review, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable,
  {half_up("100.0::DOUBLE * count(*) FILTER (WHERE status = 'pass') / count(*)", 0)} AS rate_pct FROM findings GROUP BY truth, rule_id""",
)
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Per language and hygiene rule: pass, fail, review, and the compliance rate."""
    return fi.compliance_rate(doc_findings(spark, d), ["truth", "rule_id"])


@query(
    "ext01_grammar_match",
    f"WITH {DOC_BASE_SQL}, m AS (SELECT l.config_id, l.line_no, {rule_number_sql('l.raw', 'd.vendor', DOC_GRAMMAR)} AS rule_no FROM lines l JOIN decided d USING (config_id)) SELECT config_id, line_no, CAST(rule_no AS INTEGER) AS rule_no FROM m WHERE rule_no IS NOT NULL",
)
def grammar(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("config_id", F.explode_outer("lines").alias("l")).where(F.col("l").isNotNull()).select("config_id", "l.line_no", "l.rule_no").where("rule_no IS NOT NULL")


@query("ext02_emitted_values", f"WITH {DOC_FACTS_SQL} SELECT config_id, line_no AS src_line, field_path, value_bool, value_int, value_str FROM facts")
def emitted(spark: SparkSession, d: str) -> DataFrame:
    return x.long_facts(extracted(spark, d), ["config_id"]).select("config_id", "src_line", "field_path", "value_bool", "value_int", "value_str")


N_VENDOR_RULES = len(DOC_GRAMMAR.vendor_rules)
N_FALLBACK = len(DOC_GRAMMAR.fallback_rules)


@query(
    "ext03_fallback_grammar",
    f"WITH {DOC_FACTS_SQL} SELECT config_id, line_no, field_path FROM facts WHERE rule_no >= {N_VENDOR_RULES} AND rule_no < {N_VENDOR_RULES + N_FALLBACK}",
)
def fallback(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_rows

    paths = literal_rows([r[1] for r in DOC_GRAMMAR.fallback_rules], "string")
    lines = matched(spark, d).select("config_id", F.explode_outer("lines").alias("l")).where(F.col("l").isNotNull()).select("config_id", "l.line_no", (F.col("l.rule_no") - N_VENDOR_RULES).alias("n"))
    return lines.where(F.col("n").between(0, N_FALLBACK - 1)).select("config_id", "line_no", F.element_at(paths, F.col("n") + 1).alias("field_path"))


@query("ext04_keyword_fallback", f"WITH {DOC_FACTS_SQL} SELECT config_id, line_no, field_path FROM facts WHERE rule_no >= {N_VENDOR_RULES + N_FALLBACK}")
def keyword(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_rows

    paths = literal_rows([r[2] for r in DOC_GRAMMAR.keyword_rules], "string")
    lines = matched(spark, d).select("config_id", F.explode_outer("lines").alias("l")).where(F.col("l").isNotNull()).select("config_id", "l.line_no", (F.col("l.rule_no") - N_VENDOR_RULES - N_FALLBACK).alias("n"))
    return lines.where("n >= 0").select("config_id", "line_no", F.element_at(paths, F.col("n") + 1).alias("field_path"))


@query("ext05_permissive_flag", f"WITH {DOC_BASE_SQL} SELECT config_id, coalesce(bool_or({PERMISSIVE_SQL}), false) AS permissive FROM doc LEFT JOIN lines USING (config_id) GROUP BY config_id")
def permissive(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d).select("config_id", (F.size("acl_items") > 0).alias("permissive"))


@query("ext06_unknown_lines", f"WITH {DOC_FACTS_SQL}, {UNKNOWN_SQL} SELECT config_id, line_no, md5(raw) AS raw_md5 FROM unknowns")
def unknown(spark: SparkSession, d: str) -> DataFrame:
    return x.unknown_lines(matched(spark, d), ["config_id"], DOC_GRAMMAR).select("config_id", "line_no", F.md5("raw").alias("raw_md5"))


@query("ext07_last_write_wins", f"WITH {DOC_FACTS_SQL} SELECT config_id, field_path, line_no AS src_line, value_bool, value_int, value_str FROM latest")
def last_write(spark: SparkSession, d: str) -> DataFrame:
    return x.latest_facts(extracted(spark, d), ["config_id"]).select("config_id", "field_path", "src_line", "value_bool", "value_int", "value_str")


SCALAR_PATHS = [p for p in DOC_FIELD_TYPES if "[]" not in p]
CATALOGUE_SQL = "fields(field_path) AS (VALUES " + ", ".join(f"({text(p)})" for p in SCALAR_PATHS) + ")"


@query(
    "ext08_baseline",
    f"""WITH {DOC_FACTS_SQL}, {CATALOGUE_SQL} SELECT d.config_id, f.field_path, l.value_bool, l.value_int, l.value_str, l.config_id IS NOT NULL AS explicit,
  CASE WHEN l.config_id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS confidence, CASE WHEN l.config_id IS NULL THEN 'default_assumed' ELSE 'deterministic_parser' END AS method
FROM doc d CROSS JOIN fields f LEFT JOIN latest l ON l.config_id = d.config_id AND l.field_path = f.field_path""",
)
def baseline(spark: SparkSession, d: str) -> DataFrame:
    b = x.baseline(extracted(spark, d), ["config_id"], DOC_FIELD_TYPES)
    return b.select("config_id", "field_path", "value_bool", "value_int", "value_str", "explicit", "confidence", "method")


@query("ext09_overall_confidence", f"WITH {DOC_FACTS_SQL} SELECT d.config_id, CASE WHEN count(l.config_id) = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS overall, count(l.config_id) AS fields FROM doc d LEFT JOIN latest l USING (config_id) GROUP BY d.config_id")
def overall(spark: SparkSession, d: str) -> DataFrame:
    distinct = F.size(F.array_distinct(F.transform("facts", lambda f: f["field_path"]))).cast("bigint")
    return extracted(spark, d).select("config_id", x.overall_confidence(F.col("facts")).alias("overall"), distinct.alias("fields"))


@query("jon02_document_findings", f"WITH {DOC_FINDINGS_SQL} SELECT config_id, vendor, rule_id, severity, status, src_line, confidence FROM findings")
def every_finding(spark: SparkSession, d: str) -> DataFrame:
    return doc_findings(spark, d).select("config_id", "vendor", "rule_id", "severity", "status", "src_line", "confidence")


@query(
    "agg03_device_counts",
    f"""WITH {DOC_FINDINGS_SQL} SELECT config_id, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'needs_human_review') AS n_review,
  count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable, {', '.join(f"count(*) FILTER (WHERE status = 'fail' AND severity = '{s}') AS fail_{s}" for s in fi.SEVERITIES)} FROM findings GROUP BY config_id""",
)
def device_counts(spark: SparkSession, d: str) -> DataFrame:
    return fi.summarize(doc_findings(spark, d), ["config_id"])


@query(
    "agg04_mission_counters",
    f"""WITH {DOC_FINDINGS_SQL}, {UNKNOWN_SQL}, c AS (SELECT count(DISTINCT config_id) AS devices, {', '.join(f"count(*) FILTER (WHERE status = 'fail' AND severity = '{s}') AS {s}" for s in fi.SEVERITIES)},
  (SELECT count(*) FROM unknowns) AS unknown_patterns FROM findings)
SELECT *, 'Processed ' || devices || '/' || devices || ' devices | Unknown patterns: ' || unknown_patterns || ' | Critical: ' || critical || '  High: ' || high || '  Medium: ' || medium || '  Low: ' || low AS status_line FROM c""",
)
def counters(spark: SparkSession, d: str) -> DataFrame:
    rows = ru.findings_in_row(extracted(spark, d), DOC_RULES, DOC_FIELD_TYPES)
    return fi.mission_counters(rows, x.unknown_count(DOC_GRAMMAR))


@query(
    "agg13_status_distribution",
    f"WITH {DOC_FINDINGS_SQL} SELECT vendor, status, count(*) AS findings FROM findings GROUP BY vendor, status",
)
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return doc_findings(spark, d).groupBy("vendor", "status").agg(F.count("*").alias("findings"))


@query(
    "ext11_calibrated_confidence",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10.0::DOUBLE AS sim, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS certainty, l_linestatus = 'O' AS fits, l_tax * 12.0::DOUBLE AS vc FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN certainty >= 1.0 THEN 1.0::DOUBLE ELSE {half_up("least(greatest(0.5::DOUBLE * sim + 0.2::DOUBLE * (CASE WHEN fits THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) + 0.3::DOUBLE * vc, 0.0::DOUBLE), 1.0::DOUBLE)", 4)} END AS confidence FROM s""",
)
def calibrated(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.plans.adapters import table

    li = table(spark, d, "lineitem")
    value = x.calibrated_confidence(
        F.col("l_discount") * 10.0, F.when(F.col("l_returnflag") == "A", F.lit(1.0)).otherwise(0.0), F.col("l_linestatus") == "O", F.col("l_tax") * 12.0
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("confidence"))


@query(
    "jon15_findings_with_rule_text",
    f"""WITH {DOC_FINDINGS_SQL}, meta(rule_id, title) AS (VALUES {', '.join(f"({text(r['id'])}, {text(r['title'])})" for r in DOC_RULES)})
SELECT truth, rule_id, title, status, count(*) AS findings FROM findings JOIN meta USING (rule_id) GROUP BY ALL""",
)
def with_text(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.operators.review import rule_attribute

    shown = doc_findings(spark, d).withColumn("title", rule_attribute(F.col("rule_id"), "title", DOC_RULES))
    return shown.groupBy("truth", "rule_id", "title", "status").agg(F.count("*").alias("findings"))


@query(
    "doc_nested_baseline",
    f"""WITH {DOC_FACTS_SQL}, h AS (SELECT config_id, value_int FROM latest WHERE field_path = 'content.email.host'), s AS (SELECT config_id, value_str FROM latest WHERE field_path = 'content.secret.state')
SELECT d.config_id, h.value_int AS email_host, s.value_str AS secret_state, CASE WHEN s.config_id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS secret_confidence FROM doc d LEFT JOIN h USING (config_id) LEFT JOIN s USING (config_id)""",
)
def nested(spark: SparkSession, d: str) -> DataFrame:
    n = x.nested_baseline(x.baseline(extracted(spark, d), ["config_id"], DOC_FIELD_TYPES), ["config_id"], DOC_FIELD_TYPES)
    return n.select("config_id", F.col("content.email.host.value_int").alias("email_host"), F.col("content.secret.state.value_str").alias("secret_state"), F.col("content.secret.state.confidence").alias("secret_confidence"))


@query(
    "agg02_compliance_by_source",
    f"""WITH {DOC_FINDINGS_SQL} SELECT d.source, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS n_pass, {half_up("100.0::DOUBLE * count(*) FILTER (WHERE status = 'pass') / count(*)", 2)} AS rate FROM findings JOIN doc d USING (config_id) GROUP BY d.source""",
)
def by_source(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status") == "pass"
    return doc_findings(spark, d).groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(s).alias("n_pass"), round_half_up(F.lit(100.0) * F.count_if(s) / F.count("*"), 2).alias("rate")
    )
