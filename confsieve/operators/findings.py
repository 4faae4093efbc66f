"""Finding summaries and views. Every count is a conditional aggregate, so a status that does not occur still shows as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.functions.numbers import round_half_up
from confsieve.operators.rules import FAIL, NOT_APPLICABLE, PASS, REVIEW

SEVERITIES = ["critical", "high", "medium", "low", "info"]


def status_counts() -> list[Column]:
    s = F.col("status")
    return [F.count_if(s == v).alias(n) for v, n in ((PASS, "n_pass"), (FAIL, "n_fail"), (REVIEW, "n_review"), (NOT_APPLICABLE, "n_not_applicable"))]


def severity_counts() -> list[Column]:
    return [F.count_if((F.col("status") == FAIL) & (F.col("severity") == v)).alias(f"fail_{v}") for v in SEVERITIES]


def summarize(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, and by severity for failures, per group or over everything."""
    return (findings.groupBy(*by) if by else findings).agg(*status_counts(), *severity_counts())


def compliance_rate(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = F.count("*")
    return (findings.groupBy(*by) if by else findings).agg(
        total.alias("total"),
        *status_counts(),
        round_half_up(F.lit(100.0) * F.count_if(F.col("status") == PASS) / F.nullif(total, F.lit(0)), 0).alias("rate_pct"),
    )


def mission_counters(rows: DataFrame, unknown: Column) -> DataFrame:
    """One row: devices, unknown lines, failures by severity, and the status line. ``rows`` has one row a device with ``findings``
    (rules.findings_in_row); ``unknown`` is its number of unknown lines. Texts are read once, and one row a task is shuffled."""
    def failed(severity: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("findings", lambda f: (f["status"] == FAIL) & (f["severity"] == severity)))), F.lit(0)).alias(severity)

    one = rows.agg(F.count("*").alias("devices"), *[failed(v) for v in SEVERITIES], F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown_patterns"))
    # Fixed value: the status line.
    line = F.format_string(
        "Processed %d/%d devices | Unknown patterns: %d | Critical: %d  High: %d  Medium: %d  Low: %d",
        "devices", "devices", "unknown_patterns", "critical", "high", "medium", "low",
    )
    return one.withColumn("status_line", line)


def session_totals(findings: DataFrame, session: str, device: str) -> DataFrame:
    per_device = findings.groupBy(session, device).agg(F.count_if(F.col("status") == PASS).alias("p"), F.count_if(F.col("status") == FAIL).alias("f"))
    return per_device.groupBy(session).agg(F.count("*").alias("devices"), F.sum("p").alias("n_pass"), F.sum("f").alias("n_fail"))


def select_devices(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted devices, or all of them when none of the wanted exists."""
    names = wanted.select(key).distinct()
    marked = df.join(names.withColumn("_wanted", F.lit(True)), key, "left")
    hits = df.join(names, key, "left_semi").limit(1).agg(F.count("*")).scalar()
    return marked.withColumn("_hits", hits).where(F.col("_wanted") | (F.col("_hits") == 0)).drop("_wanted", "_hits")


def grid(findings: DataFrame, device: Column | None = None, status: str | None = None, text: str | None = None, searched: list[str] | None = None) -> DataFrame:
    """The finding grid's filters: device, status, and a substring over the searched columns."""
    out = findings
    if device is not None:
        out = out.where(device)
    if status is not None:
        out = out.where(F.col("status") == status)
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", *(searched or []))), F.lit(text.lower())))
    return out


def failed_view(findings: DataFrame, rule_meta: DataFrame, fixes: DataFrame) -> DataFrame:
    """Failures with rule text and whether a fix is on file. Both lookups are keyed by rule; AQE broadcasts them when they are small."""
    known = fixes.select("rule_id").distinct().withColumn("_known", F.lit(True))
    return (
        findings.where(F.col("status") == FAIL)
        .join(rule_meta, "rule_id", "left")
        .join(known, "rule_id", "left")
        .withColumn("has_known_fix", F.col("_known").isNotNull())
        .drop("_known")
    )


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """A person's decision overwrites the status of the finding it names. ``verdicts`` has one row per key with ``decision``."""
    decided = F.when(F.col("decision") == "PASS", PASS).otherwise(FAIL)
    joined = findings.join(verdicts.select(*keys, "decision"), keys, "left")
    return (
        joined.withColumn("before_status", F.col("status"))
        .withColumn("status", F.when(F.col("decision").isNotNull(), decided).otherwise(F.col("status")))
        .withColumn("human_resolved", F.col("decision").isNotNull())
        .drop("decision")
    )


def first_and_last(findings: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Two finding sets out of a log: the first and the last status per key."""
    both = findings.groupBy(*keys).agg(F.min_by("status", order).alias("first"), F.max_by("status", order).alias("last"))
    return both.select(*keys, F.col("first").alias("status")), both.select(*keys, F.col("last").alias("status"))
