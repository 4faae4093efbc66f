"""Reports as ordered rows of text. One device's or one run's section is one row; a fleet report is those rows in order, never one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confsieve.operators.rules import FAIL

DEVICE_HEAD = r"^- \*\*(.+?)\*\*: (\d+) failing checks out of (\d+) evaluated"
FINDING_ITEM = r"- `([^`]+)` \((\w+)\) — (\S+)"
REVIEW_ITEM = r"^Vendor `([^`]+)` — pattern seen on (\d+) device\(s\) — status: (\w+)\n   Raw: `([^`]*)`"
AUDIT_MARK = "## Audit Trail"


def device_sections(findings: DataFrame, device: str) -> DataFrame:
    """One text per device: the head line and its failing checks with their fix. A device has no more findings than there are rules."""
    item = F.concat(
        F.lit("  - `"), F.col("rule_id"), F.lit("` ("), F.col("severity"), F.lit(") — "), F.col("field_path"),
        F.when(F.col("fix_command").isNotNull(), F.concat(F.lit(" fix: "), F.split_part(F.col("fix_command"), F.lit("\n"), F.lit(1)))).otherwise(""),
    )
    per = findings.groupBy(device).agg(
        F.count_if(F.col("status") == FAIL).alias("failing"),
        F.count("*").alias("evaluated"),
        F.array_sort(F.collect_list(F.when(F.col("status") == FAIL, item))).alias("items"),
    )
    head = F.format_string("- **%s**: %d failing checks out of %d evaluated", F.col(device).cast("string"), F.col("failing"), F.col("evaluated"))
    return per.select(device, "failing", "evaluated", F.concat_ws("\n", head, F.array_join("items", "\n")).alias("section"))


def review_sections(groups: DataFrame) -> DataFrame:
    """One text per review group (group_id, vendor, devices, status, raw)."""
    text = F.format_string("Vendor `%s` — pattern seen on %d device(s) — status: %s\n   Raw: `%s`", "vendor", "devices", "status", "raw")
    return groups.select("group_id", text.alias("section"))


def fleet_report(goal: str, status_line: DataFrame, devices: DataFrame, reviews: DataFrame, device: str, group: str) -> DataFrame:
    """(part, position, section): write it sorted by part and position. ``status_line`` is one row."""
    head = status_line.select(
        F.lit(0).alias("part"), F.lit("").alias("position"),
        F.concat(F.lit(f"# Mission Report\n\n**Goal:** {goal}\n\n**Summary:** "), F.col("status_line")).alias("section"),
    )
    d = devices.select(F.lit(1).alias("part"), F.lpad(F.col(device).cast("string"), 20, "0").alias("position"), "section")
    r = reviews.select(F.lit(2).alias("part"), F.lpad(F.col(group).cast("string"), 20, "0").alias("position"), "section")
    return head.unionByName(d).unionByName(r)


def write_report(report: DataFrame, path: str) -> None:
    """The report as text files whose names and lines are in its order; it is sorted by ranges and never one string."""
    report.repartitionByRange("part", "position").sortWithinPartitions("part", "position").select("section").write.text(path)


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, line): the lines of a written report with their place. A long file may be read in several ranges (``start``)."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def parse_report(lines: DataFrame) -> DataFrame:
    """A written report back to rows (kind, name, detail): goal, status, device, finding and review.

    A line belongs to the last head above it. Heads are filled forward inside each range that was read; the last head of each range, one row
    a range, is carried over to the ranges after it."""
    x = F.col("line")
    vendor = r"^Vendor `([^`]+)` — pattern seen on (\d+) device\(s\) — status: (\w+)$"
    head = F.when(x.rlike(DEVICE_HEAD), F.regexp_extract(x, DEVICE_HEAD, 1)).when(x.rlike(vendor), x)
    marked = lines.withColumn("own", head)
    ranges = marked.groupBy("file", "start").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("last"))
    carried = ranges.withColumn("carried", F.last("last", True).over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumn("above", F.last("own", True).over(inside)).join(carried.drop("last"), ["file", "start"]).withColumn("above", F.coalesce("above", "carried"))
    item = F.concat_ws("|", F.regexp_extract(x, FINDING_ITEM, 1), F.upper(F.regexp_extract(x, FINDING_ITEM, 2)), F.regexp_extract(x, FINDING_ITEM, 3))
    raw, above = r"^   Raw: `([^`]*)`$", F.col("above")

    def made(kind: str, name: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))

    goal, summary, none = r"^\*\*Goal:\*\* (.*)$", r"^\*\*Summary:\*\* (.*)$", F.lit("")
    seen = F.concat_ws("|", F.regexp_extract(above, vendor, 2), F.upper(F.regexp_extract(above, vendor, 3)), F.regexp_extract(x, raw, 1))
    what = (
        F.when(x.rlike(goal), made("goal", none, F.regexp_extract(x, goal, 1)))
        .when(x.rlike(summary), made("status", none, F.regexp_extract(x, summary, 1)))
        .when(x.rlike(DEVICE_HEAD), made("device", above, F.concat_ws("/", F.regexp_extract(x, DEVICE_HEAD, 2), F.regexp_extract(x, DEVICE_HEAD, 3))))
        .when(x.rlike("^  " + FINDING_ITEM), made("finding", above, item))
        .when(x.rlike(raw), made("review", F.regexp_extract(above, vendor, 1), seen))
    )
    return filled.select(what.alias("w")).where(F.col("w").isNotNull()).select("w.*")


def parse_sections(sections: DataFrame) -> DataFrame:
    """Device sections back to rows: (device, failing, evaluated, rule_id, severity, field_path); devices without failures give one row."""
    s = F.col("section")
    heads = sections.where(s.rlike(DEVICE_HEAD)).select(
        F.regexp_extract(s, DEVICE_HEAD, 1).alias("device"),
        F.regexp_extract(s, DEVICE_HEAD, 2).cast("int").alias("failing"),
        F.regexp_extract(s, DEVICE_HEAD, 3).cast("int").alias("evaluated"),
        F.explode_outer(F.regexp_extract_all(s, F.lit(FINDING_ITEM), F.lit(0))).alias("item"),
    )
    i = F.col("item")
    return heads.select(
        "device", "failing", "evaluated",
        F.regexp_extract(i, FINDING_ITEM, 1).alias("rule_id"), F.upper(F.regexp_extract(i, FINDING_ITEM, 2)).alias("severity"), F.regexp_extract(i, FINDING_ITEM, 3).alias("field_path"),
    )


def parse_reviews(sections: DataFrame) -> DataFrame:
    s = F.col("section")
    return sections.where(s.rlike(REVIEW_ITEM)).select(
        F.regexp_extract(s, REVIEW_ITEM, 1).alias("vendor"), F.regexp_extract(s, REVIEW_ITEM, 2).cast("int").alias("devices"),
        F.upper(F.regexp_extract(s, REVIEW_ITEM, 3)).alias("status"), F.regexp_extract(s, REVIEW_ITEM, 4).alias("raw"),
    )


def _gate(name: str, ok: Column) -> Column:
    return F.concat(F.lit(f"- **{name}:** "), F.when(ok, "PASS").otherwise("FAIL"))


def remediation_sections(promoted: DataFrame, run: str, file: str) -> DataFrame:
    """One text per remediation run from its gate columns and its decision."""
    outcome = F.when(F.col("decision") == "APPROVED", "the candidate is now the configuration").when(F.col("passed"), "the candidate holds and waits").otherwise("the candidate is held back")
    text = F.concat_ws(
        "\n",
        F.lit("## Remediation & Verification"),
        F.concat(F.lit("**Configuration:** "), F.col(file).cast("string")),
        F.concat(F.lit("**Session ID:** "), F.col(run).cast("string")),
        F.lit("#### Validation Gates"),
        _gate("Syntax Validation", F.col("syntax_valid")),
        _gate("Target Resolution", F.col("unresolved") == 0),
        _gate("Regression Audit", F.col("regressions") == 0),
        _gate("Security Invariants", F.col("violations") == 0),
        F.concat(F.lit("   - Before: "), F.col("before_pass"), F.lit(" PASS | "), F.col("before_fail"), F.lit(" FAIL")),
        F.concat(F.lit("   - After: "), F.col("after_pass"), F.lit(" PASS | "), F.col("after_fail"), F.lit(" FAIL")),
        F.concat(F.lit("#### Summary\n"), F.col("summary")),
        F.concat(F.lit("**Decision:** "), F.col("decision"), F.lit(" — "), F.col("rationale")),
        F.concat(F.lit("**Outcome:** "), outcome),
    )
    return promoted.select(run, text.alias("section"))


def insert_section(report: Column, section: Column) -> Column:
    """Puts a section before the last audit-trail heading, else at the end."""
    at = F.length(report) - F.instr(F.reverse(report), AUDIT_MARK[::-1]) - len(AUDIT_MARK) + 2
    found = F.contains(report, F.lit(AUDIT_MARK))
    before, after = F.call_function("substring", report, F.lit(1), at - 1), F.call_function("substring", report, at, F.length(report))
    return F.when(found, F.concat(before, section, after)).otherwise(F.concat(report, F.lit("\n\n"), section))


def key_value_summary(row: DataFrame, title: str) -> DataFrame:
    """``### title`` and one bullet per column, for each row of a summary table."""
    bullets = [F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in row.columns]
    return row.select(F.concat_ws("\n", F.lit(f"### {title}"), *bullets).alias("summary"))
