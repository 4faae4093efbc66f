"""Queries over stored evidence (line items): predicates, rule decisions, overrides, re-audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.catalog.fields import FIELD_TYPES
from confsieve.catalog.rules import RULES
from confsieve.functions.predicates import list_predicate, scalar_predicate
from confsieve.functions.tables import literal_rows
from confsieve.operators import extract as x
from confsieve.operators import findings as fi
from confsieve.operators import rules as ru
from confsieve.plans.adapters import (
    EVIDENCE_ORDER, EVIDENCE_SQL, PREDICATE_SQL, evidence, evidence_findings_sql, rules_sql, table,
)
from confsieve.plans.registry import query, text
from confsieve.session import run_folder
from confsieve.sources.configs import load_rules

USED = [r for r in RULES if r["field_path"] in {
    "management.telnet.enabled", "management.ssh.protocol_version", "authentication.password_policy.min_length", "cryptography.tls.min_version",
    "management.snmp.community_strings_default", "management.ssh.idle_timeout_seconds", "access_control.acl_rules[].is_any_any_permit", "logging.syslog.enabled"}]
# The same rules a version later: stricter numbers, another TLS list, the list rule turned round.
CHANGED = {"CIS-AUTH-02": 30, "CIS-MGMT-07": 300, "CIS-CRYPTO-02": ["1.3"]}
NEXT = [{**r, "expected": CHANGED.get(r["id"], r["expected"]), "operator": "list_all_true" if r["id"] == "CIS-ACL-01" else r["operator"]} for r in USED]


def packed(spark: SparkSession, d: str) -> DataFrame:
    return ru.pack_evidence(evidence(spark, d), ["device_id", "vendor"], EVIDENCE_ORDER)


PREDICATE_CASES = [
    {"rule_id": "p1", "field_path": "management.telnet.enabled", "operator": "equals", "expected": "disabled"},
    {"rule_id": "p2", "field_path": "management.telnet.enabled", "operator": "not_equals", "expected": "disabled"},
    {"rule_id": "p3", "field_path": "cryptography.tls.min_version", "operator": "in", "expected": ["1.2", "1.3"]},
    {"rule_id": "p4", "field_path": "cryptography.tls.min_version", "operator": "not_in", "expected": ["1.0"]},
    {"rule_id": "p5", "field_path": "authentication.password_policy.min_length", "operator": "greater_than_or_equal", "expected": 14},
    {"rule_id": "p6", "field_path": "authentication.password_policy.min_length", "operator": "less_than_or_equal", "expected": 20},
    {"rule_id": "p7", "field_path": "management.ssh.protocol_version", "operator": "in", "expected": [2]},
    {"rule_id": "p8", "field_path": "management.snmp.community_strings_default", "operator": "equals", "expected": False},
]
_CASES = [{**c, "id": c["rule_id"], "severity": "low", "minimum_confidence": 0.75, "require_explicit": True, "known_insecure_defaults": {}} for c in PREDICATE_CASES]


@query(
    "prj07_scalar_predicates",
    f"WITH {EVIDENCE_SQL}, {rules_sql(_CASES, FIELD_TYPES)} SELECT rule_id, field_path, op AS operator, count(*) AS evidence_rows, count(*) FILTER (WHERE {PREDICATE_SQL}) AS holds FROM evidence JOIN rules USING (field_path) GROUP BY ALL",
)
def predicates(spark: SparkSession, d: str) -> DataFrame:
    table_ = literal_rows(ru.rule_rows(_CASES, FIELD_TYPES), ru.RULE_TYPE)
    ev = evidence(spark, d)
    pairs = ev.select("field_path", F.struct("value_bool", "value_int", "value_str").alias("v")).select("v", F.explode_outer(F.filter(table_, lambda r: r["field_path"] == F.col("field_path"))).alias("r")).where(F.col("r").isNotNull())
    held = pairs.select(F.col("r.rule_id"), F.col("r.field_path"), F.col("r.operator"), scalar_predicate(F.col("v"), F.col("r")).alias("ok"))
    return held.groupBy("rule_id", "field_path", "operator").agg(F.count("*").alias("evidence_rows"), F.count_if("ok").alias("holds"))


@query(
    "prj08_list_predicates",
    f"WITH {EVIDENCE_SQL} SELECT d.device_id, coalesce(NOT any_true, true) AS none_true, coalesce(all_true, true) AS all_true FROM devices d LEFT JOIN lists USING (device_id)",
)
def list_predicates(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform("acl_items", lambda i: i["value_bool"])
    return packed(spark, d).select("device_id", list_predicate(values, F.lit("list_none_true")).alias("none_true"), list_predicate(values, F.lit("list_all_true")).alias("all_true"))


@query(
    "prj09_path_resolution",
    f"WITH {EVIDENCE_SQL} SELECT device_id, field_path, value_bool, value_int, value_str, explicit FROM scalars",
)
def paths(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).select("device_id", F.explode_outer("facts").alias("f")).where(F.col("f").isNotNull()).select("device_id", "f.field_path", "f.value_bool", "f.value_int", "f.value_str", "f.explicit")


@query("ext10_validation_flag", f"WITH {EVIDENCE_SQL} SELECT field_path, count(*) AS evidence_rows, count(*) FILTER (WHERE confidence < 0.75) AS needs_validation FROM evidence GROUP BY field_path")
def validation_flag(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).groupBy("field_path").agg(F.count("*").alias("evidence_rows"), F.count_if(F.col("confidence") < x.REVIEW_CONFIDENCE).alias("needs_validation"))


@query(
    "ext12_mapping_validation",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN 'management.telnet.enabled' WHEN 2 THEN 'management.ssh.protocol_version' WHEN 3 THEN 'logging.syslog.enabled'
   WHEN 4 THEN 'cryptography.tls.min_version' ELSE 'no.such.field' END AS field_path,
   CASE WHEN l_suppkey % 3 = 0 THEN 'enabled' WHEN l_suppkey % 3 = 1 THEN 'true' ELSE CAST(l_suppkey AS VARCHAR) END AS v FROM lineitem),
t AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'state' WHEN 2 THEN 'int' WHEN 3 THEN 'bool' WHEN 4 THEN 'str' END AS typ FROM m),
c AS (SELECT *, CASE typ WHEN 'state' THEN v IN ('enabled', 'disabled') WHEN 'int' THEN TRY_CAST(v AS BIGINT) IS NOT NULL WHEN 'bool' THEN v IN ('true', 'false') WHEN 'str' THEN true ELSE false END AS ok FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(typ, 'unknown') AS expected_type, ok AS valid,
  CASE WHEN typ IS NULL THEN 'unknown field path ' || field_path WHEN NOT ok THEN 'expected ' || typ || ', received ' || v END AS error FROM c""",
)
def mapping(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    path = F.when(n == 1, "management.telnet.enabled").when(n == 2, "management.ssh.protocol_version").when(n == 3, "logging.syslog.enabled").when(n == 4, "cryptography.tls.min_version").otherwise("no.such.field")
    value = F.when(s % 3 == 0, "enabled").when(s % 3 == 1, "true").otherwise(s.cast("string"))
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", path.alias("field_path"), value.alias("value"))
    return x.validate_mapping(m).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "expected_type", "valid", "error")


ALL_STATUS = f"WITH {EVIDENCE_SQL}, {evidence_findings_sql(USED, FIELD_TYPES)}"


@query("evl01_scalar_decisions", f"{ALL_STATUS} SELECT device_id, rule_id, status FROM findings WHERE field_path NOT LIKE '%[]%'")
def scalar(spark: SparkSession, d: str) -> DataFrame:
    return ru.evaluate(packed(spark, d), ["device_id"], [r for r in USED if "[]" not in r["field_path"]]).select("device_id", "rule_id", "status")


@query("evl02_list_decisions", f"{ALL_STATUS} SELECT device_id, rule_id, status FROM findings WHERE field_path LIKE '%[]%'")
def listed(spark: SparkSession, d: str) -> DataFrame:
    return ru.evaluate(packed(spark, d), ["device_id"], [r for r in USED if "[]" in r["field_path"]]).select("device_id", "rule_id", "status")


@query(
    "evl03_catalogue_evaluation",
    f"WITH {EVIDENCE_SQL}, {evidence_findings_sql(RULES, FIELD_TYPES)} SELECT vendor, rule_id, severity, status, count(*) AS findings FROM findings GROUP BY ALL",
)
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return ru.evaluate(packed(spark, d), ["device_id"]).groupBy("vendor", "rule_id", "severity", "status").agg(F.count("*").alias("findings"))


@query(
    "evl04_catalogue_use",
    f"WITH {EVIDENCE_SQL}, {rules_sql(RULES, FIELD_TYPES)} SELECT r.op AS operator, r.severity, count(DISTINCT r.rule_id) AS rules, count(e.device_id) AS evidence_rows FROM rules r LEFT JOIN evidence e USING (field_path) GROUP BY ALL",
)
def catalogue_use(spark: SparkSession, d: str) -> DataFrame:
    rows = ru.rule_rows()
    rules = spark.createDataFrame([(r["rule_id"], r["operator"], r["severity"], r["field_path"]) for r in rows], "rule_id string, operator string, severity string, field_path string")
    seen = evidence(spark, d).groupBy("field_path").agg(F.count("*").alias("n"))
    joined = rules.join(seen, "field_path", "left")
    return joined.groupBy("operator", "severity").agg(F.count("*").alias("rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_rows"))




@query(
    "evl06_re_audit",
    f"""WITH {EVIDENCE_SQL}, {evidence_findings_sql(USED, FIELD_TYPES, '_a')}, {evidence_findings_sql(NEXT, FIELD_TYPES, '_b')}
SELECT a.device_id, a.rule_id, a.status AS before_status, b.status AS after_status, a.status <> b.status AS changed FROM findings_a a JOIN findings_b b USING (device_id, rule_id)""",
)
def re_audit(spark: SparkSession, d: str) -> DataFrame:
    return ru.re_audit(packed(spark, d), ["device_id"], USED, NEXT)


REMEDIES_SQL = "remedies(rule_id, vendor, fix_command) AS (VALUES " + ", ".join(f"({text(r['rule_id'])}, {text(r['vendor'])}, {text(r['command'])})" for r in ru.remediation_rows()) + ")"


@query(
    "evl07_remediation_lookup",
    f"{ALL_STATUS}, {REMEDIES_SQL} SELECT rule_id, vendor, fix_command, count(*) AS findings FROM findings LEFT JOIN remedies USING (rule_id, vendor) WHERE status = 'fail' GROUP BY ALL",
)
def remediation(spark: SparkSession, d: str) -> DataFrame:
    failing = ru.evaluate(packed(spark, d), ["device_id"], USED).where("status = 'fail'")
    return ru.with_remediation(failing).groupBy("rule_id", "vendor", "fix_command").agg(F.count("*").alias("findings"))


CONFIRMED_SQL = """confirmed AS (SELECT l_orderkey AS device_id, 'management.telnet.enabled' AS field_path FROM lineitem WHERE l_quantity >= 45 GROUP BY l_orderkey)"""


@query(
    "knw08_confirmed_mappings",
    f"""{ALL_STATUS}, {CONFIRMED_SQL}
SELECT f.device_id, f.rule_id, CASE WHEN c.device_id IS NOT NULL AND f.rule_id = 'CIS-MGMT-01' THEN 'pass' ELSE f.status END AS status, c.device_id IS NOT NULL AS human
FROM findings f LEFT JOIN confirmed c ON c.device_id = f.device_id AND c.field_path = f.field_path""",
)
def confirmed(spark: SparkSession, d: str) -> DataFrame:
    ev = evidence(spark, d, "l_quantity")
    human = ev.where("l_quantity >= 45 AND device_id IS NOT NULL").select("device_id", "vendor").distinct().select(
        "device_id", "vendor", F.lit("management.telnet.enabled").alias("field_path"), F.lit(None).cast("boolean").alias("value_bool"), F.lit(None).cast("bigint").alias("value_int"), F.lit("disabled").alias("value_str")
    )
    extracted = ru.pack_evidence(ev.where("field_path IS NOT NULL"), ["device_id", "vendor"], EVIDENCE_ORDER)
    merged = ru.override_in_row(extracted, human, ["device_id", "vendor"])
    # ``human``: the rule reads a field that a person confirmed.
    found = ru.evaluate(merged, ["device_id", "confirmed_fields"], USED)
    return found.select("device_id", "rule_id", "status", F.array_contains("confirmed_fields", F.col("field_path")).alias("human"))


def catalogue_file(spark: SparkSession) -> str:
    """The rule catalogue as YAML with nested blocks, one file."""
    import yaml

    nested = [
        {
            "id": r["id"], "title": r["title"], "framework": r["framework"], "baseline_field_path": r["field_path"], "description": r["description"], "severity": r["severity"],
            "evaluation": {"operator": r["operator"], "expected": r["expected"]}, "evidence": {"minimum_confidence": r["minimum_confidence"], "require_explicit_configuration": r["require_explicit"]},
            "known_insecure_defaults": r["known_insecure_defaults"], "remediation": {v: {"command": c, "rationale": None} for v, c in r["remediation"].items()},
            "references": [{"benchmark": r["framework"], "control_id": None}, {"benchmark": "own", "control_id": r["id"]}],
        }
        for r in RULES
    ]
    path = f"{run_folder(spark, 'rules')}.yaml"
    spark.createDataFrame([(yaml.safe_dump({"rules": nested}, sort_keys=False),)], "value string").coalesce(1).write.text(path)
    return path


@query(
    "src07_rule_catalogue",
    f"WITH {rules_sql(RULES, FIELD_TYPES)}, {EVIDENCE_SQL} SELECT rule_id, severity, op AS operator, min_conf AS min_confidence, need_explicit AS require_explicit, 2 AS refs, (SELECT count(*) FROM evidence e WHERE e.field_path = rules.field_path AND e.confidence >= rules.min_conf) AS usable_rows FROM rules",
)
def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as a file with nested blocks and references, loaded, and met with the evidence that can be used."""
    loaded = load_rules(spark, catalogue_file(spark))
    refs = {r["id"]: len(r["references"]) for r in loaded}
    rows = ru.rule_rows(loaded)
    rules = spark.createDataFrame(
        [(r["rule_id"], r["severity"], r["operator"], float(r["min_confidence"]), r["require_explicit"], refs[r["rule_id"]], r["field_path"]) for r in rows],
        "rule_id string, severity string, operator string, min_confidence double, require_explicit boolean, refs int, field_path string",
    )
    # Confidence has few distinct values, so evidence shrinks to a count per (field, confidence) before it meets the rules.
    per_value = evidence(spark, d).groupBy("field_path", "confidence").agg(F.count("*").alias("n"))
    hit = rules.join(per_value, "field_path", "left").groupBy(rules.columns[:-1]).agg(F.coalesce(F.sum(F.when(F.col("confidence") >= F.col("min_confidence"), F.col("n"))), F.lit(0)).alias("usable_rows"))
    return hit


@query(
    "agg01_finding_summary",
    f"{ALL_STATUS} SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'needs_human_review') AS n_review, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable, "
    + ", ".join(f"count(*) FILTER (WHERE status = 'fail' AND severity = '{s}') AS fail_{s}" for s in fi.SEVERITIES)
    + " FROM findings",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    return fi.summarize(ru.evaluate(packed(spark, d), ["device_id"], USED))


