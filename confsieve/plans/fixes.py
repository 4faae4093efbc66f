"""Queries of the remediation flow: proposals, application, gates, promotion, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.functions.digest import sha256
from confsieve.functions.numbers import round_half_up
from confsieve.operators import findings as fi
from confsieve.operators import remediation as rem
from confsieve.operators import report as rep
from confsieve.operators import rules as ru
from confsieve.plans.adapters import DOC_BASE_SQL, DOC_SIGNATURES, DOC_SQL, FIELD_OF, ORDERS_SQL, configs, findings, table
from confsieve.plans.evidences import REMEDIES_SQL
from confsieve.plans.registry import half_up, query, text
from confsieve.session import cut_lineage, run_folder

FIELD_SQL = "CASE rule_id " + " ".join(f"WHEN {text(k)} THEN {text(FIELD_OF[k])}" for k in ("CIS-MGMT-01", "CIS-MGMT-02", "CIS-AUTH-01", "CIS-LOG-01", "CIS-CRYPTO-01", "CIS-AUTH-02")) + " END"


def order_findings(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_map

    return findings(spark, d).withColumn("field_path", F.try_element_at(literal_map(FIELD_OF), F.col("rule_id")))


# ---- proposals --------------------------------------------------------------------------------------------------------------------------

_TABLE_ROWS = ", ".join(f"({text(r)}, {text(v)}, {text(a)}, {text(x)})" for r, v, a, _p, x in rem.FIXES)
FIXES_SQL = f"""{ORDERS_SQL}, fixes(rule_id, part, action, replacement) AS (VALUES {_TABLE_ROWS}),
failing AS (SELECT *, CASE WHEN contains(vendor, 'cisco') THEN 'cisco' WHEN contains(vendor, 'juniper') THEN 'juniper' WHEN contains(vendor, 'huawei') THEN 'huawei' END AS grp FROM findings WHERE status = 'fail'),
proposed AS (SELECT f.device_id, f.seq, f.rule_id, f.vendor, coalesce(own.action, gen.action) AS action, coalesce(own.replacement, gen.replacement) AS replacement
  FROM failing f LEFT JOIN fixes own ON own.rule_id = f.rule_id AND own.part = f.grp LEFT JOIN fixes gen ON gen.rule_id = f.rule_id AND gen.part = 'generic')"""


@query("rem01_fix_proposals", f"WITH {FIXES_SQL} SELECT seq, rule_id, vendor, action, replacement, 0.88::DOUBLE AS confidence FROM proposed WHERE action IS NOT NULL")
def proposals(spark: SparkSession, d: str) -> DataFrame:
    return rem.propose_fixes(order_findings(spark, d), ["seq"]).select("seq", "rule_id", "vendor", "action", "replacement", "confidence")


# A catalogue with too few rule fixes, so that the field and grammar levels have to step in.
SECOND = rem.fix_rows(
    [f for f in rem.FIXES if f[0] == "CIS-MGMT-01"],
    rem.FIELD_FIXES,
    [("syslog.enabled", "juniper", "set system syslog host"), ("syslog.enabled", "juniper", "set system syslog archive"), ("syslog.enabled", "juniper", "set system syslog third"), ("ssh.protocol_version", "huawei", "stelnet server enable")],
)


@query(
    "rem02_fallback_fixes",
    f"""WITH {FIXES_SQL}, second AS (
  SELECT seq, rule_id, 0.88::DOUBLE AS confidence, replacement FROM proposed WHERE rule_id = 'CIS-MGMT-01'
  UNION ALL SELECT seq, rule_id, 0.75, CASE rule_id WHEN 'CIS-MGMT-02' THEN 'ip ssh version 2' WHEN 'CIS-AUTH-01' THEN 'service password-encryption' ELSE 'logging host 10.0.0.100' || chr(10) || 'logging on' END FROM failing WHERE grp = 'cisco' AND rule_id IN ('CIS-MGMT-02', 'CIS-AUTH-01', 'CIS-LOG-01')
  UNION ALL SELECT seq, rule_id, 0.85, unnest(['set system syslog host', 'set system syslog archive']) FROM failing WHERE grp = 'juniper' AND rule_id = 'CIS-LOG-01'
  UNION ALL SELECT seq, rule_id, 0.85, 'stelnet server enable' FROM failing WHERE grp = 'huawei' AND rule_id = 'CIS-MGMT-02') SELECT * FROM second""",
)
def fallbacks(spark: SparkSession, d: str) -> DataFrame:
    return rem.propose_fixes(order_findings(spark, d), ["seq"], SECOND).select("seq", "rule_id", "confidence", "replacement")


@query("rem03_batch_proposals", f"WITH {FIXES_SQL} SELECT device_id, rule_id, count(*) AS fixes, min(replacement) AS first_fix FROM proposed WHERE action IS NOT NULL GROUP BY ALL")
def batch(spark: SparkSession, d: str) -> DataFrame:
    """Fixes grouped by device and rule: their number and the first text; the fixes themselves stay rows."""
    fixes = rem.propose_fixes(order_findings(spark, d), ["device_id", "seq"])
    return fixes.groupBy("device_id", "rule_id").agg(F.count("*").alias("fixes"), F.min("replacement").alias("first_fix"))


CONF_SQL = "least(1.0::DOUBLE, (0.5::DOUBLE + l_discount * 5.0::DOUBLE) * CASE WHEN l_returnflag = 'R' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)"


@query("agg23_fix_confidence", f"SELECT l_orderkey, count(*) AS fixes, {half_up(f'sum(round({CONF_SQL} * 1048576) / 1048576.0::DOUBLE) / count(*)', 3)} AS fix_confidence FROM lineitem GROUP BY l_orderkey")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", (F.lit(0.5) + F.col("l_discount") * 5.0).alias("confidence"), (F.col("l_returnflag") == "R").alias("vendor_specific"))
    raised = F.least(F.lit(1.0), F.col("confidence") * F.when(F.col("vendor_specific"), 1.1).otherwise(1.0))
    # On a binary grid first: the sum then does not depend on the order of the rows.
    gridded = li.select("l_orderkey", (F.round(raised * 1048576) / 1048576.0).alias("confidence"), F.lit(False).alias("vendor_specific"))
    return rem.fix_set_confidence(gridded, ["l_orderkey"])


# ---- application ----------------------------------------------------------------------------------------------------------------------------

EDITS = [
    {"action": "replace", "pattern": "worthless", "replacement": "worthwhile $1"},
    {"action": "replace", "pattern": "^no such line$", "replacement": "added line"},
    {"action": "delete", "pattern": "[#][#][#]", "replacement": ""},
    {"action": "delete", "pattern": "zzzz", "replacement": ""},
    {"action": "append", "pattern": None, "replacement": "end"},
]
S1 = "CASE WHEN replace(raw_text, 'worthless', 'worthwhile $1') <> raw_text THEN replace(raw_text, 'worthless', 'worthwhile $1') ELSE raw_text || chr(10) || 'worthwhile $1' || chr(10) END"
APPLIED_SQL = f"""{DOC_SQL}, s1 AS (SELECT *, {S1} AS t1 FROM doc), s2 AS (SELECT *, t1 || chr(10) || 'added line' || chr(10) AS t2 FROM s1), applied AS (SELECT *, replace(t2, '###', '') || chr(10) || 'end' || chr(10) AS candidate FROM s2)"""


def applied(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_rows

    fixes = literal_rows(EDITS, "struct<action:string,pattern:string,replacement:string>")
    return rem.apply_fixes(configs(spark, d).withColumn("fixes", fixes), "fixes", "raw_text")


@query("rem04_applied_fixes", f"WITH {APPLIED_SQL} SELECT config_id, sha256(raw_text) AS original_hash, sha256(candidate) AS candidate_hash FROM applied")
def application(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, d).select("config_id", "original_hash", "candidate_hash")


@query("win07_sequential_edits", f"WITH {APPLIED_SQL} SELECT config_id, CAST(length(candidate) AS INTEGER) AS candidate_length, md5(candidate) AS candidate_md5 FROM applied")
def edits(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, d).select("config_id", F.length("candidate_text").alias("candidate_length"), F.md5("candidate_text").alias("candidate_md5"))


@query(
    "rem12_line_diff",
    f"""WITH {APPLIED_SQL}, a AS (SELECT config_id, unnest(CASE WHEN raw_text[-1:] = chr(10) THEN string_split(raw_text[1:length(raw_text) - 1], chr(10)) ELSE string_split(raw_text, chr(10)) END) AS line FROM applied WHERE raw_text <> ''),
b AS (SELECT config_id, unnest(string_split(candidate[1:length(candidate) - 1], chr(10))) AS line FROM applied),
n AS (SELECT config_id, line, sum(s) AS delta FROM (SELECT config_id, line, -1 AS s FROM a UNION ALL SELECT config_id, line, 1 FROM b) GROUP BY ALL)
SELECT config_id, CASE WHEN delta > 0 THEN '+' ELSE '-' END AS side, md5(line) AS line_md5, CAST(abs(delta) AS BIGINT) AS times FROM n WHERE delta <> 0""",
)
def diff(spark: SparkSession, d: str) -> DataFrame:
    return rem.line_diff(applied(spark, d), ["config_id"], "raw_text", "candidate_text").select("config_id", "side", F.md5("line").alias("line_md5"), "times")


VENDOR_SQL = "CASE config_id % 4 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'juniper_junos' WHEN 2 THEN 'fortinet_fortios' ELSE 'vyos' END"
BENT_SQL = "CASE WHEN config_id % 5 = 0 THEN raw_text || '{' WHEN config_id % 5 = 1 THEN raw_text || ' config [x' WHEN config_id % 97 = 2 THEN '  ' ELSE raw_text END"


@query(
    "rem05_structure_errors",
    f"""WITH {DOC_BASE_SQL}, c AS (SELECT doc.config_id, d.vendor AS found, {VENDOR_SQL.replace('config_id', 'doc.config_id')} AS v, {BENT_SQL.replace('config_id', 'doc.config_id').replace('raw_text', 'doc.raw_text')} AS t FROM doc JOIN decided d USING (config_id)),
n AS (SELECT *, length(t) - length(replace(t, '{{', '')) AS ob, length(t) - length(replace(t, '}}', '')) AS cb, length(t) - length(replace(t, '[', '')) AS os, length(t) - length(replace(t, ']', '')) AS cs,
  (length(t) - length(replace(lower(t), 'config ', ''))) / 7.0 AS nc, (length(t) - length(replace(lower(t), chr(10) || 'end', ''))) / 4.0 AS ne FROM c)
SELECT config_id, CASE WHEN trim(t) = '' THEN 'empty configuration' WHEN found = 'unknown' AND length(t) > 100 THEN 'structure not recognised' ELSE concat_ws('; ', CASE WHEN v LIKE 'cisco%' AND NOT contains(lower(t), 'end') THEN 'missing end statement' END,
  CASE WHEN (v LIKE 'cisco%' OR v LIKE 'juniper%') AND ob <> cb THEN 'unbalanced braces' END, CASE WHEN v LIKE 'juniper%' AND os <> cs THEN 'unbalanced brackets' END, CASE WHEN v LIKE 'fortinet%' AND nc > ne THEN 'config block without end' END) END AS errors FROM n""",
)
def structure(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.operators.fingerprint import fingerprint

    c = fingerprint(configs(spark, d), DOC_SIGNATURES).withColumnRenamed("vendor", "found")
    n = F.col("config_id")
    vendor = F.when(n % 4 == 0, "cisco_ios").when(n % 4 == 1, "juniper_junos").when(n % 4 == 2, "fortinet_fortios").otherwise("vyos")
    bent = F.when(n % 5 == 0, F.concat("raw_text", F.lit("{"))).when(n % 5 == 1, F.concat("raw_text", F.lit(" config [x"))).when(n % 97 == 2, "  ").otherwise(F.col("raw_text"))
    return c.select("config_id", F.array_join(rem.structure_errors(bent, vendor, F.col("found")), "; ").alias("errors"))


# ---- gates ------------------------------------------------------------------------------------------------------------------------------------
# A run is a device; its first finding per rule is the original, its last since CANDIDATES_FROM the candidate. Every order is also an audit of the
# control that no priority stands for.

CANDIDATES_FROM = "1997-01-01"
CRITICAL_SQL = "(" + ", ".join(text(c) for c in rem.CRITICAL_CONTROLS) + ")"

SIDES_SQL = f"""{ORDERS_SQL}, audits AS (SELECT device_id, seq, rule_id, status, audited_at FROM findings UNION ALL SELECT o_custkey, o_orderkey, 'CIS-AUTH-02', CASE WHEN o_totalprice > 400000 THEN 'fail' ELSE 'pass' END, o_orderdate FROM orders),
o AS (SELECT device_id, rule_id, arg_min(status, seq) AS status FROM audits GROUP BY ALL), c AS (SELECT device_id, rule_id, arg_max(status, seq) AS status FROM audits WHERE audited_at >= TIMESTAMP '{CANDIDATES_FROM}' GROUP BY ALL),
targets AS (SELECT device_id, rule_id FROM o WHERE status = 'fail' UNION SELECT device_id, 'CIS-ACL-02' FROM o WHERE device_id % 5 = 0),
t AS (SELECT g.device_id, g.rule_id, o.status AS original_status, c.status AS candidate_status, CASE WHEN o.status IS NULL THEN 'target rule not found in original findings' WHEN o.status <> 'fail' THEN 'original was not failing' WHEN c.status IS NULL THEN 'rule not evaluated in candidate'
  WHEN c.status = 'pass' THEN 'fixed' WHEN c.status = 'not_applicable' THEN 'control no longer applicable' ELSE 'violation still present' END AS note FROM targets g LEFT JOIN o USING (device_id, rule_id) LEFT JOIN c USING (device_id, rule_id)),
tr AS (SELECT *, note IN ('original was not failing', 'fixed', 'control no longer applicable') AS resolved FROM t),
j AS (SELECT coalesce(o.device_id, c.device_id) AS device_id, coalesce(o.rule_id, c.rule_id) AS rule_id, o.status AS os, c.status AS cs FROM o FULL JOIN c ON o.device_id = c.device_id AND o.rule_id = c.rule_id),
reg AS (SELECT device_id, count(*) FILTER (WHERE os = 'pass' AND cs = 'fail') AS regressions, count(*) FILTER (WHERE os = 'fail' AND cs = 'pass') AS improvements, count(*) FILTER (WHERE os = 'fail' AND cs = 'pass' AND (rule_id LIKE 'CIS-MGMT%' OR rule_id LIKE 'CIS-AUTH%')) AS reviewable_improvements,
  count(*) FILTER (WHERE os = 'pass') AS before_pass, count(*) FILTER (WHERE os = 'fail') AS before_fail, count(*) FILTER (WHERE cs = 'pass') AS after_pass, count(*) FILTER (WHERE cs = 'fail') AS after_fail FROM j GROUP BY device_id),
inv AS (SELECT device_id, count(*) FILTER (WHERE status = 'fail' AND rule_id IN {CRITICAL_SQL}) AS failing_critical, {len(rem.CRITICAL_CONTROLS)} - count(*) FILTER (WHERE rule_id IN {CRITICAL_SQL}) AS missing_critical FROM c GROUP BY device_id),
tg AS (SELECT device_id, count(*) AS targets, count(*) FILTER (WHERE NOT resolved) AS unresolved, count(*) FILTER (WHERE resolved AND note <> 'fixed') AS edge_notes FROM tr GROUP BY device_id),
runs AS (SELECT DISTINCT device_id, CASE WHEN device_id % 17 = 0 THEN 1 ELSE 0 END AS structure_errors FROM o),
v0 AS (SELECT r.device_id, structure_errors, coalesce(targets, 0) AS targets, coalesce(unresolved, 0) AS unresolved, coalesce(edge_notes, 0) AS edge_notes, coalesce(regressions, 0) AS regressions, coalesce(improvements, 0) AS improvements, coalesce(reviewable_improvements, 0) AS reviewable_improvements,
  coalesce(before_pass, 0) AS before_pass, coalesce(before_fail, 0) AS before_fail, coalesce(after_pass, 0) AS after_pass, coalesce(after_fail, 0) AS after_fail, coalesce(failing_critical, 0) + coalesce(missing_critical, 0) AS violations FROM runs r LEFT JOIN tg USING (device_id) LEFT JOIN reg USING (device_id) LEFT JOIN inv USING (device_id)),
v AS (SELECT *, structure_errors = 0 AS syntax_valid, structure_errors = 0 AND unresolved = 0 AND regressions = 0 AND violations = 0 AS passed FROM v0),
vs AS (SELECT *, CASE WHEN NOT syntax_valid THEN 'the candidate is not well formed' WHEN passed THEN 'all gates held: solved ' || (targets - unresolved) || ' target(s), ' || improvements || ' control(s) better, none worse'
  ELSE 'held back: ' || concat_ws('; ', CASE WHEN unresolved > 0 THEN unresolved || ' target(s) still failing' END, CASE WHEN regressions > 0 THEN regressions || ' control(s) now failing' END, CASE WHEN violations > 0 THEN 'a critical control does not hold' END) END AS summary FROM v),
dec AS (SELECT *, CASE WHEN NOT passed THEN 'REJECTED' WHEN (reviewable_improvements > 0 OR edge_notes > 0) AND device_id % 2 <> 0 THEN 'DEFERRED' ELSE 'APPROVED' END AS decision FROM vs),
pro AS (SELECT *, passed AND reviewable_improvements = 0 AND edge_notes = 0 AS auto_promote, CASE decision WHEN 'REJECTED' THEN concat_ws(' | ', CASE WHEN NOT syntax_valid THEN 'not well formed (' || structure_errors || ' error(s))' END, CASE WHEN unresolved > 0 THEN 'targets not met (' || unresolved || ' left)' END,
   CASE WHEN regressions > 0 THEN 'controls made worse (' || regressions || ' now failing)' END, CASE WHEN violations > 0 THEN 'critical controls lost (' || violations || ')' END)
  WHEN 'DEFERRED' THEN CASE WHEN reviewable_improvements > 0 THEN 'management or login controls changed (' || reviewable_improvements || ' of them); a person decides' ELSE 'some targets met in an unusual way; a person decides' END
  ELSE 'All validation gates passed. Resolved ' || targets || ' target(s), ' || improvements || ' control(s) better, none worse.' || CASE WHEN device_id % 2 = 0 THEN ' A person overruled the gate.' ELSE '' END END AS rationale FROM dec)"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    length = table(spark, d, "orders").select(
        F.col("o_custkey").alias("device_id"), F.col("o_orderkey").alias("seq"), F.lit("CIS-AUTH-02").alias("rule_id"), F.when(F.col("o_totalprice") > 400000, "fail").otherwise("pass").alias("status"), F.col("o_orderdate").alias("audited_at")
    )
    f = findings(spark, d).select(length.columns).unionByName(length)
    first, _ = fi.first_and_last(f, ["device_id", "rule_id"], "seq")
    _, last = fi.first_and_last(f.where(F.col("audited_at") >= F.to_timestamp(F.lit(CANDIDATES_FROM))), ["device_id", "rule_id"], "seq")
    extra = first.where("device_id % 5 = 0").select("device_id", F.lit("CIS-ACL-02").alias("rule_id"))
    return first, last, first.where("status = 'fail'").select("device_id", "rule_id").unionByName(extra).distinct()


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    first, last, targets = sides(spark, d)
    runs = first.select("device_id").distinct().withColumn("structure_errors", F.when(F.col("device_id") % 17 == 0, 1).otherwise(0))
    return rem.verdict(
        runs, rem.target_resolution(targets, first, last, "device_id"), rem.regressions(first, last, "device_id"), rem.invariants(last, "device_id", list(rem.CRITICAL_CONTROLS)), "device_id"
    )


def promotions(spark: SparkSession, d: str) -> DataFrame:
    return rem.promotion(verdicts(spark, d), F.col("device_id") % 2 == 0)


@query("rem06_target_resolution", f"WITH {SIDES_SQL} SELECT device_id, rule_id, note, resolved FROM tr")
def resolution(spark: SparkSession, d: str) -> DataFrame:
    first, last, targets = sides(spark, d)
    return rem.target_resolution(targets, first, last, "device_id").select("device_id", "rule_id", "note", "resolved")


@query("jon04_target_sides", f"WITH {SIDES_SQL} SELECT device_id, rule_id, original_status, candidate_status FROM tr")
def target_sides(spark: SparkSession, d: str) -> DataFrame:
    first, last, targets = sides(spark, d)
    return rem.target_resolution(targets, first, last, "device_id").select("device_id", "rule_id", "original_status", "candidate_status")


@query("rem07_regressions", f"WITH {SIDES_SQL} SELECT device_id, regressions, improvements, before_pass, before_fail, after_pass, after_fail FROM reg")
def regressed(spark: SparkSession, d: str) -> DataFrame:
    first, last, _ = sides(spark, d)
    return rem.regressions(first, last, "device_id").drop("reviewable_improvements")


@query("jon03_matched_sides", f"WITH {SIDES_SQL} SELECT os AS before_status, cs AS after_status, count(*) AS rules FROM j WHERE os IS NOT NULL AND cs IS NOT NULL GROUP BY ALL")
def matched_sides(spark: SparkSession, d: str) -> DataFrame:
    first, last, _ = sides(spark, d)
    joined = first.withColumnRenamed("status", "before_status").join(last.withColumnRenamed("status", "after_status"), ["device_id", "rule_id"])
    return joined.groupBy("before_status", "after_status").agg(F.count("*").alias("rules"))


@query("rem08_invariants", f"WITH {SIDES_SQL} SELECT device_id, count(*) FILTER (WHERE status = 'fail' AND rule_id IN {CRITICAL_SQL}) AS failing_critical, {len(rem.CRITICAL_CONTROLS)} - count(*) FILTER (WHERE rule_id IN {CRITICAL_SQL}) AS missing_critical FROM c GROUP BY device_id")
def invariant(spark: SparkSession, d: str) -> DataFrame:
    _, last, _ = sides(spark, d)
    return rem.invariants(last, "device_id", list(rem.CRITICAL_CONTROLS))


@query("rem09_validation_verdict", f"WITH {SIDES_SQL} SELECT device_id, syntax_valid, passed, summary FROM vs")
def validation(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).select("device_id", "syntax_valid", "passed", "summary")


@query("rem10_promotion_decision", f"WITH {SIDES_SQL} SELECT device_id, decision, rationale, auto_promote FROM pro")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    return promotions(spark, d).select("device_id", "decision", "rationale", "auto_promote")


@query("rem11_promoted_versions", f"WITH {ORDERS_SQL}, p AS (SELECT device_id, seq FROM findings WHERE status = 'pass') SELECT device_id, seq, CASE WHEN seq = max(seq) OVER (PARTITION BY device_id) THEN 'current' ELSE 'archived' END AS state FROM p")
def promoted(spark: SparkSession, d: str) -> DataFrame:
    return rem.promoted_versions(findings(spark, d).where("status = 'pass'").select("device_id", "seq"), "device_id", "seq")


RUN_SQL = "CASE status WHEN 'pass' THEN CASE WHEN seq % 2 = 0 THEN 'promoted' ELSE 'passed' END WHEN 'fail' THEN 'failed' ELSE 'testing' END"


@query("agg22_run_outcomes", f"WITH {ORDERS_SQL}, r AS (SELECT {RUN_SQL} AS s FROM findings) SELECT count(*) AS runs, count(*) FILTER (WHERE s = 'promoted') AS promoted, count(*) FILTER (WHERE s = 'passed') AS passed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'testing') AS pending FROM r")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("status") == "pass", F.when(F.col("seq") % 2 == 0, "promoted").otherwise("passed")).when(F.col("status") == "fail", "failed").otherwise("testing")
    return rem.run_outcomes(findings(spark, d).withColumn("run_status", s), "run_status")


@query("srt07_recent_runs", f"WITH {ORDERS_SQL} SELECT seq, device_id, status FROM findings WHERE status = 'fail'")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where("status = 'fail'").select("seq", "device_id", "status").orderBy(F.desc("seq"))


# ---- reports ------------------------------------------------------------------------------------------------------------------------------------

SECTION_SQL = f"""{SIDES_SQL}, {REMEDIES_SQL}, lf AS (SELECT c.device_id, c.rule_id, c.status, CASE c.device_id % 3 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'juniper_junos' ELSE 'huawei_vrp' END AS vendor, {FIELD_SQL} AS field_path,
  CASE rule_id WHEN 'CIS-MGMT-01' THEN 'critical' WHEN 'CIS-MGMT-02' THEN 'high' WHEN 'CIS-AUTH-01' THEN 'medium' WHEN 'CIS-LOG-01' THEN 'low' WHEN 'CIS-AUTH-02' THEN 'high' ELSE 'info' END AS severity FROM c),
items AS (SELECT device_id, rule_id, severity, field_path, status, '  - `' || rule_id || '` (' || severity || ') — ' || field_path || CASE WHEN fix_command IS NULL THEN '' ELSE ' fix: ' || split_part(fix_command, chr(10), 1) END AS item FROM lf LEFT JOIN remedies USING (rule_id, vendor)),
sections AS (SELECT device_id, count(*) FILTER (WHERE status = 'fail') AS failing, count(*) AS evaluated, '- **' || device_id || '**: ' || count(*) FILTER (WHERE status = 'fail') || ' failing checks out of ' || count(*) || ' evaluated' || chr(10) || coalesce(string_agg(item, chr(10) ORDER BY item) FILTER (WHERE status = 'fail'), '') AS section FROM items GROUP BY device_id)"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_map
    from confsieve.plans.adapters import RULE_OF, SEVERITY_OF

    _, last, _ = sides(spark, d)
    severity = {RULE_OF[k]: v for k, v in SEVERITY_OF.items()} | {"CIS-AUTH-02": "high"}
    n = F.col("device_id") % 3
    full = last.withColumn("vendor", F.when(n == 0, "cisco_ios").when(n == 1, "juniper_junos").otherwise("huawei_vrp"))
    full = full.withColumn("field_path", F.try_element_at(literal_map(FIELD_OF), F.col("rule_id"))).withColumn("severity", F.try_element_at(literal_map(severity), F.col("rule_id")))
    return rep.device_sections(ru.with_remediation(full), "device_id")


@query("rpt01_fleet_report", f"WITH {SECTION_SQL} SELECT device_id, failing, evaluated, md5(section) AS section_md5 FROM sections")
def report(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("device_id", "failing", "evaluated", F.md5("section").alias("section_md5"))


@query("rpt02_parsed_report", f"WITH {SECTION_SQL} SELECT CAST(s.device_id AS VARCHAR) AS device, CAST(failing AS INTEGER) AS failing, CAST(evaluated AS INTEGER) AS evaluated, i.rule_id, upper(i.severity) AS severity, i.field_path FROM sections s LEFT JOIN items i ON i.device_id = s.device_id AND i.status = 'fail'")
def parsed(spark: SparkSession, d: str) -> DataFrame:
    return rep.parse_sections(sections(spark, d))


REVIEW_GROUPS_SQL = "groups AS (SELECT c_nationkey || '-' || c_mktsegment AS group_id, 'nation ' || c_nationkey AS vendor, count(*) AS devices, CASE WHEN avg(c_acctbal) > 4500 THEN 'pending' ELSE 'resolved' END AS status, 'segment ' || c_mktsegment AS raw FROM customer GROUP BY c_nationkey, c_mktsegment)"


@query(
    "rpt02_whole_report",
    f"""WITH {SECTION_SQL}, {REVIEW_GROUPS_SQL}
SELECT 'goal' AS kind, '' AS name, 'audit all devices' AS detail UNION ALL SELECT 'status', '', 'devices: ' || count(*) || ', failing: ' || sum(failing) FROM sections
UNION ALL SELECT 'device', CAST(device_id AS VARCHAR), failing || '/' || evaluated FROM sections UNION ALL SELECT 'finding', CAST(device_id AS VARCHAR), rule_id || '|' || upper(severity) || '|' || field_path FROM items WHERE status = 'fail'
UNION ALL SELECT 'review', vendor, devices || '|' || upper(status) || '|' || raw FROM groups""",
)
def whole_report(spark: SparkSession, d: str) -> DataFrame:
    """The fleet report written as text and parsed back: goal, status line, devices with their findings, review groups."""
    s = cut_lineage(sections(spark, d), "sections")
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("devices"), F.avg("c_acctbal").alias("mean"))
    groups = c.select(
        F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("group_id"), F.concat(F.lit("nation "), "c_nationkey").alias("vendor"), "devices",
        F.when(F.col("mean") > 4500, "pending").otherwise("resolved").alias("status"), F.concat(F.lit("segment "), "c_mktsegment").alias("raw"),
    )
    status = s.agg(F.concat(F.lit("devices: "), F.count("*"), F.lit(", failing: "), F.sum("failing")).alias("status_line"))
    path = run_folder(spark, "report")
    rep.write_report(rep.fleet_report("audit all devices", status, s, rep.review_sections(groups), "device_id", "group_id"), path)
    return rep.parse_report(rep.report_lines(spark, path))


@query("rpt03_remediation_sections", f"""WITH {SIDES_SQL}, t2 AS (SELECT device_id, concat_ws(chr(10), '## Remediation & Verification', '**Configuration:** ' || device_id || '.conf', '**Session ID:** ' || device_id, '#### Validation Gates',
  '- **Syntax Validation:** ' || CASE WHEN syntax_valid THEN 'PASS' ELSE 'FAIL' END, '- **Target Resolution:** ' || CASE WHEN unresolved = 0 THEN 'PASS' ELSE 'FAIL' END, '- **Regression Audit:** ' || CASE WHEN regressions = 0 THEN 'PASS' ELSE 'FAIL' END, '- **Security Invariants:** ' || CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END,
  '   - Before: ' || before_pass || ' PASS | ' || before_fail || ' FAIL', '   - After: ' || after_pass || ' PASS | ' || after_fail || ' FAIL', '#### Summary' || chr(10) || summary, '**Decision:** ' || decision || ' — ' || rationale,
  '**Outcome:** ' || CASE WHEN decision = 'APPROVED' THEN 'the candidate is now the configuration' WHEN passed THEN 'the candidate holds and waits' ELSE 'the candidate is held back' END) AS section FROM pro)
SELECT device_id, md5('# Report' || chr(10) || section || '## Audit Trail' || chr(10) || 'sealed') AS report_md5 FROM t2""")
def remediation_report(spark: SparkSession, d: str) -> DataFrame:
    p = promotions(spark, d).withColumn("file", F.concat(F.col("device_id").cast("string"), F.lit(".conf")))
    s = rep.remediation_sections(p, "device_id", "file")
    return s.select("device_id", F.md5(rep.insert_section(F.lit("# Report\n## Audit Trail\nsealed"), F.col("section"))).alias("report_md5"))


@query("led02_report_hashes", f"WITH {SECTION_SQL} SELECT device_id, sha256(section) AS report_hash FROM sections")
def report_hashes(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("device_id", sha256(F.col("section")).alias("report_hash"))


@query("agg02_device_rates", f"WITH {ORDERS_SQL} SELECT device_id, count(*) AS total, {half_up('''100.0::DOUBLE * count(*) FILTER (WHERE status = 'pass') / count(*)''', 1)} AS rate FROM findings GROUP BY device_id")
def device_rates(spark: SparkSession, d: str) -> DataFrame:
    ok = F.count_if(F.col("status") == "pass")
    return findings(spark, d).groupBy("device_id").agg(F.count("*").alias("total"), round_half_up(F.lit(100.0) * ok / F.count("*"), 1).alias("rate"))
