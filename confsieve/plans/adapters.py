"""The given tables in the shape the operators take: documents as configurations, orders as findings, lineitem as evidence, events as logs.

Each adapter comes with the same mapping as SQL, for the oracle side. Catalogues for the document corpus (its languages are the
"vendors") are small and of our own making; they exercise the operators on texts that are not device configurations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.catalog.rules import RULES
from confsieve.operators.extract import Grammar
from confsieve.plans.registry import text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- documents as configurations ------------------------------------------------------------------------------------------------


def configs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("config_id"),
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".conf")).alias("filename"),
        F.col("text").alias("raw_text"),
        F.col("lang").alias("truth"),
        F.col("source"),
    )


BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DOC_SQL = "doc AS (SELECT doc_id AS config_id, source || '_' || doc_id || '.conf' AS filename, text AS raw_text, lang AS truth, source FROM documents)"
# Every line with its number, blank and comment lines included.
ALL_LINES_SQL = f"""{DOC_SQL},
parts AS (SELECT *, string_split_regex(raw_text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p0 FROM doc),
parts1 AS (SELECT * EXCLUDE p0, CASE WHEN p0[-1] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p FROM parts),
all_lines AS (SELECT config_id, filename, truth, source, CAST(i AS INTEGER) AS line_no, trim(p[i], {BLANKS_SQL}) AS raw
              FROM parts1, unnest(range(1, len(p) + 1)) AS t(i))"""
LINES_SQL = f"""{ALL_LINES_SQL},
lines AS (SELECT * FROM all_lines WHERE raw <> '' AND NOT starts_with(raw, '!') AND NOT starts_with(raw, '#'))"""

DOC_SIGNATURES = [
    {"vendor": "de", "strong": ["der", "die", "und"], "weak": ["von", "mit", "ein"], "contradicts": ["the", "que"]},
    {"vendor": "en", "strong": ["the", "and", "of"], "weak": ["that", "with", "is"], "exclude": ["und"], "structural": [["the", "of"]]},
    {"vendor": "es", "strong": ["el", "los", "ción"], "weak": ["de", "la", "que", "en"], "contradicts": ["le", "les"]},
    {"vendor": "fr", "strong": ["le", "les", "des"], "weak": ["de", "la", "que", "un", "eau"], "contradicts": ["el", "los"], "structural": [["le", "ment"], ["est", "des"]]},
]

DOC_FIELD_TYPES = {
    "content.license.present": "bool",
    "content.license.name": "str",
    "content.secret.state": "state",
    "content.secret.value": "str",
    "content.email.present": "bool",
    "content.email.host": "int",
    "content.digits.run": "int",
    "content.phone.seconds": "int",
    "content.link.present": "bool",
    "content.blocks[].is_permissive": "bool",
}
DOC_GRAMMAR = Grammar(
    vendor_rules=[
        ("en", r"licensed under the (\S+)", [("content.license.present", "const", True), ("content.license.name", "text", 1)]),
        ("en", r'token = "([0-9a-f]+)"', [("content.secret.state", "const", "enabled"), ("content.secret.value", "text", 1)]),
        ("en", r"\((\d\d\d)\) (\d\d\d)-", [("content.phone.seconds", "minutes_seconds", 1)]),
        ("en", r"@mail(\d+)\.", [("content.email.present", "const", True), ("content.email.host", "int", 1)]),
        ("de", r"@mail(\d+)\.", [("content.email.present", "const", True), ("content.email.host", "minutes", 1)]),
        ("de", r'token = "([0-9a-f]+)"', [("content.secret.state", "const", "enabled"), ("content.secret.value", "text_without", "ab")]),
        ("de", r"(\d{12,16})", [("content.digits.run", "int", 1)]),
        ("fr", r'token = "([0-9a-f]+)"', [("content.secret.state", "const", "enabled")]),
        ("fr", r"@mail(\d)\.", [("content.email.host", "int", 1), ("content.link.present", "known_default", 1)]),
        ("es", r"(\d{12,16})", [("content.digits.run", "int", 1)]),
    ],
    fallback_rules=[
        (r"licen[cs]e", "content.license.present", True, "Licensing"),
        (r'token = "', "content.secret.state", "enabled", "Secrets"),
        (r"@mail\d+", "content.email.present", True, "Contact"),
        (r"(\d{12,})", "content.digits.run", 600, "Numbers"),
        (r"\d+\.\d+\.\d+\.\d+", "content.address.present", True, "Network"),
    ],
    keyword_rules=[
        (["rights"], ["reserved", "all"], "content.license.present", True, "Licensing"),
        ([], ["worthless", "http"], "content.link.present", True, "Links"),
    ],
    security_keywords=["###", "***", " | ", "free", "menu"],
    known_default_words=["1", "3"],
    field_types=DOC_FIELD_TYPES,
    acl_path="content.blocks[].is_permissive",
    permissive_needle="the the",
    permissive_verbs=(" of", " is "),
)
DOC_RULES = [
    {"id": "DOC-LIC-01", "field_path": "content.license.present", "severity": "low", "operator": "equals", "expected": True, "known_insecure_defaults": {"fr": False, "es": True}},
    {"id": "DOC-LIC-02", "field_path": "content.license.name", "severity": "low", "operator": "in", "expected": ["GNU", "MIT", "Apache"]},
    {"id": "DOC-SEC-01", "field_path": "content.secret.state", "severity": "critical", "operator": "not_equals", "expected": "enabled"},
    {"id": "DOC-PII-01", "field_path": "content.email.host", "severity": "high", "operator": "less_than_or_equal", "expected": 5},
    {"id": "DOC-PII-02", "field_path": "content.digits.run", "severity": "high", "operator": "greater_than_or_equal", "expected": 4000000000000},
    {"id": "DOC-PII-03", "field_path": "content.phone.seconds", "severity": "medium", "operator": "less_than_or_equal", "expected": 30000},
    {"id": "DOC-PII-04", "field_path": "content.email.present", "severity": "medium", "operator": "equals", "expected": False},
    {"id": "DOC-ACL-01", "field_path": "content.blocks[].is_permissive", "severity": "critical", "operator": "list_none_true", "expected": True},
]
for _r in DOC_RULES:
    _r.setdefault("framework", "doc")
    _r.setdefault("title", _r["id"].replace("-", " ").title())
    _r.setdefault("minimum_confidence", 0.75)
    _r.setdefault("require_explicit", True)
    _r.setdefault("known_insecure_defaults", {})


def marker_sql(t: str, marker: str) -> str:
    """A marker in the lower-cased text ``t``: short words between non-word characters, others anywhere."""
    if len(marker) <= 5 and marker.isalnum():
        return f"regexp_matches({t}, '(^|[^a-z0-9]){marker}([^a-z0-9]|$)')"
    return f"contains({t}, {text(marker)})"


def _count(t: str, markers: list) -> str:
    return " + ".join(f"CAST({marker_sql(t, m)} AS INTEGER)" for m in markers) or "0"


def scores_sql(source: str, signatures: list) -> str:
    """(config_id, ordinal, vendor, score) for every signature with a score above zero."""
    parts = []
    for i, s in enumerate(signatures):
        strong, weak, groups = s.get("strong", []), s.get("weak", []), s.get("structural", [])
        grouped = " + ".join("CAST(" + " AND ".join(marker_sql("t", m) for m in g) + " AS INTEGER)" for g in groups) or "0"
        veto = " OR ".join(marker_sql("t", m) for m in s.get("exclude", [])) or "false"
        possible = 3 * len(strong) + len(weak) + 2 * len(groups)
        parts.append(
            f"SELECT config_id, {i} AS ordinal, {text(s['vendor'])} AS vendor, {veto} AS veto, {_count('t', strong)} AS n_s, {_count('t', weak)} AS n_w, "
            f"{grouped} AS n_g, {_count('t', s.get('contradicts', []))} AS n_c, {possible}::DOUBLE AS possible FROM low"
        )
    return f"""low AS (SELECT config_id, lower(raw_text) AS t FROM {source}),
evidence_counts AS ({' UNION ALL '.join(parts)}),
scores AS (SELECT * FROM (SELECT config_id, ordinal, vendor, CASE WHEN veto OR n_s + n_w + n_g = 0 THEN 0::DOUBLE
  ELSE greatest(0::DOUBLE, (3 * n_s + n_w + 2 * n_g)::DOUBLE / possible - 0.20::DOUBLE * n_c) END AS score FROM evidence_counts) WHERE score > 0)"""


def decision_sql(source: str, signatures: list, floor: float = 0.08) -> str:
    """CTEs up to ``decided`` (config_id, vendor, vendor_confidence, vendor_status, ...)."""
    return f"""{scores_sql(source, signatures)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY score DESC, ordinal) AS rk FROM scores),
tops AS (SELECT config_id, max(CASE WHEN rk = 1 THEN vendor END) AS v1, max(CASE WHEN rk = 1 THEN score END) AS s1,
         max(CASE WHEN rk = 2 THEN vendor END) AS v2, coalesce(max(CASE WHEN rk = 2 THEN score END), 0::DOUBLE) AS s2 FROM ranked GROUP BY config_id),
substantive AS (SELECT config_id, count(*) AS n_lines FROM all_lines WHERE raw <> '' AND NOT (starts_with(raw, '!') OR starts_with(raw, '#')
         OR starts_with(raw, '//') OR starts_with(raw, '/*') OR starts_with(raw, '<!--')) GROUP BY config_id),
decided AS (SELECT d.config_id, v1, s1, v2, s2, coalesce(n_lines, 0) AS n_lines, trim(d.raw_text, {BLANKS_SQL}) = '' AS empty,
         (s1 - s2) / s1 AS margin,
         CASE WHEN s1 IS NULL OR s1 < {floor}::DOUBLE THEN 'unknown' ELSE v1 END AS vendor
       FROM {source} d LEFT JOIN tops USING (config_id) LEFT JOIN substantive USING (config_id))"""


def rule_number_sql(raw: str, vendor: str, g: Grammar) -> str:
    """CASE expression with the number of the first rule that matches."""
    out, n = [], 0
    for name, pattern, _ in g.vendor_rules:
        out.append(f"WHEN {vendor} = {text(name)} AND regexp_matches({raw}, {text('(?i)' + pattern)}) THEN {n}")
        n += 1
    for pattern, *_ in g.fallback_rules:
        out.append(f"WHEN regexp_matches({raw}, {text('(?i)' + pattern)}) THEN {n}")
        n += 1
    for all_of, any_of, *_ in g.keyword_rules:
        cond = "(" + " OR ".join(f"contains(lower({raw}), {text(w)})" for w in any_of) + ")"
        for w in all_of:
            cond += f" AND contains(lower({raw}), {text(w)})"
        out.append(f"WHEN {cond} THEN {n}")
        n += 1
    return "CASE " + " ".join(out) + " END"


def emissions_sql(g: Grammar) -> str:
    """VALUES rows (rule_no, fact_no, path, typ, kind, arg, grp, pattern, category)."""
    rows, n = [], 0

    def kind_of(v: object) -> str:
        return "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "str"

    for _, pattern, facts in g.vendor_rules:
        for i, (path, kind, arg) in enumerate(facts):
            typ = {"const": kind_of(arg), "int": "int", "minutes": "int", "minutes_seconds": "int", "text": "str", "text_without": "str", "known_default": "bool"}[kind]
            rows.append((n, i, path, typ, kind, str(arg).lower() if isinstance(arg, bool) else str(arg), "(?i)" + pattern, None))
        n += 1
    for pattern, path, value, category in g.fallback_rules:
        rows.append((n, 0, path, kind_of(value), "const", str(value).lower() if isinstance(value, bool) else str(value), "(?i)" + pattern, category))
        n += 1
    for _, _, path, value, category in g.keyword_rules:
        rows.append((n, 0, path, kind_of(value), "const", str(value).lower() if isinstance(value, bool) else str(value), "", category))
        n += 1
    return "VALUES " + ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows)


def _capture(group: int, patterns: list) -> str:
    """DuckDB wants constant patterns, so the capture is spelled out per pattern."""
    return "CASE e.pattern " + " ".join(f"WHEN {text(p)} THEN regexp_extract(l.raw, {text(p)}, {group})" for p in patterns) + " END"


def facts_sql(g: Grammar, vendor: str = "vendor") -> str:
    """CTEs ``matched`` and ``facts`` over ``lines`` joined with ``decided``; one fact row per emission, typed."""
    patterns = ["(?i)" + p for _, p, _ in g.vendor_rules]
    g1, g2 = _capture(1, patterns), _capture(2, [p for p in patterns if p.count("(\\d\\d\\d)") == 2])
    words = ", ".join(text(w) for w in g.known_default_words)
    return f"""matched AS (SELECT l.*, d.vendor, {rule_number_sql('l.raw', 'd.vendor', g)} AS rule_no FROM lines l JOIN decided d USING (config_id)),
emissions(rule_no, fact_no, field_path, typ, kind, arg, pattern, category) AS ({emissions_sql(g)}),
captured AS (SELECT l.*, e.fact_no, e.field_path, e.typ, e.kind, e.arg, {g1} AS g1, {g2} AS g2 FROM matched l JOIN emissions e USING (rule_no)),
valued AS (SELECT *, CASE kind WHEN 'const' THEN arg WHEN 'int' THEN g1 WHEN 'text' THEN g1 WHEN 'minutes' THEN CAST(TRY_CAST(g1 AS BIGINT) * 60 AS VARCHAR)
   WHEN 'minutes_seconds' THEN CAST(TRY_CAST(g1 AS BIGINT) * 60 + TRY_CAST(g2 AS BIGINT) AS VARCHAR) WHEN 'text_without' THEN replace(g1, arg, '')
   WHEN 'known_default' THEN CASE WHEN lower(g1) IN ({words}) THEN 'true' ELSE 'false' END END AS v FROM captured),
facts AS (SELECT config_id, filename, truth, vendor, line_no, fact_no, raw, rule_no, field_path, CASE WHEN typ = 'bool' THEN v = 'true' END AS value_bool,
   CASE WHEN typ = 'int' THEN TRY_CAST(v AS BIGINT) END AS value_int, CASE WHEN typ = 'str' THEN v END AS value_str FROM valued),
latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY config_id, field_path ORDER BY line_no DESC, fact_no DESC) AS rn FROM facts) WHERE rn = 1)"""


PERMISSIVE_SQL = "contains(lower(raw), 'the the') AND (contains(lower(raw), ' of') OR contains(lower(raw), ' is '))"


def rules_sql(rules: list, field_types: dict) -> str:
    """The rule catalogue as VALUES (rule_id, severity, field_path, operator, typ, exp_bool, exp_int, exp_str, exp_list, min_confidence, require_explicit)."""
    rows = []
    for r in rules:
        e, kind = r["expected"], field_types.get(r["field_path"], "str")
        listed = "[" + ", ".join(text(str(x)) for x in e) + "]" if isinstance(e, list) else "NULL::VARCHAR[]"
        rows.append(
            f"({text(r['id'])}, {text(r['severity'])}, {text(r['field_path'])}, {text(r['operator'])}, {text('str' if kind == 'state' else kind)}, "
            f"{text(e) if isinstance(e, bool) else 'NULL::BOOLEAN'}, {e if isinstance(e, int) and not isinstance(e, bool) else 'NULL::BIGINT'}, "
            f"{text(e) if isinstance(e, str) else 'NULL::VARCHAR'}, {listed}, {r['minimum_confidence']}::DOUBLE, {text(r['require_explicit'])})"
        )
    return "rules(rule_id, severity, field_path, op, typ, exp_bool, exp_int, exp_str, exp_list, min_conf, need_explicit) AS (VALUES " + ", ".join(rows) + ")"


def defaults_sql(rules: list) -> str:
    rows = [f"({text(r['id'])}, {text(v)}, {text(b)})" for r in rules for v, b in r["known_insecure_defaults"].items()]
    return "defaults(rule_id, vendor, insecure) AS (VALUES " + ", ".join(rows) + ")"


PREDICATE_SQL = """CASE op WHEN 'equals' THEN (typ = 'bool' AND value_bool IS NOT DISTINCT FROM exp_bool) OR (typ = 'int' AND value_int IS NOT DISTINCT FROM exp_int) OR (typ = 'str' AND value_str IS NOT DISTINCT FROM exp_str)
  WHEN 'not_equals' THEN NOT ((typ = 'bool' AND value_bool IS NOT DISTINCT FROM exp_bool) OR (typ = 'int' AND value_int IS NOT DISTINCT FROM exp_int) OR (typ = 'str' AND value_str IS NOT DISTINCT FROM exp_str))
  WHEN 'in' THEN coalesce(list_contains(exp_list, CASE WHEN typ = 'int' THEN CAST(value_int AS VARCHAR) ELSE value_str END), false)
  WHEN 'not_in' THEN NOT coalesce(list_contains(exp_list, CASE WHEN typ = 'int' THEN CAST(value_int AS VARCHAR) ELSE value_str END), false)
  WHEN 'greater_than_or_equal' THEN coalesce(value_int >= exp_int, false) WHEN 'less_than_or_equal' THEN coalesce(value_int <= exp_int, false) END"""

SCALAR_STATUS_SQL = f"""CASE WHEN coalesce(confidence, 0) < min_conf THEN 'needs_human_review'
  WHEN need_explicit AND NOT coalesce(explicit, false) THEN CASE WHEN insecure IS NULL THEN 'needs_human_review' WHEN insecure THEN 'fail' ELSE 'pass' END
  WHEN {PREDICATE_SQL} THEN 'pass' ELSE 'fail' END"""

DOC_BASE_SQL = f"{LINES_SQL},\n{decision_sql('doc', DOC_SIGNATURES)}"
DOC_FACTS_SQL = f"{DOC_BASE_SQL},\n{facts_sql(DOC_GRAMMAR)}"
# One finding per document and rule: scalar rules from the latest fact, the list rule from the permissive lines.
DOC_FINDINGS_SQL = f"""{DOC_FACTS_SQL},
{rules_sql(DOC_RULES, DOC_FIELD_TYPES)},
{defaults_sql(DOC_RULES)},
permissive AS (SELECT config_id, min(line_no) AS line_no FROM lines WHERE {PERMISSIVE_SQL} GROUP BY config_id),
findings AS (
  SELECT d.config_id, c.filename, c.truth, d.vendor, r.rule_id, r.severity, r.field_path, f.line_no AS src_line, f.raw AS src_raw, CASE WHEN f.config_id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END AS confidence,
         CASE WHEN f.config_id IS NULL THEN 'needs_human_review' WHEN {PREDICATE_SQL} THEN 'pass' ELSE 'fail' END AS status
  FROM decided d JOIN doc c USING (config_id) CROSS JOIN rules r LEFT JOIN latest f ON f.config_id = d.config_id AND f.field_path = r.field_path
  WHERE r.op NOT LIKE 'list%'
  UNION ALL
  SELECT d.config_id, c.filename, c.truth, d.vendor, r.rule_id, r.severity, r.field_path, p.line_no, l.raw, CASE WHEN p.config_id IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END,
         CASE WHEN p.config_id IS NULL THEN 'not_applicable' ELSE 'fail' END
  FROM decided d JOIN doc c USING (config_id) CROSS JOIN rules r LEFT JOIN permissive p ON p.config_id = d.config_id LEFT JOIN lines l ON l.config_id = p.config_id AND l.line_no = p.line_no
  WHERE r.op LIKE 'list%')"""
UNKNOWN_SQL = "unknowns AS (SELECT config_id, filename, vendor, line_no, raw FROM matched WHERE rule_no IS NULL AND (" + " OR ".join(f"contains(lower(raw), {text(k)})" for k in DOC_GRAMMAR.security_keywords) + "))"

# ---- orders as findings ---------------------------------------------------------------------------------------------------------

SEVERITY_OF = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "info"}
RULE_OF = {"1-URGENT": "CIS-MGMT-01", "2-HIGH": "CIS-MGMT-02", "3-MEDIUM": "CIS-AUTH-01", "4-NOT SPECIFIED": "CIS-LOG-01", "5-LOW": "CIS-CRYPTO-01"}
FIELD_OF = {r["id"]: r["field_path"] for r in RULES}


def _case(col: F.Column, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as one finding of device o_custkey; later orders are later audits."""
    p = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("device_id"),
        F.col("o_orderkey").alias("seq"),
        _case(p, RULE_OF).alias("rule_id"),
        _case(p, SEVERITY_OF).alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("needs_human_review").alias("status"),
        _case(F.col("o_custkey") % 3, {0: "cisco_ios", 1: "juniper_junos", 2: "huawei_vrp"}).alias("vendor"),
        F.col("o_orderdate").alias("audited_at"),
    )


def _case_sql(col: str, mapping: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items()) + " END"


ORDERS_SQL = f"""findings AS (SELECT o_custkey AS device_id, o_orderkey AS seq, {_case_sql('o_orderpriority', RULE_OF)} AS rule_id,
  {_case_sql('o_orderpriority', SEVERITY_OF)} AS severity, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'needs_human_review' END AS status,
  CASE o_custkey % 3 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'juniper_junos' ELSE 'huawei_vrp' END AS vendor, o_orderdate AS audited_at FROM orders)"""

# ---- lineitem as evidence -------------------------------------------------------------------------------------------------------

EVIDENCE_PATHS = {
    1: "management.telnet.enabled",
    2: "management.ssh.protocol_version",
    3: "authentication.password_policy.min_length",
    4: "cryptography.tls.min_version",
    5: "management.snmp.community_strings_default",
    6: "management.ssh.idle_timeout_seconds",
    7: "access_control.acl_rules[].is_any_any_permit",
}
EVIDENCE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice"]


def evidence(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Line items as evidence of device l_orderkey; confidence from the tax, explicitness from the discount. ``more`` columns come along."""
    n = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("device_id"),
        _case(F.col("l_orderkey") % 3, {0: "cisco_ios", 1: "juniper_junos", 2: "huawei_vrp"}).alias("vendor"),
        _case(n, EVIDENCE_PATHS).alias("field_path"),
        F.when(n == 5, F.col("l_linestatus") == "O").when(n == 7, F.col("l_returnflag") == "R").alias("value_bool"),
        F.when(n == 2, F.col("l_suppkey") % 2 + 1).when(n == 3, F.col("l_quantity").cast("bigint")).when(n == 6, F.col("l_quantity").cast("bigint") * 30).cast("bigint").alias("value_int"),
        F.when(n == 1, F.when(F.col("l_returnflag") == "R", "enabled").otherwise("disabled")).when(n == 4, F.concat(F.lit("1."), (F.col("l_suppkey") % 4).cast("string"))).alias("value_str"),
        (F.col("l_discount") < 0.08).alias("explicit"),
        (F.lit(1.0) - F.col("l_tax") * 4.0).alias("confidence"),
        F.lit(None).cast("int").alias("src_line"),
        F.lit(None).cast("string").alias("src_raw"),
        F.lit("deterministic_parser").alias("method"),
        *EVIDENCE_ORDER,
        *more,
    )


EVIDENCE_SQL = f"""evidence AS (SELECT l_orderkey AS device_id, CASE l_orderkey % 3 WHEN 0 THEN 'cisco_ios' WHEN 1 THEN 'juniper_junos' ELSE 'huawei_vrp' END AS vendor,
  {_case_sql('l_linenumber', EVIDENCE_PATHS)} AS field_path,
  CASE l_linenumber WHEN 5 THEN l_linestatus = 'O' WHEN 7 THEN l_returnflag = 'R' END AS value_bool,
  CASE l_linenumber WHEN 2 THEN l_suppkey % 2 + 1 WHEN 3 THEN CAST(l_quantity AS BIGINT) WHEN 6 THEN CAST(l_quantity AS BIGINT) * 30 END AS value_int,
  CASE l_linenumber WHEN 1 THEN CASE WHEN l_returnflag = 'R' THEN 'enabled' ELSE 'disabled' END WHEN 4 THEN '1.' || (l_suppkey % 4) END AS value_str,
  l_discount < 0.08::DOUBLE AS explicit, 1.0::DOUBLE - l_tax * 4.0::DOUBLE AS confidence, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
scalars AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, field_path ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM evidence WHERE field_path NOT LIKE '%[]%') WHERE rn = 1),
lists AS (SELECT device_id, field_path, min(confidence) AS low, bool_and(explicit) AS all_explicit, bool_or(coalesce(value_bool, false)) AS any_true, bool_and(coalesce(value_bool, false)) AS all_true FROM evidence WHERE field_path LIKE '%[]%' GROUP BY ALL),
devices AS (SELECT DISTINCT device_id, vendor FROM evidence)"""


def evidence_findings_sql(rules: list, field_types: dict, suffix: str = "") -> str:
    """CTEs for one rule set over the packed evidence; ``suffix`` keeps two rule sets apart."""
    return f"""{rules_sql(rules, field_types).replace('rules(', f'rules{suffix}(', 1)},
{defaults_sql(rules).replace('defaults(', f'defaults{suffix}(', 1)},
findings{suffix} AS (
  SELECT d.device_id, d.vendor, r.rule_id, r.severity, r.field_path, {SCALAR_STATUS_SQL} AS status
  FROM devices d CROSS JOIN rules{suffix} r LEFT JOIN scalars s ON s.device_id = d.device_id AND s.field_path = r.field_path
  LEFT JOIN defaults{suffix} k ON k.rule_id = r.rule_id AND k.vendor = d.vendor WHERE r.op NOT LIKE 'list%'
  UNION ALL
  SELECT d.device_id, d.vendor, r.rule_id, r.severity, r.field_path, CASE WHEN s.device_id IS NULL THEN 'not_applicable' WHEN low < min_conf THEN 'needs_human_review'
    WHEN need_explicit AND NOT all_explicit THEN 'needs_human_review' WHEN op = 'list_none_true' AND NOT any_true THEN 'pass' WHEN op = 'list_all_true' AND all_true THEN 'pass' ELSE 'fail' END
  FROM devices d CROSS JOIN rules{suffix} r LEFT JOIN lists s ON s.device_id = d.device_id AND s.field_path = r.field_path WHERE r.op LIKE 'list%')"""


# ---- events as logs -------------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log with its number as order, its microsecond time, and the number inside props."""
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ts_us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS_SQL = "ev AS (SELECT event_id, ts, user_id, event_type, value, props, epoch_us(ts) AS ts_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
