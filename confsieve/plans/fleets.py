"""Queries over findings (orders) and device tables: summaries, flips, grids, selections, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.catalog.rules import RULES
from confsieve.functions.tables import small_frame
from confsieve.operators import findings as fi
from confsieve.operators import rules as ru
from confsieve.operators.corpus import field_statistics
from confsieve.operators.latest import latest_per_key
from confsieve.operators.profile import asset_mix
from confsieve.plans.adapters import ORDERS_SQL, RULE_OF, findings, table
from confsieve.plans.registry import half_up, query, text
from confsieve.session import run_folder
from confsieve.sources.configs import load_dataset, preview

COUNTS_SQL = """count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) FILTER (WHERE status = 'needs_human_review') AS n_review, count(*) FILTER (WHERE status = 'not_applicable') AS n_not_applicable"""
SEVERITY_SQL = ", ".join(f"count(*) FILTER (WHERE status = 'fail' AND severity = '{s}') AS fail_{s}" for s in fi.SEVERITIES)


@query("agg01_order_summary", f"WITH {ORDERS_SQL} SELECT vendor, {COUNTS_SQL}, {SEVERITY_SQL} FROM findings GROUP BY vendor")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return fi.summarize(findings(spark, d), ["vendor"])


@query("agg02_compliance_rate", f"WITH {ORDERS_SQL} SELECT count(*) AS total, {COUNTS_SQL}, {half_up('''100.0::DOUBLE * count(*) FILTER (WHERE status = 'pass') / count(*)''', 0)} AS rate_pct FROM findings")
def rate(spark: SparkSession, d: str) -> DataFrame:
    return fi.compliance_rate(findings(spark, d))


@query("agg03_order_device_counts", f"WITH {ORDERS_SQL} SELECT device_id, {COUNTS_SQL}, {SEVERITY_SQL} FROM findings GROUP BY device_id")
def per_device(spark: SparkSession, d: str) -> DataFrame:
    return fi.summarize(findings(spark, d), ["device_id"])


MIX_SQL = "SELECT {k} AS kind, count(*) AS devices, " + half_up("100.0::DOUBLE * count(*) / (SELECT count(*) FROM customer)", 2) + " AS share_pct FROM customer GROUP BY {k}"


@query("agg05_asset_mix", MIX_SQL.format(k="c_mktsegment"))
def assets(spark: SparkSession, d: str) -> DataFrame:
    return asset_mix(table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind")), "kind")


@query("agg06_vendor_share", MIX_SQL.format(k="c_nationkey"))
def vendors(spark: SparkSession, d: str) -> DataFrame:
    return asset_mix(table(spark, d, "customer").select(F.col("c_nationkey").alias("kind")), "kind")


@query(
    "agg30_session_totals",
    f"WITH {ORDERS_SQL} SELECT year(audited_at) * 100 + month(audited_at) AS session, count(DISTINCT device_id) AS devices, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM findings GROUP BY 1",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    month = (F.year("audited_at") * 100 + F.month("audited_at")).cast("bigint")
    return fi.session_totals(findings(spark, d).withColumn("session", month), "session", "device_id")


SESSION_SQL = f"WITH {ORDERS_SQL}, s AS (SELECT year(audited_at) * 100 + month(audited_at) AS session, count(DISTINCT device_id) AS devices, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM findings GROUP BY 1)"


@query("srt03_recent_sessions", f"{SESSION_SQL} SELECT * FROM s ORDER BY session DESC LIMIT 20")
def recent(spark: SparkSession, d: str) -> DataFrame:
    return sessions(spark, d).orderBy(F.desc("session")).limit(20)


@query("snk03_session_append", f"{SESSION_SQL} SELECT session, devices, n_pass, n_fail, 'audit' AS goal FROM s")
def session_append(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.session import run_folder
    from confsieve.sources.tables import append

    path = run_folder(spark, "sessions")
    append(sessions(spark, d).withColumn("goal", F.lit("audit")), path)
    return spark.read.parquet(path)


FLIPS_SQL = "pairs AS (SELECT device_id, rule_id, arg_min(status, seq) AS before_status, arg_max(status, seq) AS after_status FROM findings GROUP BY ALL)"


@query("evl05_status_flips", f"WITH {ORDERS_SQL}, {FLIPS_SQL} SELECT * FROM pairs WHERE before_status <> after_status")
def flips(spark: SparkSession, d: str) -> DataFrame:
    first, last = fi.first_and_last(findings(spark, d), ["device_id", "rule_id"], "seq")
    return ru.status_flips(first, last, ["device_id", "rule_id"])


@query("prj11_device_selection", f"WITH {ORDERS_SQL}, w AS (SELECT DISTINCT c_custkey AS device_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000), n AS (SELECT count(*) AS hits FROM findings WHERE device_id IN (SELECT device_id FROM w)) SELECT seq, device_id, status FROM findings, n WHERE hits = 0 OR device_id IN (SELECT device_id FROM w)")
def selected(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.col("c_custkey").alias("device_id"))
    return fi.select_devices(findings(spark, d), wanted, "device_id").select("seq", "device_id", "status")


@query("prj11_selection_fallback", f"WITH {ORDERS_SQL} SELECT seq, device_id, status FROM findings")
def selected_all(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select((-F.col("c_custkey") - 1).alias("device_id"))
    return fi.select_devices(findings(spark, d), wanted, "device_id").select("seq", "device_id", "status")


META = {r["id"]: (r["title"], r["field_path"]) for r in RULES if r["id"] in RULE_OF.values()}
META_SQL = "meta(rule_id, title, field_path) AS (VALUES " + ", ".join(f"({text(k)}, {text(v[0])}, {text(v[1])})" for k, v in META.items()) + ")"


def meta(spark: SparkSession) -> DataFrame:
    return small_frame(spark, [(k, *v) for k, v in META.items()], "rule_id string, title string, field_path string")


@query("prj12_finding_grid", f"WITH {ORDERS_SQL}, {META_SQL} SELECT seq, device_id, rule_id, title, status FROM findings JOIN meta USING (rule_id) WHERE device_id % 10 = 3 AND status = 'fail' AND contains(lower(rule_id || chr(10) || title || chr(10) || field_path), 'ssh')")
def grid(spark: SparkSession, d: str) -> DataFrame:
    joined = findings(spark, d).join(meta(spark), "rule_id")
    return fi.grid(joined, F.col("device_id") % 10 == 3, "fail", "SSH", ["rule_id", "title", "field_path"]).select("seq", "device_id", "rule_id", "title", "status")


@query("prj13_failed_view", f"WITH {ORDERS_SQL}, {META_SQL} SELECT seq, rule_id, title, rule_id IN ('CIS-MGMT-01', 'CIS-LOG-01') AS has_known_fix FROM findings LEFT JOIN meta USING (rule_id) WHERE status = 'fail'")
def failed(spark: SparkSession, d: str) -> DataFrame:
    fixes = small_frame(spark, [("CIS-MGMT-01",), ("CIS-LOG-01",)], "rule_id string")
    return fi.failed_view(findings(spark, d), meta(spark), fixes).select("seq", "rule_id", "title", "has_known_fix")


@query("prj18_critical_only", f"WITH {ORDERS_SQL} SELECT device_id, count(*) AS findings FROM findings WHERE severity = 'critical' GROUP BY device_id")
def critical(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where("severity = 'critical'").groupBy("device_id").agg(F.count("*").alias("findings"))


DECISIONS_SQL = "decisions AS (SELECT user_id AS device_id, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'PASS' WHEN 'signup' THEN 'PASS' WHEN 'view' THEN 'PASS' ELSE 'FAIL' END AS decision FROM events GROUP BY user_id)"


@query(
    "knw07_verdict_application",
    f"""WITH {ORDERS_SQL}, {DECISIONS_SQL} SELECT seq, f.device_id, rule_id, f.status AS before_status, CASE WHEN d.decision = 'PASS' THEN 'pass' WHEN d.decision = 'FAIL' THEN 'fail' ELSE f.status END AS status, d.decision IS NOT NULL AS human_resolved
FROM findings f LEFT JOIN decisions d ON d.device_id = f.device_id AND f.rule_id = 'CIS-MGMT-01'""",
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("device_id")).agg(F.max_by("event_type", "event_id").alias("e"))
    decided = last.select("device_id", F.lit("CIS-MGMT-01").alias("rule_id"), F.when(F.col("e").isin("purchase", "signup", "view"), "PASS").otherwise("FAIL").alias("decision"))
    return fi.apply_verdicts(findings(spark, d), decided, ["device_id", "rule_id"]).select("seq", "device_id", "rule_id", "before_status", "status", "human_resolved")


@query("set02_rule_union", f"WITH {ORDERS_SQL} SELECT device_id, rule_id FROM findings WHERE status = 'fail' UNION SELECT device_id, rule_id FROM findings WHERE status = 'pass'")
def rule_union(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.where("status IN ('fail', 'pass')").select("device_id", "rule_id").distinct()


@query("set05_target_rules", f"WITH {ORDERS_SQL} SELECT DISTINCT device_id, rule_id FROM findings WHERE status = 'fail'")
def targets(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where("status = 'fail'").select("device_id", "rule_id").dropDuplicates()


@query("jon13_gated_findings", f"WITH {ORDERS_SQL}, g AS (SELECT device_id, rule_id AS command, seq, 1 AS src FROM findings WHERE status = 'needs_human_review'), u AS (SELECT user_id AS device_id, event_type AS command, event_id AS seq, 0 AS src FROM events) SELECT device_id, lower(command) AS command_key, arg_min(src, src * 1000000000000 + seq) AS source FROM (SELECT * FROM g UNION ALL SELECT * FROM u) GROUP BY 1, 2")
def gated(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.operators.latest import first_seen

    g = findings(spark, d).where("status = 'needs_human_review'").select("device_id", F.lower("rule_id").alias("command_key"), "seq", F.lit(1).alias("source"))
    u = table(spark, d, "events").select(F.col("user_id").alias("device_id"), F.lower("event_type").alias("command_key"), F.col("event_id").alias("seq"), F.lit(0).alias("source"))
    both = g.unionByName(u).withColumn("s", F.col("source"))
    return first_seen(both, ["device_id", "command_key"], ["s", "seq"]).select("device_id", "command_key", "source")


@query("win12_latest_state", f"WITH {ORDERS_SQL} SELECT device_id, arg_max(rule_id, seq) AS rule_id, arg_max(status, seq) AS status, max(seq) AS seq FROM findings GROUP BY device_id")
def latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(findings(spark, d).select("device_id", "rule_id", "status", "seq"), ["device_id"], ["seq"])


@query("src08_dataset_preview", "SELECT count(*) AS records, 100 AS shown, (SELECT sum(l_orderkey) FROM (SELECT l_orderkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 100)) AS first_keys FROM lineitem")
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    data = load_dataset(spark, f"{d}/lineitem.parquet")
    head = preview(data.orderBy("l_orderkey", "l_linenumber", "l_partkey"), 100).agg(F.count("*").cast("int").alias("shown"), F.sum("l_orderkey").alias("first_keys"))
    return head.withColumn("records", data.agg(F.count("*")).scalar())


@query(
    "src08_dataset_formats",
    "SELECT kind, count(*) AS records, sum(s_suppkey) AS keys, round(sum(s_acctbal::DECIMAL(38,2))::DOUBLE, 2) AS balance, min(s_name) AS first_name FROM supplier, (VALUES ('csv'), ('json'), ('yaml'), ('parquet')) AS k(kind) GROUP BY kind UNION ALL SELECT 'txt', count(*), NULL, NULL, min(s_name) FROM supplier",
)
def formats(spark: SparkSession, d: str) -> DataFrame:
    """One table written in every format and loaded by its ending; what comes back has the types it went with."""
    supplier, root = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), run_folder(spark, "formats")
    supplier.write.option("header", True).csv(f"{root}/s.csv")
    supplier.write.json(f"{root}/s.jsonl")
    supplier.write.parquet(f"{root}/s.parquet")
    supplier.select(F.format_string("---\ns_suppkey: %d\ns_name: %s\ns_acctbal: %s", "s_suppkey", F.to_json(F.array("s_name")).substr(F.lit(2), F.length(F.to_json(F.array("s_name"))) - 2), F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("value")).write.text(f"{root}/s.yaml")
    supplier.select("s_name").write.text(f"{root}/s.txt")
    found = None
    for kind, name in (("csv", "s.csv"), ("json", "s.jsonl"), ("yaml", "s.yaml"), ("parquet", "s.parquet")):
        rows = load_dataset(spark, f"{root}/{name}")
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("records"), F.sum("s_suppkey").alias("keys"), F.round(F.sum(F.col("s_acctbal").cast("decimal(38,2)")).cast("double"), 2).alias("balance"), F.min("s_name").alias("first_name"))
        found = one if found is None else found.unionByName(one)
    text_rows = load_dataset(spark, f"{root}/s.txt").agg(F.lit("txt").alias("kind"), F.count("*").alias("records"), F.lit(None).cast("bigint").alias("keys"), F.lit(None).cast("double").alias("balance"), F.min("value").alias("first_name"))
    return found.unionByName(text_rows)


STAT_FIELDS = {
    "l_quantity": "double", "l_linenumber": "integer", "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz", "is_large": "boolean", "flags": "struct",
}


def _stat(c: str, kind: str) -> str:
    x = f"(SELECT CAST({c} AS VARCHAR) AS v, TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS x FROM l)" if kind in ("double", "integer") else f"(SELECT CAST({c} AS VARCHAR) AS v, NULL::DOUBLE AS x FROM l)"
    return f"""SELECT '{c}' AS field, '{kind}' AS type, count(v) AS values, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values, count(x) AS numbers, min(x) AS min, max(x) AS max,
  {half_up("sum(x::DECIMAL(38,6))::DOUBLE / count(x)", 4)} AS mean, {half_up("sum(x::DECIMAL(38,6))::DOUBLE", 2)} AS sum, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT v FROM {x} WHERE v IS NOT NULL ORDER BY v LIMIT 10)) AS sample FROM {x}"""


@query("agg24_field_statistics", "WITH l AS (SELECT *, l_quantity > 25 AS is_large, '{\"f\":\"' || l_returnflag || '\",\"s\":\"' || l_linestatus || '\"}' AS flags FROM lineitem) " + " UNION ALL ".join(_stat(c, k) for c, k in STAT_FIELDS.items()))
def statistics(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, texts, times, booleans and nested fields."""
    rows = table(spark, d, "lineitem").withColumn("is_large", F.col("l_quantity") > 25).withColumn("flags", F.struct(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")))
    return field_statistics(rows, list(STAT_FIELDS))


@query("rpt04_summary_text", "SELECT '### Quantities' || chr(10) || '- **records**: ' || count(*) || chr(10) || '- **largest**: ' || CAST(max(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS summary FROM lineitem")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.operators.report import key_value_summary

    return key_value_summary(table(spark, d, "lineitem").agg(F.count("*").alias("records"), F.max(F.col("l_quantity").cast("bigint")).alias("largest")), "Quantities")
