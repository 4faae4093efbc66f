"""Queries over event logs and rule versions: stored tables, folds, assertions, governance, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.functions.digest import canonical, hmac_sha256, sha256
from confsieve.functions.predicates import OPERATORS
from confsieve.operators import assertions as a
from confsieve.operators import folds, ledger
from confsieve.operators import governance as gov
from confsieve.operators.latest import delete_cascade, latest_per_key
from confsieve.plans.adapters import EVENTS_SQL, events, table
from confsieve.plans.registry import half_up, query
from confsieve.session import cut_lineage, run_folder
from confsieve.sources import tables as stored

# ---- stored tables ----------------------------------------------------------------------------------------------------------------


@query("src09_table_reads", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id")
def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id = 7").select("event_id", "user_id", "event_type").orderBy("event_id")


@query("snk01_config_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Two writes, the later values first: the earlier ones must not win."""
    e, root = table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), run_folder(spark, "upserted")
    late = F.col("event_id") % 3 == 0
    stored.upsert_buckets(e.where(late), root, 0, ["user_id", "event_type"], "event_id")
    stored.upsert_buckets(e.where(~late), root, 1, ["user_id", "event_type"], "event_id")
    return stored.read_buckets(spark, root, e.schema)


@query("snk02_delete_cascade", "SELECT user_id, count(DISTINCT event_type) AS configs, count(*) AS verdicts FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY user_id")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    configs = e.select("user_id", "event_type").distinct()
    left, verdicts = delete_cascade(configs, e, e.where("event_type = 'error' AND value > 100"), "user_id")
    counted = verdicts.groupBy("user_id").agg(F.count("*").alias("verdicts"))
    return left.groupBy("user_id").agg(F.count("*").alias("configs")).join(counted, "user_id")


@query("snk04_block_upsert", f"WITH {EVENTS_SQL} SELECT user_id, k, arg_max(sha256(concat_ws('|', user_id, k, event_type)), event_id) AS rule_hash FROM ev GROUP BY ALL")
def block_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("rule_hash", sha256(canonical(F.col("user_id"), F.col("k"), F.col("event_type")))).select("user_id", "k", "event_id", "rule_hash")
    root = run_folder(spark, "blocks")
    stored.write_version(e.where("event_id % 2 = 0"), root, 1)
    stored.upsert_version(spark, root, 1, e.where("event_id % 2 = 1"), ["user_id", "k"], "event_id")
    return stored.read_version(spark, root, 2).select("user_id", "k", "rule_hash")


@query("snk05_learned_records", "SELECT event_type AS topic, count(*) AS records, count(*) FILTER (WHERE value > 50) AS passed, false AS any_citable, 'operator_learned' AS source_type FROM events GROUP BY event_type")
def learned(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    records = stored.learned_records(
        e, F.lit("generic"), F.concat(F.col("event_type"), F.lit(" setting "), F.col("user_id").cast("string")), F.upper("event_type"), F.when(F.col("value") > 50, "pass").otherwise("fail"), F.lit("")
    )
    path = run_folder(spark, "learned")
    stored.append_learned(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.groupBy("topic", "source_type").agg(F.count("*").alias("records"), F.count_if(F.col("learned_verdict") == "PASS").alias("passed"), F.max("citable").alias("any_citable"))


@query("snk08_memory_tables", f"WITH {EVENTS_SQL} SELECT user_id, k % 10 AS fact, arg_max(event_type, event_id) AS statement, max(event_id) AS event_id FROM ev GROUP BY 1, 2")
def memory(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", (F.col("k") % 10).alias("fact"), F.col("event_type").alias("statement"), "event_id")
    path = run_folder(spark, "memory")
    stored.append(e.where("event_id % 5 < 3"), path)
    stored.append(e.where("event_id % 5 >= 3"), path)
    return stored.read_latest(spark, path, ["user_id", "fact"], ["event_id"])


@query("knw10_confirmed_history", f"WITH {EVENTS_SQL} SELECT user_id, event_type, count(*) AS confirmed FROM ev WHERE k >= 50 AND user_id % 4 = 1 GROUP BY ALL")
def history(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("k >= 50 AND user_id % 4 = 1").groupBy("user_id", "event_type").agg(F.count("*").alias("confirmed"))


@query("knw11_vendor_solutions", "SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'PASS' ELSE CASE WHEN value > 50 THEN 'PASS' ELSE 'FAIL' END END AS verdict FROM events")
def solutions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    given = e.where("event_type = 'purchase'").select("event_id", "user_id", F.lit("PASS").alias("verdict"))
    own = e.where("event_type <> 'purchase'").select("event_id", "user_id", F.when(F.col("value") > 50, "PASS").otherwise("FAIL").alias("verdict"))
    return own.unionByName(given)


@query("prj16_episode_lookup", f"WITH {EVENTS_SQL} SELECT event_id, user_id, event_type, k FROM ev WHERE (event_type = 'error' OR k > 90) AND user_id % 10 = 2 AND contains(lower(props), '\"k\": 9')")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("(event_type = 'error' OR k > 90) AND user_id % 10 = 2")
    return e.where(F.contains(F.lower("props"), F.lit('"k": 9'))).select("event_id", "user_id", "event_type", "k")


@query("win12_last_episodes", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def last_episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(25)


# ---- folds ----------------------------------------------------------------------------------------------------------------------------


@query(
    "win08_token_weights",
    "SELECT event_type AS token, count(*) AS events, list_reduce(list_prepend(5000::BIGINT, list(CASE WHEN value > 30 THEN 10000::BIGINT ELSE 2000::BIGINT END ORDER BY event_id)), lambda w, t: (w * 92 + t * 8 + 50) // 100) / 10000.0::DOUBLE AS weight FROM events GROUP BY event_type",
)
def weights(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("token"), "event_id", "value")
    return folds.token_weights(e, "token", "event_id", F.col("value") > 30)


POSTERIOR_SQL = """CASE WHEN e % 2 = 1 THEN least(9900, ((acc % 100000) * 10000 + (e // 2) * (10000 - acc % 100000) + 5000) // 10000)
    + CASE WHEN least(9900, ((acc % 100000) * 10000 + (e // 2) * (10000 - acc % 100000) + 5000) // 10000) >= 8500 THEN 100000 ELSE acc - acc % 100000 END
  ELSE greatest(100, ((acc % 100000) * 10000 - (e // 2) * (acc % 100000) + 5000) // 10000)
    + CASE WHEN greatest(100, ((acc % 100000) * 10000 - (e // 2) * (acc % 100000) + 5000) // 10000) <= 1500 THEN 200000 ELSE acc - acc % 100000 END END"""


@query(
    "win09_posteriors",
    f"""WITH {EVENTS_SQL}, h AS (SELECT user_id % 40 AS hypothesis, event_id, (CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END) + 2 * (k * 20)::BIGINT AS e FROM ev),
r AS (SELECT hypothesis, count(*) AS events, list_reduce(list_prepend(5000::BIGINT, list(e::BIGINT ORDER BY event_id)), lambda acc, e: {POSTERIOR_SQL}) AS final FROM h GROUP BY hypothesis)
SELECT hypothesis, events, (final % 100000) / 10000.0::DOUBLE AS posterior, CASE final // 100000 WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'REFUTED' ELSE 'OPEN' END AS status FROM r""",
)
def posterior(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select((F.col("user_id") % 40).alias("hypothesis"), "event_id", F.col("event_type").isin("view", "click", "purchase").alias("s"), (F.col("k") / 500.0).alias("w"))
    return folds.posteriors(e, "hypothesis", "event_id", F.col("s"), F.col("w"))


@query(
    "win11_assumption_decay",
    f"WITH {EVENTS_SQL} SELECT event_id, list_reduce(list_prepend(CAST(round(value * 20) AS BIGINT), range(k % 30)), lambda acc, x: greatest(500, (acc * 85 + 50) // 100)) / 10000.0::DOUBLE AS confidence FROM ev",
)
def decayed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", folds.decay(F.round(F.col("value") * 20) / 10000.0, F.col("k") % 30).alias("confidence"))


# ---- assertions -------------------------------------------------------------------------------------------------------------------------

STATES = ["HUMAN_CONFIRMED", "VERIFIED", "KNOWN", "INFERRED", "ASSUMED", "UNKNOWN"]
SOURCES = {"view": "file", "click": "internal", "purchase": "rule_engine", "signup": "operator", "error": "network"}
ASSERTIONS_SQL = (
    f"{EVENTS_SQL}, asserted AS (SELECT event_id AS seq, 'device:' || user_id || '.' || (k % 20) AS subject, event_type AS statement, "
    + "CASE (k // 20) % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END AS epistemic, least(1.0::DOUBLE, floor(value) / 64.0::DOUBLE) AS confidence, "
    + "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items()) + " END AS source FROM ev), "
    + "spread AS (SELECT subject, count(DISTINCT statement) > 1 AS clash FROM asserted GROUP BY subject), "
    + "marked AS (SELECT a.* EXCLUDE epistemic, CASE WHEN clash THEN 'CONTRADICTED' ELSE epistemic END AS epistemic FROM asserted a JOIN spread USING (subject))"
)


def asserted(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    state, source = None, None
    for i, s in enumerate(STATES):
        hit = F.floor(F.col("k") / 20) % 6 == i
        state = F.when(hit, s) if state is None else state.when(hit, s)
    for k, v in SOURCES.items():
        source = F.when(F.col("event_type") == k, v) if source is None else source.when(F.col("event_type") == k, v)
    subject = F.concat(F.lit("device:"), F.col("user_id").cast("string"), F.lit("."), (F.col("k") % 20).cast("string"))
    return e.select(F.col("event_id").alias("seq"), subject.alias("subject"), F.col("event_type").alias("statement"), state.alias("epistemic"), F.least(F.lit(1.0), F.floor("value") / 64.0).alias("confidence"), source.alias("source"))


@query("agg28_contradictions", f"WITH {ASSERTIONS_SQL} SELECT seq, subject, epistemic, confidence FROM marked")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return a.mark_contradictions(asserted(spark, d)).select("seq", "subject", "epistemic", "confidence")


RANK_SQL = "CASE epistemic " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in a.RANKS.items()) + " END"
NAME_SQL = "CASE {r} " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in a.RANKS.items()) + " END"
ASSESS_SQL = f"""WITH {ASSERTIONS_SQL}, g AS (SELECT subject, count(*) AS assertions, avg(confidence) AS mean, max({RANK_SQL}) AS top, min({RANK_SQL}) AS bottom, bool_or(epistemic = 'CONTRADICTED') AS clash, min(confidence) AS lo, max(confidence) AS hi FROM marked GROUP BY subject),
c AS (SELECT *, CASE WHEN clash THEN 0::DOUBLE ELSE {half_up('mean', 4)} END AS confidence FROM g)"""


@query(
    "agg26_subject_confidence",
    f"""{ASSESS_SQL} SELECT subject, assertions, confidence, CASE WHEN clash THEN 'CONTRADICTED' ELSE {NAME_SQL.format(r='top')} END AS highest_state,
  CASE WHEN clash THEN 'CONTRADICTED' WHEN mean >= 0.85::DOUBLE AND top IN (5, 6) THEN 'HIGH_CONFIDENCE' WHEN mean >= 0.6::DOUBLE THEN 'MODERATE' WHEN mean >= 0.3::DOUBLE THEN 'LOW_CONFIDENCE' ELSE 'UNCERTAIN' END AS assessment FROM c""",
)
def assessed(spark: SparkSession, d: str) -> DataFrame:
    return a.assess(a.mark_contradictions(asserted(spark, d))).select("subject", "assertions", "confidence", "highest_state", "assessment")


@query("agg27_confidence_bounds", f"{ASSESS_SQL} SELECT subject, {NAME_SQL.format(r='bottom')} AS floor, {NAME_SQL.format(r='top')} AS ceiling, {half_up('hi - lo', 4)} AS spread, clash OR confidence < 0.7::DOUBLE AS needs_more FROM c")
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return a.assess(a.mark_contradictions(asserted(spark, d))).select("subject", "floor", "ceiling", "spread", "needs_more")


@query(
    "win10_contradiction_resolution",
    f"""WITH {ASSERTIONS_SQL}, s AS (SELECT *, confidence + CASE source WHEN 'rule_engine' THEN 0.5::DOUBLE WHEN 'file' THEN 0.2::DOUBLE WHEN 'internal' THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS score FROM marked),
r AS (SELECT *, CASE WHEN epistemic = 'CONTRADICTED' THEN row_number() OVER (PARTITION BY subject, epistemic ORDER BY score DESC, seq) END AS rk, count(*) FILTER (WHERE epistemic = 'CONTRADICTED') OVER (PARTITION BY subject) AS n FROM s)
SELECT seq, subject, CASE WHEN n >= 2 AND rk = 1 THEN 'promoted' WHEN n >= 2 AND rk > 1 THEN 'demoted' ELSE 'unchanged' END AS outcome, CASE WHEN n >= 2 AND rk > 1 THEN confidence * 0.5::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN n >= 2 AND rk = 1 THEN 'KNOWN' ELSE epistemic END AS epistemic FROM r""",
)
def resolved(spark: SparkSession, d: str) -> DataFrame:
    return a.resolve_contradictions(a.mark_contradictions(asserted(spark, d)), "seq").select("seq", "subject", "outcome", "confidence", "epistemic")


PATTERNS_SQL = f"""{EVENTS_SQL}, app AS (SELECT user_id AS pattern, CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'succeeded' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'failed' ELSE CASE WHEN k > 80 THEN 'contradicted' ELSE 'failed' END END AS outcome, user_id % 5 <> 0 AS validated FROM ev),
rec AS (SELECT pattern, count(*) FILTER (WHERE outcome <> 'contradicted') AS applied, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'contradicted') AS contradictions, bool_or(validated) AS v FROM app GROUP BY pattern),
done AS (SELECT * EXCLUDE v, CASE WHEN applied = 0 THEN 0::DOUBLE ELSE {half_up('succeeded::DOUBLE / applied', 4)} END AS success_rate, contradictions >= 3 AS retired, contradictions < 3 AND v AS citable FROM rec)"""


def patterns(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    outcome = F.when(t.isin("view", "click", "purchase"), "succeeded").when(t == "signup", "failed").when(F.col("k") > 80, "contradicted").otherwise("failed")
    log = events(spark, d).select(F.col("user_id").alias("pattern"), outcome.alias("outcome"), (F.col("user_id") % 5 != 0).alias("validated"))
    return a.pattern_record(log, "pattern")


@query("agg25_pattern_record", f"WITH {PATTERNS_SQL} SELECT * FROM done")
def pattern_record(spark: SparkSession, d: str) -> DataFrame:
    return patterns(spark, d)


@query("prj15_pattern_recall", f"WITH {PATTERNS_SQL} SELECT pattern, success_rate FROM done WHERE NOT retired AND pattern % 2 = 0 AND (pattern % 3 = 0 OR pattern % 7 = 0) ORDER BY success_rate DESC, pattern")
def recalled(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pattern")
    described = patterns(spark, d).withColumn("pattern_type", F.when(p % 2 == 0, "syntax").otherwise("workflow"))
    described = described.withColumn("conditions", F.concat_ws(" ", F.when(p % 3 == 0, "Needs SSH"), F.when(p % 7 == 0, "needs snmp"), F.lit("any")))
    return a.recall_patterns(described, "syntax", ["ssh", "SNMP"]).select("pattern", "success_rate")


# ---- governance -----------------------------------------------------------------------------------------------------------------------------

VERSIONS_SQL = """versions AS (SELECT p_brand AS rule_id, p_partkey AS version, p_name AS title, 'cis' AS framework, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  p_type AS field_path, CASE p_size % 3 WHEN 0 THEN 'equals' WHEN 1 THEN 'in' ELSE 'between' END AS operator, CAST(p_size AS VARCHAR) AS expected, CASE p_size % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'PENDING_APPROVAL' ELSE 'REJECTED' END AS status FROM part)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("rule_id"), F.col("p_partkey").alias("version"), F.col("p_name").alias("title"), F.lit("cis").alias("framework"),
        F.when(s % 4 == 0, "low").when(s % 4 == 1, "medium").when(s % 4 == 2, "high").otherwise("critical").alias("severity"),
        F.col("p_type").alias("field_path"), F.when(s % 3 == 0, "equals").when(s % 3 == 1, "in").otherwise("between").alias("operator"), s.cast("string").alias("expected"),
        F.when(s % 5 < 2, "ACTIVE").when(s % 5 == 2, "PENDING_APPROVAL").otherwise("REJECTED").alias("status"),
    )


CURRENT_SQL = "current AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY CAST(status = 'ACTIVE' AS INTEGER) DESC, version DESC) AS rn FROM versions) WHERE rn = 1)"


@query("win02_current_versions", f"WITH {VERSIONS_SQL}, {CURRENT_SQL} SELECT rule_id, version, severity, expected, status FROM current")
def current(spark: SparkSession, d: str) -> DataFrame:
    return gov.current_versions(versions(spark, d)).select("rule_id", "version", "severity", "expected", "status")


@query("win03_previous_versions", f"WITH {VERSIONS_SQL} SELECT rule_id, version, lag(version) OVER w AS previous_version, lag(expected) OVER w AS previous_expected FROM versions WINDOW w AS (PARTITION BY rule_id ORDER BY version)")
def previous(spark: SparkSession, d: str) -> DataFrame:
    return gov.previous_versions(versions(spark, d)).select("rule_id", "version", "previous_version", "previous_expected")


FIELDS = {"ECONOMY": "bool", "SMALL": "int", "STANDARD": "str", "PROMO": "str"}
FIELDS_SQL = "(" + ", ".join(f"'{f}'" for f in FIELDS) + ")"
OPERATORS_SQL = "(" + ", ".join(f"'{o}'" for o in OPERATORS) + ")"


@query(
    "gov01_rule_validation",
    f"WITH {VERSIONS_SQL} SELECT rule_id, version, concat_ws('; ', CASE WHEN field_path NOT IN {FIELDS_SQL} THEN 'unknown field path ' || field_path END, CASE WHEN operator NOT IN {OPERATORS_SQL} THEN 'unsupported operator ' || operator END) AS errors FROM versions",
)
def validated(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).select("rule_id", "version", F.array_join(gov.validation_errors(FIELDS), "; ").alias("errors"))


@query(
    "jon07_rule_conflicts",
    f"""WITH {VERSIONS_SQL}, act AS (SELECT DISTINCT field_path, rule_id FROM versions WHERE status = 'ACTIVE')
SELECT v.rule_id, v.version, (SELECT count(*) FROM act a WHERE a.field_path = v.field_path AND a.rule_id <> v.rule_id) AS conflicting_rules, (SELECT min(a.rule_id) FROM act a WHERE a.field_path = v.field_path AND a.rule_id <> v.rule_id) AS first_conflict FROM versions v""",
)
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    return gov.field_conflict(v, v.where("status = 'ACTIVE'")).select("rule_id", "version", "conflicting_rules", "first_conflict")


@query(
    "gov02_proposals",
    f"""WITH {VERSIONS_SQL}, {CURRENT_SQL}, prop AS (SELECT rule_id, max(CAST(version AS VARCHAR)) AS expected, CASE WHEN count(*) % 2 = 0 THEN 'equals' END AS operator FROM versions GROUP BY rule_id),
merged AS (SELECT c.rule_id, (SELECT max(version) FROM versions v WHERE v.rule_id = c.rule_id) + 1 AS version, coalesce(p.operator, c.operator) AS operator, p.expected, c.field_path FROM current c JOIN prop p USING (rule_id)),
act AS (SELECT rule_id, field_path FROM current WHERE status = 'ACTIVE')
SELECT rule_id, version, operator, expected, CASE WHEN field_path NOT IN {FIELDS_SQL} OR operator NOT IN {OPERATORS_SQL} THEN 'invalid' WHEN EXISTS (SELECT 1 FROM act a WHERE a.field_path = m.field_path AND a.rule_id <> m.rule_id) THEN 'conflict' ELSE 'accepted' END AS outcome FROM merged m""",
)
def proposals(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    none = F.lit(None).cast("string")
    p = v.groupBy("rule_id").agg(F.max(F.col("version").cast("string")).alias("expected"), F.when(F.count("*") % 2 == 0, "equals").alias("operator"))
    p = p.withColumn("title", none).withColumn("framework", none).withColumn("severity", none).withColumn("field_path", none)
    return gov.propose(v, p, FIELDS).select("rule_id", "version", "operator", "expected", "outcome")


APPROVALS_SQL = f"{EVENTS_SQL}, states AS (SELECT user_id AS rule_id, k % 7 AS version, count(DISTINCT event_type) AS reviewers, count(*) - count(DISTINCT event_type) AS repeats, CASE WHEN count(DISTINCT event_type) >= 2 THEN 'APPROVED' ELSE 'APPROVED_BY_ONE' END AS status FROM ev GROUP BY 1, 2)"


def approvals(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("rule_id"), (F.col("k") % 7).alias("version"), F.col("event_type").alias("reviewer"))
    return gov.approval_state(e, ["rule_id", "version"])


@query("gov03_approval_state", f"WITH {APPROVALS_SQL} SELECT * FROM states")
def approval_state(spark: SparkSession, d: str) -> DataFrame:
    return approvals(spark, d)


@query("gov04_activation", f"WITH {APPROVALS_SQL} SELECT rule_id, version, CASE WHEN status = 'APPROVED' THEN CASE WHEN version = max(CASE WHEN status = 'APPROVED' THEN version END) OVER (PARTITION BY rule_id) THEN 'ACTIVE' ELSE 'SUPERSEDED' END ELSE status END AS status FROM states")
def activation(spark: SparkSession, d: str) -> DataFrame:
    return gov.activate(approvals(spark, d), "rule_id", "version").select("rule_id", "version", "status")


# The key of a test signature; a real one is passed in by the caller.
TEST_KEY = "not-a-secret"
_PAD = TEST_KEY.encode().ljust(64, b"\0")
HASH_SQL = "sha256(concat_ws('|', rule_id, version, field_path, operator, expected, severity, framework))"
HMAC_SQL = f"sha256(unhex('{bytes(b ^ 0x5C for b in _PAD).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in _PAD).hex()}') || encode({{m}}))))"


@query("gov05_signatures", f"WITH {VERSIONS_SQL}, h AS (SELECT *, {HASH_SQL} AS rule_hash FROM versions) SELECT rule_id, version, rule_hash, {HMAC_SQL.format(m='rule_hash')} AS signature, version % 10 <> 3 AS hash_valid, version % 10 <> 3 AND version % 10 <> 4 AS signature_valid FROM h")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    signed = gov.sign(versions(spark, d), TEST_KEY)
    n = F.col("version") % 10
    # What was stored, with content changed after signing for some versions and the signature changed for others.
    changed = signed.withColumn("expected", F.when(n == 3, F.concat("expected", F.lit("x"))).otherwise(F.col("expected"))).withColumn(
        "signature", F.when(n == 4, F.reverse("signature")).otherwise(F.col("signature"))
    )
    checked = gov.verify_signatures(changed, TEST_KEY)
    return checked.select("rule_id", "version", "rule_hash", F.when(n == 4, F.reverse("signature")).otherwise(F.col("signature")).alias("signature"), "hash_valid", "signature_valid")


@query("gov06_rule_history", f"WITH {VERSIONS_SQL}, {CURRENT_SQL} SELECT v.rule_id, count(*) AS versions, count(*) FILTER (WHERE v.status = 'ACTIVE') AS ever_active, max(c.version) AS current_version FROM versions v JOIN current c USING (rule_id) GROUP BY v.rule_id")
def rule_history(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    counted = v.groupBy("rule_id").agg(F.count("*").alias("versions"), F.count_if(F.col("status") == "ACTIVE").alias("ever_active"))
    return counted.join(gov.current_versions(v).select("rule_id", F.col("version").alias("current_version")), "rule_id")


# ---- ledger -------------------------------------------------------------------------------------------------------------------------------------

CHAIN_SQL = f"""{EVENTS_SQL}, entries AS (SELECT user_id AS chain, event_id // {ledger.SEGMENT} AS segment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS block_index, row_number() OVER (PARTITION BY user_id, event_id // {ledger.SEGMENT} ORDER BY event_id) - 1 AS place, event_id AS seq, ts_us, event_type AS kind, props AS payload FROM ev),
said AS (SELECT chain, segment, segment // {ledger.FAN} AS node, sha256(string_agg(sha256(concat_ws('|', seq, ts_us, kind, payload)), '' ORDER BY seq)) AS d FROM entries GROUP BY chain, segment),
nodes AS (SELECT chain, node, sha256(string_agg(d, '' ORDER BY segment)) AS d FROM said GROUP BY chain, node),
above AS (SELECT chain, node, sha256('|' || sha256(string_agg(d, '') OVER (PARTITION BY chain ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS h FROM nodes),
beside AS (SELECT chain, segment, node, sha256(string_agg(d, '') OVER (PARTITION BY chain, node ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS b FROM said),
history AS (SELECT chain, segment, CASE WHEN b IS NULL THEN h ELSE sha256(coalesce(h, '') || '|' || b) END AS h FROM beside JOIN above USING (chain, node)),
contents AS (SELECT chain, segment, coalesce(sha256(repeat('0', 64) || '|' || h), repeat('0', 64)) AS anchor FROM history),
blocks AS (SELECT * FROM (WITH RECURSIVE b AS (
  SELECT e.chain, e.segment, e.block_index, e.place, e.seq, e.ts_us, e.kind, e.payload, c.anchor AS previous_hash, sha256(concat_ws('|', e.block_index, e.ts_us, c.anchor, e.kind, e.payload, 0)) AS block_hash
  FROM entries e JOIN contents c USING (chain, segment) WHERE place = 0
  UNION ALL
  SELECT e.chain, e.segment, e.block_index, e.place, e.seq, e.ts_us, e.kind, e.payload, b.block_hash, sha256(concat_ws('|', e.block_index, e.ts_us, b.block_hash, e.kind, e.payload, 0))
  FROM b JOIN entries e ON e.chain = b.chain AND e.segment = b.segment AND e.place = b.place + 1) SELECT * FROM b))"""


def chain_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_id", "ts_us", F.col("event_type").alias("kind"), F.col("props").alias("payload"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return ledger.append_blocks(chain_events(spark, d), "user_id", "event_id")


@query("win05_chain_append", f"WITH {CHAIN_SQL} SELECT chain, segment, seq, block_index, previous_hash, block_hash FROM blocks")
def appended(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("chain", "segment", "seq", "block_index", "previous_hash", "block_hash")


def _tampered(b: DataFrame) -> DataFrame:
    hit = (F.col("kind") == "error") & (F.col("payload") == '{"k": 13}')
    return b.withColumn("payload", F.when(hit, '{"k": 14}').otherwise(F.col("payload")))


@query(
    "win04_chain_verification",
    f"""WITH {CHAIN_SQL}, shown AS (SELECT *, kind = 'error' AND payload = '{{"k": 13}}' AS changed FROM blocks),
f AS (SELECT s.*, CASE WHEN changed THEN 'hash mismatch' WHEN place = 0 AND EXISTS (SELECT 1 FROM shown p WHERE p.chain = s.chain AND p.segment < s.segment AND p.changed) THEN 'broken link' END AS fault FROM shown s)
SELECT chain, count(*) AS blocks, count(fault) AS faults, min(CASE WHEN fault IS NOT NULL THEN seq END) AS first_seq, arg_min(fault, seq) FILTER (WHERE fault IS NOT NULL) AS first_fault FROM f GROUP BY chain""",
)
def verified(spark: SparkSession, d: str) -> DataFrame:
    """The stored chain with some payloads changed afterwards: each change shows in its own block and in the anchor of every later segment."""
    return ledger.first_fault(ledger.verify_blocks(_tampered(cut_lineage(blocks(spark, d), "chain"))))


@query("led03_chain_status", f"WITH {CHAIN_SQL} SELECT count(*) AS blocks, 0::BIGINT AS faults, count(DISTINCT chain) AS chains FROM blocks")
def chain_status(spark: SparkSession, d: str) -> DataFrame:
    per_chain = ledger.first_fault(ledger.verify_blocks(cut_lineage(blocks(spark, d), "chain")))
    return per_chain.agg(F.sum("blocks").alias("blocks"), F.sum("faults").alias("faults"), F.count("*").alias("chains"))


KIND_SQL = "CASE event_type WHEN 'purchase' THEN 'RULE_APPROVAL' WHEN 'view' THEN 'REPORT_INTEGRITY' WHEN 'click' THEN 'KNOWLEDGE_CONFIRMATION' ELSE 'HUMAN_DECISION' END"


@query(
    "led01_block_payloads",
    f"""WITH {EVENTS_SQL} SELECT event_id, {KIND_SQL} AS kind, sha256(CASE {KIND_SQL}
  WHEN 'RULE_APPROVAL' THEN concat_ws('|', user_id, k, sha256(props), 'a,b', '', 2, 'APPROVED_AND_ACTIVATED')
  WHEN 'REPORT_INTEGRITY' THEN concat_ws('|', event_id, sha256(props), 'audit', event_type, length(props))
  WHEN 'KNOWLEDGE_CONFIRMATION' THEN concat_ws('|', user_id, props, 'content.path', event_type, sha256(props))
  ELSE concat_ws('|', user_id, k, props, sha256(props), event_type, 'auditor', '', 'false', '') END) AS payload_hash FROM ev""",
)
def payloads(spark: SparkSession, d: str) -> DataFrame:
    t, props = F.col("event_type"), F.col("props")
    e = events(spark, d)
    kind = F.when(t == "purchase", "RULE_APPROVAL").when(t == "view", "REPORT_INTEGRITY").when(t == "click", "KNOWLEDGE_CONFIRMATION").otherwise("HUMAN_DECISION")
    e = e.select("event_id", "event_type", "props", kind.alias("kind"), "user_id", "k")
    shared = {"rule_id": F.when(F.col("kind") == "HUMAN_DECISION", F.col("k")).otherwise(F.col("user_id")), "version": F.col("k"), "rule_sha256": sha256(props), "approvers": F.lit("a,b"), "rationale": F.lit(""), "approval_count": F.lit(2), "status": F.lit("APPROVED_AND_ACTIVATED")}
    shared |= {"report_id": F.col("event_id"), "report_sha256": sha256(props), "goal": F.lit("audit"), "summary": t, "report_length_bytes": F.octet_length(props)}
    shared |= {"vendor": F.col("user_id"), "raw_pattern": props, "baseline_field_path": F.lit("content.path"), "confirmed_by": t, "pattern_sha256": sha256(props)}
    shared |= {"device_id": F.col("user_id"), "command_raw": props, "command_hash": sha256(props), "decision": t, "reviewer": F.lit("auditor"), "notes": F.lit(""), "has_uploaded_info": F.lit(False), "uploaded_info_hash": F.lit("")}
    e = e.withColumns(shared)
    text = None
    for name in ledger.PAYLOAD_FIELDS:
        text = F.when(F.col("kind") == name, ledger.payload(name)) if text is None else text.when(F.col("kind") == name, ledger.payload(name))
    return e.select("event_id", "kind", sha256(text).alias("payload_hash"))


@query(
    "led02_report_integrity",
    f"WITH {EVENTS_SQL}, l AS (SELECT user_id AS chain, arg_max(sha256(props), event_id) FILTER (WHERE event_type = 'view') AS stored_hash, sha256(arg_max(props, event_id)) AS current_hash FROM ev GROUP BY user_id) SELECT chain, CASE WHEN stored_hash IS NULL THEN 'NOT RECORDED' WHEN stored_hash = current_hash THEN 'VERIFIED' ELSE 'TAMPER DETECTED' END AS verdict FROM l",
)
def integrity(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    recorded = e.where("event_type = 'view'").select("user_id", "event_id", "ts_us", F.lit("REPORT_INTEGRITY").alias("kind"), sha256(F.col("props")).alias("payload"))
    chain = ledger.append_blocks(recorded, "user_id", "event_id")
    now = latest_per_key(e.select("user_id", "event_id", "props"), ["user_id"], ["event_id"]).select(F.col("user_id").alias("chain"), F.col("props").alias("report_text"))
    return ledger.latest_report_check(chain, now).select("chain", "verdict")


@query("jon08_ledger_union", f"WITH {EVENTS_SQL}, h AS (SELECT event_id, ts_us, sha256(concat_ws('|', user_id, event_type, k)) AS block_hash FROM ev), cur AS (SELECT * FROM h WHERE event_id % 3 = 0), st AS (SELECT * FROM h WHERE event_id % 3 <> 0) SELECT * FROM cur UNION ALL SELECT * FROM st WHERE block_hash NOT IN (SELECT block_hash FROM cur)")
def merged(spark: SparkSession, d: str) -> DataFrame:
    h = events(spark, d).select("event_id", "ts_us", sha256(canonical(F.col("user_id"), F.col("event_type"), F.col("k"))).alias("block_hash"))
    return ledger.merge_ledgers(h.where("event_id % 3 = 0"), h.where("event_id % 3 <> 0"))


@query("srt02_ledger_order", f"WITH {EVENTS_SQL} SELECT event_id, ts_us FROM ev")
def ordered(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "ts_us").orderBy(F.desc("ts_us"), F.desc("event_id"))


@query("set03_stored_minus_current", "SELECT DISTINCT user_id, event_type FROM events WHERE value > 10 EXCEPT SELECT user_id, event_type FROM events WHERE value > 60")
def minus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("value > 10").select("user_id", "event_type").distinct().join(e.where("value > 60").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")
