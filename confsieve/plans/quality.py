"""Queries on detection quality: labels against results, families, gates, mining, device profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confsieve.functions.tables import computed
from confsieve.operators import detection as de
from confsieve.operators import fingerprint as fp
from confsieve.operators import profile as pr
from confsieve.plans.adapters import DOC_BASE_SQL, DOC_SIGNATURES, DOC_SQL, configs, table
from confsieve.plans.registry import half_up, query, text
from confsieve.session import cut_lineage

# ---- device profile -------------------------------------------------------------------------------------------------------------------

# Capabilities keep the names the role table asks for; what stands for them in prose is our own choice.
CAPS = [
    ("BGP", r"(?i)tion the"), ("OSPF", r"(?i)menu|free"), ("NAT", r"(?i)token = "), ("VLAN", r"(?i) der die "), ("PORT_SECURITY", r"###"),
    ("MPLS", r"\d{3}\.\d+\.\d+\.\d+"), ("STATIC_ROUTING", r"(?i)@mail\d"), ("IPSEC_VPN", r"\(\d\d\d\) "), ("VXLAN_EVPN", r"(?i)apache"), ("BACNET", r"(?i)los el"),
    ("L2_SWITCHING", r"(?i) \| "),
]
DOC_DEVICES = pr.DeviceCatalog(
    hostname_patterns=[r"(?m)^(\S+) of the", r"(?i)token = \"([^\"]+)\"", r"@(mail\d+)\."],
    capabilities=CAPS,
    models=[
        (r"(?i)^mail7", "wireless_ap", "wireless_access", "Mail Seven"),
        (r"(?i)released under", "firewall", "perimeter", "Released Text"),
        (r"(?i)worthless", "iot_controller", "ot_cell", "Worthless Text"),
        (r"\d{16}", "network_switch", "access", "Card Text"),
    ],
    class_signals={"network_switch": [(r"(?i) la ", 4.0), (r"(?i) les ", 3.0)], "firewall": [(r"(?i) und ", 4.0), (r"(?i) mit ", 1.5)], "router": [(r"(?i) the ", 2.0)]},
    class_gates={"network_switch": r"(?i)(^|\s)de(\s|$)", "firewall": r"(?i)(^|\s)(der|of)(\s|$)", "iot_controller": r"\|"},
    cascade=[("iot_endpoint", r"(?i)menu", "menu text"), ("load_balancer", r"(?i)\*\*\*", "decorated text"), ("firewall", r"(?i) rerrely", "relying text")],
    l2_forwarding=r"(?i) que les ",
    routed_only=r"(?i) the of ",
    filename_hints=[(r"src1_", "network_switch"), (r"src[23]_", "router")],
    vendor_class={"de": "firewall", "fr": "router"},
    platforms={"de": "Deutsch", "en": "English", "fr": "Francais"},
    role_name_hints=[(r"(?i)^mail", "wan"), (r"(?i)^[0-9a-f]{40}", "core"), (r"(?i)^and", "edge")],
    spine=r"(?i)mail", outside=r"(?i)(^|\s)und(\s|$)", access_port=r"(?i)est ", external_peer=r"(?i) from ",
)
C = DOC_DEVICES


def _rx(t: str, p: str) -> str:
    return f"regexp_matches({t}, {text(p)})"


def _when(cases: list, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


HOST_SQL = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(raw_text, {text(p)}, 1), '\"''; ' || chr(9)), '')" for p in C.hostname_patterns) + ")"
CAPS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_rx('raw_text', p)} THEN '{n}' END" for n, p in sorted(CAPS)) + "], lambda x: x IS NOT NULL)"
MODEL_SQL = "coalesce(" + _when([(_rx("hostname", m[0]), str(i)) for i, m in enumerate(C.models)], "NULL") + ", " + _when([(_rx("raw_text", m[0]), str(i)) for i, m in enumerate(C.models)], "NULL") + ")"


def _has(name: str) -> str:
    return f"list_contains(caps, '{name}')"


_POLICY, _WIRELESS, _IOT = "device_class IN ('firewall', 'security_appliance')", "device_class IN ('wireless_ap', 'wireless_controller')", "device_class IN ('iot_gateway', 'iot_endpoint')"
_WIRED = f"NOT ({_POLICY}) AND NOT ({_WIRELESS}) AND NOT ({_IOT}) AND device_class <> 'iot_controller'"
_PEER = _rx("raw_text", C.external_peer)
ROLES = [
    (f"{_has('VXLAN_EVPN')} AND {_rx('coalesce(hostname, {0}) || {1} || raw_text'.format(chr(39) * 2, text(' ')), C.spine)}", "dc_spine", 0.80),
    (_has("VXLAN_EVPN"), "dc_leaf", 0.80),
    (f"{_POLICY} AND ({_has('NAT')} OR {_rx('raw_text', C.outside)})", "perimeter", 0.75),
    (_POLICY, "segmentation", 0.60),
    (_WIRELESS, "wireless_access", 0.85),
    (f"device_class = 'iot_controller' AND {_has('BACNET')}", "building_automation", 0.80),
    ("device_class = 'iot_controller'", "ot_cell", 0.75),
    (_IOT, "iot_edge", 0.75),
    (f"{_WIRED} AND ({_has('MPLS')} OR ({_has('BGP')} AND ({_has('OSPF')} OR {_has('ISIS')})))", "core", 0.75),
    (f"{_WIRED} AND {_has('BGP')} AND {_PEER} AND {_has('NAT')}", "internet_gateway", 0.70),
    (f"{_WIRED} AND {_has('BGP')} AND {_PEER}", "edge", 0.68),
    (f"{_WIRED} AND (ports >= 8 OR {_has('PORT_SECURITY')})", "access", 0.72),
    (f"{_WIRED} AND ({_has('OSPF')} OR {_has('ISIS')}) AND list_has_any(caps, {C.l2!r})", "distribution", 0.65),
    (f"{_WIRED} AND ({_has('CELLULAR_WAN')} OR {_has('IPSEC_VPN')})", "branch", 0.65),
    (f"{_WIRED} AND {_has('STATIC_ROUTING')} AND {_has('NAT')}", "internet_gateway", 0.62),
]
_M = "(model_no IS NOT NULL)"
PROFILE_SQL = f"""{DOC_BASE_SQL},
p1 AS (SELECT c.*, d.vendor, {HOST_SQL} AS hostname, {CAPS_SQL} AS caps FROM doc c JOIN decided d USING (config_id)),
p2 AS (SELECT *, {MODEL_SQL} AS m FROM p1),
p3 AS (SELECT *, CASE WHEN CASE m {' '.join(f"WHEN {i} THEN {_rx('raw_text', C.class_gates[k[1]]) if k[1] in C.class_gates else 'true'}" for i, k in enumerate(C.models))} END THEN m END AS model_no,
  list_has_any(caps, {C.l3!r}) AS l3, len(regexp_extract_all(raw_text, {text(C.access_port)})) AS ports FROM p2),
p4 AS (SELECT *, CASE WHEN {_M} THEN CASE model_no {' '.join(f"WHEN {i} THEN {text(k[1])}" for i, k in enumerate(C.models))} END
  {' '.join(f"WHEN {_rx('raw_text', p)} THEN {text(k)}" for k, p, _ in C.cascade)} WHEN {_rx('raw_text', C.l2_forwarding)} THEN 'network_switch' WHEN {_rx('raw_text', C.routed_only)} OR l3 THEN 'router'
  {' '.join(f"WHEN {_rx('filename', p)} THEN {text(k)}" for p, k in C.filename_hints)} {' '.join(f"WHEN vendor = {text(v)} THEN {text(k)}" for v, k in C.vendor_class.items())} ELSE 'unknown' END AS device_class,
  CASE WHEN {_M} THEN 0.93::DOUBLE {' '.join(f"WHEN {_rx('raw_text', p)} THEN 0.88::DOUBLE" for k, p, _ in C.cascade)} WHEN {_rx('raw_text', C.l2_forwarding)} THEN 0.86::DOUBLE WHEN {_rx('raw_text', C.routed_only)} OR l3 THEN 0.82::DOUBLE
  {' '.join(f"WHEN {_rx('filename', p)} THEN 0.60::DOUBLE" for p, k in C.filename_hints)} {' '.join(f"WHEN vendor = {text(v)} THEN 0.55::DOUBLE" for v in C.vendor_class)} ELSE 0::DOUBLE END AS class_confidence,
  CASE model_no {' '.join(f"WHEN {i} THEN {text(k[2])}" for i, k in enumerate(C.models))} END AS model_role,
  CASE model_no {' '.join(f"WHEN {i} THEN {text(k[3])}" for i, k in enumerate(C.models))} END AS model FROM p3),
p5 AS (SELECT *, {_when([(c, text(r)) for c, r, _ in ROLES], "coalesce(model_role, 'unknown')")} AS role0, {_when([(c, f'{v}::DOUBLE') for c, _, v in ROLES], "CASE WHEN model_role IS NOT NULL THEN 0.55::DOUBLE ELSE 0::DOUBLE END")} AS conf0,
  {_when([(_rx('hostname', p), text(r)) for p, r in C.role_name_hints], 'NULL')} AS named FROM p4),
profiles AS (SELECT *, CASE WHEN named IS NOT NULL AND role0 = 'unknown' THEN named ELSE role0 END AS network_role,
  {half_up("CASE WHEN named IS NOT NULL AND role0 = 'unknown' THEN 0.5::DOUBLE WHEN named = role0 THEN least(0.95::DOUBLE, conf0 + 0.12::DOUBLE) ELSE conf0 END", 2)} AS role_confidence FROM p5)"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return pr.profile(fp.fingerprint(configs(spark, d), DOC_SIGNATURES), DOC_DEVICES)


@query("fpr05_hostname", f"WITH {DOC_SQL} SELECT config_id, {HOST_SQL} AS hostname FROM doc")
def hostnames(spark: SparkSession, d: str) -> DataFrame:
    return configs(spark, d).select("config_id", pr.hostname(F.col("raw_text"), DOC_DEVICES).alias("hostname"))


@query("fpr06_capabilities", f"WITH {DOC_SQL} SELECT config_id, array_to_string({CAPS_SQL}, ',') AS capabilities FROM doc")
def caps(spark: SparkSession, d: str) -> DataFrame:
    ready = computed(configs(spark, d), low=F.lower("raw_text"))
    return ready.select("config_id", F.array_join(pr.capabilities(F.col("raw_text"), DOC_DEVICES, F.col("low")), ",").alias("capabilities"))


@query("fpr07_model_match", f"WITH {DOC_SQL}, h AS (SELECT *, {HOST_SQL} AS hostname FROM doc) SELECT config_id, CAST({MODEL_SQL} AS INTEGER) AS model_no FROM h")
def models(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw_text")
    ready = computed(configs(spark, d), h=pr.hostname(raw, DOC_DEVICES), low=F.lower(raw))
    return ready.select("config_id", pr.model_number(raw, F.col("h"), DOC_DEVICES, F.col("low")).alias("model_no"))


@query("fpr08_plausible_models", f"WITH {PROFILE_SQL} SELECT config_id, m IS NOT NULL AND model_no IS NULL AS implausible, model FROM profiles")
def plausible(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d).withColumn("n", pr.model_number(F.col("raw_text"), F.col("hostname"), DOC_DEVICES, F.lower("raw_text")))
    return p.select("config_id", (F.col("n").isNotNull() & F.col("model").isNull()).alias("implausible"), "model")


_CLASS_SQL = " UNION ALL ".join(
    f"SELECT config_id, '{k}' AS device_class, CASE WHEN {_rx('raw_text', C.class_gates[k]) if k in C.class_gates else 'true'} THEN "
    + " + ".join(f"CASE WHEN {_rx('raw_text', p)} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in s) + " ELSE 0::DOUBLE END AS score FROM doc"
    for k, s in C.class_signals.items()
)


@query("fpr09_class_evidence", f"WITH {DOC_SQL} SELECT * FROM ({_CLASS_SQL}) WHERE score > 0")
def class_evidence(spark: SparkSession, d: str) -> DataFrame:
    return pr.class_scores(configs(spark, d), ["config_id"], DOC_DEVICES)


@query("fpr10_class_cascade", f"WITH {PROFILE_SQL} SELECT config_id, device_class, class_confidence AS device_class_confidence FROM profiles")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("config_id", "device_class", "device_class_confidence")


@query("fpr11_network_role", f"WITH {PROFILE_SQL} SELECT config_id, network_role, role_confidence AS network_role_confidence FROM profiles")
def roles(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("config_id", "network_role", "network_role_confidence")


@query(
    "fpr12_profiles",
    f"""WITH {PROFILE_SQL} SELECT config_id, vendor, CASE vendor WHEN 'de' THEN 'Deutsch' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Francais' END AS platform, model, l3 AS l3_capable, list_has_any(caps, {C.l2!r}) AS l2_capable,
  array_to_string(list_filter(caps, lambda x: list_contains({C.routing!r}, x)), ',') AS routing_protocols, device_class = 'unknown' AS ambiguity,
  CASE WHEN device_class IN ('router', 'network_switch', 'load_balancer', 'wireless_controller') THEN 'network' WHEN device_class = 'firewall' THEN 'security' WHEN device_class = 'unknown' THEN 'unknown' ELSE 'iot' END AS asset_group FROM profiles""",
)
def full_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("config_id", "vendor", "platform", "model", "l3_capable", "l2_capable", F.array_join("routing_protocols", ",").alias("routing_protocols"), "ambiguity", "asset_group")


@query(
    "agg07_profile_summary",
    f"""WITH {PROFILE_SQL}, x AS (SELECT 'device_class' AS facet, device_class AS value FROM profiles UNION ALL SELECT 'network_role', network_role FROM profiles UNION ALL SELECT 'total', 'all' FROM profiles UNION ALL SELECT 'ambiguous', 'yes' FROM profiles WHERE device_class = 'unknown'),
k AS (SELECT 'capability' AS facet, unnest(caps) AS value FROM profiles), top AS (SELECT facet, value, count(*) AS devices FROM k GROUP BY ALL ORDER BY devices DESC, value LIMIT 15)
SELECT facet, value, count(*) AS devices FROM x GROUP BY ALL UNION ALL SELECT * FROM top""",
)
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return pr.profile_summary(profiles(spark, d))


# ---- labels against results ---------------------------------------------------------------------------------------------------------------

OUTCOME_SQL = "CASE WHEN vendor = truth THEN 'correct' WHEN vendor = 'unknown' THEN 'abstained' ELSE 'wrong' END"
RESULTS_SQL = f"{DOC_BASE_SQL}, results AS (SELECT c.config_id, c.filename, c.truth, c.source, d.vendor, d.n_lines, {OUTCOME_SQL} AS outcome FROM decided d JOIN doc c USING (config_id))"


def results(spark: SparkSession, d: str) -> DataFrame:
    r = fp.fingerprint(configs(spark, d), DOC_SIGNATURES)
    matched = de.vendor_matches(F.col("truth"), F.lit(""), F.col("vendor"))
    return r.withColumn("outcome", de.outcome(matched, F.col("vendor")))


@query("fpr14_label_match", f"WITH {RESULTS_SQL} SELECT config_id, vendor = truth AS matched FROM results")
def label_match(spark: SparkSession, d: str) -> DataFrame:
    r = fp.fingerprint(configs(spark, d), DOC_SIGNATURES)
    return r.select("config_id", de.vendor_matches(F.col("truth"), F.lit(""), F.col("vendor")).alias("matched"))


@query("fpr15_model_claims", "SELECT p_partkey, split_part(p_name, ' ', 2) IN ('ring', 'widget') AND length(split_part(p_name, ' ', 2)) > 2 OR split_part(p_name, ' ', 1) = lower(p_type) AS holds FROM part")
def claims(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", de.model_claim_holds(F.col("p_name"), F.concat(F.lit("Ring/Widget of "), F.col("p_type"))).alias("holds"))


_RATES = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("correct", "wrong", "abstained")) + ", " + ", ".join(half_up(f"count(*) FILTER (WHERE outcome = '{o}')::DOUBLE / count(*)", 4) + f" AS {o}_rate" for o in ("correct", "wrong", "abstained"))


@query("agg08_identification_metrics", f"WITH {RESULTS_SQL} SELECT truth, count(*) AS samples, {_RATES} FROM results GROUP BY truth")
def identification(spark: SparkSession, d: str) -> DataFrame:
    return de.identification_metrics(results(spark, d), ["truth"])


@query(
    "agg09_model_metrics",
    f"""WITH p AS (SELECT CASE WHEN p_size % 3 > 0 THEN p_name END AS claimed, CASE WHEN p_size % 5 > 0 THEN 'Ring/Widget' ELSE '' END AS product FROM part),
c AS (SELECT *, claimed IS NOT NULL AND product <> '' AS checked, claimed IS NOT NULL AND product <> '' AND split_part(claimed, ' ', 2) IN ('ring', 'widget') AS ok FROM p)
SELECT count(*) AS samples, count(claimed) AS claimed, {half_up('count(claimed)::DOUBLE / count(*)', 4)} AS coverage, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE ok) AS correct, {half_up('count(*) FILTER (WHERE ok)::DOUBLE / nullif(count(*) FILTER (WHERE checked), 0)', 4)} AS precision FROM c""",
)
def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("claimed"), F.when(F.col("p_size") % 5 > 0, "Ring/Widget").otherwise("").alias("product"))
    return de.model_metrics(p, "claimed", "product")


EXPECTED = {"de": "firewall", "en": "router", "es": "network_switch", "fr": "wireless_ap"}
EXPECTED_SQL = "CASE truth " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPECTED.items()) + " END"
NEAR_SQL = "(device_class = expected OR " + " OR ".join("(device_class IN ({g}) AND expected IN ({g}))".format(g=", ".join(f"'{x}'" for x in g)) for g in de.INTERCHANGEABLE) + ")"
CLASSED_SQL = f"{PROFILE_SQL}, classed AS (SELECT *, {EXPECTED_SQL} AS expected FROM profiles)"


def classed(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_map

    return profiles(spark, d).withColumn("expected", F.try_element_at(literal_map(EXPECTED), F.col("truth")))


@query(
    "agg10_class_accuracy",
    f"""WITH {CLASSED_SQL} SELECT count(*) AS samples, count(*) FILTER (WHERE device_class = expected) AS exact, count(*) FILTER (WHERE {NEAR_SQL}) AS equivalent, count(*) FILTER (WHERE length(raw_text) >= 500) AS plain_samples,
  count(*) FILTER (WHERE device_class = expected AND length(raw_text) >= 500) AS plain_exact, {half_up('count(*) FILTER (WHERE device_class = expected)::DOUBLE / count(*)', 4)} AS exact_rate,
  {half_up('count(*) FILTER (WHERE device_class = expected AND length(raw_text) >= 500)::DOUBLE / count(*) FILTER (WHERE length(raw_text) >= 500)', 4)} AS plain_exact_rate FROM classed""",
)
def class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return de.class_metrics(classed(spark, d), "expected", "device_class", F.length("raw_text") < 500)


@query(
    "agg11_confusions",
    f"WITH {CLASSED_SQL} SELECT CASE WHEN {NEAR_SQL} THEN expected || ' ~ ' || device_class || ' (equivalent)' ELSE expected || ' -> ' || device_class END AS disagreement, count(*) AS samples FROM classed WHERE expected <> device_class GROUP BY 1 ORDER BY samples DESC, disagreement LIMIT 12",
)
def confusions(spark: SparkSession, d: str) -> DataFrame:
    return de.confusion(classed(spark, d), "expected", "device_class")


@query(
    "agg12_capability_recall",
    f"""WITH {PROFILE_SQL}, named AS (SELECT caps, unnest(CASE WHEN length(raw_text) > 2000 THEN ['BGP', 'NAT'] ELSE ['OSPF'] END) AS capability FROM profiles)
SELECT capability, count(*) FILTER (WHERE list_contains(caps, capability)) AS detected, count(*) FILTER (WHERE NOT list_contains(caps, capability)) AS missed, {half_up('count(*) FILTER (WHERE list_contains(caps, capability))::DOUBLE / count(*)', 4)} AS recall FROM named GROUP BY capability""",
)
def recall(spark: SparkSession, d: str) -> DataFrame:
    labelled = profiles(spark, d).withColumn("controls", F.when(F.length("raw_text") > 2000, F.lit(["bgp", "nat", "ssh_v2"])).otherwise(F.lit(["ospf", "ntp"])))
    return de.capability_recall(labelled, "controls", "capabilities")


FAMILIES = {"short_text": "n_chars < 300", "taken_for_english": "vendor = 'en'", "french_source": "truth = 'fr'"}


@query("agg14_failure_families", f"WITH {RESULTS_SQL}, w AS (SELECT r.*, d.n_chars FROM results r JOIN documents d ON d.doc_id = r.config_id WHERE outcome <> 'correct') " + " UNION ALL ".join(f"SELECT '{n}' AS family, count(*) FILTER (WHERE {e}) AS cases FROM w" for n, e in FAMILIES.items()))
def families(spark: SparkSession, d: str) -> DataFrame:
    wrong = results(spark, d).where("outcome <> 'correct'").withColumn("n_chars", F.length("raw_text"))
    return de.failure_families(wrong, FAMILIES)


@query("udf02_predicate_columns", "SELECT doc_id, n_chars < 300 AS short_text, lang = 'fr' AS french_source, coalesce(NULL > 1, false) AS never FROM documents")
def predicate_columns(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return de.apply_predicates(docs, {"short_text": "n_chars < 300", "french_source": "lang = 'fr'", "never": "NULL > 1"}).select("doc_id", "short_text", "french_source", "never")


BASE_SQL = f"{RESULTS_SQL}, now AS (SELECT config_id, truth, CASE WHEN s1 IS NULL OR s1 < 0.02::DOUBLE THEN 'unknown' ELSE v1 END AS vendor FROM decided JOIN doc USING (config_id)), converted AS (SELECT r.config_id FROM results r JOIN now n USING (config_id) WHERE r.vendor = 'unknown' AND n.vendor NOT IN ('unknown', n.truth))"


def two_runs(spark: SparkSession, d: str) -> DataFrame:
    """The detector at its floor and at a lower one, the change the gate is asked about: texts are scored once, and ``ranking`` decides both."""
    scored = fp.score_vendors(configs(spark, d), DOC_SIGNATURES).select("config_id", "truth", fp.vendor_at(fp.EVIDENCE_FLOOR).alias("vendor"), fp.vendor_at(0.02).alias("vendor_after"))
    runs = computed(scored, outcome=_outcome("vendor"), outcome_after=_outcome("vendor_after"))
    return cut_lineage(runs, "two-runs")


def _outcome(vendor: str) -> F.Column:
    return de.outcome(de.vendor_matches(F.col("truth"), F.lit(""), F.col(vendor)), F.col(vendor))


def converted(runs: DataFrame) -> DataFrame:
    return runs.where("outcome = 'abstained' AND outcome_after = 'wrong'").select("config_id")


@query("jon12_abstentions_turned_wrong", f"WITH {BASE_SQL} SELECT config_id FROM converted")
def turned(spark: SparkSession, d: str) -> DataFrame:
    return converted(two_runs(spark, d))


@query("set01_run_intersection", f"WITH {BASE_SQL} SELECT config_id FROM results WHERE outcome = 'correct' INTERSECT SELECT config_id FROM now WHERE vendor = truth")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    runs = two_runs(spark, d)
    return runs.where("outcome = 'correct'").select("config_id").intersect(runs.where("outcome_after = 'correct'").select("config_id"))


@query(
    "agg16_regression_gate",
    f"""WITH {BASE_SQL}, b AS (SELECT count(*) FILTER (WHERE outcome = 'wrong') AS wrong, {half_up("count(*) FILTER (WHERE outcome = 'correct')::DOUBLE / count(*) FILTER (WHERE outcome <> 'abstained')", 4)} AS precision, count(*) FILTER (WHERE outcome = 'wrong' AND truth = 'fr') AS fr FROM results),
c AS (SELECT count(*) FILTER (WHERE vendor NOT IN ('unknown', truth)) AS wrong, {half_up("count(*) FILTER (WHERE vendor = truth)::DOUBLE / count(*) FILTER (WHERE vendor <> 'unknown')", 4)} AS precision, count(*) FILTER (WHERE vendor NOT IN ('unknown', truth) AND truth = 'fr') AS fr FROM now)
SELECT 'wrong_count' AS criterion FROM b, c WHERE c.wrong > b.wrong UNION ALL SELECT 'abstentions' WHERE (SELECT count(*) FROM converted) > 0 UNION ALL SELECT 'family' FROM b, c WHERE c.fr > b.fr
UNION ALL SELECT 'zero_family' FROM c WHERE c.fr > 0 UNION ALL SELECT 'model_precision' FROM b, c WHERE c.precision < b.precision - 1e-9""",
)
def gate(spark: SparkSession, d: str) -> DataFrame:
    def metrics(r: DataFrame) -> DataFrame:
        o = F.col("outcome")
        return r.agg(F.count_if(o == "wrong").alias("wrong"), de.ratio(F.count_if(o == "correct"), F.count_if(o != "abstained")).alias("precision"))

    fam = {"french": "truth = 'fr'"}
    runs = two_runs(spark, d)
    before, after = runs.select("config_id", "truth", "outcome"), runs.select("config_id", "truth", F.col("outcome_after").alias("outcome"))
    return de.regression_gate(
        metrics(before), metrics(after), de.failure_families(before.where("outcome = 'wrong'"), fam), de.failure_families(after.where("outcome = 'wrong'"), fam), converted(runs), "french"
    ).select("criterion")


LEGACY = {"de": "firewall", "en": "router", "es": "switch", "fr": "satellite"}


@query(
    "agg17_relabel_verdicts",
    f"""WITH {PROFILE_SQL}, l AS (SELECT *, CASE truth WHEN 'de' THEN 'firewall' WHEN 'en' THEN 'router' WHEN 'es' THEN 'network_switch' END AS mapped FROM profiles)
SELECT CASE WHEN device_class = 'unknown' THEN 'ambiguous' WHEN mapped IS NOT NULL AND mapped <> device_class THEN 'review' ELSE 'verified' END AS label_confidence, device_class, count(*) AS samples FROM l GROUP BY 1, 2""",
)
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.functions.tables import literal_map

    legacy = F.try_element_at(literal_map(LEGACY), F.col("truth"))
    r = de.relabel(profiles(spark, d), legacy, F.col("device_class"), F.col("ambiguity"), F.col("device_class_basis"), F.col("network_role"))
    return r.groupBy("label_confidence", "device_class").agg(F.count("*").alias("samples"))


@query(
    "fpr16_marker_mining",
    f"""WITH {DOC_SQL}, tok AS (SELECT config_id, truth, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(raw_text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1))) AS token FROM doc),
df AS (SELECT truth, token, count(*) AS df FROM tok GROUP BY ALL), sz AS (SELECT truth, count(*) AS group_size FROM doc GROUP BY truth), sp AS (SELECT token, count(*) AS groups FROM df GROUP BY token)
SELECT truth, token, df, group_size, groups FROM df JOIN sz USING (truth) JOIN sp USING (token) WHERE df::DOUBLE / group_size >= 0.55::DOUBLE AND groups <= 3""",
)
def mined(spark: SparkSession, d: str) -> DataFrame:
    return de.mine_markers(configs(spark, d), "truth", "raw_text", 0.55, 3)


@query("snk07_frozen_metrics", f"WITH {RESULTS_SQL} SELECT truth, count(*) AS samples, {_RATES} FROM results GROUP BY truth")
def frozen(spark: SparkSession, d: str) -> DataFrame:
    from confsieve.session import run_folder
    from confsieve.sources.tables import freeze_baseline

    r = results(spark, d)
    root = run_folder(spark, "baseline")
    freeze_baseline(de.identification_metrics(r, ["truth"]), r.where("outcome <> 'correct'").select("config_id", "truth", "vendor", "outcome"), root)
    return spark.read.parquet(f"{root}/metrics")
