"""Decisions on hand-written configurations with the default catalogues."""

from pyspark.sql import functions as F

from confsieve.operators import extract, findings, fingerprint, profile, rules

SECURE = "\n".join(["Building configuration...", "hostname core-sw-01", "service password-encryption", "ip ssh version 2", "line vty 0 4", " transport input ssh", " exec-timeout 5 0", "security passwords min-length 14", "no ip http server", "end"])
OPEN = "\n".join(["Building configuration...", "hostname edge-rt", "ip ssh version 1", "line vty 0 4", " transport input telnet", "security passwords min-length 8", "snmp-server community public RO", "access-list 101 permit ip any any", "login quirk 5", "end"])
SWITCH = "\n".join(["hostname leaf-7", "interface Ethernet1", " switchport mode access", "router bgp 65001", " neighbor 10.0.0.1 remote-as 65002", "spanning-tree mode mstp"])


def frame(spark, texts):
    return spark.createDataFrame([(k, k + ".conf", v) for k, v in texts.items()], "config_id string, filename string, raw_text string")


def statuses(spark, texts):
    found = rules.evaluate(extract.extract(fingerprint.fingerprint(frame(spark, texts))), ["config_id"])
    return {(r.config_id, r.rule_id): r.status for r in found.collect()}


def test_rule_decisions(spark):
    got = statuses(spark, {"secure": SECURE, "open": OPEN, "empty": ""})
    assert len(got) == 3 * 20
    assert got["secure", "CIS-MGMT-01"] == got["secure", "CIS-MGMT-02"] == got["secure", "CIS-AUTH-02"] == "pass"
    assert got["open", "CIS-MGMT-01"] == got["open", "CIS-MGMT-02"] == got["open", "CIS-AUTH-02"] == got["open", "CIS-MGMT-05"] == "fail"
    assert got["open", "CIS-ACL-01"] == "fail" and got["secure", "CIS-ACL-01"] == "not_applicable"
    # A field never seen is a question for a person even where the vendor default is known.
    assert got["secure", "CIS-LOG-01"] == "needs_human_review"
    assert {v for (c, _), v in got.items() if c == "empty"} == {"needs_human_review", "not_applicable"}


def test_defaults_apply_to_evidence_that_is_not_explicit(spark):
    row = "device_id string, vendor string, field_path string, value_bool boolean, value_int bigint, value_str string, explicit boolean, confidence double, src_line int, src_raw string, method string, n int"
    ev = spark.createDataFrame(
        [
            ("a", "cisco_ios", "management.telnet.enabled", None, None, "enabled", False, 0.9, 1, "x", "m", 1),
            ("b", "cisco_ios", "management.http.enabled", None, None, "enabled", False, 0.9, 1, "x", "m", 1),
            ("c", "vyos", "management.telnet.enabled", None, None, "disabled", False, 0.9, 1, "x", "m", 1),
            ("d", "vyos", "management.telnet.enabled", None, None, "enabled", True, 0.9, 1, "x", "m", 1),
            ("d", "vyos", "management.telnet.enabled", None, None, "disabled", True, 0.9, 2, "x", "m", 2),
            ("e", "vyos", "management.telnet.enabled", None, None, "disabled", True, 0.5, 2, "x", "m", 2),
        ],
        row,
    )
    packed = rules.pack_evidence(ev, ["device_id", "vendor"], ["n"])
    got = {(r.device_id, r.rule_id): r.status for r in rules.evaluate(packed, ["device_id"]).collect()}
    assert got["a", "CIS-MGMT-01"] == "fail" and got["b", "CIS-MGMT-03"] == "pass" and got["c", "CIS-MGMT-01"] == "needs_human_review"
    assert got["d", "CIS-MGMT-01"] == "pass" and got["e", "CIS-MGMT-01"] == "needs_human_review"


def test_sparse_texts_abstain(spark):
    texts = {"empty": "", "comment": "! nothing here\n", "markup": "<DeviceConfiguration/>", "json": '{"a": 1}', "token": "switchport"}
    got = {r.config_id: r for r in fingerprint.fingerprint(frame(spark, texts)).collect()}
    assert {r.vendor for r in got.values()} == {"unknown"}
    assert {r.vendor_status for r in got.values()} == {"UNKNOWN_EDGE_CASE"}


def test_short_markers_need_token_borders(spark):
    sig = [{"vendor": "x", "strong": ["ews"]}]
    got = {r.config_id: r.vendor for r in fingerprint.fingerprint(frame(spark, {"in": "reviews of things", "alone": "set ews-model"}), sig).collect()}
    assert got == {"in": "unknown", "alone": "x"}


def test_routing_switch_stays_a_switch(spark):
    p = profile.profile(fingerprint.fingerprint(frame(spark, {"s": SWITCH}))).first()
    assert p.device_class == "network_switch" and "BGP" in p.capabilities and p.hostname == "leaf-7" and p.l3_capable


def test_unknown_lines_and_counts(spark):
    e = extract.extract(fingerprint.fingerprint(frame(spark, {"open": OPEN})))
    assert [r.raw for r in extract.unknown_lines(e, ["config_id"]).collect()] == ["login quirk 5"]
    s = findings.summarize(rules.evaluate(e, ["config_id"])).first()
    assert s.n_fail + s.n_pass + s.n_review + s.n_not_applicable == 20 and s.fail_critical == 3


def test_confirmed_mapping_flips_a_review(spark):
    e = extract.extract(fingerprint.fingerprint(frame(spark, {"open": OPEN})))
    ev = extract.latest_facts(e, ["config_id", "vendor"])
    human = spark.createDataFrame([("open", "cisco_ios", "authentication.account_lockout.enabled", True, None, None)], "config_id string, vendor string, field_path string, value_bool boolean, value_int bigint, value_str string")
    merged = rules.override_evidence(ev, human, ["config_id", "vendor"])
    after = {r.rule_id: r.status for r in rules.evaluate(rules.pack_evidence(merged, ["config_id", "vendor"], ["confidence"]), ["config_id"]).collect()}
    assert after["CIS-AUTH-03"] == "pass"


def test_strict_fallback_takes_the_number(spark):
    df = spark.createDataFrame([("a", "session-idle-timeout 45", "zyxel")], "config_id string, raw_text string, vendor string")
    plain = extract.long_facts(extract.extract(df), ["config_id"]).first()
    strict = extract.Grammar(strict_fallback=True)
    assert plain.value_int == 600
    assert extract.long_facts(extract.extract(df, strict), ["config_id"]).select(F.col("value_int")).first()[0] == 45
