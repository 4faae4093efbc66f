"""Rule decisions: packed evidence against a rule catalogue, one finding per (device, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.catalog.fields import FIELD_TYPES
from confsieve.catalog.rules import RULES
from confsieve.functions.predicates import list_predicate, scalar_predicate
from confsieve.functions.tables import computed, literal_rows
from confsieve.operators.extract import FACT_TYPE

PASS, FAIL, REVIEW, NOT_APPLICABLE = "pass", "fail", "needs_human_review", "not_applicable"

RULE_TYPE = (
    "struct<rule_id:string,framework:string,severity:string,field_path:string,is_list:boolean,operator:string,value_type:string,"
    "exp_bool:boolean,exp_int:bigint,exp_str:string,exp_list:array<string>,min_confidence:double,require_explicit:boolean,"
    "defaults:map<string,boolean>>"
)


def rule_rows(rules: list = RULES, field_types: dict = FIELD_TYPES) -> list:
    """Catalogue rules as flat rows with the expected value in the column of its type."""
    rows = []
    for r in rules:
        expected = r["expected"]
        kind = field_types.get(r["field_path"], "str")
        rows.append(
            {
                "rule_id": r["id"],
                "framework": r.get("framework", "cis"),
                "severity": r["severity"],
                "field_path": r["field_path"],
                "is_list": "[]" in r["field_path"],
                "operator": r["operator"],
                "value_type": "str" if kind == "state" else kind,
                "exp_bool": expected if isinstance(expected, bool) else None,
                "exp_int": expected if isinstance(expected, int) and not isinstance(expected, bool) else None,
                "exp_str": expected if isinstance(expected, str) else None,
                "exp_list": [str(e) for e in expected] if isinstance(expected, list) else None,
                "min_confidence": r.get("minimum_confidence", 0.75),
                "require_explicit": r.get("require_explicit", True),
                "defaults": r.get("known_insecure_defaults") or {},
            }
        )
    return rows


def _scalar_status(ev: Column, rule: Column, vendor: Column) -> Column:
    confidence = F.coalesce(ev["confidence"], F.lit(0.0))
    explicit = F.coalesce(ev["explicit"], F.lit(False))
    insecure = F.try_element_at(rule["defaults"], vendor)
    # The confidence test stands first: a field that was never seen is a question for a person, whatever its default.
    return (
        F.when(confidence < rule["min_confidence"], REVIEW)
        .when(rule["require_explicit"] & ~explicit & insecure.isNull(), REVIEW)
        .when(rule["require_explicit"] & ~explicit & insecure, FAIL)
        .when(rule["require_explicit"] & ~explicit, PASS)
        .when(scalar_predicate(ev, rule), PASS)
        .otherwise(FAIL)
    )


def _list_status(items: Column, rule: Column) -> Column:
    lowest = F.array_min(F.transform(items, lambda i: i["confidence"]))
    all_explicit = F.forall(items, lambda i: F.coalesce(i["explicit"], F.lit(False)))
    return (
        F.when(F.size(items) == 0, NOT_APPLICABLE)
        .when(lowest < rule["min_confidence"], REVIEW)
        .when(rule["require_explicit"] & ~all_explicit, REVIEW)
        .when(list_predicate(F.transform(items, lambda i: i["value_bool"]), rule["operator"]), PASS)
        .otherwise(FAIL)
    )


def evaluate(devices: DataFrame, keys: list[str], rules: list = RULES, field_types: dict = FIELD_TYPES, vendor: str = "vendor") -> DataFrame:
    """Every device against every rule. ``devices`` carries ``facts`` (scalars in order) and ``acl_items`` (list items).

    The catalogue is a literal, so this is a projection and an explode: no join, no shuffle.
    """
    table = literal_rows(rule_rows(rules, field_types), RULE_TYPE)
    paired = F.transform(
        table,
        lambda r: F.struct(
            r.alias("rule"),
            F.try_element_at(F.filter("facts", lambda f: f["field_path"] == r["field_path"]), F.lit(-1)).alias("ev"),
            F.filter("acl_items", lambda f: f["field_path"] == r["field_path"]).alias("items"),
        ),
    )
    rows = devices.select(*dict.fromkeys([*keys, vendor]), F.explode_outer(paired).alias("p")).where(F.col("p").isNotNull())
    rule, ev, items = F.col("p.rule"), F.col("p.ev"), F.col("p.items")
    status = F.when(rule["is_list"], _list_status(items, rule)).otherwise(_scalar_status(ev, rule, F.col(vendor)))
    shown = F.when(rule["is_list"], F.try_element_at(items, F.lit(1))).otherwise(ev)
    return rows.select(
        *dict.fromkeys([*keys, vendor]),
        rule["rule_id"].alias("rule_id"),
        rule["framework"].alias("framework"),
        rule["severity"].alias("severity"),
        rule["field_path"].alias("field_path"),
        status.alias("status"),
        shown["src_line"].alias("src_line"),
        shown["src_raw"].alias("src_raw"),
        F.coalesce(shown["confidence"], F.lit(0.0)).alias("confidence"),
    )


FINDING_TYPE = "struct<rule_id:string,severity:string,field_path:string,status:string,src_line:int,src_raw:string,confidence:double>"


def findings_in_row(devices: DataFrame, rules: list = RULES, field_types: dict = FIELD_TYPES, vendor: str = "vendor") -> DataFrame:
    """As :func:`evaluate`, with the findings of a device as an array in its row."""
    table = literal_rows(rule_rows(rules, field_types), RULE_TYPE)
    paired = F.transform(
        table,
        lambda r: F.struct(
            r.alias("rule"),
            F.try_element_at(F.filter("facts", lambda f: f["field_path"] == r["field_path"]), F.lit(-1)).alias("ev"),
            F.filter("acl_items", lambda f: f["field_path"] == r["field_path"]).alias("items"),
        ),
    )

    def decided(p: Column) -> Column:
        rule, ev, items = p["rule"], p["ev"], p["items"]
        status = F.when(rule["is_list"], _list_status(items, rule)).otherwise(_scalar_status(ev, rule, F.col(vendor)))
        shown = F.when(rule["is_list"], F.try_element_at(items, F.lit(1))).otherwise(ev)
        return F.struct(
            rule["rule_id"].alias("rule_id"), rule["severity"].alias("severity"), rule["field_path"].alias("field_path"), status.alias("status"),
            shown["src_line"].alias("src_line"), shown["src_raw"].alias("src_raw"), F.coalesce(shown["confidence"], F.lit(0.0)).alias("confidence"),
        )

    staged = computed(devices, _paired=paired)
    return computed(staged, findings=F.transform("_paired", decided).cast(f"array<{FINDING_TYPE}>")).drop("_paired")


def pack_evidence(evidence: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Long evidence to one row per device with ``facts`` and ``acl_items``.

    The first aggregation combines map-side and leaves one row per field, or at most two per list field (its true items and its
    other items, with the lowest confidence and joint explicitness of each), which is all a rule can ask of a list. So the second
    one collects no more than twice the number of fields, however many rows one device has.
    """
    is_list = F.col("field_path").contains("[]")
    item = F.when(is_list, F.coalesce(F.col("value_bool"), F.lit(False)))
    values = F.struct("value_bool", "value_int", "value_str", "explicit", "src_line", "src_raw", "method", "confidence")
    reduced = (
        evidence.withColumn("_item", item)
        .groupBy(*keys, "field_path", "_item")
        .agg(
            F.max_by(values, F.struct(*order)).alias("v"),
            F.min("confidence").alias("low"),
            F.min(F.coalesce("explicit", F.lit(False))).alias("all_explicit"),
        )
    )
    listed = F.col("_item").isNotNull()
    fact = F.struct(
        F.col("field_path"),
        F.col("v.value_bool"),
        F.col("v.value_int"),
        F.col("v.value_str"),
        F.when(listed, F.col("all_explicit")).otherwise(F.col("v.explicit")).alias("explicit"),
        F.col("v.src_line"),
        F.col("v.src_raw"),
        F.col("v.method"),
        F.when(listed, F.col("low")).otherwise(F.col("v.confidence")).alias("confidence"),
    ).cast(FACT_TYPE)
    return reduced.groupBy(*keys).agg(
        F.collect_list(F.when(~listed, fact)).alias("facts"),
        F.collect_list(F.when(listed, fact)).alias("acl_items"),
    )


#: So many rules, of both versions together, are written out one by one where two versions meet.
UNROLLED = 64


def status_flips(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(device, rule) pairs whose status differs between two finding sets."""
    b = before.select(*keys, F.col("status").alias("before_status"))
    a = after.select(*keys, F.col("status").alias("after_status"))
    return b.join(a, keys).where(F.col("before_status") != F.col("after_status"))


def re_audit(devices: DataFrame, keys: list[str], previous: list, active: list, field_types: dict = FIELD_TYPES) -> DataFrame:
    """Both versions of a rule set over the same evidence, met inside the row of a device: no shuffle. Rules of one version only drop out."""
    if len(previous) + len(active) <= UNROLLED:
        return _re_audit_unrolled(devices, keys, previous, active, field_types)
    before = findings_in_row(devices, previous, field_types).withColumnRenamed("findings", "_before")
    both = findings_in_row(before, active, field_types)

    def paired(a: Column) -> Column:
        old = F.try_element_at(F.filter("_before", lambda b: b["rule_id"] == a["rule_id"]), F.lit(1))
        return F.struct(a["rule_id"].alias("rule_id"), old["status"].alias("before_status"), a["status"].alias("after_status"))

    rows = both.select(*keys, F.inline(F.transform("findings", paired))).where(F.col("before_status").isNotNull())
    return rows.withColumn("changed", F.col("before_status") != F.col("after_status"))


def _re_audit_unrolled(devices: DataFrame, keys: list[str], previous: list, active: list, field_types: dict, vendor: str = "vendor") -> DataFrame:
    """:func:`re_audit` with an expression a rule. The evidence of a field is looked up once for all rules that read it; what the rule states
    is constant, so Spark leaves of each decision the branch that the rule takes."""
    tables = [literal_rows(rule_rows(rules, field_types), RULE_TYPE) for rules in (previous, active)]
    fields = list(dict.fromkeys(r["field_path"] for r in [*previous, *active]))
    first = {r["id"]: k for k, r in reversed([*enumerate(previous)])}  # the first of an id, should one come twice
    seen = F.transform(
        F.array(*[F.lit(p) for p in fields]).cast("array<string>"),
        lambda p: F.struct(F.try_element_at(F.filter("facts", lambda f: f["field_path"] == p), F.lit(-1)).alias("ev"), F.filter("acl_items", lambda f: f["field_path"] == p).alias("items")),
    )

    def status(version: int, number: int, rule: dict) -> Column:
        stated, evidence = F.element_at(tables[version], F.lit(number + 1)), F.element_at("_seen", fields.index(rule["field_path"]) + 1)
        return _list_status(evidence["items"], stated) if "[]" in rule["field_path"] else _scalar_status(evidence["ev"], stated, F.col(vendor))

    pairs = [
        F.struct(F.lit(r["id"]).alias("rule_id"), status(0, first[r["id"]], previous[first[r["id"]]]).alias("before_status"), status(1, k, r).alias("after_status"))
        for k, r in enumerate(active)
        if r["id"] in first
    ]
    rows = computed(devices, _seen=seen).select(*keys, F.inline(F.array(*pairs).cast("array<struct<rule_id:string,before_status:string,after_status:string>>")))
    return rows.withColumn("changed", F.col("before_status") != F.col("after_status"))


def _by_hand(confirmed: DataFrame, keys: list[str]) -> DataFrame:
    return confirmed.select(
        *keys,
        "field_path",
        F.col("value_bool"),
        F.col("value_int"),
        F.col("value_str"),
        F.lit(True).alias("explicit"),
        F.lit(None).cast("int").alias("src_line"),
        F.lit(None).cast("string").alias("src_raw"),
        F.lit("human_annotated").alias("method"),
        F.lit(1.0).alias("confidence"),
    )


def override_evidence(evidence: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed mappings replace what was extracted for the field, with full trust. ``confirmed`` has one row per (keys, field)."""
    human = _by_hand(confirmed, keys)
    untouched = evidence.join(human.select(*keys, "field_path"), [*keys, "field_path"], "left_anti")
    return untouched.select(human.columns).unionByName(human)


def override_in_row(devices: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`override_evidence`, for packed evidence: ``facts`` and ``acl_items`` of the confirmed fields give way to what was confirmed.

    ``confirmed_fields`` names them. A device that only has confirmed mappings is added. One row per device meets one per device, so
    evidence is not spread out and packed again."""
    human = _by_hand(confirmed, keys)
    fact = F.struct(*[c for c in human.columns if c not in keys]).cast(FACT_TYPE)
    is_list = F.col("field_path").contains("[]")
    answered = human.groupBy(*keys).agg(
        F.collect_list(F.when(~is_list, fact)).alias("_facts"), F.collect_list(F.when(is_list, fact)).alias("_items"), F.collect_list("field_path").alias("_fields")
    )
    both = devices.join(answered, keys, "full")

    def given(own: str, more: str) -> Column:
        kept = F.filter(own, lambda f: ~F.coalesce(F.array_contains("_fields", f["field_path"]), F.lit(False)))
        none = F.array().cast(f"array<{FACT_TYPE}>")
        return F.when(F.col("_fields").isNull(), F.col(own)).otherwise(F.concat(F.coalesce(kept, none), more))

    return both.select(*keys, given("facts", "_facts").alias("facts"), given("acl_items", "_items").alias("acl_items"), F.coalesce("_fields", F.array().cast("array<string>")).alias("confirmed_fields"))


def remediation_rows(rules: list = RULES) -> list:
    return [
        {"rule_id": r["id"], "vendor": v, "command": command, "rationale": rationale or f"On {v} this sets {r['field_path']} as {r['id']} asks."}
        for r in rules
        for v, fix in (r.get("remediation") or {}).items()
        for command, rationale in [(fix, None) if isinstance(fix, str) else fix]
    ]


def with_remediation(findings: DataFrame, rules: list = RULES, vendor: str = "vendor") -> DataFrame:
    """Looks the fix text up by (rule, vendor) in a literal map."""
    from confsieve.functions.tables import literal_map

    rows = remediation_rows(rules)
    key = F.concat_ws("|", F.col("rule_id"), F.col(vendor))
    commands = literal_map({f"{r['rule_id']}|{r['vendor']}": r["command"] for r in rows})
    rationales = literal_map({f"{r['rule_id']}|{r['vendor']}": r["rationale"] for r in rows})
    return findings.withColumn("fix_command", F.try_element_at(commands, key)).withColumn("fix_rationale", F.try_element_at(rationales, key))
