"""Lines to typed facts.

A configuration is one row, so its lines never leave it: splitting, grammar matching and fact emission are array expressions on
that row, with no shuffle and no join. Facts can be exploded into the long evidence table afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.catalog import fields as field_catalog
from confsieve.catalog import grammar as grammar_catalog
from confsieve.functions.needles import needles
from confsieve.functions.numbers import clamp, round_half_up
from confsieve.functions.tables import computed, literal_map, literal_rows
from confsieve.functions.text import any_of, numbered_lines

REVIEW_CONFIDENCE = 0.75
NO_FACT_CONFIDENCE = 0.3

FACT_TYPE = (
    "struct<field_path:string,value_bool:boolean,value_int:bigint,value_str:string,explicit:boolean,"
    "src_line:int,src_raw:string,method:string,confidence:double>"
)


@dataclass(frozen=True)
class Grammar:
    """Everything line extraction reads: catalogues as plain rows, so that a caller can bring their own."""

    vendor_rules: list = field(default_factory=lambda: grammar_catalog.GRAMMAR)
    fallback_rules: list = field(default_factory=lambda: grammar_catalog.FALLBACK_GRAMMAR)
    # (words that must all occur, words of which one must occur, field path, value, category)
    keyword_rules: list = field(
        default_factory=lambda: [
            # Keyword fallback, tested in this order.
            (["retry-options"], ["tries", "lockout"], "authentication.account_lockout.enabled", True, "Authentication"),
            ([], ["password-encryption", "format sha256", "irreversible-cipher"], "authentication.password_policy.encryption_enabled", True, "Authentication"),
            ([], ["tacacs", "radius"], "authentication.privilege_levels_defined", True, "Authentication"),
            ([], ["transport input ssh", "delete system services telnet"], "management.telnet.enabled", "disabled", "Management"),
            ([], ["no ip http server", "delete system services web-management http"], "management.http.enabled", "disabled", "Management"),
        ]
    )
    security_keywords: list = field(default_factory=lambda: grammar_catalog.SECURITY_KEYWORDS)
    known_default_words: list = field(default_factory=lambda: grammar_catalog.KNOWN_DEFAULT_WORDS)
    field_types: dict = field(default_factory=lambda: field_catalog.FIELD_TYPES)
    acl_path: str = field_catalog.ACL_PATH
    permissive_needle: str = "any any"
    permissive_verbs: tuple = ("permit", "accept")
    # True takes the captured number of a fallback pattern instead of its constant.
    strict_fallback: bool = False


def _type_of(value: object) -> str:
    return "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "str"


def _emission_rows(g: Grammar) -> list:
    """One row per rule, indexed by rule number: vendor rules first, then fallback rules, then keyword rules."""
    rows = []
    for _, pattern, facts in g.vendor_rules:
        out = []
        for path, kind, arg in facts:
            kind_type = {"const": _type_of(arg), "int": "int", "minutes": "int", "minutes_seconds": "int", "text": "str", "text_without": "str", "known_default": "bool"}[kind]
            constant = kind in ("const", "text_without")
            text = str(arg).lower() if isinstance(arg, bool) else str(arg)
            out.append({"path": path, "kind": kind, "type": kind_type, "arg": text if constant else None, "grp": 1 if constant else arg, "pattern": "(?i)" + pattern, "category": None})
        rows.append(out)
    for pattern, path, value, category in g.fallback_rules:
        rows.append([_constant_row(path, value, category, pattern, g.strict_fallback)])
    for _, _, path, value, category in g.keyword_rules:
        rows.append([_constant_row(path, value, category, "", False)])
    return rows


def _constant_row(path: str, value: object, category: str, pattern: str, strict: bool) -> dict:
    captures = strict and _type_of(value) == "int" and r"(\d+)" in pattern
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return {"path": path, "kind": "first_number" if captures else "const", "type": _type_of(value), "arg": text, "grp": 1, "pattern": "(?i)" + pattern, "category": category}


_EMISSION_TYPE = "array<struct<path:string,kind:string,type:string,arg:string,grp:int,pattern:string,category:string>>"


def _first_match(raw: Column, numbered: list, possible: Column | None = None) -> Column:
    out = None
    for number, pattern in numbered:
        hit = raw.rlike("(?i)" + pattern)
        if possible is not None and needles(pattern):
            hit = F.get(possible, F.lit(number)) & hit
        out = F.when(hit, F.lit(number)) if out is None else out.when(hit, F.lit(number))
    return out if out is not None else F.lit(None).cast("int")


def _holds_any(low: Column, words: list[str]) -> Column:
    hit = F.lit(not words)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def possible_rules(low: Column, vendor: Column, g: Grammar) -> Column:
    """For each vendor and fallback rule whether the lower-cased text holds a word the rule cannot match without."""
    out = []
    for name, pattern, _ in g.vendor_rules:
        out.append((vendor == name) & _holds_any(low, needles(pattern)))
    for pattern, *_ in g.fallback_rules:
        out.append(_holds_any(low, needles(pattern)))
    return F.array(*[F.coalesce(x, F.lit(False)) for x in out]) if out else F.array().cast("array<boolean>")


def rule_number(raw: Column, vendor: Column, g: Grammar, possible: Column | None = None) -> Column:
    """Number of the first grammar rule that matches the line: vendor grammar, fallback grammar, keyword test, else null.

    ``possible`` (see :func:`possible_rules`) spares the patterns that cannot match any line of the text.
    """
    by_vendor: dict = {}
    for number, (name, pattern, _) in enumerate(g.vendor_rules):
        by_vendor.setdefault(name, []).append((number, pattern))
    own = None
    for name, numbered in by_vendor.items():
        branch = _first_match(raw, numbered, possible)
        own = F.when(vendor == name, branch) if own is None else own.when(vendor == name, branch)
    base = len(g.vendor_rules)
    fallback = _first_match(raw, [(base + i, r[0]) for i, r in enumerate(g.fallback_rules)], possible)
    base += len(g.fallback_rules)
    keyword = None
    low = F.lower(raw)
    for i, (all_of, any_of, *_rest) in enumerate(g.keyword_rules):
        cond = F.lit(False)
        for word in any_of:
            cond = cond | F.contains(low, F.lit(word))
        for word in all_of:
            cond = cond & F.contains(low, F.lit(word))
        keyword = F.when(cond, F.lit(base + i)) if keyword is None else keyword.when(cond, F.lit(base + i))
    return F.coalesce(*[c for c in (own, fallback, keyword) if c is not None]).cast("int")


def is_permissive(raw: Column, g: Grammar) -> Column:
    low = F.lower(raw)
    verb = F.lit(False)
    for word in g.permissive_verbs:
        verb = verb | F.contains(low, F.lit(word))
    return F.contains(low, F.lit(g.permissive_needle)) & verb


def _emitted_text(raw: Column, e: Column, g: Grammar) -> Column:
    capture = F.call_function("regexp_extract", raw, e["pattern"], e["grp"])
    first = F.call_function("regexp_extract", raw, e["pattern"], F.lit(1))
    return (
        F.when(e["kind"] == "const", e["arg"])
        .when(e["kind"].isin("int", "text"), capture)
        .when(e["kind"] == "minutes", (capture.try_cast("bigint") * 60).cast("string"))
        .when(e["kind"] == "minutes_seconds", (first.try_cast("bigint") * 60 + F.call_function("regexp_extract", raw, e["pattern"], F.lit(2)).try_cast("bigint")).cast("string"))
        .when(e["kind"] == "text_without", F.replace(first, e["arg"], F.lit("")))
        .when(e["kind"] == "known_default", F.lower(capture).isin(g.known_default_words).cast("string"))
        .when(e["kind"] == "first_number", F.coalesce(F.nullif(F.regexp_extract(raw, r"(\d+)", 1), F.lit("")), e["arg"]))
    )


def _fact(raw: Column, line_no: Column, e: Column, g: Grammar) -> Column:
    text = _emitted_text(raw, e, g)
    return F.struct(
        e["path"].alias("field_path"),
        F.when(e["type"] == "bool", text.try_cast("boolean")).alias("value_bool"),
        F.when(e["type"] == "int", text.try_cast("bigint")).alias("value_int"),
        F.when(e["type"] == "str", text).alias("value_str"),
        F.lit(True).alias("explicit"),
        line_no.alias("src_line"),
        raw.alias("src_raw"),
        F.lit("deterministic_parser").alias("method"),
        F.lit(1.0).alias("confidence"),
    )


def match_lines(configs: DataFrame, g: Grammar = Grammar(), text: str = "raw_text", vendor: str = "vendor") -> DataFrame:
    """Adds ``lines``: array<struct<line_no, raw, rule_no>> of every line that is not blank or a comment.

    One plain search a rule over the whole text comes first; most rules then need not be tried on any line.
    """
    low = computed(configs, _low=F.lower(F.col(text)))
    ready = computed(low, _possible=possible_rules(F.col("_low"), F.col(vendor), g)).drop("_low")
    matched = computed(
        ready,
        lines=F.transform(
            numbered_lines(F.col(text)),
            lambda x: F.struct(x["line_no"].alias("line_no"), x["raw"].alias("raw"), rule_number(x["raw"], F.col(vendor), g, F.col("_possible")).alias("rule_no")),
        ),
    )
    return matched.drop("_possible")


def emit_facts(matched: DataFrame, g: Grammar = Grammar()) -> DataFrame:
    """Adds ``facts`` in line order, and the permissive-rule item when any line is one."""
    table = literal_rows(_emission_rows(g), _EMISSION_TYPE)
    hits = F.filter("lines", lambda x: x["rule_no"].isNotNull())
    per_line = F.transform(hits, lambda x: F.transform(F.element_at(table, x["rule_no"] + 1), lambda e: _fact(x["raw"], x["line_no"], e, g)))
    permissive = F.try_element_at(F.filter("lines", lambda x: is_permissive(x["raw"], g)), F.lit(1))
    item = F.struct(
        F.lit(g.acl_path).alias("field_path"),
        F.lit(True).alias("value_bool"),
        F.lit(None).cast("bigint").alias("value_int"),
        F.lit(None).cast("string").alias("value_str"),
        F.lit(True).alias("explicit"),
        permissive["line_no"].alias("src_line"),
        permissive["raw"].alias("src_raw"),
        F.lit("deterministic_parser").alias("method"),
        F.lit(1.0).alias("confidence"),
    ).cast(FACT_TYPE)
    none = F.array().cast(f"array<{FACT_TYPE}>")
    return computed(matched, facts=F.flatten(per_line).cast(f"array<{FACT_TYPE}>"), acl_items=F.when(permissive.isNotNull(), F.array(item)).otherwise(none))


def extract(configs: DataFrame, g: Grammar = Grammar(), text: str = "raw_text", vendor: str = "vendor") -> DataFrame:
    return emit_facts(match_lines(configs, g, text, vendor), g)


def _unknown(g: Grammar) -> Column:
    return F.filter("lines", lambda x: x["rule_no"].isNull() & x["raw"].rlike(any_of(g.security_keywords)))


def unknown_count(g: Grammar = Grammar()) -> Column:
    return F.size(_unknown(g))


def unknown_lines(matched: DataFrame, keys: list[str], g: Grammar = Grammar()) -> DataFrame:
    """Security-relevant lines no rule matched, one row each."""
    return matched.select(*keys, F.explode_outer(_unknown(g)).alias("u")).where(F.col("u").isNotNull()).select(*keys, F.col("u.line_no").alias("line_no"), F.col("u.raw").alias("raw"))


def long_facts(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Every fact as a row, before the last one per field wins."""
    return extracted.select(*keys, F.posexplode_outer("facts").alias("fact_no", "f")).where(F.col("f").isNotNull()).select(*keys, "fact_no", "f.*")


def latest_facts(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """The last fact per field. Facts sit in line order inside the row, so no grouping is needed."""
    paths = F.array_distinct(F.transform("facts", lambda f: f["field_path"]))
    last = F.transform(paths, lambda p: F.element_at(F.filter("facts", lambda f: f["field_path"] == p), -1))
    return extracted.select(*keys, F.explode_outer(last).alias("f")).where(F.col("f").isNotNull()).select(*keys, "f.*")


def baseline(extracted: DataFrame, keys: list[str], field_types: dict = field_catalog.FIELD_TYPES) -> DataFrame:
    """One row per (configuration, catalogue field); absent fields carry the unknown placeholder, other fields drop out."""
    catalogue = literal_rows([{"path": p, "type": t} for p, t in field_types.items() if "[]" not in p], "struct<path:string,type:string>")
    unknown = F.struct(
        F.lit(None).cast("boolean").alias("value_bool"),
        F.lit(None).cast("bigint").alias("value_int"),
        F.lit(None).cast("string").alias("value_str"),
        F.lit(False).alias("explicit"),
        F.lit(None).cast("int").alias("src_line"),
        F.lit(None).cast("string").alias("src_raw"),
        F.lit("default_assumed").alias("method"),
        F.lit(0.0).alias("confidence"),
    )
    rows = F.transform(
        catalogue,
        lambda c: F.struct(c["path"].alias("path"), F.try_element_at(F.filter("facts", lambda f: f["field_path"] == c["path"]), F.lit(-1)).alias("f")),
    )
    columns = ["value_bool", "value_int", "value_str", "explicit", "src_line", "src_raw", "method", "confidence"]
    out = extracted.select(*keys, F.explode_outer(rows).alias("r")).where(F.col("r").isNotNull())
    pick = [F.when(F.col("r.f").isNotNull(), F.col(f"r.f.{c}")).otherwise(unknown[c]).alias(c) for c in columns]
    return out.select(*keys, F.col("r.path").alias("field_path"), *pick).withColumn("needs_validation", F.col("confidence") < REVIEW_CONFIDENCE)


def nested_baseline(long_baseline: DataFrame, keys: list[str], field_types: dict = field_catalog.FIELD_TYPES) -> DataFrame:
    """The long baseline as nested structs, one row per configuration. Each configuration has at most one row per catalogue field."""
    leaf = F.struct("value_bool", "value_int", "value_str", "explicit", "confidence", "method", "src_line", "src_raw")
    packed = long_baseline.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field_path", leaf))).alias("m"))
    tree: dict = {}
    for path in field_types:
        if "[]" in path:
            continue
        node = tree
        *parents, name = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[name] = path

    def build(node: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else F.col("m")[v]).alias(k) for k, v in node.items()])

    return packed.select(*keys, *[build(v).alias(k) for k, v in tree.items()])


def overall_confidence(facts: Column) -> Column:
    """Mean over the distinct fields extracted, fields outside the baseline included; a fixed low value when there are none."""
    paths = F.array_distinct(F.transform(facts, lambda f: f["field_path"]))
    last = F.transform(paths, lambda p: F.element_at(F.filter(facts, lambda f: f["field_path"] == p), -1)["confidence"])
    total = F.aggregate(last, F.lit(0.0), lambda a, c: a + c)
    return F.when(F.size(last) > 0, total / F.size(last)).otherwise(F.lit(NO_FACT_CONFIDENCE))


def calibrated_confidence(similarity: Column, parser_certainty: Column, type_fits: Column, vendor_confidence: Column) -> Column:
    blended = F.lit(0.5) * similarity + F.lit(0.2) * F.when(type_fits, 1.0).otherwise(0.3) + F.lit(0.3) * vendor_confidence
    return F.when(parser_certainty >= 1.0, F.lit(1.0)).otherwise(round_half_up(clamp(blended), 4))


def validate_mapping(mappings: DataFrame, field_types: dict = field_catalog.FIELD_TYPES, path: str = "field_path", value: str = "value") -> DataFrame:
    """Does the path exist, and does the text fit its type? Adds valid, expected_type and error."""
    types = literal_map(field_types)
    typed = mappings.withColumn("expected_type", F.try_element_at(types, F.col(path)))
    v = F.col(value)
    fits = (
        F.when(F.col("expected_type") == "bool", F.lower(v).isin("true", "false"))
        .when(F.col("expected_type") == "int", v.try_cast("bigint").isNotNull())
        .when(F.col("expected_type") == "state", v.isin(field_catalog.STATES))
        .otherwise(v.isNotNull())
    )
    return (
        typed.withColumn("valid", F.col("expected_type").isNotNull() & F.coalesce(fits, F.lit(False)))
        .withColumn(
            "error",
            F.when(F.col("expected_type").isNull(), F.concat(F.lit("unknown field path "), F.col(path))).when(
                ~F.col("valid"), F.concat(F.lit("expected "), F.col("expected_type"), F.lit(", received "), F.coalesce(v, F.lit("null")))
            ),
        )
        .withColumn("expected_type", F.coalesce("expected_type", F.lit("unknown")))
    )
