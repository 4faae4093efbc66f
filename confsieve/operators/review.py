"""The review queue: which control a directive belongs to, how far it is trusted, what was decided about it before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.catalog.review import CONTROL_KEYWORDS
from confsieve.catalog.rules import RULES
from confsieve.functions.numbers import clamp, round_half_up
from confsieve.functions.tables import computed, literal_map
from confsieve.functions.text import any_of, first_of_keys, flatten_markup, is_reviewable, resolution_key
from confsieve.operators.extract import Grammar, rule_number

UNMAPPED = "UNMAPPED"
# Weights and bands of the trust score.
TRUST_WEIGHTS = {"mapped": 0.30, "known": 0.25, "learned": 0.20, "similar": 0.15, "vendor": 0.10}
HIGH, MEDIUM = 0.70, 0.45


def control_of(text: Column, field_path: Column, rule_hint: Column, rules: list = RULES, keywords: list = CONTROL_KEYWORDS, low: Column | None = None) -> Column:
    """The control a directive is about: the hinted rule, else the rule of its field, else the first keyword row that fits.

    ``text`` is the directive with its markup flattened; as a column and not an expression, for it is read once per keyword row. ``low``
    is the text and the field path in lower case, also as a column: a row's pattern is tried only where it holds one of the row's words.
    """
    ids = [r["id"] for r in rules]
    by_field: dict = {}
    for r in rules:
        by_field.setdefault(r["field_path"], r["id"])
    haystack = F.concat(text, F.lit(" "), F.coalesce(field_path, F.lit("")))
    chain = None
    for rule_id, words in keywords:
        if rule_id not in ids:
            continue
        hit = haystack.rlike(any_of(words))
        if low is not None:
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in _least(words)]) & hit
        chain = F.when(hit, rule_id) if chain is None else chain.when(hit, rule_id)
    by_words = F.lit(None).cast("string") if chain is None else chain
    return F.coalesce(F.when(rule_hint.isin(ids), rule_hint), F.try_element_at(literal_map(by_field), field_path), by_words, F.lit(UNMAPPED))


def _least(words: list[str]) -> list[str]:
    """The words that hold no other of the words."""
    return [w for w in dict.fromkeys(words) if not any(o.lower() in w.lower() for o in words if o.lower() != w.lower())]


def with_control(df: DataFrame, text: str, field_path: Column, rule_hint: Column, rules: list = RULES, keywords: list = CONTROL_KEYWORDS) -> DataFrame:
    """Adds ``control``."""
    flat = computed(df, _flat=flatten_markup(F.col(text)))
    low = computed(flat, _low=F.lower(F.concat(F.col("_flat"), F.lit(" "), F.coalesce(field_path, F.lit("")))))
    return computed(low, control=control_of(F.col("_flat"), field_path, rule_hint, rules, keywords, F.col("_low"))).drop("_flat", "_low")


def rule_attribute(control: Column, name: str, rules: list = RULES) -> Column:
    return F.try_element_at(literal_map({r["id"]: None if r.get(name) is None else str(r[name]) for r in rules}), control)


def learned_weights(directives: DataFrame, key: str, text: str, weights: DataFrame) -> DataFrame:
    """Mean learned weight of a directive's tokens and the share of them that has one. ``weights`` has token and weight."""
    raw = F.filter(F.split(F.col(text), r"\s+", -1), lambda t: F.length(t) > 2)
    tokens = F.transform(raw, lambda t: F.btrim(F.lower(t), F.lit("\"'")))
    exploded = directives.select(key, F.explode_outer(tokens).alias("token"))
    joined = exploded.join(weights, "token", "left")
    return joined.groupBy(key).agg(
        F.count("token").alias("tokens"),
        F.count("weight").alias("known_tokens"),
        F.coalesce(F.avg("weight"), F.lit(0.0)).alias("learned"),
    )


def trust(mapped: Column, known: Column, learned: Column, similar: Column, vendor_confidence: Column) -> Column:
    w = TRUST_WEIGHTS
    score = (
        F.lit(w["mapped"]) * F.when(mapped, 1.0).otherwise(0.0)
        + F.lit(w["known"]) * F.when(known, 1.0).otherwise(0.0)
        + F.lit(w["learned"]) * learned
        + F.lit(w["similar"]) * similar
        + F.lit(w["vendor"]) * vendor_confidence
    )
    return round_half_up(clamp(score), 3)


def trust_band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def trust_factors(mapped: Column, known: Column, learned: Column, similar: Column, vendor_confidence: Column) -> Column:
    """The five parts of the score, so that a person can see where it comes from."""
    values = {"mapped": F.when(mapped, 1.0).otherwise(0.0), "known": F.when(known, 1.0).otherwise(0.0), "learned": learned, "similar": similar, "vendor": vendor_confidence}
    return F.array(*[F.struct(F.lit(n).alias("label"), round_half_up(values[n], 3).alias("value"), F.lit(TRUST_WEIGHTS[n]).alias("weight")) for n in TRUST_WEIGHTS])


ENTRY_TYPE = "struct<key:string,source:int,line_no:int,command:string,rule_hint:string,field_hint:string>"


def queue_in_row(rows: DataFrame, keys: list[str], g: Grammar = Grammar(), filename: str = "filename") -> DataFrame:
    """The queue of every configuration, found inside its row: lines that no rule matched, and lines behind failing findings.

    ``rows`` has ``lines`` (extract) and ``findings`` (rules.findings_in_row). Out come keys, line_no, command, rule_hint, field_hint,
    resolution_key, and ``first``: the entry that stands for its key, unknown lines before gated findings. Nothing is shuffled."""
    none = F.lit(None).cast("string")
    unknown = F.filter("lines", lambda x: x["rule_no"].isNull() & x["raw"].rlike(any_of(g.security_keywords)))
    gated = F.filter("findings", lambda f: (f["status"] == "fail") & f["src_raw"].isNotNull())
    both = F.concat(
        F.transform(unknown, lambda x: F.struct(F.lit(0).alias("source"), x["line_no"].alias("line_no"), x["raw"].alias("command"), none.alias("rule_hint"), none.alias("field_hint"))),
        F.transform(gated, lambda f: F.struct(F.lit(1).alias("source"), f["src_line"].alias("line_no"), f["src_raw"].alias("command"), f["rule_id"].alias("rule_hint"), f["field_path"].alias("field_hint"))),
    )
    staged = computed(rows.select(*dict.fromkeys([*keys, filename]), both.alias("_both")), _kept=F.filter("_both", lambda x: is_reviewable(x["command"])))
    keyed = F.transform("_kept", lambda x: F.struct(resolution_key(F.col(filename), x["command"]).alias("key"), *[x[c].alias(c) for c in ("source", "line_no", "command", "rule_hint", "field_hint")]))
    ordered = computed(staged, _ordered=F.array_sort(keyed.cast(f"array<{ENTRY_TYPE}>")))
    marked = ordered.select(*dict.fromkeys([*keys, filename]), F.explode(first_of_keys("_ordered")).alias("e"))
    return marked.select(*dict.fromkeys([*keys, filename]), "e.entry.line_no", "e.entry.command", "e.entry.rule_hint", "e.entry.field_hint", F.col("e.entry.key").alias("resolution_key"), "e.first")


def with_verdicts(commands: DataFrame, verdicts: DataFrame, include_resolved: bool = True) -> DataFrame:
    """Adds the stored verdict; ``verdicts`` has one row per resolution_key."""
    joined = commands.join(verdicts.select("resolution_key", "verdict", "reviewer"), "resolution_key", "left")
    out = joined.withColumn("resolved", F.col("verdict").isNotNull())
    return out if include_resolved else out.where(~F.col("resolved"))


def queue_totals(commands: DataFrame) -> DataFrame:
    """Pending and resolved per file, and over all files under the name ``(all)``. One pass with a grouping set."""
    rolled = commands.rollup("filename").agg(F.count_if(~F.col("resolved")).alias("pending"), F.count_if("resolved").alias("resolved"), F.grouping("filename").alias("_all"))
    return rolled.withColumn("filename", F.when(F.col("_all") == 1, "(all)").otherwise(F.col("filename"))).drop("_all")


def known_pattern(text: Column, vendor: Column, g: Grammar = Grammar()) -> Column:
    """Rule number of the vendor-neutral grammar for the line as it stands, else with its markup flattened."""
    neutral = Grammar(vendor_rules=[], fallback_rules=g.fallback_rules, keyword_rules=g.keyword_rules)
    return F.coalesce(rule_number(text, vendor, neutral), rule_number(flatten_markup(text), vendor, neutral))


def seed_entries(records: DataFrame, keys: list[str], lines: str, vendor: str, g: Grammar = Grammar()) -> DataFrame:
    """Knowledge entries out of documentation: example lines of at least five characters the vendor-neutral grammar matches."""
    from confsieve.functions.tables import literal_rows
    from confsieve.functions.text import numbered_lines

    rows = [{"field_path": r[1], "category": r[3]} for r in g.fallback_rules] + [{"field_path": r[2], "category": r[4]} for r in g.keyword_rules]
    table = literal_rows(rows, "struct<field_path:string,category:string>")
    exploded = records.select(*keys, vendor, F.explode_outer(numbered_lines(F.col(lines))).alias("l")).where(F.col("l").isNotNull()).where(F.length("l.raw") >= 5)
    matched = exploded.select(*keys, vendor, F.col("l.line_no").alias("line_no"), F.col("l.raw").alias("raw_pattern")).withColumn("_n", known_pattern(F.col("raw_pattern"), F.col(vendor), g))
    hit = F.element_at(table, F.col("_n") + 1)
    return matched.where(F.col("_n").isNotNull()).select(
        *keys, F.col(vendor), "line_no", "raw_pattern", hit["field_path"].alias("field_path"), hit["category"].alias("category")
    )
