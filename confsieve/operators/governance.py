"""Rule versions: validation, proposal, two-person approval, activation, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.functions.digest import canonical, hmac_sha256, sha256
from confsieve.functions.predicates import OPERATORS
from confsieve.functions.tables import literal_map
from confsieve.operators.latest import previous_in_order

APPROVALS_NEEDED = 2
REQUIRED = ["rule_id", "title", "framework", "severity", "field_path", "operator", "expected"]


def validation_errors(field_types: dict) -> Column:
    """All that is wrong with a proposed rule, as an array of texts."""
    known = F.map_contains_key(literal_map(field_types), F.coalesce(F.col("field_path"), F.lit("")))
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    return F.array_compact(
        F.array(
            *missing,
            F.when(F.col("field_path").isNotNull() & ~known, F.concat(F.lit("unknown field path "), F.col("field_path"))),
            F.when(F.col("operator").isNotNull() & ~F.col("operator").isin(OPERATORS), F.concat(F.lit("unsupported operator "), F.col("operator"))),
        )
    )


def rule_digest() -> Column:
    return sha256(canonical(F.col("rule_id"), F.col("version"), F.col("field_path"), F.col("operator"), F.col("expected"), F.col("severity"), F.col("framework")))


def sign(versions: DataFrame, key: str) -> DataFrame:
    return versions.withColumn("rule_hash", rule_digest()).withColumn("signature", hmac_sha256(key, F.col("rule_hash")))


def verify_signatures(stored: DataFrame, key: str) -> DataFrame:
    """Stored versions with whether digest and signature still fit their content."""
    return stored.withColumn("hash_valid", F.col("rule_hash") == rule_digest()).withColumn(
        "signature_valid", F.col("signature") == hmac_sha256(key, rule_digest())
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """The latest ACTIVE version per rule, else its last version. One aggregation over (active first, version)."""
    rest = [c for c in versions.columns if c != "rule_id"]
    rank = F.struct((F.col("status") == "ACTIVE").cast("int").alias("a"), F.col("version").alias("v"))
    return versions.groupBy("rule_id").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("rule_id", "r.*")


def previous_versions(versions: DataFrame) -> DataFrame:
    """Every version with the number and expectation of the one before it in its rule."""
    out = previous_in_order(versions, ["rule_id"], "version", ["expected"])
    return out.withColumn("previous_version", F.col("previous.version")).withColumn("previous_expected", F.col("previous.expected")).drop("previous")


def field_conflict(proposed: DataFrame, active: DataFrame) -> DataFrame:
    """Marks proposals whose field another active rule reads: whether, how many such rules there are, and the first of them.

    Rules of one field are not paired with each other; their number and their two lowest ids answer all three.
    """
    rules = active.select("field_path", "rule_id").distinct()
    lowest = rules.groupBy("field_path").agg(F.count("*").alias("_n"), F.min("rule_id").alias("_lo"))
    second = rules.join(lowest, "field_path").where(F.col("rule_id") != F.col("_lo")).groupBy("field_path").agg(F.min("rule_id").alias("_next"))
    own = rules.withColumn("_own", F.lit(1))
    joined = proposed.join(lowest, "field_path", "left").join(second, "field_path", "left").join(own, ["field_path", "rule_id"], "left")
    others = F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))
    first = F.when(F.col("_lo") != F.col("rule_id"), F.col("_lo")).otherwise(F.col("_next"))
    return (
        joined.withColumn("conflicting_rules", others).withColumn("conflict", others > 0).withColumn("first_conflict", F.when(others > 0, first)).drop("_n", "_lo", "_next", "_own")
    )


def propose(versions: DataFrame, proposals: DataFrame, field_types: dict) -> DataFrame:
    """New versions from proposals: fields left null keep the current version's value; validation or a conflict blocks.

    ``proposals`` has one row per rule with the changed fields; versions stay as they are.
    """
    current = current_versions(versions)
    last = versions.groupBy("rule_id").agg(F.max("version").alias("_last"))
    changed = ["title", "framework", "severity", "field_path", "operator", "expected"]
    p = proposals.select("rule_id", *[F.col(c).alias(f"_{c}") for c in changed])
    merged = current.join(p, "rule_id").join(last, "rule_id")
    for c in changed:
        merged = merged.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    merged = merged.withColumn("version", F.col("_last") + 1).drop("_last", *[f"_{c}" for c in changed])
    active = current.where(F.col("status") == "ACTIVE").select("rule_id", "field_path")
    checked = field_conflict(merged.withColumn("errors", validation_errors(field_types)), active)
    outcome = F.when(F.size("errors") > 0, "invalid").when(F.col("conflict"), "conflict").otherwise("accepted")
    return checked.withColumn("outcome", outcome).withColumn("status", F.when(outcome == "accepted", "PENDING_APPROVAL").otherwise("REJECTED"))


def approval_state(approvals: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct reviewers per version; a reviewer who approves twice counts once."""
    # The two-step count keeps a version with most of the approvals spread over its reviewers.
    distinct = approvals.groupBy(*keys, "reviewer").agg(F.count("*").alias("_times"))
    counted = distinct.groupBy(*keys).agg(F.count("*").alias("reviewers"), F.sum(F.col("_times") - 1).alias("repeats"))
    return counted.withColumn("status", F.when(F.col("reviewers") >= APPROVALS_NEEDED, "APPROVED").otherwise("APPROVED_BY_ONE"))


def activate(states: DataFrame, rule: str, version: str) -> DataFrame:
    """Among approved versions of a rule the last one is active, earlier ones are superseded; the rest wait."""
    top = states.where(F.col("status") == "APPROVED").groupBy(rule).agg(F.max(version).alias("_top"))
    joined = states.join(top, rule, "left")
    approved = F.col("status") == "APPROVED"
    return joined.withColumn(
        "status", F.when(approved & (F.col(version) == F.col("_top")), "ACTIVE").when(approved, "SUPERSEDED").otherwise(F.col("status"))
    ).drop("_top")
