"""Assertions about subjects: contradiction, confidence, resolution, and the track record of learned patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confsieve.functions.numbers import clamp, round_half_up
from confsieve.functions.tables import literal_map

# How much each epistemic state counts, and the threshold of retirement.
RANKS = {"HUMAN_CONFIRMED": 6, "VERIFIED": 5, "KNOWN": 4, "INFERRED": 3, "ASSUMED": 2, "UNKNOWN": 1, "CONTRADICTED": 0}
MAX_CONTRADICTIONS = 3
SOURCE_BONUS = {"rule_engine": 0.5, "file": 0.2, "internal": 0.2}


def rank(epistemic: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(RANKS, "int"), epistemic), F.lit(0))


def _name_of_rank(r: Column) -> Column:
    return F.element_at(literal_map({str(v): k for k, v in RANKS.items()}), r.cast("string"))


def mark_contradictions(assertions: DataFrame) -> DataFrame:
    """A subject with two different statements contradicts itself, and all its rows say so.

    Least and greatest statement decide it: both combine map-side, where a set of statements per subject would not stay small.
    """
    spread = assertions.groupBy("subject").agg((F.min("statement") != F.max("statement")).alias("_clash"))
    joined = assertions.join(spread, "subject")
    return (
        joined.withColumn("epistemic", F.when(F.col("_clash"), "CONTRADICTED").otherwise(F.col("epistemic")))
        .withColumn("confidence", clamp(F.col("confidence")))
        .drop("_clash")
    )


def is_permitted(subject: Column, source: Column) -> Column:
    """Verdicts on rules may only come from the rule engine."""
    verdict = subject.endswith(".status") & F.contains(subject, F.lit("rule:"))
    return ~verdict | source.isNull() | (source == "rule_engine")


def assess(assertions: DataFrame, seek_below: float = 0.7) -> DataFrame:
    """Mean confidence, best state, assessment, bounds and the wish for more evidence, per subject."""
    r = rank(F.col("epistemic"))
    agg = assertions.groupBy("subject").agg(
        F.count("*").alias("assertions"),
        F.avg("confidence").alias("mean"),
        F.max(r).alias("top"),
        F.min(r).alias("bottom"),
        F.max(F.col("epistemic") == "CONTRADICTED").alias("clash"),
        F.min("confidence").alias("lowest"),
        F.max("confidence").alias("highest"),
    )
    mean = F.when(F.col("clash"), F.lit(0.0)).otherwise(round_half_up(F.col("mean"), 4))
    assessment = (
        F.when(F.col("clash"), "CONTRADICTED")
        .when((F.col("mean") >= 0.85) & F.col("top").isin(RANKS["VERIFIED"], RANKS["HUMAN_CONFIRMED"]), "HIGH_CONFIDENCE")
        .when(F.col("mean") >= 0.6, "MODERATE")
        .when(F.col("mean") >= 0.3, "LOW_CONFIDENCE")
        .otherwise("UNCERTAIN")
    )
    return agg.select(
        "subject",
        "assertions",
        mean.alias("confidence"),
        F.when(F.col("clash"), "CONTRADICTED").otherwise(_name_of_rank(F.col("top"))).alias("highest_state"),
        assessment.alias("assessment"),
        _name_of_rank(F.col("bottom")).alias("floor"),
        _name_of_rank(F.col("top")).alias("ceiling"),
        round_half_up(F.col("highest") - F.col("lowest"), 4).alias("spread"),
        (F.col("clash") | (mean < seek_below)).alias("needs_more"),
    )


def resolve_contradictions(assertions: DataFrame, order: str) -> DataFrame:
    """The best contradicted assertion of a subject becomes KNOWN, the others lose half their confidence.

    Best is confidence plus a bonus for its source; the earlier assertion wins ties. The winner comes from an aggregation, not from
    ranking the subject's rows against each other.
    """
    bonus = F.coalesce(F.try_element_at(literal_map(SOURCE_BONUS, "double"), F.col("source")), F.lit(0.0))
    contradicted = assertions.where(F.col("epistemic") == "CONTRADICTED").withColumn("_score", F.col("confidence") + bonus)
    winners = (
        contradicted.groupBy("subject")
        .agg(F.count("*").alias("_n"), F.max(F.struct("_score", (-F.col(order)).alias("_neg"))).alias("_w"))
        .where(F.col("_n") >= 2)
        .select("subject", (-F.col("_w._neg")).alias("_winner"))
    )
    joined = assertions.join(winners, "subject", "left")
    involved = F.col("_winner").isNotNull() & (F.col("epistemic") == "CONTRADICTED")
    wins = involved & (F.col(order) == F.col("_winner"))
    return (
        joined.withColumn("outcome", F.when(wins, "promoted").when(involved, "demoted").otherwise("unchanged"))
        .withColumn("confidence", F.when(involved & ~wins, F.col("confidence") * 0.5).otherwise(F.col("confidence")))
        .withColumn("epistemic", F.when(wins, "KNOWN").otherwise(F.col("epistemic")))
        .drop("_winner")
    )


def pattern_record(applications: DataFrame, pattern: str) -> DataFrame:
    """Uses, successes, contradictions per pattern; three contradictions retire it; only validated, live patterns may be cited.

    ``applications`` has outcome in (succeeded, failed, contradicted) and validated BOOLEAN.
    """
    o = F.col("outcome")
    agg = applications.groupBy(pattern).agg(
        F.count_if(o.isin("succeeded", "failed")).alias("applied"),
        F.count_if(o == "succeeded").alias("succeeded"),
        F.count_if(o == "failed").alias("failed"),
        F.count_if(o == "contradicted").alias("contradictions"),
        F.max("validated").alias("_validated"),
    )
    retired = F.col("contradictions") >= MAX_CONTRADICTIONS
    rate = F.when(F.col("applied") == 0, F.lit(0.0)).otherwise(round_half_up(F.col("succeeded") / F.nullif(F.col("applied"), F.lit(0)), 4))
    return agg.withColumn("success_rate", rate).withColumn("retired", retired).withColumn("citable", ~retired & F.col("_validated")).drop("_validated")


def recall_patterns(patterns: DataFrame, kind: str | None, keywords: list[str]) -> DataFrame:
    """Live patterns of a kind whose conditions mention any keyword, best success rate first."""
    out = patterns.where(~F.col("retired"))
    if kind is not None:
        out = out.where(F.col("pattern_type") == kind)
    if keywords:
        out = out.where(F.exists(F.lit([k.lower() for k in keywords]), lambda k: F.contains(F.lower("conditions"), k)))
    return out.orderBy(F.desc("success_rate"), "pattern")
