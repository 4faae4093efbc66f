"""Runnable queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from confsieve.plans.registry import ORACLES, QUERIES

AREAS = ["texts", "audits", "evidences", "fleets", "logs", "quality", "reviews", "fixes", "corpora", "streams"]


def all_queries() -> tuple[dict, dict]:
    for area in AREAS:
        import_module(f"confsieve.plans.{area}")
    return QUERIES, ORACLES


def flagship(spark, folder):
    return all_queries()[0]["fleet_scorecard"](spark, folder)
