"""The eight rule operators as null-safe expressions over typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALAR_OPERATORS = ["equals", "not_equals", "in", "not_in", "greater_than_or_equal", "less_than_or_equal"]
LIST_OPERATORS = ["list_none_true", "list_all_true"]
OPERATORS = SCALAR_OPERATORS + LIST_OPERATORS


def same_value(value: Column, rule: Column) -> Column:
    """Equality inside the declared type only: 2, "2" and true never meet."""
    return (
        F.when(rule["value_type"] == "bool", value["value_bool"].eqNullSafe(rule["exp_bool"]))
        .when(rule["value_type"] == "int", value["value_int"].eqNullSafe(rule["exp_int"]))
        .otherwise(value["value_str"].eqNullSafe(rule["exp_str"]))
    )


def is_member(value: Column, rule: Column) -> Column:
    text = F.when(rule["value_type"] == "int", value["value_int"].cast("string")).otherwise(value["value_str"])
    return F.coalesce(F.array_contains(rule["exp_list"], text), F.lit(False))


def scalar_predicate(value: Column, rule: Column) -> Column:
    op = rule["operator"]
    return (
        F.when(op == "equals", same_value(value, rule))
        .when(op == "not_equals", ~same_value(value, rule))
        .when(op == "in", is_member(value, rule))
        .when(op == "not_in", ~is_member(value, rule))
        .when(op == "greater_than_or_equal", F.coalesce(value["value_int"] >= rule["exp_int"], F.lit(False)))
        .when(op == "less_than_or_equal", F.coalesce(value["value_int"] <= rule["exp_int"], F.lit(False)))
    )


def list_predicate(values: Column, op: Column) -> Column:
    """``values`` is array<boolean>; an empty list satisfies both operators."""
    return F.when(op == "list_none_true", ~F.exists(values, lambda v: v.eqNullSafe(F.lit(True)))).when(
        op == "list_all_true", F.forall(values, lambda v: v.eqNullSafe(F.lit(True)))
    )
