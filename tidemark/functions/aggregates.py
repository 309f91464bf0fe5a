"""Aggregate policies for hourly reduction.

A policy names how one column collapses to one value per group:

* ``mean``, ``min``, ``max`` -- built-in aggregates, which skip NULLs already.
* ``first`` / ``last`` -- the earliest / latest non-NULL value by a time column,
  as ``min``/``max`` of a ``(time, value)`` struct that is NULL where the value
  is NULL (aggregates skip NULL inputs).  For ties in time the value itself
  breaks the tie (smallest for first, largest for last), so the answer does not
  depend on partitioning or row order.

All of them are partial-aggregate friendly: a hot group is reduced map-side
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("mean", "min", "max", "first", "last")


def first_non_null(value: str, order: str) -> Column:
    """Earliest non-NULL ``value`` by ``order`` (ties: smallest value)."""
    v = F.col(value)
    return F.min(F.when(v.isNotNull(), F.struct(F.col(order).alias("t"), v.alias("v"))))["v"]


def last_non_null(value: str, order: str) -> Column:
    """Latest non-NULL ``value`` by ``order`` (ties: largest value)."""
    v = F.col(value)
    return F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("t"), v.alias("v"))))["v"]


def policy_agg(column: str, policy: str, order: str | None = None, source: str | None = None) -> Column:
    """The aggregate of ``policy`` over ``source`` (default ``column``), named ``column``."""
    src = source or column
    if policy == "mean":
        e = F.avg(F.col(src))
    elif policy == "min":
        e = F.min(src)
    elif policy == "max":
        e = F.max(src)
    elif policy == "first":
        e = first_non_null(src, order)
    elif policy == "last":
        e = last_non_null(src, order)
    else:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")
    return e.alias(column)


def state_aggs(column: str, policy: str, order: str | None = None) -> list[Column]:
    """Aggregates whose values ``merge_agg`` combines to the policy's result over several groups."""
    v = F.col(column)
    if policy == "mean":
        return [F.sum(v).alias(f"_s_{column}"), F.count(v).alias(f"_n_{column}")]
    if policy in ("first", "last"):
        pair = F.when(v.isNotNull(), F.struct(F.col(order).alias("t"), v.alias("v")))
        return [(F.min(pair) if policy == "first" else F.max(pair)).alias(f"_s_{column}")]
    return [policy_agg(column, policy).alias(f"_s_{column}")]


def merge_agg(column: str, policy: str) -> Column:
    """The policy's result from the columns of ``state_aggs``."""
    s = F.col(f"_s_{column}")
    e = {"mean": lambda: F.sum(s) / F.sum(f"_n_{column}"), "min": lambda: F.min(s), "max": lambda: F.max(s),
         "first": lambda: F.min(s)["v"], "last": lambda: F.max(s)["v"]}[policy]()
    return e.alias(column)
