"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def spread_lookup(facts: DataFrame, lookup: DataFrame, key: str, slot: Column) -> DataFrame:
    """Left join to ``lookup``, which has one row per ``key``.

    The facts of a key are spread over the values of ``slot``, and the lookup
    row is sent only to the (key, slot) pairs that occur. Adaptive skew
    handling cannot split this join when the lookup is itself an aggregate.
    """
    slotted = facts.withColumn("_slot", slot)
    wanted = slotted.select(key, "_slot").distinct().join(lookup, key)
    return slotted.join(wanted, [key, "_slot"], "left").drop("_slot")
