"""Monthly cohort retention and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exact import percent
from tallyloom.model import CANCELLED
from tallyloom.operators.order_facts import month_number


def counted_orders(orders: DataFrame) -> DataFrame:
    """Orders that make their customer active: not cancelled, with customer, status and date."""
    return orders.filter(
        (F.col("order_status") != CANCELLED) & F.col("customer_id").isNotNull() & F.col("order_date").isNotNull()
    )


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Retention per cohort month and months since.

    A customer's cohort is the month of the first order that was not
    cancelled. Orders without a customer, status or date are left out.
    """
    active = (
        counted_orders(orders)
        .select("customer_id", month_number(F.col("order_date")).alias("month"))
        # Map tasks fold repeated months, so a customer with very many orders
        # reaches the window as one row per active month.
        .distinct()
    )
    first = F.min("month").over(W.partitionBy("customer_id"))
    counts = (
        active.select(first.alias("cohort"), (F.col("month") - first).alias("months_since_cohort"))
        .groupBy("cohort", "months_since_cohort")
        .agg(F.count(F.lit(1)).alias("retained_users"))
    )
    return retention_rates(counts)


def retention_rates(counts: DataFrame) -> DataFrame:
    """Sizes and rates for (cohort, months_since_cohort, retained_users); cohorts are months since year 0."""
    # Every customer is active at offset 0, so that count is the cohort's size.
    size = F.max(F.when(F.col("months_since_cohort") == 0, F.col("retained_users"))).over(W.partitionBy("cohort"))
    cohort_month = F.make_date(F.floor(F.col("cohort") / 12).cast("int"), (F.col("cohort") % 12 + 1).cast("int"), F.lit(1))
    return (
        counts.withColumn("cohort_size", size)
        .select(
            cohort_month.alias("cohort_month"),
            F.col("months_since_cohort").cast("int").alias("months_since_cohort"),
            "cohort_size",
            "retained_users",
            percent(F.col("retained_users"), F.col("cohort_size")).alias("retention_rate"),
        )
        .orderBy("cohort_month", "months_since_cohort")
    )


def cohort_pivot(cohorts: DataFrame, offsets: Sequence[int] | None = None) -> DataFrame:
    """One row per cohort month, one ``month_<k>`` column per offset.

    Without ``offsets``, every offset that occurs becomes a column (one small
    collect: at most as many values as months). Absent cells are NULL. A
    (cohort, offset) that occurs twice is an error.
    """
    if offsets is None:
        found = cohorts.select("months_since_cohort").distinct().collect()
        offsets = sorted(row[0] for row in found)
    rate = F.col("retention_rate")
    only = F.when(F.count(F.lit(1)) <= 1, F.first(rate)).otherwise(
        F.raise_error(F.lit("duplicate cohort month and offset"))
    )
    wide = cohorts.groupBy("cohort_month").pivot("months_since_cohort", list(offsets)).agg(only)
    named = [F.col(f"`{k}`").alias(f"month_{k}") for k in offsets]
    return wide.select("cohort_month", *named).orderBy("cohort_month")


def retention_window(pivot: DataFrame, up_to: int) -> DataFrame:
    """The pivot's columns up to offset ``up_to``, inclusive."""
    kept = [c for c in pivot.columns if c.startswith("month_") and int(c.removeprefix("month_")) <= up_to]
    return pivot.select("cohort_month", *kept)


def retention_curve(cohorts: DataFrame) -> DataFrame:
    """Size-weighted retention per offset, with two denominators.

    ``rate_present_only`` counts the cohorts that have a row at the offset;
    ``rate_eligible`` counts every cohort old enough to be seen there.
    """
    rows = cohorts.select(
        (F.year("cohort_month") * 12 + F.month("cohort_month")).alias("cohort"),
        "months_since_cohort",
        "cohort_size",
        "retained_users",
    )
    newest = rows.agg(F.max(F.col("cohort") + F.col("months_since_cohort")).alias("newest")).scalar()
    eligible = (
        rows.filter(F.col("months_since_cohort") == 0)
        .withColumn("months_since_cohort", F.explode(F.sequence(F.lit(0), newest - F.col("cohort"))))
        .groupBy("months_since_cohort")
        .agg(F.sum("cohort_size").alias("eligible_size"))
    )
    return (
        rows.groupBy("months_since_cohort")
        .agg(F.sum("retained_users").alias("retained_users"), F.sum("cohort_size").alias("present_size"))
        .join(eligible, "months_since_cohort")
        .select(
            "months_since_cohort",
            "retained_users",
            "present_size",
            "eligible_size",
            percent(F.col("retained_users"), F.col("present_size")).alias("rate_present_only"),
            percent(F.col("retained_users"), F.col("eligible_size")).alias("rate_eligible"),
        )
    )
