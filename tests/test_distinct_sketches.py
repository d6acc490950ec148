"""Distinct counts by sketches: error, merging, incremental adds, plans."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.distinct_sketches import (
    LG_K,
    SketchStore,
    distinct_count,
    error_bound,
    estimates,
    month_number,
    monthly_sketches,
)
from tallyloom.operators.funnel import fulfillment_funnel
from tallyloom.operators.sales import kpi_summary


def orders(spark, n, customers, months=24):
    """``n`` orders over ``months`` months from January 2020; one customer has a third of them."""
    number = F.col("id")
    customer = F.when(number % 3 == 0, 0).otherwise(F.pmod(F.xxhash64(number), F.lit(customers)))
    day = F.add_months(F.lit(date(2020, 1, 5)), (number % months).cast("int"))
    return spark.range(n).select(
        number.alias("order_id"),
        day.alias("order_date"),
        customer.alias("customer_id"),
        F.lit("Completed").alias("order_status"),
    )


@pytest.mark.parametrize("lg_k", [8, 12, 14])
def test_error_stays_within_the_bound(spark, lg_k):
    for n in (0, 1, 10, 3_000, 200_000):
        row = spark.range(n).agg(distinct_count("id", lg_k).alias("near"), distinct_count("id").alias("exact"))
        near, exact, bound = row.select("near", "exact", error_bound(F.col("exact"), lg_k)).first()
        assert exact == n and abs(near - exact) <= bound


def test_null_is_no_value(spark):
    df = spark.createDataFrame([(None,), (None,)], "id long")
    assert df.agg(distinct_count("id", LG_K)).first()[0] == 0


def test_any_range_of_months_from_monthly_sketches(spark, tmp_path):
    df = orders(spark, 60_000, 9_000)
    store = SketchStore(spark, str(tmp_path / "sketches"), ("customer_id", "order_id"))
    store.add(df, "order_date")
    for first, last in [(None, None), (date(2020, 3, 1), date(2020, 3, 31)), (date(2020, 11, 9), date(2021, 6, 2)), (date(2022, 1, 1), None)]:
        within = F.lit(True)
        if first:
            within &= F.col("order_date") >= first.replace(day=1)
        if last:
            within &= month_number("order_date") <= last.year * 12 + last.month - 1
        exact = df.filter(within).agg(F.countDistinct("customer_id"), F.countDistinct("order_id")).first()
        near = store.total(first, last).first()
        for a, b in zip(near, exact):
            assert abs(a - b) <= max(0.5, b * 3 * 1.04 / 64)


def test_adding_again_changes_nothing_and_adding_more_merges(spark, tmp_path):
    df = orders(spark, 30_000, 5_000)
    store = SketchStore(spark, str(tmp_path / "sketches"), ("customer_id",))
    store.add(df.filter("order_id < 20000"), "order_date")
    once = store.total().first()
    store.add(df.filter("order_id < 20000"), "order_date")
    assert store.total().first() == once
    store.add(df.filter("order_id >= 15000"), "order_date")
    exact = df.agg(F.countDistinct("customer_id")).first()[0]
    assert abs(store.total().first()[0] - exact) <= exact * 3 * 1.04 / 64
    compact = store.compact(str(tmp_path / "compact"))
    assert compact.sketches().count() == 24 < store.sketches().count()
    assert compact.total().first() == store.total().first()
    assert sorted(compact.per_months(12).collect()) == sorted(store.per_months(12).collect())


def test_rows_without_a_day_and_no_rows(spark, tmp_path):
    df = orders(spark, 10, 5).withColumn("order_date", F.lit(None).cast("date"))
    assert monthly_sketches(df, "order_date", ["customer_id"]).count() == 0
    none = monthly_sketches(orders(spark, 0, 1), "order_date", ["customer_id"])
    assert estimates(none, ["customer_id"]).first()[0] == 0


def test_sketches_need_no_shuffle_of_the_values(spark):
    df = orders(spark, 1000, 50).repartition(4)
    exact = fulfillment_funnel(df)._jdf.queryExecution().executedPlan().toString()
    sketched = fulfillment_funnel(df, LG_K)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" in exact
    assert "hashpartitioning" not in sketched and "partial_hll_sketch_agg" in sketched


def test_a_range_reads_its_months_only(spark, tmp_path):
    store = SketchStore(spark, str(tmp_path / "sketches"), ("customer_id",))
    store.add(orders(spark, 1000, 50), "order_date")
    found = store.sketches(date(2020, 2, 1), date(2020, 4, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    low, high = 2020 * 12 + 1, 2020 * 12 + 3
    assert re.search(rf"PartitionFilters: \[isnotnull\(month.*>= {low}\).*<= {high}\)", plan)
    assert found.select("month").distinct().count() == 3


def test_options_of_the_reports(spark, make):
    customers = make("customers", *((i, "a", "b", "c", "d") for i in range(40)))
    placed = orders(spark, 150, 30).withColumn("seller_id", F.lit(1))
    tables = (customers, placed, make("order_items", (1, 1, 1, 1, "2.00", "2.00")), make("products"), make("sellers"))
    exact, near = kpi_summary(*tables).first(), kpi_summary(*tables, sketch_lg_k=LG_K).first()
    assert exact.asDict().keys() == near.asDict().keys()
    assert exact == near  # so few values are counted exactly by a sketch
    assert fulfillment_funnel(placed, LG_K).collect() == fulfillment_funnel(placed).collect()
