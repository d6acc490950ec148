"""What must hold for the plans when one key has a third of all rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import customers as c
from tallyloom.operators import funnel as f
from tallyloom.operators import products as p
from tallyloom.operators import retention as r
from tallyloom.operators import sales as s
from tests.conftest import rows

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SMALL_SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    # Map outputs of small files are merged otherwise; splits follow map outputs.
    "spark.sql.files.maxPartitionBytes": "64KB",
    "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture
def settings(spark):
    before = {}

    def change(values):
        for key, value in values.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    """The plan that ran, without the initial plans of it and of its subqueries."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def skewed(spark, make, tmp_path_factory):
    """A third of the lines is of order 1, a third of product 1; a third of the orders is of customer 1."""
    n = 60_000
    hot = F.col("id") % 3 == 0
    folder = tmp_path_factory.mktemp("skewed")
    items = spark.range(0, n, 1, 12).select(
        F.col("id").alias("order_item_id"),
        F.when(hot, 1).otherwise(F.col("id") % 5000 + 2).alias("order_id"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.xxhash64("id") % 150 + 151).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.lit(1).cast("decimal(18,2)").alias("price_per_unit"),
        (F.col("id") % 1000).cast("decimal(18,2)").alias("total_sale"),
    )
    items.write.parquet(f"{folder}/items")
    orders = spark.range(1, 5002).select(
        F.col("id").alias("order_id"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("order_date"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 400 + 2).alias("customer_id"),
        (F.col("id") % 40).alias("seller_id"),
        F.when(F.col("id") % 4 == 0, "Returned").otherwise("Completed").alias("order_status"),
    )
    orders.write.parquet(f"{folder}/orders")
    products = make("products", *[(i, f"p{i}", 1, 1, i % 6) for i in range(1, 303)])
    customers = make("customers", *[(i, "a", str(i), "hot" if i % 3 else "cold", "x") for i in range(1, 403)])
    return {
        "items": spark.read.parquet(f"{folder}/items"),
        "orders": spark.read.parquet(f"{folder}/orders"),
        "products": products,
        "customers": customers,
    }


def test_line_level_join_is_split_for_a_hot_order(skewed, settings):
    settings(NO_BROADCAST | SMALL_SKEW)
    for df in (
        p.top_products(skewed["orders"], skewed["items"], skewed["products"]),
        p.top_returned_products(skewed["orders"], skewed["items"], skewed["products"]),
        p.yoy_decline(skewed["orders"], skewed["items"], skewed["products"]),
    ):
        assert "skew=true" in final_plan(df)


def test_lines_are_folded_before_their_exchange(skewed, settings):
    """Customer reports: the exchange on order_id carries partial sums, not lines."""
    settings(NO_BROADCAST)
    for df in (
        c.customer_aov(skewed["orders"], skewed["items"], skewed["customers"]),
        c.state_revenue(skewed["orders"], skewed["items"], skewed["customers"]),
        s.monthly_sales_trend(skewed["orders"], skewed["items"]),
    ):
        plan = final_plan(df)
        assert len(re.findall(r"FileScan parquet \[[^\]]*total_sale", plan)) == 1
        assert re.search(r"Exchange hashpartitioning\(order_id#\d+L, \d+\).*\n[^\n]*HashAggregate\(keys=\[order_id#\d+L\][^\n]*partial_sum", plan)


def test_results_do_not_depend_on_partitions(spark, skewed, settings):
    def results(partitions, broadcast):
        settings({"spark.sql.shuffle.partitions": str(partitions)} | ({} if broadcast else NO_BROADCAST))
        items, orders = skewed["items"].repartition(partitions), skewed["orders"].repartition(partitions)
        frames = [
            p.top_products(orders, items, skewed["products"]),
            c.customer_clv_rank(orders, items, skewed["customers"]),
            c.top_customers_per_state(orders, items, skewed["customers"]),
            p.product_margin_rank(items, skewed["products"]),
            r.cohort_retention(orders),
        ]
        return [sorted(rows(df), key=repr) for df in frames]

    assert results(2, True) == results(7, False)


def test_no_join_without_keys(spark, skewed, settings):
    settings(NO_BROADCAST)
    events = spark.range(1000).select(
        (F.col("id") % 3 * F.col("id") % 7).alias("user_id"),
        F.timestamp_seconds(F.col("id") * 977).alias("ts"),
        F.when(F.col("id") % 2 == 0, "view").otherwise("buy").alias("event_type"),
    )
    for df in (
        f.event_funnel(events, [("v", "view"), ("b", "buy")], 12),
        c.customer_clv_rank(skewed["orders"], skewed["items"], skewed["customers"]),
        s.kpi_summary(skewed["customers"], skewed["orders"], skewed["items"], skewed["products"], skewed["products"].select(F.col("product_id").alias("seller_id"))),
        s.payment_status_share(skewed["orders"], skewed["orders"].select("order_id", F.col("order_status").alias("payment_status"))),
        r.retention_curve(r.cohort_retention(skewed["orders"])),
    ):
        assert not re.search("NestedLoop|Cartesian", final_plan(df))


def test_event_slices_share_one_scan(spark, settings, tmp_path):
    settings(NO_BROADCAST)
    kind = F.element_at(F.array(F.lit("view"), F.lit("cart"), F.lit("buy")), (F.col("id") % 3 + 1).cast("int"))
    spark.range(5000).select(
        (F.col("id") % 4).alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), kind.alias("event_type")
    ).write.parquet(f"{tmp_path}/events")
    steps = [("v", "view"), ("c", "cart"), ("b", "buy")]
    plan = final_plan(f.event_funnel(spark.read.parquet(f"{tmp_path}/events"), steps, 12))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_filters_and_columns_reach_the_scan(skewed, settings, tmp_path, make, spark):
    settings(NO_BROADCAST)
    plan = final_plan(p.yoy_decline(skewed["orders"], skewed["items"], skewed["products"]))
    assert re.search(r"PushedFilters: \[[^\n]*GreaterThanOrEqual\(order_date,2022-01-01\)", plan)
    assert "ReadSchema: struct<order_id:bigint,product_id:bigint,total_sale:decimal(18,2)>" in plan
    make("inventory", (1, 1, 9, 1, None)).write.parquet(f"{tmp_path}/inventory")
    plan = final_plan(p.low_inventory(spark.read.parquet(f"{tmp_path}/inventory"), skewed["products"]))
    assert "LessThan(stock,10)" in plan
    plan = final_plan(r.cohort_retention(skewed["orders"]))
    assert "Not(EqualTo(order_status,Cancelled))" in plan
    assert "ReadSchema: struct<order_date:date,customer_id:bigint,order_status:string>" in plan
