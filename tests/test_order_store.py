"""Stored orders and lines: no exchange of lines, months pruned, hot orders apart."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import customers as c
from tallyloom.operators import products as p
from tallyloom.operators import sales as s
from tallyloom.operators.order_facts import lines_of, order_totals, with_totals
from tallyloom.sources.order_store import OrderStore
from tests.conftest import rows
from tests.test_scale import NO_BROADCAST, final_plan, settings, skewed  # noqa: F401


@pytest.fixture(scope="module")
def store(spark, skewed, tmp_path_factory):  # noqa: F811
    stored = OrderStore(spark, "skewed_store", str(tmp_path_factory.mktemp("store")), buckets=4)
    nameless = skewed["items"].limit(5).withColumn("order_id", F.lit(None).cast("long"))
    unknown = skewed["items"].limit(3).withColumn("order_id", F.lit(10**9))
    lines = skewed["items"].unionByName(nameless).unionByName(unknown)
    stored.write(skewed["orders"], lines, most_lines=1000)
    yield stored, lines
    stored.drop()


def exchanged(plan: str, table: str) -> list[str]:
    """The exchanges that rows of the table's scan go through."""
    found, open_ = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        open_ = [(d, text) for d, text in open_ if d < depth]
        if "Exchange" in line:
            open_.append((depth, line.strip()))
        if table in line and "Scan" in line:
            found += [text for _, text in open_]
    return found


def test_hot_orders_are_apart(store):
    lines = store[0].lines()
    assert rows(lines.hot_orders) == [(1,)]
    assert {r[0] for r in rows(lines.hot.select("order_id").distinct())} == {1, None}
    assert lines.cold.filter("order_id = 1 or order_id is null").count() == 0
    assert lines.all().count() == store[1].count()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_totals_as_of_plain_lines(store, how):
    orders, lines = store[0].orders(), store[0].lines()
    columns = ("order_id", "order_date", "lines", "revenue", "largest_line")
    plain = with_totals(orders, store[1], how)
    assert sorted(rows(with_totals(orders, lines, how), *columns), key=repr) == sorted(rows(plain, *columns), key=repr)
    assert sorted(rows(order_totals(lines)), key=repr) == sorted(rows(order_totals(store[1])), key=repr)


def test_cold_lines_meet_their_orders_without_an_exchange(store, settings):  # noqa: F811
    settings(NO_BROADCAST)
    orders, lines = store[0].orders(), store[0].lines()
    for joined in (
        with_totals(orders.select("order_id", "customer_id"), lines),
        lines_of(lines, orders.select("order_id", "order_date"), "product_id", "total_sale"),
    ):
        plan = final_plan(joined)
        assert "skewed_store_lines" in plan
        assert exchanged(plan, "skewed_store_lines") == []
        # the hot part goes through an exchange, as any table
        assert exchanged(plan, "hot_lines")
    plain = final_plan(with_totals(orders.select("order_id", "customer_id"), store[1]))
    assert "Exchange hashpartitioning(order_id" in plain


def test_a_hot_order_is_spread_over_tasks(store, settings):  # noqa: F811
    settings(NO_BROADCAST | {"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    orders, lines = store[0].orders(), store[0].lines()
    joined = lines_of(lines, orders.select("order_id", "order_date"), "product_id", "total_sale")
    dealt = exchanged(final_plan(joined), "hot_lines")
    # What is dealt by the order alone is one row per order and slot.
    assert re.search(r"hashpartitioning\(order_id#\d+L, _slot", dealt[0])
    sizes = joined.filter("order_id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 20_000
    assert joined.count() == store[1].join(orders, "order_id").count()


def test_reports_read_their_months_only(store, skewed):  # noqa: F811
    orders, lines = store[0].orders(), store[0].lines()
    products = skewed["products"]
    trend, plain = s.monthly_sales_trend(orders, lines, 3), s.monthly_sales_trend(orders, store[1], 3)
    assert rows(trend) == rows(plain)
    decline, plain = p.yoy_decline(orders, lines, products, 2022, 2023), p.yoy_decline(orders, store[1], products, 2022, 2023)
    assert rows(decline) == rows(plain)
    read = [_partitions_read(df) for df in (trend, decline, p.yoy_decline(orders, lines, products, 2023, 2024))]
    assert read == [4, 24, 12]  # of 24 months and the lines without one


def _partitions_read(df) -> int:
    """Month partitions of the bucketed lines that the plan read."""
    df.collect()
    found = []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name == "FileSourceScanExec" and "order_month" in node.toString() and "bucket" in node.toString().lower():
            found.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))
        return None

    visit(df._jdf.queryExecution().executedPlan())
    assert re.search(r"PartitionFilters: \[[^\]]*order_month", df._jdf.queryExecution().executedPlan().toString())
    return max(found)


def test_other_reports_take_stored_lines(store, skewed):  # noqa: F811
    orders, lines = store[0].orders(), store[0].lines()
    for report in (
        lambda items: c.state_revenue(orders, items, skewed["customers"]),
        lambda items: c.customer_aov(orders, items, skewed["customers"]),
    ):
        assert sorted(rows(report(lines))) == sorted(rows(report(store[1])))
