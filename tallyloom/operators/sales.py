"""Sales over time, payments, sellers, shipping and the KPI row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exact import as_double, cents, exact_ratio, percent
from tallyloom.model import CANCELLED, COMPLETED, IN_PROGRESS, RETURNED
from tallyloom.operators.distinct_sketches import distinct_count
from tallyloom.operators.order_facts import (
    Lines,
    in_months,
    month_number,
    months_before_last_order,
    order_totals,
    with_status,
    with_totals,
)


def monthly_sales_trend(orders: DataFrame, items: Lines, months: int = 12) -> DataFrame:
    """Revenue per month from ``months`` before the newest order on, and that of the row before.

    Of lines stored by month only those months are read.

    The inclusive start gives ``months + 1`` calendar months, the first one
    partial. The previous row need not be the previous month.
    """
    start = months_before_last_order(orders, months)
    recent = orders.select("order_id", "order_date").filter(F.col("order_date") >= start)
    monthly = (
        with_totals(recent, in_months(items, lambda month: month >= month_number(start)))
        .groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month"))
        .agg(F.sum("revenue").alias("sale"))
    )
    # At most months + 1 rows reach this window.
    by_month = W.orderBy("year", "month")
    return monthly.select(
        "year",
        "month",
        as_double(F.col("sale")).alias("current_month_sale"),
        as_double(F.lag("sale", 1).over(by_month)).alias("last_month_sale"),
    ).orderBy("year", "month")


def payment_status_share(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments of known orders per status, as a share of all payments."""
    all_payments = payments.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        payments.select("order_id", "payment_status")
        .join(orders.select("order_id"), "order_id", "left_semi")
        .groupBy("payment_status")
        .agg(F.count(F.lit(1)).alias("total_cnt"))
        .withColumn("pct_of_all_payments", percent(F.col("total_cnt"), all_payments))
    )


def top_seller_success(orders: DataFrame, items: Lines, sellers: DataFrame, k: int = 5) -> DataFrame:
    """Completed share of the ``k`` sellers with the highest revenue.

    In-progress and returned orders are left out, so the percentage is
    completed / (completed + cancelled). Revenue and status counts come from
    one pass over the orders.
    """
    decided = ~F.col("order_status").isin(IN_PROGRESS, RETURNED)
    per_seller = (
        with_totals(orders.select("order_id", "seller_id", "order_status"), items, "left")
        .groupBy("seller_id")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.count("lines").alias("sold_orders"),
            F.count_if(F.col("order_status") == COMPLETED).alias("completed_orders"),
            F.count_if(F.col("order_status") == CANCELLED).alias("cancelled_orders"),
            F.count_if(decided).alias("total_orders"),
        )
        .filter(F.col("sold_orders") > 0)
    )
    return (
        per_seller.join(sellers.select("seller_id", "seller_name"), "seller_id")
        .orderBy(F.desc_nulls_first("revenue"), "seller_id")
        .limit(k)
        .filter(F.col("total_orders") > 0)
        .select(
            "seller_id",
            "seller_name",
            "completed_orders",
            "cancelled_orders",
            "total_orders",
            percent(F.col("completed_orders"), F.col("total_orders")).alias("successful_orders_percentage"),
        )
    )


def inactive_sellers(
    orders: DataFrame, items: Lines, sellers: DataFrame, months: int = 6, null_safe: bool = False
) -> DataFrame:
    """Sellers without an order in the trailing ``months``: last sale date, largest sale.

    ``last_sale_amount`` is the largest line, not the latest. Sellers that
    never sold do not appear. As in SQL ``NOT IN``, one recent order without a
    seller empties the result; ``null_safe=True`` ignores such orders.
    """
    start = months_before_last_order(orders, months)
    per_seller = (
        with_totals(orders.select("order_id", "order_date", "seller_id"), items, "left")
        .groupBy("seller_id")
        .agg(
            F.max("order_date").alias("last_order_date"),
            F.max(F.when(F.col("lines").isNotNull(), F.col("order_date"))).alias("last_sale_date"),
            F.max("largest_line").alias("last_sale_amount"),
            F.count("lines").alias("sold_orders"),
        )
    )
    active = F.coalesce(F.col("last_order_date") >= start, F.lit(False))
    quiet = per_seller.filter((F.col("sold_orders") > 0) & ~active)
    if not null_safe:
        nameless = per_seller.filter(F.col("seller_id").isNull() & active)
        quiet = quiet.filter(nameless.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    return quiet.join(sellers.select("seller_id"), "seller_id", "left_semi").select(
        "seller_id", "last_sale_date", as_double(F.col("last_sale_amount")).alias("last_sale_amount")
    )


def slow_shipping(
    shippings: DataFrame, orders: DataFrame, customers: DataFrame, at_least: int = 4
) -> DataFrame:
    """Shipments sent ``at_least`` days after the order."""
    return (
        shippings.select("order_id", "shipping_date", "shipping_providers")
        .join(orders.select("order_id", "order_date", "customer_id", "order_status"), "order_id")
        .withColumn("days_to_ship", F.datediff("shipping_date", "order_date"))
        .filter(F.col("days_to_ship") >= at_least)
        .join(customers.select("customer_id", "first_name", "last_name"), "customer_id")
        .select(
            "days_to_ship",
            "customer_id",
            "first_name",
            "last_name",
            "order_id",
            "order_date",
            "order_status",
            "shipping_providers",
        )
    )


def provider_performance(shippings: DataFrame, orders: DataFrame, items: Lines) -> DataFrame:
    """Order lines, revenue and average days until return per shipping provider.

    The average runs over shipments with a return date, weighted by lines; 0
    without any. Shipments are folded per order first, so that an order with
    very many of them cannot load one task.
    """
    days = F.datediff("return_date", "shipping_date")
    shipped = shippings.groupBy("order_id", "shipping_providers").agg(
        F.count(F.lit(1)).alias("shipments"), F.sum(days).alias("days"), F.count(days).alias("timed")
    )
    sold = order_totals(items).join(orders.select("order_id"), "order_id", "left_semi")
    return (
        shipped.join(sold, "order_id")
        .groupBy("shipping_providers")
        .agg(
            F.sum(F.col("shipments") * F.col("lines")).alias("orders_handled"),
            as_double(F.sum(F.col("shipments") * F.col("revenue"))).alias("total_sale"),
            F.sum(F.col("days") * F.col("lines")).alias("days"),
            F.sum(F.col("timed") * F.col("lines")).alias("timed"),
        )
        .select(
            "shipping_providers",
            "orders_handled",
            "total_sale",
            F.coalesce(exact_ratio(F.col("days"), F.col("timed"), 1), F.lit(0.0)).alias("avg_return_days"),
        )
    )


def return_share(orders: DataFrame) -> DataFrame:
    """Returned orders as a share of all orders."""
    returned = F.count_if(F.col("order_status") == RETURNED)
    return orders.agg(F.count(F.lit(1)).alias("total_orders"), returned.alias("returned_orders")).withColumn(
        "return_share_pct", percent(F.col("returned_orders"), F.col("total_orders"))
    )


def kpi_summary(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    statuses: Iterable[str] | None = None,
    sketch_lg_k: int | None = None,
) -> DataFrame:
    """The nine headline numbers in one row.

    ``avg_order_value`` averages over order lines. ``statuses`` restricts the
    two money columns. With ``sketch_lg_k`` the two counts of customers are
    estimates (``distinct_sketches``), and no customer is shuffled.
    """
    paid = items
    if statuses is not None:
        paid = items.join(with_status(orders, statuses).select("order_id"), "order_id", "left_semi")
    money = paid.agg(
        as_double(F.sum("total_sale")).alias("total_revenue"),
        exact_ratio(cents(F.sum("total_sale")), F.count("total_sale") * 100).alias("avg_order_value"),
    )
    placed = orders.agg(
        distinct_count("customer_id", sketch_lg_k).alias("customers_with_orders"),
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    return placed.select(
        customers.agg(distinct_count("customer_id", sketch_lg_k).alias("n")).scalar().alias("total_customers"),
        "customers_with_orders",
        "total_orders",
        money.select("total_revenue").scalar().alias("total_revenue"),
        money.select("avg_order_value").scalar().alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        products.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_products"),
        sellers.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_sellers"),
    )
