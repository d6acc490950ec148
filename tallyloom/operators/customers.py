"""Customer reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exact import as_double, cents, exact_ratio, full_name, percent
from tallyloom.functions.ranking import global_dense_rank, top_dense_rank
from tallyloom.model import CANCELLED, RETURNED
from tallyloom.operators.order_facts import Lines, months_before_last_order, with_status, with_totals


def customer_totals(orders: DataFrame, items: Lines, statuses: Iterable[str] | None = None) -> DataFrame:
    """One row per customer with order lines: lines, revenue, returned lines."""
    returned = F.when(F.col("order_status") == RETURNED, F.col("lines")).otherwise(0)
    sold = with_status(orders, statuses).select("order_id", "customer_id", "order_status")
    return (
        with_totals(sold, items)
        .groupBy("customer_id")
        .agg(
            F.sum("lines").alias("total_orders"),
            F.sum("revenue").alias("total_sale"),
            F.sum(returned).alias("total_return"),
        )
    )


def customer_aov(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    more_than: int = 5,
    statuses: Iterable[str] | None = None,
) -> DataFrame:
    """Average order value of customers with more than ``more_than`` order lines."""
    totals = customer_totals(orders, items, statuses).filter(F.col("total_orders") > more_than)
    return (
        totals.join(customers.select("customer_id", "first_name", "last_name"), "customer_id")
        .select(
            "customer_id",
            full_name().alias("full_name"),
            exact_ratio(cents(F.col("total_sale")), F.col("total_orders") * 100).alias("aov"),
            "total_orders",
        )
        .orderBy(F.desc_nulls_first("aov"), "customer_id")
    )


def customers_never_ordered(customers: DataFrame, orders: DataFrame, within_months: int | None = None) -> DataFrame:
    """Customers without an order, or without one in the trailing ``within_months``."""
    if within_months is not None:
        orders = orders.filter(F.col("order_date") >= months_before_last_order(orders, within_months))
    # Distinct ids first: the right side of an anti join cannot be split when one key is hot.
    return customers.join(orders.select("customer_id").distinct(), "customer_id", "left_anti")


def customer_clv_rank(
    orders: DataFrame, items: DataFrame, customers: DataFrame, statuses: Iterable[str] | None = None
) -> DataFrame:
    """Lifetime value per customer and its dense rank over all customers."""
    values = (
        customer_totals(orders, items, statuses)
        .join(customers.select("customer_id", "first_name", "last_name"), "customer_id")
        .select("customer_id", full_name().alias("full_name"), F.col("total_sale").alias("clv"))
    )
    ranked = global_dense_rank(values, "clv", "customer_ranking")
    return ranked.withColumn("clv", as_double(F.col("clv")))


def customer_return_class(
    orders: DataFrame, items: DataFrame, customers: DataFrame, more_than: int = 5
) -> DataFrame:
    """Order lines and returned lines per customer, with a class.

    ``Returning_customer`` means more than ``more_than`` returned lines, not a
    repeat buyer.
    """
    return (
        customer_totals(orders, items)
        .join(customers.select("customer_id", "first_name", "last_name"), "customer_id")
        .select(
            full_name().alias("customer"),
            "total_orders",
            "total_return",
            F.when(F.col("total_return") > more_than, "Returning_customer")
            .otherwise("New")
            .alias("customer_category"),
        )
    )


def top_customers_per_state(
    orders: DataFrame, items: DataFrame, customers: DataFrame, k: int = 5, by_id: bool = False
) -> DataFrame:
    """Customers among the ``k`` highest order-line counts of their state.

    Groups by state and full name, so namesakes in a state are one customer;
    ``by_id=True`` keeps them apart and adds customer_id. Ties share a rank, so
    a state may have more than ``k`` rows.
    """
    keys = ["state", "customer"] + (["customer_id"] if by_id else [])
    totals = (
        customer_totals(orders, items)
        .join(customers.select("customer_id", "first_name", "last_name", "state"), "customer_id")
        .withColumn("customer", full_name())
        .groupBy(*keys)
        .agg(F.sum("total_orders").alias("total_orders"), F.sum("total_sale").alias("total_sale"))
    )
    best = top_dense_rank(totals, "state", "total_orders", "rnk", k)
    return best.select(*keys, "total_orders", as_double(F.col("total_sale")).alias("total_sale"), "rnk")


def least_category_per_state(
    orders: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    category: DataFrame,
    statuses: Iterable[str] | None = None,
) -> DataFrame:
    """Per state the category with the lowest revenue; ties are all kept.

    Revenue is folded to (customer, category) before the customer join, so a
    customer with very many lines reaches it as a few rows.
    """
    lines = (
        items.select("order_id", "product_id", "total_sale")
        .join(products.select("product_id", "category_id"), "product_id")
        .join(with_status(orders, statuses).select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id", "category_id")
        .agg(F.sum("total_sale").alias("sale"))
    )
    per_state = (
        lines.join(customers.select("customer_id", "state"), "customer_id")
        .groupBy("state", "category_id")
        .agg(F.sum("sale").alias("sale"))
        .join(category, "category_id")
        .groupBy("state", "category_name")
        .agg(F.sum("sale").alias("total_sale"))
    )
    # A state has at most as many rows as there are categories.
    lowest_first = W.partitionBy("state").orderBy(F.asc_nulls_last("total_sale"))
    return (
        per_state.withColumn("rnk", F.rank().over(lowest_first))
        .filter(F.col("rnk") == 1)
        .select("state", "category_name", as_double(F.col("total_sale")).alias("total_sale"), "rnk")
    )


def order_count_distribution(orders: DataFrame) -> DataFrame:
    """Orders per ordering customer: least, most, median and mean."""
    per_customer = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    # Exact median over the (few) different counts, weighted by how many customers have each.
    histogram = per_customer.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))
    return histogram.agg(
        F.sum("customers").alias("ordering_customers"),
        F.min("n").alias("min_orders"),
        F.max("n").alias("max_orders"),
        F.percentile("n", 0.5, F.col("customers")).alias("median_orders"),
        exact_ratio(F.sum(F.col("n") * F.col("customers")), F.sum("customers")).alias("mean_orders"),
    )


def state_revenue(orders: DataFrame, items: Lines, customers: DataFrame) -> DataFrame:
    """Registered customers, ordering customers and revenue per state."""
    per_customer = (
        with_totals(orders.select("order_id", "customer_id"), items, "left")
        .groupBy("customer_id")
        .agg(F.sum("revenue").alias("revenue"), F.lit(True).alias("ordered"))
    )
    return (
        customers.select("customer_id", "state")
        .join(per_customer, "customer_id", "left")
        .groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count("ordered").alias("ordering_customers"),
            as_double(F.sum("revenue")).alias("revenue"),
        )
    )


def never_ordered_share(customers: DataFrame, orders: DataFrame, within_months: int | None = None) -> DataFrame:
    """How many customers never ordered, and both shares in percent."""
    if within_months is not None:
        orders = orders.filter(F.col("order_date") >= months_before_last_order(orders, within_months))
    buyers = orders.select("customer_id").distinct().withColumn("ordered", F.lit(True))
    counts = (
        customers.select("customer_id")
        .join(buyers, "customer_id", "left")
        .agg(F.count(F.lit(1)).alias("total_customers"), F.count("ordered").alias("ordered"))
        .withColumn("never_ordered", F.col("total_customers") - F.col("ordered"))
    )
    return counts.select(
        "total_customers",
        "never_ordered",
        percent(F.col("never_ordered"), F.col("total_customers")).alias("never_ordered_pct"),
        percent(F.col("ordered"), F.col("total_customers")).alias("ordered_pct"),
    )


def only_cancelled_customers(orders: DataFrame) -> DataFrame:
    """Customers with orders of which none succeeded, with their order count."""
    succeeded = F.count_if(F.col("order_status") != CANCELLED)
    return (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("total_orders"), succeeded.alias("succeeded"))
        .filter(F.col("succeeded") == 0)
        .select("customer_id", "total_orders")
    )
