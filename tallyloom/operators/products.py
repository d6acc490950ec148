"""Product, category and inventory reports."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exact import as_double, cents, percent
from tallyloom.functions.ranking import global_dense_rank
from tallyloom.model import RETURNED
from tallyloom.operators.order_facts import Lines, in_months, lines_of, with_status


def top_products(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    k: int = 10,
    statuses: Iterable[str] | None = None,
) -> DataFrame:
    """The ``k`` products with the highest revenue; ties by product_id.

    ``total_orders`` counts order lines. Every status counts unless
    ``statuses`` is given.
    """
    known = with_status(orders, statuses).select("order_id")
    sold = (
        items.select("order_id", "product_id", "total_sale")
        .join(known, "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("total_sale").alias("total_sales"), F.count(F.lit(1)).alias("total_orders"))
    )
    return (
        sold.join(products.select("product_id", "product_name"), "product_id")
        .orderBy(F.desc_nulls_first("total_sales"), "product_id")
        .limit(k)
        .select("product_id", "product_name", as_double(F.col("total_sales")).alias("total_sales"), "total_orders")
    )


def category_revenue_share(
    items: DataFrame,
    products: DataFrame,
    category: DataFrame,
    orders: DataFrame | None = None,
    statuses: Iterable[str] | None = None,
) -> DataFrame:
    """Revenue per category and its share of the revenue of all items.

    Items of unknown products count in the denominator only. Products without
    a category form a group with a NULL name.
    """
    if statuses is not None:
        items = items.join(with_status(orders, statuses).select("order_id"), "order_id", "left_semi")
    known = products.select("product_id", "category_id", F.lit(True).alias("known"))
    per_category = (
        items.groupBy("product_id")
        .agg(F.sum("total_sale").alias("sale"))
        .join(known, "product_id", "left")
        .groupBy("category_id", "known")
        .agg(F.sum("sale").alias("total_sale"))
        # One row per category, and one for unknown products, reach this window.
        .withColumn("overall", F.sum("total_sale").over(W.partitionBy()))
        .filter(F.col("known"))
    )
    return (
        per_category.join(category, "category_id", "left")
        .orderBy(F.desc_nulls_first("total_sale"), F.asc_nulls_last("category_id"))
        .select(
            "category_id",
            "category_name",
            as_double(F.col("total_sale")).alias("total_sale"),
            percent(cents(F.col("total_sale")), cents(F.col("overall"))).alias("pct_contribution"),
        )
    )


def product_margin_rank(items: DataFrame, products: DataFrame) -> DataFrame:
    """Profit margin in percent per product, densely ranked on the rounded value."""
    # Lines with a NULL price or quantity have no profit and drop out of both sums of it.
    sold = items.groupBy("product_id").agg(
        F.sum("total_sale").alias("sale"),
        F.sum(F.when(F.col("quantity").isNotNull(), F.col("total_sale"))).alias("costed_sale"),
        F.sum(F.when(F.col("total_sale").isNotNull(), F.col("quantity"))).alias("units"),
    )
    profit = F.col("costed_sale") - F.col("cogs") * F.col("units")
    margins = sold.join(products.select("product_id", "product_name", "cogs"), "product_id").select(
        "product_id",
        "product_name",
        percent(cents(profit), cents(F.col("sale"))).alias("profit_margin"),
    )
    return global_dense_rank(margins, "profit_margin", "product_ranking")


def top_returned_products(orders: DataFrame, items: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` products with the highest share of returned order lines.

    Counts lines, not units, and sets no minimum volume. Ties by product_id.
    """
    returned = F.when(F.col("order_status") == RETURNED, 1).otherwise(0)
    lines = (
        items.select("order_id", "product_id")
        .join(orders.select("order_id", "order_status"), "order_id")
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("total_order_lines"), F.sum(returned).alias("total_returned"))
    )
    return (
        lines.join(products.select("product_id", "product_name"), "product_id")
        .withColumn("return_rate_pct", percent(F.col("total_returned"), F.col("total_order_lines")))
        .orderBy(F.desc_nulls_first("return_rate_pct"), "product_id")
        .limit(k)
        .select("product_id", "product_name", "total_order_lines", "total_returned", "return_rate_pct")
    )


def yoy_decline(
    orders: DataFrame,
    items: Lines,
    products: DataFrame,
    before: int = 2022,
    after: int = 2023,
    k: int = 10,
) -> DataFrame:
    """The ``k`` products whose revenue fell most, in percent, between two years.

    Products without a sale in either year are left out. One pass over the
    orders of both years; of lines stored by month only those of the two years
    are read.
    """

    def in_year(year: int):
        day = F.col("order_date")
        return (day >= F.lit(date(year, 1, 1))) & (day < F.lit(date(year + 1, 1, 1)))

    dated = orders.select("order_id", "order_date").filter(in_year(before) | in_year(after))
    of_years = in_months(
        items, lambda month: month.between(before * 12, before * 12 + 11) | month.between(after * 12, after * 12 + 11)
    )
    revenue = (
        lines_of(of_years, dated, "product_id", "total_sale")
        .groupBy("product_id")
        .agg(
            F.sum(F.when(in_year(before), F.col("total_sale"))).alias("old"),
            F.sum(F.when(in_year(after), F.col("total_sale"))).alias("new"),
        )
        .filter(F.col("old") > F.col("new"))
    )
    drop = F.col("old") - F.col("new")
    return (
        revenue.join(products.select("product_id"), "product_id", "left_semi")
        .withColumn("revenue_decline_pct", percent(cents(drop), cents(F.col("old"))))
        .orderBy(F.desc_nulls_first("revenue_decline_pct"), "product_id")
        .limit(k)
        .select(
            "product_id",
            as_double(F.col("old")).alias(f"revenue_{before}"),
            as_double(F.col("new")).alias(f"revenue_{after}"),
            as_double(drop).alias("revenue_diff"),
            "revenue_decline_pct",
        )
    )


def low_inventory(inventory: DataFrame, products: DataFrame, below: int = 10) -> DataFrame:
    """Inventory rows with fewer than ``below`` units in stock."""
    return (
        inventory.filter(F.col("stock") < below)
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "inventory_id",
            "product_name",
            F.col("stock").alias("current_stock_left"),
            "last_stock_date",
            "warehouse_id",
        )
    )
