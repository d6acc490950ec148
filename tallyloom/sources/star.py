"""The commerce model as views on a TPC-H-like star schema with an event table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.model import (
    CANCELLED,
    COMPLETED,
    DEFAULT_ADDRESS,
    DELIVERED,
    IN_PROGRESS,
    MONEY,
    PAYMENT_FAILED,
    PAYMENT_OK,
    REFUNDED,
    RETURNED,
    SHIPPED,
)

# Declared, so that no file is opened to find out.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _order_status() -> Column:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (
        F.when((status == "P") & (priority == "5-LOW"), CANCELLED)
        .when(status == "P", RETURNED)
        .when(status == "O", IN_PROGRESS)
        .when(status == "F", COMPLETED)
    )


@dataclass(frozen=True)
class StarTables:
    """Lazy views; each reads only the columns its consumer selects."""

    spark: SparkSession
    folder: str
    _sources: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._sources[name]

    @property
    def category(self) -> DataFrame:
        # A handful of part types; the window sees only the distinct names.
        names = self.source("part").select(F.col("p_type").alias("category_name")).distinct()
        return names.select(F.dense_rank().over(W.orderBy("category_name")).cast("long").alias("category_id"), "category_name")

    @property
    def customers(self) -> DataFrame:
        nation = self.source("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state"))
        return (
            self.source("customer")
            .join(nation, "c_nationkey")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
                F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
                "state",
                F.lit(DEFAULT_ADDRESS).alias("address"),
            )
        )

    @property
    def sellers(self) -> DataFrame:
        nation = self.source("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin"))
        return (
            self.source("supplier")
            .join(nation, "s_nationkey")
            .select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"), "origin")
        )

    @property
    def products(self) -> DataFrame:
        price = F.col("p_retailprice").cast(MONEY)
        return (
            self.source("part")
            .join(self.category, F.col("p_type") == F.col("category_name"))
            .select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                price.alias("price"),
                (price * F.lit(0.5).cast("decimal(2,1)")).cast(MONEY).alias("cogs"),
                "category_id",
            )
        )

    @property
    def orders_without_seller(self) -> DataFrame:
        """Orders straight from their table; the seller would cost a fold of all lines."""
        return self.source("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer_id"),
            _order_status().alias("order_status"),
        )

    @property
    def orders(self) -> DataFrame:
        """Orders with a seller: the lowest one among the order's lines, if any."""
        seller = (
            self.source("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.min("l_suppkey").alias("seller_id"))
        )
        return self.orders_without_seller.join(seller, "order_id", "left").select(
            "order_id", "order_date", "customer_id", "seller_id", "order_status"
        )

    @property
    def items(self) -> DataFrame:
        sale, quantity = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast("int")
        return self.source("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            quantity.alias("quantity"),
            F.try_divide(sale, quantity).cast(MONEY).alias("price_per_unit"),
            sale.alias("total_sale"),
        )

    @property
    def payments(self) -> DataFrame:
        status = F.col("order_status")
        return self.orders_without_seller.select(
            F.col("order_id").alias("payment_id"),
            "order_id",
            F.col("order_date").alias("payment_date"),
            F.when(status == CANCELLED, PAYMENT_FAILED)
            .when(status == RETURNED, REFUNDED)
            .otherwise(PAYMENT_OK)
            .alias("payment_status"),
        )

    @property
    def shippings(self) -> DataFrame:
        sent = (
            self.source("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))
        )
        status = F.col("order_status")
        shipped = (
            self.source("orders")
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_orderpriority").alias("shipping_providers"),
                _order_status().alias("order_status"),
            )
            .filter(status != CANCELLED)
        )
        return shipped.join(sent, "order_id").select(
            F.col("order_id").alias("shipping_id"),
            "order_id",
            F.col("first_day").alias("shipping_date"),
            F.when(status == RETURNED, F.col("last_day")).alias("return_date"),
            "shipping_providers",
            F.when(status == IN_PROGRESS, SHIPPED)
            .when(status == COMPLETED, DELIVERED)
            .otherwise(RETURNED)
            .alias("delivery_status"),
        )

    @property
    def inventory(self) -> DataFrame:
        return self.source("part").select(
            F.col("p_partkey").alias("inventory_id"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_size").alias("stock"),
            F.lit(1).alias("warehouse_id"),
            F.to_date(F.lit("2001-08-01")).alias("last_stock_date"),
        )

    @property
    def events(self) -> DataFrame:
        return self.source("events")

    @property
    def attempts(self) -> DataFrame:
        """Checkout attempts: a purchase succeeded, an error failed; two arms by user."""
        kind = F.col("event_type")
        return (
            self.events.filter(kind.isin("purchase", "error"))
            .select((F.col("user_id") % 2).alias("arm"), (kind == "purchase").alias("success"))
        )

    @property
    def sale_requests(self) -> DataFrame:
        """Every order line as a request to sell its product once more.

        Lines of one order with the same number get the same new order id, so
        some requests repeat one.
        """
        line_key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        # An order has one line per number, or a few on these tables.
        repeats = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_shipdate")
        buyer = self.source("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"))
        return (
            self.source("lineitem")
            .repartition("l_orderkey")  # as the join needs them too
            .withColumn("repeat", F.row_number().over(repeats))
            .join(buyer, "l_orderkey")
            .select(
                (line_key * 10**6 + F.col("repeat")).alias("seq"),
                (line_key + 10**12).alias("order_id"),
                (line_key + 10**12).alias("order_item_id"),
                "customer_id",
                F.col("l_suppkey").alias("seller_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("l_quantity").cast("int").alias("quantity"),
            )
        )

    def model_tables(self) -> dict[str, DataFrame]:
        """All tables under their model names."""
        return {
            "category": self.category,
            "customers": self.customers,
            "sellers": self.sellers,
            "products": self.products,
            "orders": self.orders,
            "order_items": self.items,
            "payments": self.payments,
            "shippings": self.shippings,
            "inventory": self.inventory,
        }
