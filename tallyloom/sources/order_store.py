"""Orders and order lines stored so that they meet without an exchange, by month.

Both tables are bucketed by order_id with the same number of buckets. Lines are also
partitioned by the month of their order, so a report over some months reads these months
only. Lines of orders with more than ``most_lines`` of them, and lines without an order id,
are kept apart, in a table that is not bucketed: a bucket can be read by one task only.

The load pays one shuffle of the lines, then every report reads them as they lie. An order
must have one row; lines without a known order have no month and meet no order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.order_facts import ORDER_MONTH, SplitLines, month_number

#: Lines of one order from which on they are not bucketed.
MOST_LINES = 100_000


@dataclass(frozen=True)
class OrderStore:
    """Tables ``<name>_orders`` and ``<name>_lines`` of the session's catalog, with files in ``folder``."""

    spark: SparkSession
    name: str
    folder: str
    buckets: int

    def write(self, orders: DataFrame, lines: DataFrame, most_lines: int = MOST_LINES) -> None:
        many = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_lines)
        many.filter(F.col("order_id").isNotNull()).select("order_id").write.mode("overwrite").parquet(f"{self.folder}/hot_orders")
        hot_orders = self._hot_orders(orders)
        months = orders.select("order_id", month_number(F.col("order_date")).alias(ORDER_MONTH))
        dated = lines.join(months, "order_id", "left")
        hot = dated.join(hot_orders, "order_id", "left_semi").unionByName(dated.filter(F.col("order_id").isNull()))
        cold = dated.filter(F.col("order_id").isNotNull()).join(hot_orders, "order_id", "left_anti")
        hot.write.mode("overwrite").partitionBy(ORDER_MONTH).parquet(f"{self.folder}/hot_lines")
        self._write_bucketed(cold, "lines", ORDER_MONTH)
        self._write_bucketed(orders, "orders")

    def _write_bucketed(self, df: DataFrame, table: str, *partitions: str) -> None:
        # Dealt as the buckets are: one file per bucket and month.
        dealt = df.repartition(self.buckets, "order_id").sortWithinPartitions(*partitions, "order_id")
        writer = dealt.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "order_id").sortBy("order_id")
        writer = writer.partitionBy(*partitions) if partitions else writer
        writer.option("path", f"{self.folder}/{table}").saveAsTable(f"{self.name}_{table}")

    def _hot_orders(self, orders: DataFrame) -> DataFrame:
        kind = orders.schema["order_id"].dataType.simpleString()
        return self.spark.read.schema(f"order_id {kind}").parquet(f"{self.folder}/hot_orders")

    def orders(self) -> DataFrame:
        return self.spark.table(f"{self.name}_orders")

    def lines(self) -> SplitLines:
        cold = self.spark.table(f"{self.name}_lines")
        hot = self.spark.read.schema(cold.schema).parquet(f"{self.folder}/hot_lines")
        return SplitLines(cold, hot.select(*cold.columns), self._hot_orders(cold))

    def drop(self) -> None:
        """Takes the tables out of the catalog; the files stay."""
        for table in ("orders", "lines"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
