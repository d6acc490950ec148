"""Cohort retention that new orders add to, without a look at the old ones.

What retention needs of a customer is the set of active months. It is kept as bits, ``WORD``
months to a whole number: one small row per customer and five years, however many orders.
New orders only add bits, so their sets are appended and met by a bitwise OR when they are
read; adding orders again changes nothing, and late orders of an earlier month count.
An order that is cancelled after it was added stays counted: add orders when their status
is final, or write the store anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.order_facts import month_number
from tallyloom.operators.retention import counted_orders, retention_rates

#: Months to a whole number; the sign bit stays free.
WORD = 60


def active_months(orders: DataFrame) -> DataFrame:
    """(customer_id, word, bits): bit ``k`` stands for month ``WORD * word + k`` since year 0."""
    month = month_number(F.col("order_date"))
    bit = F.expr("shiftleft(1L, CAST(month % {WORD} AS INT))".format(WORD=WORD))
    return (
        counted_orders(orders)
        .select("customer_id", month.alias("month"))
        .groupBy("customer_id", F.floor(F.col("month") / WORD).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )


def _lowest(bits: Column) -> Column:
    """The place of the lowest bit that is set."""
    return F.length(F.bin(bits.bitwiseAND(-bits))) - 1


def retention_of(activity: DataFrame) -> DataFrame:
    """Cohort retention from sets of active months; a customer's set may stand in several rows.

    Customers of one cohort with the same months are one row before any month is looked at.
    """
    sets = activity.groupBy("customer_id", "word").agg(F.bit_or("bits").alias("bits"))
    first = F.min(F.col("word") * WORD + _lowest(F.col("bits"))).over(W.partitionBy("customer_id"))
    patterns = sets.select(first.alias("cohort"), "word", "bits").groupBy("cohort", "word", "bits").agg(
        F.count(F.lit(1)).alias("customers")
    )
    places = F.expr(f"filter(sequence(0, {WORD - 1}), k -> shiftright(bits, k) % 2 = 1)")
    counts = (
        patterns.select("cohort", "word", "customers", F.explode(places).alias("place"))
        .groupBy("cohort", (F.col("word") * WORD + F.col("place") - F.col("cohort")).alias("months_since_cohort"))
        .agg(F.sum("customers").alias("retained_users"))
    )
    return retention_rates(counts)


@dataclass(frozen=True)
class CohortStore:
    """Sets of active months as a Parquet table that grows with each ``add``."""

    spark: SparkSession
    folder: str
    key_type: str = "bigint"

    def add(self, orders: DataFrame) -> None:
        """Appends the months of these orders; reads nothing that is there."""
        active_months(orders).write.mode("append").parquet(self.folder)

    def activity(self) -> DataFrame:
        return self.spark.read.schema(f"customer_id {self.key_type}, word int, bits bigint").parquet(self.folder)

    def retention(self) -> DataFrame:
        return retention_of(self.activity())

    def compact(self, folder: str) -> CohortStore:
        """The same sets in another folder, one row per customer and word."""
        self.activity().groupBy("customer_id", "word").agg(F.bit_or("bits").alias("bits")).write.mode("overwrite").parquet(folder)
        return CohortStore(self.spark, folder, self.key_type)
