"""Distinct counts by mergeable sketches, for tables where an exact count costs too much.

``count(distinct x)`` sends every distinct value through a shuffle and cannot be added up:
a year's customers are not the sum of its months'. A HyperLogLog sketch has a fixed size
(``2**lg_k`` registers), is folded in the map tasks, and the sketch of a union is the union
of the sketches. So one sketch per month answers every range of months, and new orders add
to it without a look at the old ones. Adding the same orders twice changes nothing.

An estimate's relative standard error is 1.04 / sqrt(2**lg_k), 1.6 % at the default;
``error_bound`` is three of them, and never less than half a value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12


def error_bound(exact: Column, lg_k: int = LG_K) -> Column:
    """How far an estimate may lie from ``exact``: three standard errors."""
    return F.greatest(exact * F.lit(3 * 1.04 / math.sqrt(2**lg_k)), F.lit(0.5))


def distinct_count(column: str, lg_k: int | None = None) -> Column:
    """Aggregate: distinct values of a whole-number or text column; NULL is none.

    Exact by default; with ``lg_k`` the estimate of a sketch, which needs no shuffle of
    the values.
    """
    if lg_k is None:
        return F.countDistinct(column)
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(column, lg_k)), F.lit(0))


def month_number(day: str) -> Column:
    """Months since year 0, so that ranges are ranges of whole numbers."""
    return F.year(day) * 12 + F.month(day) - 1


def monthly_sketches(rows: DataFrame, day: str, columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(month, one sketch per column): one row per month; rows without a day are left out."""
    return (
        rows.filter(F.col(day).isNotNull())
        .groupBy(month_number(day).alias("month"))
        .agg(*(F.hll_sketch_agg(c, lg_k).alias(c) for c in columns))
    )


def estimates(sketches: DataFrame, columns: Sequence[str], *by: Column) -> DataFrame:
    """Estimated distinct values per group of months, from sketches that may share months."""
    return sketches.groupBy(*by).agg(
        *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns)
    )


@dataclass(frozen=True)
class SketchStore:
    """Monthly sketches as a Parquet table partitioned by month.

    ``add`` appends sketches of new rows; it reads nothing that is there. A range of months
    reads the sketches of these months only. ``compact`` writes one sketch per month anew.
    """

    spark: SparkSession
    folder: str
    columns: tuple[str, ...]
    lg_k: int = LG_K

    def add(self, rows: DataFrame, day: str) -> None:
        self._write(monthly_sketches(rows, day, self.columns, self.lg_k), self.folder)

    def _write(self, sketches: DataFrame, folder: str) -> None:
        # One file per month: a month's sketches are one row here.
        sketches.repartition("month").write.mode("append").partitionBy("month").parquet(folder)

    def sketches(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Stored sketches of the months from that of ``first`` to that of ``last``."""
        schema = ", ".join(f"{c} binary" for c in self.columns) + ", month int"
        found = self.spark.read.schema(schema).parquet(self.folder)
        for day, within in ((first, F.col("month").__ge__), (last, F.col("month").__le__)):
            if day is not None:
                found = found.filter(within(day.year * 12 + day.month - 1))
        return found

    def total(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """One row: estimated distinct values over a range of months."""
        return estimates(self.sketches(first, last), self.columns)

    def per_months(self, months: int, first: date | None = None, last: date | None = None) -> DataFrame:
        """(first_month, estimates) per calendar period of ``months`` months (3: quarters, 12: years)."""
        period = F.floor(F.col("month") / months) * months
        start = F.make_date(F.floor(F.col("period") / 12).cast("int"), (F.col("period") % 12 + 1).cast("int"), F.lit(1))
        found = estimates(self.sketches(first, last), self.columns, period.alias("period"))
        return found.select(start.alias("first_month"), *self.columns)

    def compact(self, folder: str) -> SketchStore:
        """The same sketches in another folder, one row per month."""
        merged = self.sketches().groupBy("month").agg(
            *(F.hll_union_agg(c).alias(c) for c in self.columns)
        )
        self._write(merged, folder)
        return SketchStore(self.spark, folder, self.columns, self.lg_k)
