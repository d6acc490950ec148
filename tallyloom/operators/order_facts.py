"""Order lines folded to one row per order, the common first step, and how lines meet their orders."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.joins import spread_lookup

#: Tasks at most that share the lines of a hot order.
SPREAD = 64
#: Partition column of lines stored by the month of their order: months since year 0.
ORDER_MONTH = "order_month"


@dataclass(frozen=True)
class SplitLines:
    """Order lines in two parts, for the reports that take ``items``.

    ``cold`` is bucketed by order_id, as the orders are, so the two meet without an
    exchange. The lines of orders with very many of them would be one bucket that no task
    may share: they are ``hot``, not bucketed, and joined as any other table.
    ``hot_orders`` holds the ids of the hot part's orders.
    """

    cold: DataFrame
    hot: DataFrame
    hot_orders: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.cold.columns

    def filter(self, condition: Column) -> SplitLines:
        return SplitLines(self.cold.filter(condition), self.hot.filter(condition), self.hot_orders)

    def parts(self) -> list[DataFrame]:
        return [self.cold, self.hot]

    def all(self) -> DataFrame:
        """Both parts as one frame, for reports that do not ask for the order."""
        return self.cold.unionByName(self.hot)


Lines = DataFrame | SplitLines


def _parts(items: Lines) -> list[DataFrame]:
    return items.parts() if isinstance(items, SplitLines) else [items]


def _each(items: Lines, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(run, _parts(items)))


def order_totals(items: Lines) -> DataFrame:
    """One row per order: lines, revenue, largest line.

    Folding before the join to orders lets every map task combine the lines of
    an order with very many of them; the result stays partitioned by order_id,
    so the join adds no exchange of its own. Unused columns are pruned.
    """
    return _each(
        items,
        lambda part: part.groupBy("order_id").agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("total_sale").alias("revenue"),
            F.max("total_sale").alias("largest_line"),
        ),
    )


def with_totals(orders: DataFrame, items: Lines, how: str = "inner") -> DataFrame:
    """Orders with their totals; ``how`` is inner or left.

    Of split lines each part is joined by itself: the bucketed one without an exchange.
    """
    if not isinstance(items, SplitLines):
        return orders.join(order_totals(items), "order_id", how)
    # A hot order has no cold lines: a left join would keep it as one without lines.
    others = orders if how == "inner" else orders.join(items.hot_orders, "order_id", "left_anti")
    cold = others.join(order_totals(items.cold), "order_id", how)
    return cold.unionByName(orders.join(order_totals(items.hot), "order_id"))


def lines_of(items: Lines, orders: DataFrame, *columns: str) -> DataFrame:
    """The named columns of lines, each with the columns of its order (one row per order).

    Of split lines the hot ones are dealt by order and line, so that a hot order is spread
    over several tasks even where the orders' buckets keep Spark from splitting it.
    """
    if not isinstance(items, SplitLines):
        return items.select("order_id", *columns).join(orders, "order_id")
    cold = items.cold.select("order_id", *columns).join(orders, "order_id")
    of_line = ["order_item_id"] if "order_item_id" in items.columns else columns
    slot = F.pmod(F.xxhash64(*of_line), F.lit(SPREAD))
    hot = items.hot.select("order_id", *columns, slot.alias("_line"))
    known = orders.join(items.hot_orders, "order_id", "left_semi").withColumn("_known", F.lit(True))
    met = spread_lookup(hot, known, "order_id", F.col("_line")).filter("_known").drop("_line", "_known")
    return cold.unionByName(met)


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def in_months(items: Lines, condition: Callable[[Column], Column]) -> Lines:
    """Lines whose order's month meets the condition, where lines are stored by it; else all lines.

    The condition must hold for every line that the report needs.
    """
    return items.filter(condition(F.col(ORDER_MONTH))) if ORDER_MONTH in items.columns else items


def with_status(orders: DataFrame, statuses: Iterable[str] | None) -> DataFrame:
    """Orders in one of ``statuses``; all orders when None."""
    return orders if statuses is None else orders.filter(F.col("order_status").isin(list(statuses)))


def months_before_last_order(orders: DataFrame, months: int) -> Column:
    """The date ``months`` before the newest order; month ends clamp."""
    newest = orders.agg(F.max("order_date").alias("newest")).scalar()
    return F.add_months(newest, -months)
