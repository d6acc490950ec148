"""Audits that take the place of database constraints and load checks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.model import CANCELLED, IN_PROGRESS, LEGAL_STATUS, RETURNED, TABLES
from tallyloom.operators.funnel import fulfillment_funnel


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def load_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, and order lines without a total (NULL for other tables)."""
    frames = []
    for name, df in tables.items():
        missing = F.count_if(F.col("total_sale").isNull()) if "total_sale" in df.columns else F.lit(None).cast("long")
        frames.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), missing.alias("null_total_sale")).withColumn(
                "table_name", F.lit(name)
            )
        )
    return _stack(frames).select("table_name", "row_count", "null_total_sale")


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Key values that occur more than once or hold a NULL, with their row count."""
    has_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in key))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) | has_null)


def primary_key_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Repeated key values, the rows they cover, and rows with a NULL key, per table."""
    frames = []
    for name, df in tables.items():
        key = TABLES[name].primary_key
        repeated = F.col(key).isNotNull() & (F.col("rows") > 1)
        frames.append(
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("rows"))
            .agg(
                F.count_if(repeated).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(repeated, F.col("rows"))), F.lit(0)).alias("duplicate_rows"),
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("rows"))), F.lit(0)).alias("null_rows"),
            )
            .withColumn("table_name", F.lit(name))
            .withColumn("key_column", F.lit(key))
        )
    return _stack(frames).select("table_name", "key_column", "duplicate_keys", "duplicate_rows", "null_rows")


def foreign_key_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Reference values without a parent row, per relation; NULL references pass.

    References are counted per value before the anti join, so a value that
    many rows share is one row in it.
    """
    frames = []
    for name, df in tables.items():
        for column, parent in TABLES[name].foreign_keys:
            if parent not in tables:
                continue
            references = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            parents = tables[parent].select(F.col(TABLES[parent].primary_key).alias(column))
            frames.append(
                references.join(parents, column, "left_anti")
                .agg(
                    F.count(F.lit(1)).alias("orphan_keys"),
                    F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
                )
                .withColumn("table_name", F.lit(name))
                .withColumn("column_name", F.lit(column))
                .withColumn("parent_table", F.lit(parent))
            )
    return _stack(frames).select("table_name", "column_name", "parent_table", "orphan_keys", "orphan_rows")


def text_width_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose text is wider than declared, and the widest text, per column.

    One aggregate per table.
    """
    frames = []
    for name, df in tables.items():
        widths = {c: n for c, n in TABLES[name].max_length.items() if c in df.columns}
        if not widths:
            continue
        found = df.agg(
            *(F.count_if(F.length(c) > n).alias(f"{c}_over") for c, n in widths.items()),
            *(F.max(F.length(c)).alias(f"{c}_widest") for c in widths),
        )
        rows = F.array(
            *(
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(c).alias("column_name"),
                    F.lit(n).alias("max_length"),
                    F.col(f"{c}_over").alias("too_long"),
                    F.col(f"{c}_widest").alias("widest"),
                )
                for c, n in widths.items()
            )
        )
        frames.append(found.select(F.explode(rows).alias("row")).select("row.*"))
    return _stack(frames)


def status_matrix(orders: DataFrame, payments: DataFrame, shippings: DataFrame) -> DataFrame:
    """Orders per combination of order, payment and delivery status, and whether it is legal."""
    paid = payments.select("order_id", "payment_status").distinct()
    sent = shippings.select("order_id", "delivery_status").distinct().withColumn("sent", F.lit(True))
    status = F.col("order_status")
    legal = F.lit(False)
    for order_status, (payment, delivery) in LEGAL_STATUS.items():
        shipped = F.col("sent").isNull() if delivery is None else F.col("delivery_status") == delivery
        legal = legal | ((status == order_status) & (F.col("payment_status") == payment) & shipped)
    return (
        orders.select("order_id", "order_status")
        .join(paid, "order_id", "left")
        .join(sent, "order_id", "left")
        .groupBy("order_status", "payment_status", "delivery_status")
        .agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.bool_and(legal), F.lit(False)).alias("is_legal"))
    )


def funnel_reconciliation(orders: DataFrame) -> DataFrame:
    """Each funnel drop-off next to the count of the status that explains it."""
    counts = orders.agg(
        F.count_if(F.col("order_status") == CANCELLED).alias("cancelled"),
        F.count_if(F.col("order_status") == IN_PROGRESS).alias("in_progress"),
        F.count_if(F.col("order_status") == RETURNED).alias("returned"),
    )
    expected = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit(2).alias("stage_order"), F.lit(CANCELLED).alias("order_status"), F.col("cancelled").alias("status_orders")),
                F.struct(F.lit(3).alias("stage_order"), F.lit(IN_PROGRESS).alias("order_status"), F.col("in_progress").alias("status_orders")),
                F.struct(F.lit(4).alias("stage_order"), F.lit(RETURNED).alias("order_status"), F.col("returned").alias("status_orders")),
            )
        ).alias("row")
    ).select("row.*")
    return (
        fulfillment_funnel(orders)
        .join(expected, "stage_order")
        .select(
            "stage",
            "drop_off",
            "order_status",
            "status_orders",
            (F.col("drop_off") == F.col("status_orders")).alias("reconciles"),
        )
    )


def cohort_checks(cohorts: DataFrame) -> DataFrame:
    """Violations of what must hold for retention rows, in one row."""
    offset = F.col("months_since_cohort")
    return cohorts.agg(
        F.count(F.lit(1)).alias("cohort_rows"),
        F.count_if(offset == 0).alias("cohorts"),
        F.sum(F.when(offset == 0, F.col("cohort_size"))).alias("cohort_customers"),
        F.count_if((offset == 0) & (F.col("retention_rate") != 100)).alias("start_not_full"),
        F.count_if(offset < 0).alias("negative_offsets"),
        F.count_if(F.col("retained_users") > F.col("cohort_size")).alias("retained_over_size"),
    )
