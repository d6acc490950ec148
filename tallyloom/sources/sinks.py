"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_provenance(df: DataFrame, is_simulated: bool, methodology: str | None = None) -> DataFrame:
    """Adds the columns that say how a result came about."""
    df = df.withColumn("is_simulated", F.lit(is_simulated))
    return df if methodology is None else df.withColumn("methodology", F.lit(methodology))


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one headed CSV file; for reports of a few thousand rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A result of any size as Parquet, written by all tasks.

    With ``partition_by``, rows are rebalanced first, so that a large
    partition value is split over several files and a small one is not
    scattered.
    """
    if partition_by:
        df = df.hint("rebalance", *(F.col(c) for c in partition_by))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
