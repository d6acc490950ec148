"""Dense ranks that never bring one large group into one task."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import cut_lineage

WIDTH = 32
SLICES = WIDTH * WIDTH
#: Rows that a slice holds at least, on average, before there are more slices.
SLICE_ROWS = 10_000


def slice_bounds(values: DataFrame, column: str) -> list[float]:
    """Ascending cut points that split a numeric column into about equal slices.

    A small table has few slices, a large one ``SLICES`` (1, 4, 16 ... of them). One small
    row comes to the driver. As literals, the cut points are the same wherever they are
    used; the sketch behind them steers balance only.
    """
    cuts = _doubles([i / SLICES for i in range(1, SLICES)])
    number = F.col(column).cast("double")
    rows, found = values.agg(F.count(number), F.percentile_approx(number, cuts, 4 * SLICES)).first()
    width = 1
    while width < WIDTH and width * width * SLICE_ROWS < rows:
        width *= 2
    stride = SLICES // (width * width)
    bounds = (found or [0.0] * (SLICES - 1))[stride - 1 :: stride]
    return [v if math.isfinite(v) else math.copysign(sys.float_info.max, v) for v in bounds]


def _doubles(values: list[float]) -> Column:
    """An array literal, in one call instead of one per value."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")


def slice_number(bounds: list[float], value: Column) -> Column:
    """How many cut points lie below ``value``, plus one; 0 for NULL.

    ``bounds`` come from ``slice_bounds``. Grows with ``value``, so the order of
    slices is the order of values. As a double, a value keeps its order. Two short
    searches, first for the block of cut points and then inside it, take the place
    of one long one.
    """
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    known = value.isNotNull().cast("long")
    width = math.isqrt(len(bounds) + 1)
    if width == 1:
        return known
    block = _below(_doubles(bounds[width - 1 :: width]), number)
    blocks = F.array(*(_doubles(bounds[i : i + width - 1]) for i in range(0, width * width, width)))
    within = _below(F.get(blocks, block.cast("int")), number)
    return (block * width + within + 1) * known


def _below(sorted_values: Column, value: Column) -> Column:
    """How many entries of a sorted array are smaller than ``value``."""
    return F.array_position(F.sort_array(F.concat(sorted_values, F.array(value))), value) - 1


def global_dense_rank(df: DataFrame, score: str, rank: str) -> DataFrame:
    """``dense_rank() over (order by score desc nulls first)`` over the whole frame.

    An unpartitioned window would sort every row in one task. Here the distinct
    scores are cut into value slices, ranked within their slice, shifted by the
    number of scores in the slices above (at most ``SLICES + 1`` rows), and
    joined back. A score shared by many rows is one row until the join, where
    its partition can be split. The scored rows are used four times, so they
    are written once.
    """
    df = cut_lineage(df)
    scores = df.select(F.col(score).alias("_score")).distinct()
    sliced = scores.withColumn("_slice", slice_number(slice_bounds(scores, "_score"), F.col("_score")))

    # NULL has slice 0, the lowest number, but ranks first.
    order = F.when(F.col("_slice") == 0, F.lit(SLICES + 1)).otherwise(F.col("_slice"))
    above = W.orderBy(order.desc()).rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_shift"))
    )
    within = W.partitionBy("_slice").orderBy(F.col("_score").desc_nulls_first())
    ranked = sliced.join(F.broadcast(shifts), "_slice").select(
        "_score", (F.col("_shift") + F.row_number().over(within)).alias(rank)
    )
    return df.join(ranked, F.col(score).eqNullSafe(F.col("_score"))).drop("_score")


def top_dense_rank(df: DataFrame, group: str, score: str, rank: str, k: int) -> DataFrame:
    """Rows whose dense rank by ``score`` (descending) in ``group`` is at most ``k``.

    The filter on the rank lets Spark drop rows beyond rank ``k`` of a group in
    the map tasks already, so of a group that holds a large share of the rows
    each task sends its own best only.
    """
    within = W.partitionBy(group).orderBy(F.col(score).desc_nulls_first())
    return df.withColumn(rank, F.dense_rank().over(within)).filter(F.col(rank) <= k)
