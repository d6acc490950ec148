"""Funnels: order fulfilment by status, and ordered steps in an event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.exact import micros, percent
from tallyloom.functions.ranking import slice_bounds, slice_number
from tallyloom.model import CANCELLED, COMPLETED, RETURNED
from tallyloom.operators.distinct_sketches import distinct_count


def stage_rows(totals: DataFrame, stages: Sequence[tuple[str, str]], extra: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """One row of stage counts turned into one row per stage.

    ``stages`` pairs labels with count columns; ``extra`` names further columns
    and their count column per stage. Adds stage_order, drop_off and the two
    conversions.
    """
    rows = []
    for place, (label, column) in enumerate(stages):
        count = F.col(column).cast("long")
        previous = F.col(stages[place - 1][1]).cast("long") if place else F.lit(None).cast("long")
        start = F.col(stages[0][1])
        rows.append(
            F.struct(
                F.lit(label).alias("stage"),
                F.lit(place + 1).alias("stage_order"),
                count.alias("reached"),
                (previous - count).alias("drop_off"),
                percent(count, previous).alias("conversion_from_previous_pct"),
                (percent(count, start) if place else F.lit(100.0)).alias("conversion_from_start_pct"),
                *(F.col(columns[place]).alias(name) for name, columns in (extra or {}).items()),
            )
        )
    # One frame with one row per stage, so the totals are computed once.
    return totals.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def fulfillment_funnel(orders: DataFrame, sketch_lg_k: int | None = None) -> DataFrame:
    """Orders placed, paid, delivered and kept, from order status.

    Placed orders are counted by their distinct ids; with ``sketch_lg_k`` that is
    an estimate (``distinct_sketches``), and no id is shuffled.
    """

    def reached(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    status = F.col("order_status")
    totals = orders.agg(
        distinct_count("order_id", sketch_lg_k).alias("placed"),
        reached(status != CANCELLED).alias("paid"),
        reached(status.isin(COMPLETED, RETURNED)).alias("delivered"),
        reached(status == COMPLETED).alias("kept"),
    )
    # Stage labels.
    stages = [
        ("Orders Placed", "placed"),
        ("Payment Successful", "paid"),
        ("Delivered", "delivered"),
        ("Kept (Not Returned)", "kept"),
    ]
    return (
        stage_rows(totals, stages)
        .withColumnRenamed("reached", "orders")
        .withColumn("is_simulated", F.lit(False))
        .orderBy("stage_order")
    )


def order_completion_rate(orders: DataFrame) -> DataFrame:
    """Kept orders as a share of placed orders: the funnel's last row."""
    last = fulfillment_funnel(orders).filter(F.col("stage_order") == 4)
    return last.select(
        F.col("orders").alias("kept_orders"), F.col("conversion_from_start_pct").alias("completion_rate_pct")
    )


def event_chains(
    events: DataFrame,
    steps: Sequence[str],
    user: str = "user_id",
    time: str = "ts",
    event_type: str = "event_type",
) -> DataFrame:
    """For each event of the first step, when each later step was first reached.

    Returns (user, t0, t1, ..., n) in microseconds: ``t_k`` is the first event
    of step ``k`` strictly after ``t_(k-1)``, NULL if there is none; ``n`` is
    the number of first-step events at ``t0``.

    Equal events (user, time, step) are folded in the map tasks. What is left
    of a user is cut into time slices at quantiles of all events' times, so
    that no task holds all events of a very active user, nor those of a very
    busy hour. Inside a slice one descending pass finds the next
    event of each step. What lies beyond the slice comes from a summary with
    one row per (user, slice): the first chain that starts in a later slice.
    """
    clock = micros(F.col(time), events.schema[time].dataType.typeName())
    step = F.array_position(F.array(*(F.lit(s) for s in steps)), F.col(event_type)) - 1
    last = len(steps) - 1
    known = F.col(user).isNotNull() & F.col(time).isNotNull() & F.col(event_type).isin(list(steps))
    rows = events.filter(known).select(F.col(user).alias("user"), clock.alias("t"), step.cast("int").alias("step"))
    bounds = slice_bounds(rows.select("t"), "t")
    rows = rows.groupBy("user", "t", "step").agg(F.count(F.lit(1)).alias("n"))
    # The filters are implied; stated here, they and the columns they need are the
    # same in both branches of the join below, which so share one scan and exchange.
    rows = rows.withColumn("slice", slice_number(bounds, F.col("t")))
    rows = rows.filter(F.col("slice").isNotNull() & (F.col("n") > 0))

    # Descending time makes "strictly later" a growing frame: one pass per step.
    later = W.partitionBy("user", "slice").orderBy((-F.col("t")).alias("desc")).rangeBetween(W.unboundedPreceding, -1)

    def start(k: int) -> Column:
        """A step-k event with the chain that follows it inside its slice."""
        following = [F.col(f"next{k + 1}.t{j}").alias(f"t{j}") for j in range(k + 1, last + 1)]
        return F.when(F.col("step") == k, F.struct(F.col("t").alias(f"t{k}"), *following))

    for k in range(last, 0, -1):
        rows = rows.withColumn(f"next{k}", F.min(start(k)).over(later))

    def filled(chain: str, k: int) -> list[Column]:
        """Times of steps k.. of a chain; from its first gap on, those found beyond the slice."""
        times = []
        for j in range(k, last + 1):
            time_j = F.when(F.col(f"{chain}.t{j}").isNotNull(), F.col(f"{chain}.t{j}"))
            for gap in range(k, j + 1):
                time_j = time_j.when(F.col(f"{chain}.t{gap}").isNull(), F.col(f"beyond{gap}.t{j}"))
            times.append(time_j.alias(f"t{j}"))
        return times

    # One row per (user, slice); the grouping reuses the windows' partitioning.
    beyond = rows.groupBy("user", "slice").agg(*(F.min(start(k)).alias(f"first{k}") for k in range(1, last + 1)))
    after = W.partitionBy("user").orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    for k in range(last, 0, -1):
        whole = F.struct(F.col(f"first{k}.t{k}").alias(f"t{k}"), *filled(f"first{k}", k + 1))
        found = F.when(F.col(f"first{k}").isNotNull(), whole)
        beyond = beyond.withColumn(f"whole{k}", found).withColumn(f"beyond{k}", F.min(f"whole{k}").over(after))
    beyond = beyond.select("user", "slice", *(f"beyond{k}" for k in range(1, last + 1)))

    return (
        rows.filter(F.col("step") == 0)
        .select("user", "slice", F.col("t").alias("t0"), "next1", "n")
        .join(beyond, ["user", "slice"])
        .select("user", "t0", *filled("next1", 1), "n")
    )


def event_funnel(
    events: DataFrame,
    steps: Sequence[tuple[str, str]],
    within_hours: int,
    user: str = "user_id",
    time: str = "ts",
    event_type: str = "event_type",
) -> DataFrame:
    """Users and attempts that reach each step in order.

    ``steps`` pairs stage labels with event types. An attempt is one event of
    the first step; it goes on to the first event of the next step that is
    strictly later, if that comes at most ``within_hours`` after. Drop-off and
    conversions count users.
    """
    chains = event_chains(events, [kind for _, kind in steps], user, time, event_type)
    allowed = within_hours * 3_600 * 1_000_000
    reached = [F.lit(True)]
    for k in range(1, len(steps)):
        in_time = F.coalesce(F.col(f"t{k}") - F.col(f"t{k - 1}") <= allowed, F.lit(False))
        reached.append(reached[-1] & in_time)
    per_user = chains.groupBy("user").agg(*(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias(f"n{k}") for k, ok in enumerate(reached)))
    totals = per_user.agg(
        *(F.count_if(F.col(f"n{k}") > 0).alias(f"users{k}") for k in range(len(steps))),
        *(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"attempts{k}") for k in range(len(steps))),
    )
    stages = [(label, f"users{k}") for k, (label, _) in enumerate(steps)]
    attempts = {"attempts": [f"attempts{k}" for k in range(len(steps))]}
    return (
        stage_rows(totals, stages, attempts)
        .withColumnRenamed("reached", "users")
        .withColumn("is_simulated", F.lit(False))
        .orderBy("stage_order")
    )
