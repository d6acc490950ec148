"""Two-proportion z-test over a table of attempts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exact import exact_ratio, percent
from tallyloom.functions.stats import pooled_z, two_tailed_p


@dataclass(frozen=True)
class Experiment:
    """Arms, labels and provenance of one test."""

    test_name: str
    control: object
    treatment: object
    control_label: str = "Control (A)"
    treatment_label: str = "Treatment (B)"
    control_description: str = "existing"
    treatment_description: str = "new"
    experimental_unit: str = "attempt"
    conversion_metric: str = "success"
    alpha: float = 0.05
    is_simulated: bool = False
    provenance: dict[str, str] = field(default_factory=dict)


def ab_test_groups(attempts: DataFrame, arm: str, success: str, experiment: Experiment) -> DataFrame:
    """Attempts, successes and conversion rate per arm, control first; an arm without attempts has zeros."""
    arms = [(0, experiment.control), (1, experiment.treatment)]
    counts = [
        F.struct(
            F.lit(place).alias("place"),
            F.count_if(F.col(arm) == F.lit(value)).alias("checkout_attempts"),
            F.count_if((F.col(arm) == F.lit(value)) & F.col(success)).alias("successful_checkouts"),
        )
        for place, value in arms
    ]
    return (
        attempts.agg(F.array(*counts).alias("arms"))
        .select(F.explode("arms").alias("row"))
        .select("row.*")
        .orderBy("place")
        .select(
            _by_arm(experiment.control_label, experiment.treatment_label).alias("group"),
            _by_arm(experiment.control_description, experiment.treatment_description).alias("group_description"),
            "checkout_attempts",
            "successful_checkouts",
            exact_ratio(F.col("successful_checkouts"), F.col("checkout_attempts"), 4).alias("conversion_rate"),
        )
    )


def _by_arm(control: str, treatment: str) -> Column:
    return F.when(F.col("place") == 0, control).otherwise(treatment)


def ab_test_z(attempts: DataFrame, arm: str, success: str, experiment: Experiment) -> DataFrame:
    """One row: counts per arm, lifts and the unrounded z statistic.

    The relative lift is NaN when nothing converted in the control arm.
    """
    in_a = F.col(arm) == F.lit(experiment.control)
    in_b = F.col(arm) == F.lit(experiment.treatment)
    won = F.col(success)
    counts = attempts.agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_a & won).alias("x_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_b & won).alias("x_b"),
    )
    n_a, x_a, n_b, x_b = (F.col(c).cast("decimal(19,0)") for c in ("n_a", "x_a", "n_b", "x_b"))
    # rate_b - rate_a over the common denominator, in whole numbers.
    difference = x_b * n_a - x_a * n_b
    relative = F.when(x_a == 0, F.lit(float("nan"))).otherwise(percent(difference, x_a * n_b))
    return counts.select(
        "n_a",
        "x_a",
        "n_b",
        "x_b",
        exact_ratio(difference, n_a * n_b, 4).alias("absolute_lift"),
        relative.alias("relative_lift_pct"),
        pooled_z(F.col("n_a"), F.col("x_a"), F.col("n_b"), F.col("x_b")).alias("z"),
    )


def ab_test_readout(attempts: DataFrame, arm: str, success: str, experiment: Experiment) -> DataFrame:
    """One row: the test's design, statistics, p-value and derived winner."""
    row = ab_test_z(attempts, arm, success, experiment).withColumn("p_value", two_tailed_p("z"))
    p = F.col("p_value")
    significant = p < experiment.alpha
    # Hypothesis and verdict texts, number formats.
    return row.select(
        F.lit(experiment.test_name).alias("test_name"),
        F.lit(experiment.is_simulated).alias("is_simulated"),
        F.lit(experiment.experimental_unit).alias("experimental_unit"),
        F.lit(experiment.conversion_metric).alias("conversion_metric"),
        F.lit("p_treatment = p_control").alias("hypothesis_null"),
        F.lit("p_treatment != p_control (two-tailed)").alias("hypothesis_alt"),
        F.lit(experiment.alpha).alias("alpha"),
        "absolute_lift",
        "relative_lift_pct",
        F.round("z", 4).alias("z_statistic"),
        "p_value",
        F.when(p < 0.0001, F.format_string("%.2e", p)).otherwise(F.format_string("%.4f", p)).alias("p_value_display"),
        significant.alias("is_significant"),
        F.when(significant & (F.col("z") > 0), experiment.treatment_label)
        .when(significant & (F.col("z") < 0), experiment.control_label)
        .otherwise("No statistically significant difference")
        .alias("winner"),
        *(F.lit(text).alias(name) for name, text in experiment.provenance.items()),
    )
