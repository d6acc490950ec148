from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.stats import two_tailed_p
from tallyloom.operators import experiment as e
from tests.conftest import rows

TEST = e.Experiment(
    test_name="checkout", control="A", treatment="B", control_label="control", treatment_label="treatment",
    provenance={"baseline_rate_source": "orders", "treatment_assumption": "none"},
)
NO_DIFFERENCE = "No statistically significant difference"


def attempts(spark, n_a, x_a, n_b, x_b):
    def arm(name, n, x):
        return spark.range(n).select(F.lit(name).alias("arm"), (F.col("id") < x).alias("ok"))

    return arm("A", n_a, x_a).unionByName(arm("B", n_b, x_b)).unionByName(arm("other", 7, 3))


def readout(spark, *counts):
    return e.ab_test_readout(attempts(spark, *counts), "arm", "ok", TEST).first()


def test_published_readout(spark):
    # Published counts and statistics.
    row = readout(spark, 10000, 9760, 10000, 9850)
    assert (row["absolute_lift"], row["relative_lift_pct"], row["z_statistic"]) == (0.009, 0.92, 4.6024)
    assert row["p_value"] == pytest.approx(4.1760661830000995e-06, rel=1e-12)
    assert (row["p_value_display"], row["is_significant"], row["winner"]) == ("4.18e-06", True, "treatment")
    assert (row["baseline_rate_source"], row["treatment_assumption"]) == ("orders", "none")
    groups = e.ab_test_groups(attempts(spark, 10000, 9760, 10000, 9850), "arm", "ok", TEST)
    assert rows(groups, "group", "checkout_attempts", "successful_checkouts", "conversion_rate") == [
        ("control", 10000, 9760, 0.976),
        ("treatment", 10000, 9850, 0.985),
    ]


def test_control_wins(spark):
    row = readout(spark, 1000, 500, 1000, 400)
    assert row["winner"] == "control" and row["absolute_lift"] == -0.1 and row["relative_lift_pct"] == -20.0


def test_no_difference(spark):
    row = readout(spark, 100, 50, 100, 51)
    assert (row["winner"], row["is_significant"], row["p_value_display"]) == (NO_DIFFERENCE, False, "0.8875")


def test_zero_error_gives_zero_z(spark):
    row = readout(spark, 10, 10, 20, 20)
    assert (row["z_statistic"], row["p_value"], row["winner"]) == (0.0, 1.0, NO_DIFFERENCE)


def test_control_rate_zero_gives_nan_lift(spark):
    row = readout(spark, 50, 0, 50, 20)
    assert math.isnan(row["relative_lift_pct"]) and row["winner"] == "treatment"


def test_empty_arm_gives_no_statistics(spark):
    row = readout(spark, 10, 4, 0, 0)
    assert row["z_statistic"] is None and row["p_value"] is None and row["winner"] == NO_DIFFERENCE


def test_p_value_display_changes_below_a_ten_thousandth(spark):
    df = spark.createDataFrame([(3.89,), (3.9,), (-3.9,), (0.0,), (30.0,)], "z double")
    p = [r[0] for r in rows(df.select(two_tailed_p("z")))]
    assert p == [math.erfc(abs(z) / math.sqrt(2)) for z in (3.89, 3.9, 3.9, 0.0, 30.0)]
    assert p[0] > 0.0001 > p[1] and 0 < p[4] < 1e-190


def test_an_arm_without_attempts_has_zeros(spark):
    got = rows(e.ab_test_groups(attempts(spark, 4, 2, 0, 0), "arm", "ok", TEST))
    assert [r[0] for r in got] == ["control", "treatment"] and [r[2:] for r in got] == [(4, 2, 0.5), (0, 0, None)]
