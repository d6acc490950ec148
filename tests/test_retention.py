from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.functions.exact import percent
from tallyloom.operators import retention as r
from tests.conftest import day, rows


@pytest.fixture(scope="module")
def orders(make):
    return make(
        "orders",
        (1, "2023-12-31", 1, 1, "Completed"),
        (2, "2024-01-01", 1, 1, "Returned"),
        (3, "2024-01-20", 1, 1, "Completed"),
        (4, "2023-12-01", 2, 1, "Cancelled"),  # the first order failed, the second counts
        (5, "2024-01-02", 2, 1, "Inprogress"),
        (6, "2023-12-05", 3, 1, "Cancelled"),  # only cancelled: no cohort
        (7, "2023-12-05", 4, 1, None),
        (8, "2023-12-05", None, 1, "Completed"),
        (9, None, 5, 1, "Completed"),
        (10, "2023-12-09", 5, 1, "Completed"),
        (11, "2024-03-09", 5, 1, "Completed"),
    )


EXPECTED = [
    (day("2023-12-01"), 0, 2, 2, 100.0),
    (day("2023-12-01"), 1, 2, 1, 50.0),
    (day("2023-12-01"), 3, 2, 1, 50.0),
    (day("2024-01-01"), 0, 1, 1, 100.0),
]


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_cohorts(orders, partitions):
    assert rows(r.cohort_retention(orders.repartition(partitions))) == EXPECTED


def test_rates_round_as_published(spark):
    # Cohort sizes, retained counts and rates of published rows.
    published = [(166, 166, 100.0), (166, 99, 59.64), (166, 112, 67.47)]
    df = spark.createDataFrame(published, "size long, kept long, rate double")
    assert df.filter(percent(F.col("kept"), F.col("size")) != F.col("rate")).count() == 0


def test_window_form_equals_group_form(spark, orders):
    """A second formulation: first month by GROUP BY and a join."""
    orders.createOrReplaceTempView("cohort_orders")
    want = spark.sql("""
        WITH ok AS (SELECT DISTINCT customer_id, trunc(order_date, 'MM') AS m FROM cohort_orders
                    WHERE order_status <> 'Cancelled' AND customer_id IS NOT NULL AND order_date IS NOT NULL),
             first AS (SELECT customer_id, min(m) AS c FROM ok GROUP BY customer_id)
        SELECT c, cast(months_between(m, c) AS int) AS k, count(*) AS n FROM ok JOIN first USING (customer_id) GROUP BY c, m
    """)
    got = r.cohort_retention(orders).select("cohort_month", "months_since_cohort", "retained_users")
    assert sorted(rows(got)) == sorted(rows(want))


def test_pivot_leaves_gaps_empty(orders):
    wide = r.cohort_pivot(r.cohort_retention(orders))
    assert wide.columns == ["cohort_month", "month_0", "month_1", "month_3"]
    assert rows(wide) == [(day("2023-12-01"), 100.0, 50.0, 50.0), (day("2024-01-01"), 100.0, None, None)]
    assert r.retention_window(wide, 1).columns == ["cohort_month", "month_0", "month_1"]
    assert r.retention_window(wide, 3).columns == wide.columns


def test_pivot_refuses_duplicates(orders):
    cohorts = r.cohort_retention(orders)
    with pytest.raises(PySparkException, match="duplicate cohort month and offset"):
        r.cohort_pivot(cohorts.unionByName(cohorts)).collect()


def test_curve_has_two_denominators(orders):
    got = {x[0]: x[1:] for x in rows(r.retention_curve(r.cohort_retention(orders)))}
    # The January cohort has no row at offset 1 though old enough, and is too young for offset 3.
    assert got == {
        0: (3, 3, 3, 100.0, 100.0),
        1: (1, 2, 3, 50.0, 33.33),
        3: (1, 2, 2, 50.0, 50.0),
    }
