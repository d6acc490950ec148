from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions.exact import exact_ratio, full_name, micros
from tests.conftest import rows


def expected(n, d, digits, scale):
    if not d:
        return None
    exact = Decimal(n) * scale / Decimal(d)
    return float(abs(exact).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).copy_sign(exact))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(10**14), 10**14), st.integers(-(10**6), 10**6)), min_size=1, max_size=40))
def test_ratio_rounds_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = rows(df.select(exact_ratio(F.col("n"), F.col("d")), exact_ratio(F.col("n"), F.col("d"), 1, 100)))
    assert got == [(expected(n, d, 2, 1), expected(n, d, 1, 100)) for n, d in pairs]


def test_ratio_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (181828647, 4200), (None, 3), (3, None), (3, 0)], "n long, d long")
    assert [r[0] for r in rows(df.select(exact_ratio(F.col("n"), F.col("d"))))] == [0.13, -0.13, 43292.54, None, None, None]


def test_full_name_skips_null(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None), (None, "B"), (None, None)], "first_name string, last_name string")
    assert [r[0] for r in rows(df.select(full_name()))] == ["A B", "A ", " B", " "]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_micros_of_zone_free_time_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        # The night clocks change in New York.
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 01:30:00' AS a, TIMESTAMP_NTZ'2024-03-10 03:30:00.000001' AS b")
        gap = df.select(micros(F.col("b"), "timestamp_ntz") - micros(F.col("a"), "timestamp_ntz")).first()[0]
        assert gap == 2 * 3_600_000_000 + 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
