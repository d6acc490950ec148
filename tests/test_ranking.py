from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import ranking
from tallyloom.functions.joins import spread_lookup
from tallyloom.functions.ranking import SLICES, global_dense_rank, slice_bounds, slice_number, top_dense_rank
from tests.conftest import rows


@pytest.fixture(autouse=True)
def many_slices(monkeypatch):
    """Small tables in as many slices as large ones have."""
    monkeypatch.setattr(ranking, "SLICE_ROWS", 1)


def scored(spark, n, kinds, seed=1):
    rng = random.Random(seed)
    # A third of the rows share one score; some have none.
    def score():
        x = rng.random()
        return Decimal("50.00") if x < 0.34 else None if x < 0.37 else Decimal(rng.randrange(kinds)) / 100

    return spark.createDataFrame([(i, f"g{min(i % 9, 3)}", score()) for i in range(n)], "id long, g string, s decimal(18,2)")


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("kinds", [1, 40, 5000])
def test_global_dense_rank_equals_window(spark, partitions, kinds):
    df = scored(spark, 3000, kinds).repartition(partitions)
    want = df.withColumn("r", F.dense_rank().over(W.orderBy(F.col("s").desc_nulls_first())))
    got = global_dense_rank(df, "s", "r")
    assert sorted(rows(got, "id", "r")) == sorted(rows(want, "id", "r"))


def test_slice_numbers_count_the_cut_points_below(spark):
    values = spark.createDataFrame([(None,)] + [(v / 3,) for v in range(-300, 3000)], "v double")
    bounds = slice_bounds(values, "v")
    assert len(bounds) == SLICES - 1 and bounds == sorted(bounds)
    for v, n in rows(values.select("v", slice_number(bounds, F.col("v")))):
        assert n == (0 if v is None else sum(b < v for b in bounds) + 1)


@pytest.mark.parametrize("slice_rows, slices", [(10**6, 1), (3_200, 4), (400, 16), (3, 1024)])
def test_number_of_slices_follows_the_rows(spark, monkeypatch, slice_rows, slices):
    monkeypatch.setattr(ranking, "SLICE_ROWS", slice_rows)
    values = spark.createDataFrame([(None,)] + [(v / 3,) for v in range(-300, 3000)], "v double")
    bounds = slice_bounds(values, "v")
    assert len(bounds) == slices - 1 and bounds == sorted(bounds)
    for v, n in rows(values.select("v", slice_number(bounds, F.col("v")))):
        assert n == (0 if v is None else sum(b < v for b in bounds) + 1)
    df = scored(spark, 900, 300)
    want = df.withColumn("r", F.dense_rank().over(W.orderBy(F.col("s").desc_nulls_first())))
    assert sorted(rows(global_dense_rank(df, "s", "r"), "id", "r")) == sorted(rows(want, "id", "r"))


def test_global_dense_rank_of_nothing_and_of_one_value(spark):
    df = scored(spark, 10, 5)
    assert rows(global_dense_rank(df.filter("id < 0"), "s", "r")) == []
    same = global_dense_rank(df.withColumn("s", F.lit(7.5)), "s", "r")
    assert {r[0] for r in rows(same, "r")} == {1}


def test_top_dense_rank_keeps_ties(spark):
    df = scored(spark, 900, 30)
    window = W.partitionBy("g").orderBy(F.col("s").desc_nulls_first())
    want = df.withColumn("r", F.dense_rank().over(window)).filter("r <= 3")
    got = top_dense_rank(df, "g", "s", "r", 3)
    assert sorted(rows(got, "id", "r")) == sorted(rows(want, "id", "r"))


def test_spread_lookup_is_a_left_join(spark):
    facts = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") == 7, None).otherwise(F.col("id")).alias("k"))
    lookup = spark.createDataFrame([(1, "hot"), (4, "four"), (999, "none")], "k long, v string")
    got = spread_lookup(facts, lookup, "k", F.pmod(F.xxhash64("id"), F.lit(8)))
    want = facts.join(lookup, "k", "left")
    assert sorted(rows(got, "id", "v"), key=repr) == sorted(rows(want, "id", "v"), key=repr)
