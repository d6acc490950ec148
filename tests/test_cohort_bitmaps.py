"""Retention from sets of active months against retention from all orders."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tallyloom.operators.cohort_bitmaps import WORD, CohortStore, active_months, retention_of
from tallyloom.operators.retention import cohort_retention
from tests.conftest import rows


def random_orders(rng, n, days):
    start = date(1998, 11, 20)
    return [
        (
            i,
            rng.choice([start + timedelta(days=rng.randrange(days)), start + timedelta(days=rng.randrange(days)), None]),
            rng.choice([1, 1, 1, rng.randrange(2, 60), None]),
            1,
            rng.choice(["Completed", "Returned", "Inprogress", "Cancelled", None]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("days", [40, 800, 6000])
def test_equals_retention_from_orders(make, days):
    orders = make("orders", *random_orders(random.Random(days), 600, days))
    assert rows(retention_of(active_months(orders))) == rows(cohort_retention(orders))
    assert retention_of(active_months(orders)).dtypes == cohort_retention(orders).dtypes


def test_first_and_last_bit_of_a_word(make):
    first = WORD * ((2000 * 12) // WORD)  # a word's first month
    day = lambda month: f"{month // 12}-{month % 12 + 1:02d}-15"
    orders = make("orders", *[(i, day(first + k), 1, 1, "Completed") for i, k in enumerate((-1, 0, WORD - 1, WORD))])
    sets = {(r.word - first // WORD, r.bits) for r in active_months(orders).collect()}
    assert sets == {(-1, 1 << (WORD - 1)), (0, 1 | 1 << (WORD - 1)), (1, 1)}
    assert [r.months_since_cohort for r in retention_of(active_months(orders)).collect()] == [0, 1, WORD, WORD + 1]


def test_a_month_more_reads_its_own_orders_only(spark, make, tmp_path):
    orders = random_orders(random.Random(2), 900, 1200)
    orders = [o for o in orders if o[1] is not None]
    last = max(o[1] for o in orders).replace(day=1)
    old, new = [o for o in orders if o[1] < last], [o for o in orders if o[1] >= last]
    store = CohortStore(spark, str(tmp_path / "sets"))
    store.add(make("orders", *old))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "sets").glob("*.parquet")}
    store.add(make("orders", *new))
    assert before.items() <= {p.name: p.stat().st_mtime_ns for p in (tmp_path / "sets").glob("*.parquet")}.items()
    whole = make("orders", *orders)
    assert rows(store.retention()) == rows(cohort_retention(whole))
    # again, and a late order of an earlier month
    late = [(5000, old[0][1], 59, 1, "Completed")]
    store.add(make("orders", *new, *late))
    assert rows(store.retention()) == rows(cohort_retention(make("orders", *orders, *late)))
    compact = store.compact(str(tmp_path / "compact"))
    assert rows(compact.retention()) == rows(store.retention())
    assert compact.activity().count() < store.activity().count()


def test_adding_a_month_touches_no_stored_set(spark, make, tmp_path):
    store = CohortStore(spark, str(tmp_path / "sets"))
    store.add(make("orders", (1, "2020-01-05", 7, 1, "Completed")))
    plan = active_months(make("orders", (2, "2020-02-05", 7, 1, "Completed")))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "hashpartitioning(customer_id" in plan


def test_no_orders(make):
    assert rows(retention_of(active_months(make("orders")))) == []
