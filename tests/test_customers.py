from __future__ import annotations

import pytest

from tallyloom.operators import customers as c
from tests.conftest import rows


@pytest.fixture(scope="module")
def people(make):
    return make(
        "customers",
        (1, "Ann", "Lee", "Ohio", "xxxx"),
        (2, "Bob", None, "Ohio", "xxxx"),
        (3, "Ann", "Lee", "Ohio", "xxxx"),
        (4, "Dan", "Fox", "Utah", "xxxx"),
        (5, "Eve", "Kay", "Utah", "xxxx"),
    )


def one_line_orders(make, *spec):
    """Orders with one line of 10.00 each: (customer, status, how many)."""
    orders, items, n = [], [], 0
    for customer, status, count in spec:
        for _ in range(count):
            n += 1
            orders.append((n, "2024-01-01", customer, 1, status))
            items.append((n, n, 1, 1, 10, 10))
    return make("orders", *orders), make("order_items", *items)


def test_aov_needs_more_than_five_lines(make, people):
    orders, items = one_line_orders(make, (1, "Completed", 5), (2, "Completed", 6), (None, "Completed", 9), (99, "Completed", 9))
    assert rows(c.customer_aov(orders, items, people)) == [(2, "Bob ", 10.0, 6)]


def test_aov_rounds_the_exact_quotient(make, people):
    orders, _ = one_line_orders(make, (1, "Completed", 1))
    items = make("order_items", *[(i, 1, 1, 1, 0, 0) for i in range(7)], (8, 1, 1, 1, "0.04", "0.04"))
    # 0.04 / 8 = 0.005 exactly, away from zero.
    assert rows(c.customer_aov(orders, items, people), "aov") == [(0.01,)]


def test_never_ordered_and_share(make, people):
    orders, _ = one_line_orders(make, (1, "Cancelled", 1), (None, "Completed", 2))
    assert sorted(rows(c.customers_never_ordered(people, orders), "customer_id")) == [(2,), (3,), (4,), (5,)]
    assert rows(c.never_ordered_share(people, orders)) == [(5, 4, 80.0, 20.0)]


def test_not_ordered_lately_includes_the_start_day(make, people):
    orders = make(
        "orders",
        (1, "2024-08-31", 1, 1, "Completed"),
        (2, "2024-02-29", 2, 1, "Completed"),  # 31 August minus six months, clamped
        (3, "2024-02-28", 3, 1, "Completed"),
    )
    assert sorted(rows(c.customers_never_ordered(people, orders, 6), "customer_id")) == [(3,), (4,), (5,)]


def test_clv_rank_with_ties_and_null(make, people):
    orders = make("orders", *[(i, "2024-01-01", i, 1, "Completed") for i in range(1, 6)])
    items = make(
        "order_items",
        (1, 1, 1, 1, 10, 10),
        (2, 2, 1, 1, 10, 10),
        (3, 3, 1, 1, 30, 30),
        (4, 4, 1, 1, None, None),
        (5, 5, 1, 1, 5, 5),
    )
    got = {r[0]: (r[2], r[3]) for r in rows(c.customer_clv_rank(orders, items, people))}
    assert got == {4: (None, 1), 3: (30.0, 2), 1: (10.0, 3), 2: (10.0, 3), 5: (5.0, 4)}


def test_return_class_turns_at_six(make, people):
    orders, items = one_line_orders(make, (1, "Returned", 5), (2, "Returned", 6), (2, "Completed", 1))
    assert sorted(rows(c.customer_return_class(orders, items, people))) == [
        ("Ann Lee", 5, 5, "New"),
        ("Bob ", 7, 6, "Returning_customer"),
    ]


def test_top_customers_merge_namesakes_unless_by_id(make, people):
    orders, items = one_line_orders(make, (1, "Completed", 2), (2, "Completed", 3), (3, "Completed", 2), (4, "Completed", 1), (5, "Completed", 1))
    merged = c.top_customers_per_state(orders, items, people, k=1)
    assert sorted(rows(merged)) == [
        ("Ohio", "Ann Lee", 4, 40.0, 1),
        ("Utah", "Dan Fox", 1, 10.0, 1),
        ("Utah", "Eve Kay", 1, 10.0, 1),
    ]
    apart = c.top_customers_per_state(orders, items, people, k=2, by_id=True)
    assert sorted(rows(apart, "customer_id", "rnk")) == [(1, 2), (2, 1), (3, 2), (4, 1), (5, 1)]


def test_least_category_keeps_ties_and_puts_null_last(make, people):
    orders = make("orders", (1, "2024-01-01", 1, 1, "Completed"), (2, "2024-01-01", 4, 1, "Completed"))
    products = make("products", (1, "a", 1, 1, 1), (2, "b", 1, 1, 2), (3, "c", 1, 1, 3), (4, "d", 1, 1, None))
    category = make("category", (1, "x"), (2, "y"), (3, "z"))
    items = make(
        "order_items",
        (1, 1, 1, 1, 5, 5),
        (2, 1, 2, 1, 5, 5),
        (3, 1, 3, 1, 9, 9),
        (4, 1, 4, 1, 1, 1),  # no category: left out
        (5, 2, 1, 1, None, None),
        (6, 2, 2, 1, 7, 7),
    )
    got = c.least_category_per_state(orders, items, people, products, category)
    assert sorted(rows(got)) == [("Ohio", "x", 5.0, 1), ("Ohio", "y", 5.0, 1), ("Utah", "y", 7.0, 1)]


def test_order_count_distribution(make):
    orders, _ = one_line_orders(make, (1, "Completed", 1), (2, "Cancelled", 2), (3, "Completed", 6), (4, "Completed", 3), (None, "Completed", 5))
    assert rows(c.order_count_distribution(orders)) == [(4, 1, 6, 2.5, 3.0)]


def test_state_revenue_counts_both_kinds_of_customers(make, people):
    orders, items = one_line_orders(make, (1, "Cancelled", 2), (4, "Completed", 1))
    extra = make("orders", (1000, "2024-01-01", 5, 1, "Completed"))  # an order without lines
    got = c.state_revenue(orders.unionByName(extra), items, people)
    assert sorted(rows(got)) == [("Ohio", 3, 1, 20.0), ("Utah", 2, 2, 10.0)]


def test_only_cancelled_customers(make):
    orders, _ = one_line_orders(make, (1, "Cancelled", 2), (2, "Cancelled", 1), (2, "Completed", 1), (3, None, 1), (None, "Cancelled", 1))
    assert sorted(rows(c.only_cancelled_customers(orders))) == [(1, 2), (3, 1)]
