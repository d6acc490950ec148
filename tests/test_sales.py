from __future__ import annotations

import pytest

from tallyloom.operators import sales as s
from tests.conftest import day, rows


def test_monthly_trend_starts_on_the_cutoff_day_and_lags_by_row(make):
    orders = make(
        "orders",
        (1, "2023-03-14", 1, 1, "Completed"),  # a day too early
        (2, "2023-03-15", 1, 1, "Completed"),
        (3, "2023-06-01", 1, 1, "Cancelled"),
        (4, "2024-03-15", 1, 1, "Completed"),
    )
    items = make("order_items", (1, 1, 1, 1, 1, 1), (2, 2, 1, 1, 2, 2), (3, 3, 1, 1, 4, 4), (4, 4, 1, 1, 8, 8))
    assert rows(s.monthly_sales_trend(orders, items)) == [(2023, 3, 2.0, None), (2023, 6, 4.0, 2.0), (2024, 3, 8.0, 4.0)]


def test_payment_share_uses_all_payments(make):
    orders = make("orders", (1, "2024-01-01", 1, 1, "Completed"))
    payments = make(
        "payments",
        (1, 1, None, "Refunded"),
        (2, 1, None, "Refunded"),
        (3, 9, None, "Refunded"),
        (4, None, None, "Payment Failed"),
        (5, 1, None, None),
        (6, 9, None, "Payment Failed"),
    )
    assert sorted(rows(s.payment_status_share(orders, payments)), key=repr) == [("Refunded", 2, 33.33), (None, 1, 16.67)]


def test_top_seller_success(make):
    sellers = make("sellers", (1, "one", "USA"), (2, "two", "UK"), (3, "three", "UK"), (4, "four", "UK"))
    orders = make(
        "orders",
        (1, "2024-01-01", 1, 1, "Completed"),
        (2, "2024-01-01", 1, 1, "Completed"),
        (3, "2024-01-01", 1, 1, "Cancelled"),
        (4, "2024-01-01", 1, 1, "Inprogress"),
        (5, "2024-01-01", 1, 1, None),
        (6, "2024-01-01", 1, 2, "Returned"),  # among the top two, but nothing decided
        (7, "2024-01-01", 1, 3, "Completed"),
        (8, "2024-01-01", 1, 99, "Completed"),  # unknown seller with the highest revenue
        (9, "2024-01-01", 1, 4, "Completed"),  # no lines
    )
    items = make("order_items", (1, 1, 1, 1, 90, 90), (2, 6, 1, 1, 50, 50), (3, 7, 1, 1, 1, 1), (4, 8, 1, 1, 999, 999))
    # Order 2 has no line but counts as a completed order of a top seller.
    assert rows(s.top_seller_success(orders, items, sellers, k=2)) == [(1, "one", 2, 1, 3, 66.67)]
    assert [r[0] for r in rows(s.top_seller_success(orders, items, sellers))] == [1, 3]


@pytest.fixture(scope="module")
def selling(make):
    sellers = make("sellers", (1, "late", "UK"), (2, "quiet", "UK"), (3, "never", "UK"), (4, "edge", "UK"), (5, "empty", "UK"))
    orders = make(
        "orders",
        (1, "2024-08-31", 1, 1, "Completed"),
        (2, "2024-02-28", 1, 2, "Completed"),
        (3, "2023-01-01", 1, 2, "Cancelled"),
        (4, "2024-02-29", 1, 4, "Completed"),
        (5, "2023-05-05", 1, 5, "Completed"),
        (6, "2022-05-05", 1, 99, "Completed"),
    )
    items = make(
        "order_items", (1, 1, 1, 1, 5, 5), (2, 2, 1, 1, 5, 5), (3, 3, 1, 1, 70, 70), (4, 4, 1, 1, 5, 5), (6, 6, 1, 1, 5, 5)
    )
    return orders, items, sellers


def test_inactive_sellers(selling):
    # The amount is the largest line; a seller with orders but no lines is left out.
    assert rows(s.inactive_sellers(*selling)) == [(2, day("2024-02-28"), 70.0)]


def test_one_recent_order_without_seller_empties_the_literal_form(make, selling):
    orders, items, sellers = selling
    orders = orders.unionByName(make("orders", (50, "2024-08-01", 1, None, "Completed")))
    assert rows(s.inactive_sellers(orders, items, sellers)) == []
    assert [r[0] for r in rows(s.inactive_sellers(orders, items, sellers, null_safe=True))] == [2]


def test_old_order_without_seller_does_no_harm(make, selling):
    orders, items, sellers = selling
    orders = orders.unionByName(make("orders", (50, "2020-08-01", 1, None, "Completed")))
    assert [r[0] for r in rows(s.inactive_sellers(orders, items, sellers))] == [2]


def test_slow_shipping_from_four_days(make):
    customers = make("customers", (7, "Ann", "Lee", "Ohio", "xxxx"))
    orders = make("orders", *[(i, "2024-02-27", 7, 1, "Completed") for i in (1, 2, 3)], (4, "2024-02-27", 8, 1, "Completed"))
    ships = make(
        "shippings",
        (1, 1, "2024-03-01", None, "fast", "Delivered"),  # three days over a leap day
        (2, 2, "2024-03-02", None, "slow", "Delivered"),
        (3, 3, None, None, "none", "Delivered"),
        (4, 4, "2024-12-01", None, "slow", "Delivered"),
    )
    assert rows(s.slow_shipping(ships, orders, customers)) == [
        (4, 7, "Ann", "Lee", 2, day("2024-02-27"), "Completed", "slow")
    ]


def test_provider_performance_weights_by_line(make):
    orders = make("orders", *[(i, "2024-01-01", 1, 1, "Returned") for i in (1, 2, 3)])
    items = make(
        "order_items", (1, 1, 1, 1, 10, 10), (2, 1, 1, 1, 10, 10), (3, 2, 1, 1, 5, 5), (4, 3, 1, 1, 1, 1), (5, 9, 1, 1, 1, 1)
    )
    ships = make(
        "shippings",
        (1, 1, "2024-01-01", "2024-01-03", "a", "Returned"),
        (2, 2, "2024-01-01", "2024-01-04", "a", "Returned"),
        (3, 2, "2024-01-01", None, "a", "Delivered"),
        (4, 3, "2024-01-01", None, "b", "Delivered"),
        (5, 9, "2024-01-01", "2024-01-02", "c", "Returned"),
    )
    # a: two lines of order 1 (2 days) and one line of order 2 twice (3 days, none): 7 / 3.
    assert sorted(rows(s.provider_performance(ships, orders, items))) == [("a", 4, 30.0, 2.3), ("b", 1, 1.0, 0.0)]


def test_return_share(make):
    orders = make("orders", (1, None, 1, 1, "Returned"), (2, None, 1, 1, None), (3, None, 1, 1, "Completed"))
    assert rows(s.return_share(orders)) == [(3, 1, 33.33)]
    assert rows(s.return_share(orders.limit(0))) == [(0, 0, None)]


def test_kpi_row(make):
    customers = make("customers", *[(i, "a", "b", "s", "x") for i in (1, 2, 3)])
    orders = make(
        "orders", (1, "2024-01-05", 1, 1, "Completed"), (2, "2023-01-05", 1, 1, "Cancelled"), (3, None, None, 1, "Completed")
    )
    items = make("order_items", (1, 1, 1, 1, 1, 10), (2, 2, 1, 1, 1, "0.01"), (3, 2, 1, 1, 1, None))
    products, sellers = make("products", (1, "a", 1, 1, 1)), make("sellers", (1, "s", "UK"), (2, "t", "UK"))
    got = rows(s.kpi_summary(customers, orders, items, products, sellers))
    assert got == [(3, 1, 3, 10.01, 5.01, day("2023-01-05"), day("2024-01-05"), 1, 2)]
    paid = s.kpi_summary(customers, orders, items, products, sellers, ["Completed"])
    assert rows(paid, "total_orders", "total_revenue", "avg_order_value") == [(3, 10.0, 10.0)]
