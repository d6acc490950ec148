from __future__ import annotations

from tallyloom.operators import quality as q
from tests.conftest import rows


def test_load_audit(make):
    items = make("order_items", (1, 1, 1, 1, 1, 1), (2, 1, 1, None, 1, None))
    got = rows(q.load_audit({"category": make("category", (1, "a")), "order_items": items}))
    assert sorted(got) == [("category", 1, None), ("order_items", 2, 1)]


def test_primary_keys(make):
    tables = {"category": make("category", (1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f"))}
    assert rows(q.primary_key_audit(tables)) == [("category", "category_id", 1, 3, 2)]
    assert sorted(rows(q.duplicate_keys(tables["category"], "category_id")), key=repr) == [(1, 3), (None, 2)]


def test_foreign_keys(make):
    tables = {
        "category": make("category", (1, "a")),
        "products": make("products", (1, "x", 1, 1, 1), (2, "x", 1, 1, 9), (3, "x", 1, 1, 9), (4, "x", 1, 1, None)),
        "inventory": make("inventory", (1, 4, 1, 1, None)),
    }
    assert sorted(rows(q.foreign_key_audit(tables))) == [
        ("inventory", "product_id", "products", 0, 0),
        ("products", "category_id", "category", 1, 2),
    ]


def test_text_widths(make):
    sellers = make("sellers", (1, "x" * 26, "USA"), (2, "x" * 25, None))
    assert sorted(rows(q.text_width_audit({"sellers": sellers}))) == [
        ("sellers", "origin", 10, 0, 3),
        ("sellers", "seller_name", 25, 1, 26),
    ]


def test_status_matrix_flags_what_is_not_legal(make):
    orders = make(
        "orders",
        (1, None, 1, 1, "Cancelled"),
        (2, None, 1, 1, "Cancelled"),
        (3, None, 1, 1, "Completed"),
        (4, None, 1, 1, "Returned"),
        (5, None, 1, 1, None),
    )
    payments = make(
        "payments", *[(i, i, None, s) for i, s in enumerate(["Payment Failed", "Payment Failed", "Payment Successed", "Refunded"], 1)]
    )
    shippings = make(
        "shippings",
        (1, 2, None, None, "p", "Shipped"),  # a cancelled order with a shipment
        (2, 3, None, None, "p", "Delivered"),
        (3, 4, None, None, "p", "Returned"),
        (4, 4, None, None, "q", "Returned"),
    )
    got = {r[:3]: r[3:] for r in rows(q.status_matrix(orders, payments, shippings))}
    assert got == {
        ("Cancelled", "Payment Failed", None): (1, True),
        ("Cancelled", "Payment Failed", "Shipped"): (1, False),
        ("Completed", "Payment Successed", "Delivered"): (1, True),
        ("Returned", "Refunded", "Returned"): (1, True),
        (None, None, None): (1, False),
    }


def test_reconciliation(make):
    status = ["Completed", "Returned", "Returned", "Inprogress", "Cancelled"]
    orders = make("orders", *[(i, None, 1, 1, s) for i, s in enumerate(status)])
    assert sorted(rows(q.funnel_reconciliation(orders), "order_status", "status_orders", "reconciles")) == [
        ("Cancelled", 1, True),
        ("Inprogress", 1, True),
        ("Returned", 2, True),
    ]


def test_cohort_checks_find_violations(spark):
    schema = "months_since_cohort int, cohort_size long, retained_users long, retention_rate double"
    data = [(0, 10, 10, 100.0), (0, 5, 4, 80.0), (-1, 5, 1, 20.0), (2, 5, 6, 120.0)]
    assert rows(q.cohort_checks(spark.createDataFrame(data, schema))) == [(4, 2, 15, 1, 1, 1)]
