"""Table schemas, keys and status values of the commerce model.

Money is ``decimal(18,2)`` so that sums do not depend on how rows are
partitioned. Integer keys are ``bigint``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

_KEY = T.LongType()
_INT = T.IntegerType()
_STR = T.StringType()
_DATE = T.DateType()


@dataclass(frozen=True)
class TableSpec:
    """Columns, key, references and text widths of one table."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    primary_key: str
    foreign_keys: tuple[tuple[str, str], ...] = ()  # (column, parent table)
    max_length: dict[str, int] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, True) for n, t in self.columns])

    @property
    def column_names(self) -> list[str]:
        return [n for n, _ in self.columns]


# Column names, keys and text widths of the nine tables.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "category",
            (("category_id", _KEY), ("category_name", _STR)),
            "category_id",
            max_length={"category_name": 20},
        ),
        TableSpec(
            "customers",
            (
                ("customer_id", _KEY),
                ("first_name", _STR),
                ("last_name", _STR),
                ("state", _STR),
                ("address", _STR),
            ),
            "customer_id",
            max_length={"first_name": 20, "last_name": 20, "state": 20, "address": 5},
        ),
        TableSpec(
            "sellers",
            (("seller_id", _KEY), ("seller_name", _STR), ("origin", _STR)),
            "seller_id",
            max_length={"seller_name": 25, "origin": 10},
        ),
        TableSpec(
            "products",
            (
                ("product_id", _KEY),
                ("product_name", _STR),
                ("price", MONEY),
                ("cogs", MONEY),
                ("category_id", _KEY),
            ),
            "product_id",
            (("category_id", "category"),),
            {"product_name": 60},
        ),
        TableSpec(
            "orders",
            (
                ("order_id", _KEY),
                ("order_date", _DATE),
                ("customer_id", _KEY),
                ("seller_id", _KEY),
                ("order_status", _STR),
            ),
            "order_id",
            (("customer_id", "customers"), ("seller_id", "sellers")),
            {"order_status": 15},
        ),
        TableSpec(
            "order_items",
            (
                ("order_item_id", _KEY),
                ("order_id", _KEY),
                ("product_id", _KEY),
                ("quantity", _INT),
                ("price_per_unit", MONEY),
                ("total_sale", MONEY),
            ),
            "order_item_id",
            (("order_id", "orders"), ("product_id", "products")),
        ),
        TableSpec(
            "payments",
            (
                ("payment_id", _KEY),
                ("order_id", _KEY),
                ("payment_date", _DATE),
                ("payment_status", _STR),
            ),
            "payment_id",
            (("order_id", "orders"),),
            {"payment_status": 20},
        ),
        TableSpec(
            "shippings",
            (
                ("shipping_id", _KEY),
                ("order_id", _KEY),
                ("shipping_date", _DATE),
                ("return_date", _DATE),
                ("shipping_providers", _STR),
                ("delivery_status", _STR),
            ),
            "shipping_id",
            (("order_id", "orders"),),
            {"shipping_providers": 50, "delivery_status": 50},
        ),
        TableSpec(
            "inventory",
            (
                ("inventory_id", _KEY),
                ("product_id", _KEY),
                ("stock", _INT),
                ("warehouse_id", _INT),
                ("last_stock_date", _DATE),
            ),
            "inventory_id",
            (("product_id", "products"),),
        ),
    )
}

# Status words as they occur in the data.
COMPLETED, RETURNED = "Completed", "Returned"
IN_PROGRESS, CANCELLED = "Inprogress", "Cancelled"
PAYMENT_OK, REFUNDED, PAYMENT_FAILED = "Payment Successed", "Refunded", "Payment Failed"
DELIVERED, SHIPPED = "Delivered", "Shipped"

# Order status -> (payment status, delivery status or no shipment).
LEGAL_STATUS = {
    CANCELLED: (PAYMENT_FAILED, None),
    IN_PROGRESS: (PAYMENT_OK, SHIPPED),
    COMPLETED: (PAYMENT_OK, DELIVERED),
    RETURNED: (REFUNDED, RETURNED),
}

DEFAULT_ADDRESS = "xxxx"
