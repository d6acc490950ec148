from __future__ import annotations

from datetime import date

import pytest

from tallyloom.streaming.sales import SaleStore, apply_sales_stream
from tests.conftest import rows
from tests.test_sale_batch import REQUEST, ask


def test_later_batches_see_what_earlier_ones_left(spark, make, tmp_path):
    store = SaleStore(spark, f"{tmp_path}/store")
    store.start(make("orders", (500, "2024-01-01", 1, 1, "Completed")), make("inventory", (1, 1, 5, 1, None)))
    dimensions = (
        make("customers", (1, "a", "b", "s", "x")),
        make("sellers", (1, "s", "UK")),
        make("products", (1, "ball", 2, 1, 1)),
    )

    def feed(*requests):
        spark.createDataFrame(requests, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in")
        query = apply_sales_stream(stream, store, *dimensions, date(2024, 8, 1), f"{tmp_path}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None

    feed(ask(1, 1, 3), ask(2, 1, 4))
    assert rows(store.inventory(before=1), "stock") == [(2,)]
    feed(ask(3, 1, 2), ask(4, 1, 1, order=1001))  # order 1001 was sold in the first batch
    assert rows(store.inventory(before=2), "stock") == [(0,)]
    assert sorted(rows(store.orders(before=2), "order_id")) == [(500,), (1001,), (1003,)]
    assert sorted(rows(store.items(), "order_id", "quantity")) == [(1001, 3), (1003, 2)]


def test_a_new_checkpoint_over_an_old_store_is_refused(spark, make, tmp_path):
    store = SaleStore(spark, f"{tmp_path}/store")
    store.start(make("orders", (500, "2024-01-01", 1, 1, "Completed")), make("inventory", (1, 1, 5, 1, None)))
    store.check_turn(0)
    for number in (0, 1):
        store.write("inventory", number, store.inventory(number))
    store.check_turn(1)
    store.check_turn(2)
    for wrong in (0, 3):
        with pytest.raises(ValueError):
            store.check_turn(wrong)
