from __future__ import annotations

import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.functions.scan import numbered_runs
from tallyloom.operators import sale_batch
from tallyloom.operators.sale_batch import apply_sales
from tests.conftest import day, rows

REQUEST = "seq long, order_id long, order_item_id long, customer_id long, seller_id long, product_id long, quantity int"
TODAY = date(2024, 8, 1)


@pytest.fixture(scope="module")
def shop(make):
    return {
        "customers": make("customers", (1, "a", "b", "s", "x")),
        "sellers": make("sellers", (1, "s", "UK")),
        "products": make("products", (1, "ball", "9.99", 1, 1), (2, "bat", 5, 1, 1), (3, "net", 7, 1, 1)),
        "orders": make("orders", (500, "2024-01-01", 1, 1, "Completed")),
        "inventory": make(
            "inventory",
            (1, 1, 5, 1, "2024-05-01"),
            (2, 2, 10, 1, "2024-05-01"),
            (3, 2, 3, 2, "2024-05-01"),
            (4, 77, 9, 1, "2024-05-01"),
            (5, 1, None, 3, None),
        ),
    }


def run(spark, shop, requests, **options):
    df = spark.createDataFrame(requests, REQUEST)
    return apply_sales(df, **shop, as_of=TODAY, **options)


def outcomes(batch):
    return {r["seq"]: r["outcome"] for r in batch.outcomes.collect()}


def ask(seq, product, quantity, order=None, customer=1, seller=1):
    order = 1000 + seq if order is None else order
    return (seq, order, order, customer, seller, product, quantity)


def test_exact_stock_then_empty_then_nothing_fits(spark, shop):
    batch = run(spark, shop, [ask(1, 1, 5), ask(2, 1, 1)])
    assert outcomes(batch) == {1: "accepted", 2: "not_enough_stock"}
    assert rows(batch.orders) == [(1001, day("2024-08-01"), 1, 1, "Inprogress")]
    assert [tuple(map(str, r)) for r in rows(batch.items)] == [("1001", "1001", "1", "5", "9.99", "49.95")]
    assert sorted(rows(batch.inventory, "inventory_id", "stock")) == [(1, 0), (2, 10), (3, 3), (4, 9), (5, None)]


def test_rejected_request_uses_nothing(spark, shop):
    batch = run(spark, shop, [ask(1, 1, 3), ask(2, 1, 4), ask(3, 1, 2)])
    assert outcomes(batch) == {1: "accepted", 2: "not_enough_stock", 3: "accepted"}


def test_order_of_seq_not_of_rows(spark, shop):
    batch = run(spark, shop, [ask(3, 1, 5), ask(1, 1, 4), ask(2, 1, 2)])
    assert outcomes(batch) == {1: "accepted", 2: "not_enough_stock", 3: "not_enough_stock"}


def test_every_warehouse_loses_the_quantity(spark, shop):
    batch = run(spark, shop, [ask(1, 2, 8)])
    assert outcomes(batch) == {1: "accepted"}
    assert sorted(rows(batch.inventory, "inventory_id", "stock"))[1:3] == [(2, 2), (3, -5)]


def test_requests_that_cannot_be_matched(spark, shop):
    batch = run(
        spark,
        shop,
        [
            ask(1, 1, 1, order=500),
            ask(2, 1, 1, customer=9),
            ask(3, 1, 1, seller=9),
            ask(4, 1, 1, customer=None, seller=None),
            ask(5, 1, None),
            ask(6, 42, 1),
            ask(7, 3, 1),
            ask(8, 77, 1),
            ask(9, None, 1),
            ask(10, 1, 1, order=9000),
            ask(11, 1, 1, order=9000),
            (12, None, None, 1, 1, 1, 1),
            (13, None, None, 1, 1, 1, 1),
        ],
    )
    assert outcomes(batch) == {
        1: "taken_order_id",
        2: "unknown_customer",
        3: "unknown_seller",
        4: "accepted",  # references may be NULL
        5: "not_enough_stock",
        6: "not_enough_stock",
        7: "not_enough_stock",
        8: "unknown_product",
        9: "not_enough_stock",
        10: "accepted",
        11: "repeated_order_id",
        12: "missing_order_id",
        13: "missing_order_id",
    }


def test_item_ids_are_checked_on_request(spark, shop, make):
    items = make("order_items", (7, 500, 1, 1, 1, 1))
    requests = [(1, 1001, 7, 1, 1, 1, 1), (2, 1002, 8, 1, 1, 1, 1), (3, 1003, 8, 1, 1, 1, 1)]
    assert outcomes(run(spark, shop, requests, items=items)) == {1: "taken_order_item_id", 2: "accepted", 3: "repeated_order_item_id"}
    assert set(outcomes(run(spark, shop, requests)).values()) == {"accepted"}


def test_quantity_below_one(spark, shop):
    requests = [ask(1, 1, 5), ask(2, 1, -2), ask(3, 1, 2), ask(4, 1, 0), ask(5, 1, 1)]
    assert outcomes(run(spark, shop, requests)) == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "not_enough_stock"}
    strict = outcomes(run(spark, shop, requests, strict=True))
    assert strict == {1: "accepted", 2: "invalid_quantity", 3: "not_enough_stock", 4: "invalid_quantity", 5: "not_enough_stock"}


def test_no_requests(spark, shop):
    batch = run(spark, shop, [])
    assert rows(batch.outcomes) == [] and rows(batch.orders) == []
    assert sorted(rows(batch.inventory), key=repr) == sorted(rows(shop["inventory"]), key=repr)


def one_after_the_other(requests, stock):
    left, got = dict(stock), {}
    for seq, _, _, _, _, product, quantity in sorted(requests):
        fits = product in left and quantity <= left[product]
        if fits:
            left[product] -= quantity
        got[seq] = "accepted" if fits else "not_enough_stock"
    return got, left


def test_repeated_dimension_rows_change_nothing(spark, shop):
    twice = {name: shop[name].unionByName(shop[name]) for name in ("customers", "sellers", "products", "orders")}
    batch = run(spark, {**shop, **twice}, [ask(1, 1, 2), ask(2, 1, 1, order=500)])
    assert outcomes(batch) == {1: "accepted", 2: "taken_order_id"}
    assert batch.outcomes.count() == 2 and batch.items.count() == 1
    assert dict(rows(batch.inventory, "inventory_id", "stock"))[1] == 3


def test_lowest_price_of_a_repeated_product_counts(spark, shop, make):
    products = shop["products"].unionByName(make("products", (1, "again", 3, 1, 1)))
    batch = run(spark, {**shop, "products": products}, [ask(1, 1, 2)])
    assert [str(r[0]) for r in rows(batch.items, "price_per_unit")] == ["3.00"]


@pytest.mark.parametrize("stock, restock", [(50, 0), (5_000, 0), (20_000, 0), (50, 0.1)])
def test_hot_product_goes_by_slices(spark, make, stock, restock):
    """No task decides a hot product's requests in turn; each slice gets a bounded share."""
    rng = random.Random(stock)
    requests = [
        (i, i + 1, i + 1, 1, 1, 1, -rng.randint(1, 5) if rng.random() < restock else rng.randint(1, 5)) for i in range(20_000)
    ]
    shop = {
        "customers": make("customers", (1, "a", "b", "s", "x")),
        "sellers": make("sellers", (1, "s", "UK")),
        "products": make("products", (1, "p", 1, 1, 1)),
        "orders": make("orders", (500_000, "2024-01-01", 1, 1, "Completed")),
        "inventory": make("inventory", (1, 1, stock, 1, None)),
    }
    batch = run(spark, shop, requests, most_in_turn=1_000, slice_rows=64)
    want, left = one_after_the_other(requests, {1: stock})
    assert outcomes(batch) == want
    assert dict(rows(batch.inventory, "product_id", "stock")) == left


def test_a_million_contested_requests_of_one_product(spark):
    """Equal to the sequential fold, by slices of a bounded size and a tree of groups of ``FAN``."""
    number = 1_000_000
    quantity = (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("int")
    kept = [F.lit(1).cast("long").alias(c) for c in ("order_id", "order_item_id", "customer_id", "seller_id")]
    requests = spark.range(number).select(
        F.col("id").alias("seq"),
        *kept,
        F.when(F.col("id") % 50 == 7, 2).otherwise(1).cast("long").alias("product_id"),
        quantity.alias("quantity"),
        F.lit(None).cast("decimal(18,2)").alias("price"),
        F.lit(None).cast("string").alias("outcome"),
        F.when(F.col("id") % 50 == 7, 90_000).otherwise(11_000_000).cast("int").alias("available"),
    )
    decided = sale_batch._decide_by_slices(requests, 4_096)
    got = decided.select("seq", "product_id", "quantity", "outcome").toPandas().sort_values("seq")
    assert len(got) == number
    for product, stock in ((1, 11_000_000), (2, 90_000)):
        mine = got[got["product_id"] == product]
        left, want = stock, []
        for q in mine["quantity"].tolist():
            want.append(q <= left)
            left -= q if want[-1] else 0
        assert ((mine["outcome"] == "accepted") == want).all() and 0 < sum(want) < len(want)


def test_slices_have_a_bounded_size(spark):
    rows_ = spark.range(30_000).select(
        (F.col("id") % 3 % 2).alias("product_id"), F.col("id").alias("seq"), F.lit(-1).alias("quantity"), F.lit(9).alias("available")
    )
    ordered = rows_.repartitionByRange(5, "product_id", "seq").sortWithinPartitions("product_id", "seq")
    cells = "array<struct<product_id: long, seq: long, quantity: int>>"
    cut = sale_batch._cut(["product_id", "seq", "quantity"], 700)
    columns = f"key long, part int, k long, available long, taken long, added long, largest long, requests {cells}"
    slices = numbered_runs(ordered.mapInArrow(cut, columns))
    sizes = slices.select("key", "place", F.size("requests").alias("n"), F.col("requests")[0].seq.alias("first")).collect()
    assert max(r.n for r in sizes) <= 700 and sum(r.n for r in sizes) == 30_000
    for key in (0, 1):
        mine = sorted(r for r in sizes if r.key == key)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert [r.first for r in mine] == sorted(r.first for r in mine)


def test_runs_are_computed_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for pdf in batches:
            computed.add(len(pdf))
            yield pdf

    runs = spark.range(20).select(
        F.lit(1).cast("long").alias("key"), F.floor(F.col("id") / 5).cast("int").alias("part"), (F.col("id") % 5).alias("k"), "id"
    )
    got = numbered_runs(runs.mapInPandas(counting, runs.schema)).collect()
    assert sorted((r.place, r.id) for r in got) == [(i, i) for i in range(20)]
    assert computed.value == 20


@pytest.mark.parametrize("most_in_turn", [20_000, 5])
@pytest.mark.parametrize("lowest", [1, 0, -3])
@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_sequential_model(spark, make, lowest, partitions, most_in_turn):
    rng = random.Random(lowest)
    stock = {1: 60, 2: 15, 3: 0, 4: 4000, 5: -2, 6: 7}
    # Product 1 gets about half of the requests; product 4 has room for all.
    requests = [
        ask(seq, rng.choice([1, 1, 1, 1, 1, 2, 3, 4, 5, 6]), rng.randint(lowest, rng.choice([3, 12])), order=seq)
        for seq in rng.sample(range(100_000), 900)
    ]
    inventory = make("inventory", *[(p, p, s, 1, None) for p, s in stock.items()])
    shop = {
        "customers": make("customers", (1, "a", "b", "s", "x")),
        "sellers": make("sellers", (1, "s", "UK")),
        "products": make("products", *[(p, f"p{p}", 1, 1, 1) for p in stock]),
        "orders": make("orders", (500_000, "2024-01-01", 1, 1, "Completed")),
        "inventory": inventory.repartition(partitions),
    }
    batch = run(spark, shop, requests, most_in_turn=most_in_turn, slice_rows=7)
    want, left = one_after_the_other(requests, stock)
    assert outcomes(batch) == want
    assert dict(rows(batch.inventory, "product_id", "stock")) == left
    assert batch.items.count() == sum(v == "accepted" for v in want.values())


def _shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


@pytest.mark.parametrize("most_in_turn", [20_000, 100])
def test_a_batch_leaves_its_result_on_disk_and_nothing_else(spark, shop, most_in_turn):
    """Tables between and the files of their shuffles go while it runs."""
    requests = [ask(i, i % 2 + 1, 1, order=i // 2 * 2) for i in range(1_000)]
    before, tables = _shuffle_bytes(spark), len(session._written)

    def left():
        return sum(n for name, n in _shuffle_bytes(spark).items() if name not in before)

    batch = run(spark, shop, requests, most_in_turn=most_in_turn)
    until = time.time() + 20
    while left() > 2_000 and time.time() < until:  # they go beside the work
        time.sleep(0.2)
    assert left() <= 2_000  # of the driver's own questions, a row each
    assert len(session._written) - tables <= 6  # a table of the screened and one or two of the decided, small lookups
    assert sum(v == "repeated_order_id" for v in outcomes(batch).values()) == 499


def test_requests_that_go_a_part_at_a_time(spark, shop, make, monkeypatch):
    rng = random.Random(7)
    requests = [
        (i if i % 50 else None, rng.choice([None, 500, *range(300)]), rng.choice([None, 7, *range(300)]), rng.choice([None, 1, 9]), rng.choice([None, 1, 9]), rng.choice([None, 1, 2, 3, 42]), rng.choice([None, 1, 2]))
        for i in range(400)
    ]
    items = make("order_items", (7, 500, 1, 1, 1, 1))
    inventory = make("inventory", (1, 1, 20, 1, None), (2, 2, 15, 1, None), (3, 42, 9, 1, None))

    def decided():
        return sorted(rows(run(spark, {**shop, "inventory": inventory}, requests, items=items).outcomes), key=repr)

    whole = decided()
    assert len({r[-1] for r in whole}) == 10
    written_ = len(session._written)
    monkeypatch.setattr(sale_batch, "ROWS_A_GO", 100)
    assert decided() == whole
    assert len(session._written) > written_
