"""Sales decided in the state store against one batch of all requests."""

from __future__ import annotations

import random
from datetime import date

import pytest

from tallyloom.operators.sale_batch import apply_sales
from tallyloom.streaming.sale_state import STATE_STORE, decide_sales, inventory_after, start_sales
from tests.conftest import rows
from tests.test_sale_batch import REQUEST, ask


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    yield spark
    spark.conf.set(name, before)


@pytest.fixture
def shop(make):
    return {
        "customers": make("customers", (1, "a", "b", "s", "x"), (1, "a", "b", "s", "x")),
        "sellers": make("sellers", (1, "s", "UK")),
        "products": make("products", (1, "ball", "9.99", 1, 1), (2, "bat", 5, 1, 1), (3, "net", 7, 1, 1)),
        "orders": make("orders", (500, "2024-01-01", 1, 1, "Completed")),
        "items": make("order_items", (501, 500, 1, 1, 1, 1)),
        "inventory": make("inventory", (1, 1, 60, 1, None), (2, 2, 10, 1, None), (3, 2, 3, 2, None), (4, 77, 9, 1, None), (5, 3, None, 1, None)),
    }


class Stream:
    """Feeds files of requests to a query that is started anew each time."""

    def __init__(self, spark, shop, folder, **options):
        self.spark, self.shop, self.folder, self.options = spark, shop, folder, options

    def feed(self, *files):
        for requests in files:
            frame = self.spark.createDataFrame(requests, REQUEST).coalesce(1)
            frame.write.mode("append").parquet(f"{self.folder}/in")
        return self.run()

    def run(self):
        asked = self.spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        decided = decide_sales(asked, **self.shop, **self.options)
        query = start_sales(decided, f"{self.folder}/out", f"{self.folder}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None
        return query

    def decided(self):
        return self.spark.read.parquet(f"{self.folder}/out")


def random_requests(rng, first, count):
    out = []
    for seq in range(first, first + count):
        order = rng.choice([10_000 + seq, 10_000 + seq, 10_000 + seq, 10_000 + rng.randrange(seq + 1), 500, None])
        item = rng.choice([90_000 + seq] * 5 + [501, 90_000 + rng.randrange(seq + 1), None])
        customer, seller = rng.choice([1] * 9 + [7, None]), rng.choice([1] * 9 + [8, None])
        quantity = rng.choice([1, 2, 3, 4, 5, 9, 0, -2, None])
        out.append((seq, order, item, customer, seller, rng.choice([1, 1, 1, 1, 2, 2, 3, 77, 42, None]), quantity))
    return out


def test_restarts_and_micro_batches_equal_one_batch(rocks, shop, tmp_path):
    rng = random.Random(5)
    stream = Stream(rocks, shop, str(tmp_path))
    everything = []
    for goes in ((40,), (30, 50), (60,)):
        files = []
        for count in goes:
            files.append(random_requests(rng, len(everything), count))
            everything += files[-1]
        stream.feed(*files)
    batch = apply_sales(rocks.createDataFrame(everything, REQUEST), **shop, as_of=date(2024, 8, 1))
    want = sorted(rows(batch.outcomes, "seq", "order_id", "product_id", "quantity", "outcome"), key=repr)
    assert sorted(rows(stream.decided(), "seq", "order_id", "product_id", "quantity", "outcome"), key=repr) == want
    assert {"accepted", "not_enough_stock", "taken_order_id", "repeated_order_id", "missing_order_item_id"} <= {r[-1] for r in want}
    after = rows(inventory_after(stream.decided(), shop["inventory"]), "inventory_id", "stock")
    assert sorted(after) == sorted(rows(batch.inventory, "inventory_id", "stock"))
    prices = {r[0]: r[1] for r in rows(batch.items, "order_item_id", "price_per_unit")}
    got = stream.decided().filter("outcome = 'accepted'")
    assert {r[0]: r[1] for r in rows(got, "order_item_id", "price")} == prices


def test_nothing_new_changes_nothing_and_a_lost_commit_is_replayed(rocks, shop, tmp_path):
    stream = Stream(rocks, shop, str(tmp_path))
    stream.feed([ask(1, 1, 50), ask(2, 1, 20)])
    stream.run()
    first = sorted(rows(stream.decided(), "seq", "outcome"))
    assert first == [(1, "accepted"), (2, "not_enough_stock")]
    # The last micro-batch ended, but its commit was not recorded: it runs once more, over the same state.
    commits = sorted((p for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (tmp_path / "checkpoint" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    stream.run()
    assert sorted(rows(stream.decided(), "seq", "outcome")) == first
    stream.feed([ask(3, 1, 10), ask(4, 1, 1)])
    assert sorted(rows(stream.decided(), "seq", "outcome"))[2:] == [(3, "accepted"), (4, "not_enough_stock")]


def test_a_micro_batch_touches_only_the_keys_it_names(rocks, shop, tmp_path):
    stream = Stream(rocks, shop, str(tmp_path))
    stream.feed([ask(i, 1 + i % 2, 1) for i in range(400)])
    stream.feed([ask(1000, 1, 1)])
    query = stream.feed([ask(1001, 2, 1), ask(1002, 2, 1)])
    # Two ids each of orders and items, one product; the history is neither read nor written.
    states = [p for p in query.recentProgress if p["numInputRows"]][-1]["stateOperators"]
    assert sorted(s["numRowsUpdated"] for s in states) == [1, 2, 2]
    assert max(s["numRowsTotal"] for s in states) >= 400
    plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString() if hasattr(query._jsq, "streamingQuery") else ""
    assert f"{tmp_path}/out" not in plan


def test_strict_refuses_quantities_below_one(rocks, shop, tmp_path):
    stream = Stream(rocks, shop, str(tmp_path), strict=True)
    stream.feed([ask(1, 1, 0), ask(2, 1, -3), ask(3, 1, 61), ask(4, 1, 60)])
    assert sorted(rows(stream.decided(), "seq", "outcome")) == [
        (1, "invalid_quantity"),
        (2, "invalid_quantity"),
        (3, "not_enough_stock"),
        (4, "accepted"),
    ]
