"""A batch of sale requests applied to orders, order lines and inventory.

Requests compete in the order of ``seq``. One is accepted if some inventory
row of its product still holds the quantity; then every inventory row of the
product loses it. A request that is turned down takes nothing, so a running
sum cannot decide: the outcome needs a pass in turn per product.

* Requests are folded per product first. Products whose whole demand fits, or that
  have no stock or price, need no pass: their requests share one outcome.
* A product with at most ``MOST_IN_TURN`` requests is passed in one task, which
  streams over sorted rows and keeps one number per product.
* A product with more is sorted by all tasks together and cut into slices of at
  most ``SLICE_ROWS`` requests, as many as it needs. Running sums say what a slice
  finds if nothing was refused before it. For that stock, and for all the small
  ones that a refusal can leave, a slice works out what it does to them
  (``functions/stock.py``); these effects are composed in a balanced tree
  (``functions/scan.py``), which tells every slice the stock it really finds.

Lookups are made distinct first: a customer, seller, order or item listed twice
is one, of a product listed twice the lowest price counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.joins import spread_lookup
from tallyloom.functions.scan import exclusive_scan, numbered_runs
from tallyloom.functions.stock import act_packed, compose_packed, effect_of, sold
from tallyloom.model import IN_PROGRESS, MONEY
from tallyloom.session import cut_lineage, written

ACCEPTED, NO_STOCK = "accepted", "not_enough_stock"

#: Contested requests of one product that one task decides in turn.
MOST_IN_TURN = 20_000
#: Requests of one slice of a product that has more.
SLICE_ROWS = 4_096
#: Requests that are shuffled at a time, unless that takes more than ``GOES`` goes.
ROWS_A_GO = 4_000_000
GOES = 4

_REQUEST = ["seq", "order_id", "order_item_id", "customer_id", "seller_id", "product_id", "quantity"]


@dataclass(frozen=True)
class SaleBatch:
    """What a batch of requests leads to."""

    outcomes: DataFrame  # one row per request
    orders: DataFrame  # rows to add to orders
    items: DataFrame  # rows to add to order_items
    inventory: DataFrame  # inventory afterwards


def apply_sales(
    requests: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    inventory: DataFrame,
    orders: DataFrame,
    as_of: date,
    items: DataFrame | None = None,
    strict: bool = False,
    most_in_turn: int = MOST_IN_TURN,
    slice_rows: int = SLICE_ROWS,
) -> SaleBatch:
    """Decide every request and derive the rows to write.

    ``requests`` has seq (a unique number), order_id, order_item_id,
    customer_id, seller_id, product_id and quantity. A request with a taken or
    repeated order id, or an unknown customer or seller, writes nothing; of
    requests that share an id, the first competes. ``items`` extends the
    id check to order_item_id. A quantity below one is not refused unless
    ``strict``: it adds to the stock.
    """
    taken = {"order_id": orders} | ({} if items is None else {"order_item_id": items})
    requests = requests.select(*_REQUEST)
    screened = _screen(requests, taken, customers, sellers, strict)
    decided = _decide(screened, products, inventory, most_in_turn, slice_rows)
    accepted = decided.filter(F.col("outcome") == ACCEPTED)

    used = accepted.groupBy("product_id").agg(F.sum("quantity").alias("used"))
    slot = F.pmod(F.xxhash64("inventory_id"), F.lit(64))
    left = (F.col("stock") - F.coalesce(F.col("used"), F.lit(0))).cast(inventory.schema["stock"].dataType)
    return SaleBatch(
        outcomes=decided.select("seq", "order_id", "product_id", "quantity", "outcome"),
        orders=accepted.select(
            "order_id", F.lit(as_of).alias("order_date"), "customer_id", "seller_id", F.lit(IN_PROGRESS).alias("order_status")
        ),
        items=accepted.select(
            "order_item_id",
            "order_id",
            "product_id",
            "quantity",
            F.col("price").alias("price_per_unit"),
            (F.col("quantity") * F.col("price")).cast(MONEY).alias("total_sale"),
        ),
        inventory=spread_lookup(inventory, used, "product_id", slot)
        .withColumn("stock", left)
        .select(*inventory.columns),
    )


def _written(*frames: DataFrame, since: int | None = None) -> DataFrame:
    """Tables of requests are the most that a batch has on disk."""
    return cut_lineage(*frames, since=since, compression="zstd")


def _looked_up(
    df: DataFrame, lookup: DataFrame, key: str, step: Callable[[DataFrame, DataFrame], DataFrame], since: int
) -> DataFrame:
    """``step`` on both, those of some keys at a time: what it shuffles is never there as a whole."""
    # A session without a folder has written nothing, and would compute the rows to count them.
    goes = min(GOES, 1 + df.count() // ROWS_A_GO) if written() > since else 1
    part = F.pmod(F.xxhash64(key), F.lit(goes))
    parts = [step(df.filter(part == i), lookup.filter(part == i)) for i in range(goes)] if goes > 1 else [step(df, lookup)]
    return _written(*parts, since=since)


def _screen(
    requests: DataFrame, taken: dict[str, DataFrame], customers: DataFrame, sellers: DataFrame, strict: bool
) -> DataFrame:
    """Adds ``error``: why a request may not compete, or NULL.

    Only ids that something is wrong with are looked up, and requests are written after
    each look: at no time does more than one shuffle of them lie on disk.
    """
    since = written()
    df = _written(requests.withColumn("error", F.lit(None).cast("string")))
    for key, table in taken.items():
        wrong = _written(_wrong_ids(df, key, table))
        first = F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))
        error = (
            F.when(F.col(key).isNull(), f"missing_{key}")
            .when(F.col("_taken"), f"taken_{key}")
            .when(F.col("_taken").isNotNull() & ~first, f"repeated_{key}")
        )
        df = _looked_up(df, wrong, key, lambda rows, ids: _with_error(rows.join(ids, key, "left"), error), since)
    for key, table in {"customer_id": customers, "seller_id": sellers}.items():
        unknown = df.select(key).filter(F.col(key).isNotNull()).distinct().join(table.select(key), key, "left_anti")
        unknown = _written(unknown.withColumn("_unknown", F.lit(True)))
        if not unknown.isEmpty():
            error = F.when(F.col("_unknown"), f"unknown_{key.removesuffix('_id')}")
            df = _looked_up(df, unknown, key, lambda rows, ids: _with_error(rows.join(ids, key, "left"), error), since)
    return _with_error(df, F.when(F.col("quantity") < 1, "invalid_quantity")) if strict else df


def _with_error(df: DataFrame, error: Column) -> DataFrame:
    return df.select(*_REQUEST, F.coalesce("error", error).alias("error"))


def _wrong_ids(requests: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, _first, _taken) of ids that ``table`` has or more than one request: the first request's seq."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    return (
        requests.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .join(known, key, "left")
        .filter(F.col("_known").isNotNull() | (F.col("_n") > 1) | F.col("_first").isNull())
        .select(key, "_first", F.col("_known").isNotNull().alias("_taken"))
    )


def _decide(
    screened: DataFrame, products: DataFrame, inventory: DataFrame, most_in_turn: int, slice_rows: int
) -> DataFrame:
    """Adds ``price`` and ``outcome`` to screened requests."""
    kept = [*_REQUEST, "price", "outcome"]
    quantity = F.col("quantity")
    can_sell = F.col("error").isNull() & F.col("product_id").isNotNull() & quantity.isNotNull()
    settled = screened.filter(~can_sell).select(
        *_REQUEST, F.lit(None).cast(MONEY).alias("price"), F.coalesce("error", F.lit(NO_STOCK)).alias("outcome")
    )
    open_ = screened.filter(can_sell).select(*_REQUEST)

    stock = inventory.groupBy("product_id").agg(F.max("stock").alias("available"))
    prices = products.groupBy("product_id").agg(F.min("price").alias("price")).withColumn("listed", F.lit(True))
    available = F.col("available")
    fate = (
        F.when(available.isNull(), F.lit(NO_STOCK))
        .when(F.col("listed").isNull(), F.lit("unknown_product"))
        .when((available >= 0) & (F.col("wanted") <= available), F.lit(ACCEPTED))
    )
    since = written()
    offers = _written(
        open_.groupBy("product_id")
        .agg(F.sum(F.greatest(quantity, F.lit(0))).alias("wanted"), F.count(F.lit(1)).alias("requests"))
        .join(stock, "product_id", "left")
        .join(prices, "product_id", "left")
        .select("product_id", "available", "price", fate.alias("outcome"), (F.col("requests") > most_in_turn).alias("many"))
    )
    many = offers.filter("many")

    def passed(rows: DataFrame, lookup: DataFrame) -> DataFrame:
        return _in_turn(rows.join(lookup, "product_id")).select(*kept)

    if many.isEmpty():
        return settled.unionByName(_looked_up(open_, offers, "product_id", passed, since))
    # One in ``most_in_turn`` requests has such a product at most.
    offered = open_.join(F.broadcast(many), "product_id")
    hot = offered.filter(F.col("outcome").isNull()).select(*kept, "available")
    by_slices = _written(
        offered.filter(F.col("outcome").isNotNull()).select(*kept).unionByName(_decide_by_slices(hot, slice_rows).select(*kept)),
        since=since + 1,
    )
    others = open_.join(F.broadcast(many.select("product_id")), "product_id", "left_anti")
    rest = _looked_up(others, offers.filter(~F.col("many")), "product_id", passed, since + 2)
    return settled.unionByName(by_slices).unionByName(rest)


def _in_turn(offered: DataFrame) -> DataFrame:
    """Decides the requests without an outcome, each product in one task."""
    # The window asks for a product's rows together and in turn; the join may have dealt them so already.
    turn = F.row_number().over(W.partitionBy("product_id").orderBy("seq"))
    rows = offered.select(*_REQUEST, "price", "outcome", "available", turn.alias("turn"))
    schema = T.StructType([*rows.schema.fields, T.StructField("sold", T.BooleanType())])
    sold_ = F.when(F.col("sold"), ACCEPTED).otherwise(NO_STOCK)
    return rows.mapInArrow(_selling_in_turn(), schema).withColumn("outcome", F.coalesce("outcome", sold_))


def _decide_by_slices(requests: DataFrame, slice_rows: int) -> DataFrame:
    """Decides requests of products that have very many; no group has more than ``slice_rows`` of them."""
    ordered = requests.repartitionByRange("product_id", "seq").sortWithinPartitions("product_id", "seq")
    columns = requests.drop("available").schema
    cells = f"array<{columns.simpleString()}>"
    slices = numbered_runs(
        ordered.mapInArrow(
            _cut(columns.names, slice_rows),
            f"key long, part int, k long, available long, taken long, added long, largest long, requests {cells}",
        )
    )
    small = _written(slices.drop("requests"))
    products = small.groupBy("key").agg(
        F.first("available").alias("state"), F.sum("added").alias("added"), F.max("largest").alias("largest")
    )
    # No stock that a refusal leaves, with all that is added, reaches the limit.
    limits = products.select(
        "key", (F.least("largest", F.greatest("state", F.lit(0))) + F.col("added") + 1).alias("limit")
    )
    running = small.select("key", "place", F.encode(F.col("taken").cast("string"), "UTF-8").alias("effect"))
    tracks = exclusive_scan(running, products, _sum_of, _taken_from).withColumnRenamed("state", "track").join(limits, "key")
    quantities = slices.select("key", "place", F.col("requests.quantity").alias("quantities"))
    effects = quantities.join(tracks, ["key", "place"]).mapInArrow(_effects(), "key long, place long, effect binary")
    found = exclusive_scan(effects, products, compose_packed, act_packed).withColumnRenamed("state", "found")
    decided = T.StructType([*columns.fields, T.StructField("sold", T.BooleanType())])
    return (
        slices.join(found, ["key", "place"])
        .select("requests", "found")
        .mapInArrow(_selling_in_slices(), decided)
        .withColumn("outcome", F.when(F.col("sold"), ACCEPTED).otherwise(NO_STOCK))
    )


def _sum_of(effects: Sequence[bytes]) -> bytes:
    """What several slices take together, as text."""
    return str(sum(map(int, effects))).encode()


def _taken_from(effect: bytes, stock: int) -> int:
    return stock - int(effect)


def _cut(columns: list[str], slice_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by product and turn as slices of one product."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            products = batch.column("product_id").to_numpy()
            quantities = batch.column("quantity").to_numpy().astype(np.int64)
            changes = [0, *(np.flatnonzero(products[1:] != products[:-1]) + 1).tolist(), len(products)]
            starts = [at for low, high in zip(changes, changes[1:]) for at in range(low, high, slice_rows)]
            numbers = []
            for at in starts:
                k = k + 1 if products[at] == current else 0
                current = products[at]
                numbers.append(k)
            rows = pa.StructArray.from_arrays([batch.column(c) for c in columns], columns)
            bounds = pa.array([*starts, len(products)], pa.int32())
            arrays = {
                "key": pa.array(products[starts]),
                "part": pa.array([part] * len(starts), pa.int32()),
                "k": pa.array(numbers, pa.int64()),
                "available": batch.column("available").take(pa.array(starts)).cast(pa.int64()),
                "taken": pa.array(np.add.reduceat(quantities, starts)),
                "added": pa.array(np.add.reduceat(-np.minimum(quantities, 0), starts)),
                "largest": pa.array(np.maximum.reduceat(np.maximum(quantities, 0), starts)),
                "requests": pa.ListArray.from_arrays(bounds, rows),
            }
            yield pa.RecordBatch.from_pydict(arrays)

    return cut


def _effects() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                effect_of(_whole(batch.column("quantities")[at].values), batch.column("track")[at].as_py(), batch.column("limit")[at].as_py()).pack()
                for at in range(batch.num_rows)
            ]
            columns = [batch.column("key"), batch.column("place"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "effect"])

    return effects


def _whole(quantities: pa.Array) -> np.ndarray:
    return quantities.to_numpy(zero_copy_only=False).astype(np.int64)


def _selling_in_slices() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The requests of each slice with ``sold``, from the stock that the slice finds."""

    def sell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = batch.column("requests")[at].values
                accepted, _ = sold(_whole(rows.field("quantity")), batch.column("found")[at].as_py())
                names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(accepted)], names=[*names, "sold"])

    return sell


def _selling_in_turn() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``sold`` to rows sorted by product and turn; keeps the stock left between batches.

    Rows that have an outcome take nothing.
    """

    def sell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            products = batch.column("product_id").to_numpy()
            stock = batch.column("available").fill_null(0).to_numpy()
            quantities = batch.column("quantity").to_numpy().astype(np.int64)
            open_ = batch.column("outcome").is_null().to_numpy(zero_copy_only=False)
            accepted = np.zeros(len(products), bool)
            changes = [0, *(np.flatnonzero(products[1:] != products[:-1]) + 1).tolist(), len(products)]
            for low, high in zip(changes, changes[1:]):
                if products[low] != current:
                    current, left = products[low], int(stock[low])
                if open_[low]:  # a product's rows share what is known of them
                    accepted[low:high], left = sold(quantities[low:high], left)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted)], names=[*batch.schema.names, "sold"])

    return sell
