"""Sale requests decided as they arrive, with ids and stock kept in the state store.

A micro-batch touches the ids and products that it names and nothing else: no history of
orders is read and no inventory is rewritten, so its cost does not grow with what came
before. Orders, order lines and stock as they are at the start become the first state; after
a restart the checkpoint goes on where it was, and a micro-batch that runs again after a
failure finds the state that it found before.

Over the whole stream the outcomes are those of ``apply_sales`` for all requests as one
batch, if every micro-batch follows the one before in ``seq``: an id belongs to the first
request that has it, whatever becomes of that request.

The rows of one product (and of one id) in one micro-batch are decided together; limit a
micro-batch at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). Requests that
cannot be decided by a product's stock are spread over ``SPREAD`` groups without state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyloom.functions.stock import sold
from tallyloom.model import MONEY
from tallyloom.operators.sale_batch import ACCEPTED, NO_STOCK

SPREAD = 64

_REQUEST = (
    "seq long, order_id long, order_item_id long, customer_id long, seller_id long, product_id long, quantity int"
)
_DECIDED = f"{_REQUEST}, price decimal(18,2), outcome string, stock_left long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _key(column: str, undecided: Column) -> Column:
    """The column's value as text; rows that need no state are spread over keys of their own."""
    without_state = F.concat(F.lit("none "), F.pmod(F.xxhash64("seq"), F.lit(SPREAD)).cast("string"))
    return F.when(undecided & F.col(column).isNotNull(), F.col(column).cast("string")).otherwise(without_state)


class _FirstUse(StatefulProcessor):
    """Gives ``outcome`` to requests whose id is taken, or was asked for before, be it by a refused request."""

    def __init__(self, column: str):
        self.column = column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "taken boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.used.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith("none "):
            yield from (part.drop(columns="key") for part in rows)
            return
        asked = pd.concat(list(rows)).sort_values("seq").drop(columns="key")
        taken = f"taken_{self.column}" if self.used.exists() and self.used.get()[0] else None
        found = [taken or f"repeated_{self.column}"] * len(asked)
        if not self.used.exists():
            self.used.update((False,))
            found[0] = None
        yield asked.assign(outcome=[a if isinstance(a, str) else b for a, b in zip(asked["outcome"], found)])

    def close(self) -> None:
        pass


class _Stock(StatefulProcessor):
    """Decides a product's open requests in turn and keeps the stock left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "stock long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.left.update((int(initialState["available"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith("none "):
            for part in rows:
                yield _decided(part.assign(outcome=part["outcome"].where(part["outcome"].notna(), NO_STOCK)), None)
            return
        asked = pd.concat(list(rows)).sort_values("seq")
        if not self.left.exists():
            yield _decided(asked.assign(outcome=NO_STOCK), None)
            return
        (left,) = self.left.get()
        if asked["listed"].isna().iloc[0]:
            yield _decided(asked.assign(outcome="unknown_product"), left)
            return
        accepted, left = sold(asked["quantity"].to_numpy("int64"), left)
        self.left.update((left,))
        yield _decided(asked.assign(outcome=[ACCEPTED if a else NO_STOCK for a in accepted]), left)

    def close(self) -> None:
        pass


def _decided(rows: pd.DataFrame, left: int | None) -> pd.DataFrame:
    names = [column.split(" ")[0] for column in _DECIDED.split(", ")]
    return rows.assign(stock_left=pd.Series([left] * len(rows), index=rows.index, dtype="Int64"))[names]


def decide_sales(
    requests: DataFrame,
    customers: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    inventory: DataFrame,
    orders: DataFrame,
    items: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """A streaming frame of decided requests: the request, price, outcome, and its product's stock after the micro-batch.

    ``requests`` streams; the other tables say how things stand before the first request.
    The session needs the RocksDB state store (``STATE_STORE``).
    """
    with_errors = f"{_REQUEST}, outcome string"
    asked = requests.select(*(c.split(" ")[0] for c in _REQUEST.split(", "))).withColumn("outcome", F.lit(None).cast("string"))
    for column, table in {"order_id": orders, "order_item_id": items}.items():
        if table is None:
            continue
        missing = F.when(F.col("outcome").isNull() & F.col(column).isNull(), f"missing_{column}").otherwise(F.col("outcome"))
        taken = table.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("key")).distinct()
        keyed = asked.withColumn("outcome", missing).withColumn("key", _key(column, F.lit(True)))
        asked = keyed.groupBy("key").transformWithStateInPandas(
            _FirstUse(column), with_errors, "Append", "None", initialState=taken.groupBy("key")
        )
    for column, table in {"customer_id": customers, "seller_id": sellers}.items():
        known = table.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("known", F.lit(True))
        unknown = F.when(
            F.col("outcome").isNull() & F.col(column).isNotNull() & F.col("known").isNull(), f"unknown_{column.removesuffix('_id')}"
        ).otherwise(F.col("outcome"))
        asked = asked.join(known, column, "left").withColumn("outcome", unknown).drop("known")
    if strict:
        invalid = F.col("outcome").isNull() & (F.col("quantity") < 1)
        asked = asked.withColumn("outcome", F.when(invalid, "invalid_quantity").otherwise(F.col("outcome")))
    prices = products.groupBy("product_id").agg(F.min("price").cast(MONEY).alias("price")).withColumn("listed", F.lit(True))
    stock = (
        inventory.filter(F.col("product_id").isNotNull())
        .groupBy(F.col("product_id").cast("string").alias("key"))
        .agg(F.max("stock").cast("long").alias("available"))
        .filter(F.col("available").isNotNull())
    )
    open_ = F.col("outcome").isNull() & F.col("quantity").isNotNull()
    return (
        asked.join(prices, "product_id", "left")
        .withColumn("key", _key("product_id", open_))
        .groupBy("key")
        .transformWithStateInPandas(_Stock(), _DECIDED, "Append", "None", initialState=stock.groupBy("key"))
    )


def start_sales(decided: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the decisions of all requests that are there to a Parquet table."""
    return (
        decided.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def inventory_after(decided: DataFrame, inventory: DataFrame) -> DataFrame:
    """The inventory less what the decisions so far took: every row of a product loses it."""
    used = (
        decided.filter(F.col("outcome") == ACCEPTED).groupBy("product_id").agg(F.sum("quantity").alias("used"))
    )
    left = (F.col("stock") - F.coalesce("used", F.lit(0))).cast(inventory.schema["stock"].dataType)
    return inventory.join(used, "product_id", "left").withColumn("stock", left).select(*inventory.columns)
