"""Sale requests applied as they arrive, one micro-batch after the other."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom.model import TABLES
from tallyloom.operators.sale_batch import apply_sales
from tallyloom.session import intermediates


@dataclass(frozen=True)
class SaleStore:
    """Tables that sales change, kept per micro-batch in a shared folder.

    A batch reads what earlier batches wrote and writes under its own number.
    A batch that runs again after a failure overwrites itself, so each request
    counts once. A batch whose number does not follow the store's latest is
    refused: a new checkpoint folder over an old store would start again at 0
    and replace earlier sales.
    """

    spark: SparkSession
    folder: str

    def _read(self, table: str, path: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table].schema).parquet(path)

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def start(self, orders: DataFrame, inventory: DataFrame, items: DataFrame | None = None) -> None:
        """Stores the tables as they are before the first request; without ``items`` there are none yet."""
        orders.select(*TABLES["orders"].column_names).write.parquet(self._path("orders", -1))
        known = self.spark.createDataFrame([], TABLES["order_items"].schema) if items is None else items
        known.select(*TABLES["order_items"].column_names).write.parquet(self._path("order_items", -1))
        inventory.select(*TABLES["inventory"].column_names).write.parquet(self._path("inventory", -1))

    def orders(self, before: int) -> DataFrame:
        """Orders written before batch ``before``."""
        everything = self._read_batches("orders")
        return everything.filter(everything["batch"] < before).drop("batch")

    def _read_batches(self, table: str) -> DataFrame:
        schema = TABLES[table].schema.add("batch", "long")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def check_turn(self, batch: int) -> None:
        """Raises unless ``batch`` is the latest one again or the one after it."""
        latest = self._read_batches("inventory").agg({"batch": "max"}).first()[0]
        if latest is None or batch not in (latest, latest + 1):
            raise ValueError(f"batch {batch} does not follow the store's latest, {latest}")

    def items(self, before: int | None = None) -> DataFrame:
        """Order lines written so far, or before batch ``before``."""
        everything = self._read_batches("order_items")
        return (everything if before is None else everything.filter(everything["batch"] < before)).drop("batch")

    def inventory(self, before: int) -> DataFrame:
        """Inventory after the batch that precedes ``before``."""
        return self._read("inventory", self._path("inventory", before - 1))

    def write(self, table: str, batch: int, df: DataFrame) -> None:
        df.select(*TABLES[table].column_names).write.mode("overwrite").parquet(self._path(table, batch))


def apply_sales_stream(
    requests: DataFrame,
    store: SaleStore,
    customers: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    as_of: date,
    checkpoint: str,
    strict: bool = False,
) -> StreamingQuery:
    """Starts a query that decides every micro-batch of ``requests`` in ``seq`` order."""

    def apply_batch(batch: DataFrame, number: int) -> None:
        store.check_turn(number)
        with intermediates(store.spark):
            sales = apply_sales(
                batch,
                customers,
                sellers,
                products,
                store.inventory(number),
                store.orders(number),
                as_of,
                items=store.items(number),
                strict=strict,
            )
            store.write("orders", number, sales.orders)
            store.write("order_items", number, sales.items)
            # Last: its presence says that the batch is complete.
            store.write("inventory", number, sales.inventory)

    return (
        requests.writeStream.foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
