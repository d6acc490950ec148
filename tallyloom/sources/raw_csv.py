"""CSV ingest: header cleaning, renames, NULL tokens, declared types, derived columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.model import DEFAULT_ADDRESS, MONEY, TABLES

# File of each table, and headers that differ from the column.
FILES = {
    "category": "category.csv",
    "customers": "customers.csv",
    "sellers": "sellers.csv",
    "products": "products.csv",
    "inventory": "inventory.csv",
    "orders": "orders.csv",
    "order_items": "order_items.csv",
    "payments": "payments.csv",
    "shippings": "shipping.csv",
}
RENAMES = {
    "customers": {"Customer ID": "customer_id"},
    "shippings": {"shipping providers": "shipping_providers"},
}

# Cell texts that mean "no value" to the pandas CSV reader.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _derived(table: str) -> dict[str, Column]:
    """Columns computed on load instead of read."""
    if table == "order_items":
        return {"total_sale": (F.col("quantity") * F.col("price_per_unit")).cast(MONEY)}
    if table == "customers":
        return {"address": F.lit(DEFAULT_ADDRESS)}
    return {}


def read_clean_csv(
    spark: SparkSession, path: str, renames: Mapping[str, str] | None = None, multiline: bool = False
) -> DataFrame:
    """A headed CSV as text columns with trimmed, renamed headers.

    A byte-order mark is dropped, quotes are escaped by doubling. Cells with a
    line break need ``multiline=True``, at the price of unsplittable files.

    Files that cannot be read right are refused when rows are read: one of
    several files whose header differs from the others' (a different order
    would put values under wrong names), and rows with too few or too many
    cells (a quoted line break without ``multiline`` is seen as such).
    """
    options = _options(multiline)
    head = spark.read.csv(path, **options).columns
    # With a given schema every file's header is compared with it; without
    # column pruning every row's cells are counted, whatever is selected.
    schema = T.StructType([T.StructField(name, T.StringType()) for name in head])
    df = (
        spark.read.option("columnPruning", "false")
        .schema(schema)
        .csv(path, **options, enforceSchema=False, mode="FAILFAST")
    )
    return df.toDF(*_clean(head, renames))


def _options(multiline: bool) -> dict[str, object]:
    return {"header": True, "encoding": "UTF-8", "escape": '"', "multiLine": multiline}


def _clean(head: list[str], renames: Mapping[str, str] | None) -> list[str]:
    names = (name.lstrip("\ufeff").strip() for name in head)
    return [(renames or {}).get(name, name) for name in names]


def read_table(spark: SparkSession, table: str, path: str, multiline: bool = False) -> DataFrame:
    """One model table from CSV: selected, typed, with its derived columns."""
    spec = TABLES[table]
    derived = _derived(table)
    text = read_clean_csv(spark, path, RENAMES.get(table), multiline)
    typed = text.select(
        *(
            F.when(~F.col(name).isin(NULL_TOKENS), F.col(name)).cast(data_type).alias(name)
            for name, data_type in spec.columns
            if name not in derived
        )
    )
    return typed.withColumns(derived).select(*spec.column_names) if derived else typed


REASON, RECORD = "reject_reason", "reject_record"


def read_with_rejects(spark: SparkSession, table: str, path: str, multiline: bool = False) -> DataFrame:
    """One model table from CSV with ``reject_reason`` and ``reject_record``; both are NULL for a good row.

    A row is rejected, not the load, if it has too few or too many cells, or a cell that is
    not of its column's type. ``reject_record`` is the row as it stood in the file, or its
    cells as JSON. Files whose headers differ are refused all the same.
    """
    spec, corrupt = TABLES[table], "_corrupt_record"
    options = _options(multiline)
    head = spark.read.csv(path, **options).columns
    text_columns = [T.StructField(name, T.StringType()) for name in [*head, corrupt]]
    raw = (
        spark.read.option("columnPruning", "false")
        .schema(T.StructType(text_columns))
        .csv(path, **options, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
    )
    cells = _clean(head, RENAMES.get(table))
    text = raw.toDF(*cells, corrupt)
    derived = _derived(table)
    reasons, typed = [F.when(F.col(corrupt).isNotNull(), "wrong number of cells")], []
    for name, data_type in spec.columns:
        if name in derived:
            continue
        given = F.when(~F.col(name).isin(NULL_TOKENS), F.col(name))
        value = given.try_cast(data_type)
        reasons.append(F.when(given.isNotNull() & value.isNull(), f"{name} is not {data_type.simpleString()}"))
        typed.append(value.alias(name))
    as_json = F.to_json(F.struct(*cells))
    reason = F.coalesce(*reasons)
    record = F.when(reason.isNotNull(), F.coalesce(F.col(corrupt), as_json))
    checked = text.select(*typed, reason.alias(REASON), record.alias(RECORD))
    return checked.withColumns(derived).select(*spec.column_names, REASON, RECORD)
