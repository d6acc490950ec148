"""CSV files to typed Parquet tables, with audits in place of constraints."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import TABLES
from tallyloom.operators import quality
from tallyloom.sources.raw_csv import FILES, REASON, RECORD, read_table, read_with_rejects
from tallyloom.sources.sinks import write_table


def load_raw(
    spark: SparkSession,
    raw_folder: str,
    table_folder: str,
    tables: tuple[str, ...] = tuple(FILES),
    multiline: bool = False,
) -> dict[str, DataFrame]:
    """Writes the chosen tables as Parquet and returns them, read back.

    ``multiline`` reads cells with line breaks; without it they are refused.
    """
    for name in tables:
        write_table(read_table(spark, name, f"{raw_folder}/{FILES[name]}", multiline), f"{table_folder}/{name}")
    return open_tables(spark, table_folder, tables)


def open_tables(
    spark: SparkSession, table_folder: str, tables: tuple[str, ...] = tuple(TABLES)
) -> dict[str, DataFrame]:
    """The loaded tables, without reading file footers for their schemas."""
    return {name: spark.read.schema(TABLES[name].schema).parquet(f"{table_folder}/{name}") for name in tables}


def audit(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All audits that the given tables allow."""
    audits = {
        "load_audit": quality.load_audit(tables),
        "primary_key_audit": quality.primary_key_audit(tables),
        "foreign_key_audit": quality.foreign_key_audit(tables),
        "text_width_audit": quality.text_width_audit(tables),
    }
    if {"orders", "payments", "shippings"} <= set(tables):
        audits["status_matrix"] = quality.status_matrix(tables["orders"], tables["payments"], tables["shippings"])
    return audits


@dataclass(frozen=True)
class CheckedLoad:
    """What a load with rejects leaves, and what was counted while it wrote."""

    tables: dict[str, DataFrame]
    rejects: DataFrame  # table_name, reject_reason, reject_record
    audit: DataFrame  # table_name, row_count, null_total_sale, rejected_rows
    widths: DataFrame  # as text_width_audit


def load_checked(
    spark: SparkSession,
    raw_folder: str,
    table_folder: str,
    tables: tuple[str, ...] = tuple(FILES),
    multiline: bool = False,
) -> CheckedLoad:
    """Writes good rows and rejected ones in one pass over the files, and counts both in it.

    Every table is one Parquet folder in two partitions, ``rejected`` or not. The counts are
    those of ``load_audit`` and ``text_width_audit`` over the good rows, observed while they
    are written, so nothing is read a second time.
    """
    counts, widths = [], []
    for name in tables:
        seen = Observation(f"load {name}")
        rows = read_with_rejects(spark, name, f"{raw_folder}/{FILES[name]}", multiline)
        observed = rows.observe(seen, *_counted(name)).withColumn("rejected", F.col(REASON).isNotNull())
        observed.write.mode("overwrite").partitionBy("rejected").parquet(f"{table_folder}/{name}")
        found = seen.get
        counts.append((name, found["rows"], found.get("null_total_sale"), found["rejected"]))
        for column, most in TABLES[name].max_length.items():
            widths.append((name, column, most, found[f"{column}_over"], found[f"{column}_widest"]))
    opened = {name: _partitioned(spark, name, f"{table_folder}/{name}") for name in tables}
    rejects = [
        df.filter("rejected").select(F.lit(name).alias("table_name"), REASON, RECORD) for name, df in opened.items()
    ]
    all_rejects = rejects[0]
    for more in rejects[1:]:
        all_rejects = all_rejects.unionByName(more)
    return CheckedLoad(
        {name: df.filter("NOT rejected").select(*TABLES[name].column_names) for name, df in opened.items()},
        all_rejects,
        # A row per table, and per text column of them.
        spark.createDataFrame(counts, "table_name string, row_count long, null_total_sale long, rejected_rows long"),
        spark.createDataFrame(widths, "table_name string, column_name string, max_length int, too_long long, widest int"),
    )


def _counted(table: str) -> list[Column]:
    good = F.col(REASON).isNull()
    out = [F.count_if(good).alias("rows"), F.count_if(~good).alias("rejected")]
    if "total_sale" in TABLES[table].column_names:
        out.append(F.count_if(good & F.col("total_sale").isNull()).alias("null_total_sale"))
    for column, most in TABLES[table].max_length.items():
        length = F.when(good, F.length(column))
        out += [F.count_if(length > most).alias(f"{column}_over"), F.max(length).alias(f"{column}_widest")]
    return out


def _partitioned(spark: SparkSession, table: str, path: str) -> DataFrame:
    schema = TABLES[table].schema.add(REASON, "string").add(RECORD, "string").add("rejected", "boolean")
    return spark.read.schema(schema).parquet(path)
