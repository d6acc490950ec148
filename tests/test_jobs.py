"""CSV ingest, the load and export jobs, and the sink formats."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.experiment import Experiment
from tallyloom.operators.products import low_inventory
from tallyloom.plans import export, load
from tallyloom.sources.raw_csv import read_clean_csv, read_table
from tallyloom.sources.sinks import with_provenance, write_table
from tests.conftest import day, rows

FILES = {
    "category.csv": "category_id,category_name\n1,toys\n2,Home & Kitchen",
    "customers.csv": "﻿Customer ID, first_name ,last_name,state\r\n1,Ann,Lee,Ohio\r\n2,Bob,,NA\r\n",
    "sellers.csv": "﻿seller_id,seller_name,origin\n1,Shop,USA\n2,\"Quote \"\"Q\"\", Inc\",nan\n",
    "products.csv": "price,product_id,product_name,cogs,category_id\n9.99,1,Player’s ball,4.5,1\n5,2,bat,2,\n",
    "inventory.csv": "﻿inventory_id,product_id,stock,warehouse_id,last_stock_date\n1,1,9,1,2024-04-08\n2,2,10,1,2024-02-02\n",
    "orders.csv": "order_id,order_date,customer_id,seller_id,order_status\n1,2024-01-05,1,1,Completed\n2,2024-02-05,1,1,Cancelled\n",
    "order_items.csv": "order_item_id,order_id,product_id,quantity,price_per_unit\n1,1,1,3,9.99\n2,2,2,1,5.00\n",
    "payments.csv": "payment_id,order_id,payment_date,payment_status\n1,1,2024-01-05,Payment Successed\n2,2,2024-02-05,Payment Failed\n",
    "shipping.csv": "shipping_id,order_id,shipping_date,return_date,shipping providers,delivery_status\n1,1,2024-01-07,,fedex,Delivered\n",
}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_bytes(text.encode("utf-8"))
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, raw, tmp_path_factory):
    return load.load_raw(spark, raw, str(tmp_path_factory.mktemp("tables")))


def test_headers_lose_mark_and_blanks(spark, raw):
    assert read_clean_csv(spark, f"{raw}/customers.csv").columns == ["Customer ID", "first_name", "last_name", "state"]
    assert read_clean_csv(spark, f"{raw}/shipping.csv", {"shipping providers": "p"}).columns[4] == "p"


def test_customers_get_null_cells_and_the_default_address(tables):
    assert rows(tables["customers"]) == [(1, "Ann", "Lee", "Ohio", "xxxx"), (2, "Bob", None, None, "xxxx")]


def test_quotes_and_null_tokens(tables):
    assert rows(tables["sellers"]) == [(1, "Shop", "USA"), (2, 'Quote "Q", Inc', None)]


def test_columns_by_name_not_by_place(tables):
    assert rows(tables["products"]) == [
        (1, "Player’s ball", Decimal("9.99"), Decimal("4.50"), 1),
        (2, "bat", Decimal("5.00"), Decimal("2.00"), None),
    ]


def test_types_and_generated_total(tables):
    assert rows(tables["order_items"], "quantity", "total_sale") == [(3, Decimal("29.97")), (1, Decimal("5.00"))]
    assert rows(tables["inventory"], "last_stock_date") == [(date(2024, 4, 8),), (date(2024, 2, 2),)]
    assert rows(tables["shippings"]) == [(1, 1, day("2024-01-07"), None, "fedex", "Delivered")]


def test_cell_with_line_break(spark, tmp_path):
    (tmp_path / "category.csv").write_text('category_id,category_name\n1,"two\nlines"\n')
    assert rows(read_table(spark, "category", f"{tmp_path}/category.csv", multiline=True)) == [(1, "two\nlines")]


def test_audits_of_a_clean_load(tables):
    audits = {name: rows(df) for name, df in load.audit(tables).items()}
    assert {r[0]: r[1] for r in audits["load_audit"]}["orders"] == 2
    assert all(r[2:] == (0, 0, 0) for r in audits["primary_key_audit"])
    assert all(r[3:] == (0, 0) for r in audits["foreign_key_audit"])
    assert all(r[3] == 0 for r in audits["text_width_audit"])
    assert all(r[4] for r in audits["status_matrix"])


def test_loaded_tables_answer_a_query(tables):
    assert rows(low_inventory(tables["inventory"], tables["products"]), "inventory_id") == [(1,)]


def read_report(spark, folder, name):
    return spark.read.csv(f"{folder}/{name}", header=True)


def test_export(spark, tables, tmp_path):
    names = export.export_tables(tables, str(tmp_path))
    assert names == ["kpi_summary", "cohort_retention", "cohort_retention_pivot", "funnel_fulfillment"]
    kpi = read_report(spark, tmp_path, "kpi_summary").first().asDict()
    assert kpi["total_revenue"] == "34.97" and kpi["first_order_date"] == "2024-01-05"
    assert rows(read_report(spark, tmp_path, "cohort_retention")) == [("2024-01-01", "0", "1", "1", "100.0")]
    assert read_report(spark, tmp_path, "cohort_retention_pivot").columns == ["cohort_month", "month_0"]
    funnel = rows(read_report(spark, tmp_path, "funnel_fulfillment"), "stage", "orders", "drop_off")
    assert funnel[:2] == [("Orders Placed", "2", None), ("Payment Successful", "1", "1")]


def test_export_of_test_and_discovery_funnel(spark, tmp_path):
    attempts = spark.range(100).select((F.col("id") % 2).alias("arm"), (F.col("id") % 3 == 0).alias("ok"))
    export.export_experiment(attempts, "arm", "ok", Experiment("t", 0, 1), str(tmp_path))
    assert read_report(spark, tmp_path, "ab_test_results").count() == 2
    assert read_report(spark, tmp_path, "ab_test_summary").first()["test_name"] == "t"
    events = spark.sql("SELECT 1 AS user_id, TIMESTAMP'2024-01-01 10:00:00' AS ts, 'view' AS event_type")
    export.export_discovery_funnel(events, [("View", "view"), ("Buy", "buy")], 12, str(tmp_path))
    first = read_report(spark, tmp_path, "funnel_discovery").orderBy("stage_order").first()
    assert (first["users"], first["is_simulated"], first["methodology"][:8]) == ("1", "false", "measured")


def test_partitioned_table_round_trip(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    write_table(df, f"{tmp_path}/t", ["k"])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(rows(back, "id", "k")) == sorted(rows(df))
    assert rows(with_provenance(back.filter("id = 1"), True, "m"), "is_simulated", "methodology") == [(True, "m")]


def refused(df):
    with pytest.raises(Exception):
        df.collect()


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seller_id,seller_name,origin\n1,Shop,USA\n")
    (tmp_path / "b.csv").write_text("seller_id,seller_name,origin\n2,Stall,UK\n")
    assert sorted(rows(read_table(spark, "sellers", str(tmp_path)))) == [(1, "Shop", "USA"), (2, "Stall", "UK")]
    (tmp_path / "c.csv").write_text("origin,seller_id,seller_name\nChina,3,Stand\n")
    refused(read_table(spark, "sellers", str(tmp_path)))


@pytest.mark.parametrize("row", ["3,d", "3,d,e,f"])
def test_ragged_rows_are_refused(spark, tmp_path, row):
    (tmp_path / "a.csv").write_text(f"seller_id,seller_name,origin\n1,Shop,USA\n{row}\n")
    refused(read_table(spark, "sellers", str(tmp_path)))
    refused(read_table(spark, "sellers", str(tmp_path)).select("seller_id"))


def test_quoted_line_breaks_need_multiline(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "sellers.csv").write_text('seller_id,seller_name,origin\n1,"Two\nlines",USA\n')
    refused(read_table(spark, "sellers", f"{folder}/sellers.csv"))
    loaded = load.load_raw(spark, str(folder), f"{tmp_path}/tables", ("sellers",), multiline=True)
    assert rows(loaded["sellers"]) == [(1, "Two\nlines", "USA")]
