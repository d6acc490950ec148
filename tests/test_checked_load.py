"""Loads that keep bad rows apart and count while they write."""

from __future__ import annotations

import pytest

from tallyloom.operators import quality
from tallyloom.plans.load import load_checked, load_raw
from tallyloom.sources.raw_csv import read_with_rejects
from tests.conftest import rows
from tests.test_jobs import FILES

BAD = {
    "orders.csv": FILES["orders.csv"] + "3,soon,1,1,Completed\n4,2024-01-01,1\n5,2024-01-01,1,1,Completed,more\nx,2024-01-01,1,1,Completed\n",
    "order_items.csv": FILES["order_items.csv"] + "3,2,2,1,cheap\n4,2,2,,5.00\n5,2,2,99999999999,1\n",
    "sellers.csv": FILES["sellers.csv"] + "3,A seller whose name is far too long,a very long origin\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    for name, text in (FILES | BAD).items():
        (raw / name).write_bytes(text.encode("utf-8"))
    return raw


@pytest.fixture(scope="module")
def loaded(spark, folder, tmp_path_factory):
    return load_checked(spark, str(folder), str(tmp_path_factory.mktemp("tables")))


def test_good_rows_load_and_bad_ones_are_kept(loaded):
    assert rows(loaded.tables["orders"], "order_id") == [(1,), (2,)]
    assert sorted(rows(loaded.tables["order_items"], "order_item_id")) == [(1,), (2,), (4,)]
    found = sorted(rows(loaded.rejects))
    assert found == [
        ("order_items", "price_per_unit is not decimal(18,2)", '{"order_item_id":"3","order_id":"2","product_id":"2","quantity":"1","price_per_unit":"cheap"}'),
        ("order_items", "quantity is not int", '{"order_item_id":"5","order_id":"2","product_id":"2","quantity":"99999999999","price_per_unit":"1"}'),
        ("orders", "order_date is not date", '{"order_id":"3","order_date":"soon","customer_id":"1","seller_id":"1","order_status":"Completed"}'),
        ("orders", "order_id is not bigint", '{"order_id":"x","order_date":"2024-01-01","customer_id":"1","seller_id":"1","order_status":"Completed"}'),
        ("orders", "wrong number of cells", "4,2024-01-01,1"),
        ("orders", "wrong number of cells", "5,2024-01-01,1,1,Completed,more"),
    ]


def test_counts_are_those_of_a_second_scan(loaded):
    scanned = sorted(rows(quality.load_audit(loaded.tables)))
    assert sorted(rows(loaded.audit, "table_name", "row_count", "null_total_sale")) == scanned
    assert {r[0]: r[3] for r in rows(loaded.audit)} == {name: {"orders": 4, "order_items": 2}.get(name, 0) for name in loaded.tables}
    assert dict(rows(loaded.audit, "table_name", "null_total_sale"))["order_items"] == 1
    assert sorted(rows(loaded.widths), key=repr) == sorted(rows(quality.text_width_audit(loaded.tables)), key=repr)
    assert ("sellers", "origin", 10, 1, 18) in rows(loaded.widths)


def test_equals_the_strict_load_where_all_rows_are_good(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode("utf-8"))
    strict = load_raw(spark, str(tmp_path), str(tmp_path / "strict"))
    checked = load_checked(spark, str(tmp_path), str(tmp_path / "checked"))
    for name, df in strict.items():
        assert df.dtypes == checked.tables[name].dtypes and sorted(rows(df), key=repr) == sorted(rows(checked.tables[name]), key=repr)
    assert rows(checked.rejects) == []


def test_no_rows_and_only_bad_rows(spark, tmp_path):
    (tmp_path / "category.csv").write_text("category_id,category_name\n")
    (tmp_path / "sellers.csv").write_text("seller_id,seller_name,origin\nx,y,z\n")
    found = load_checked(spark, str(tmp_path), str(tmp_path / "out"), ("category", "sellers"))
    assert [df.count() for df in found.tables.values()] == [0, 0] and found.rejects.count() == 1
    assert sorted(rows(found.audit)) == [("category", 0, None, 0), ("sellers", 0, None, 1)]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "category").mkdir()
    (tmp_path / "category" / "a.csv").write_text("category_id,category_name\n1,a\n")
    (tmp_path / "category" / "b.csv").write_text("category_name,category_id\nb,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_with_rejects(spark, "category", str(tmp_path / "category")).collect()
