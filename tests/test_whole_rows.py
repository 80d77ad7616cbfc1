"""Whole rows and whole feeds: stored columns survive the jobs, every request has an
outcome, ids are not used again, and the console only reads."""

import datetime as dt
import os
from decimal import Decimal

import pytest

from stockroom import schemas as S
from stockroom.operators import changes as C
from stockroom.operators import sales as SA
from stockroom.plans.console import ConsoleError, adhoc_sql
from stockroom.session import CLUSTER_CONF, session_conf

OLD, NOW = dt.datetime(2020, 1, 1), dt.datetime(2024, 3, 15, 12)
P = Decimal("2.00")


@pytest.fixture
def full(spark):
    suppliers = spark.createDataFrame([(1, "Acme", "a@x.com", "123", "Street 1", OLD)], S.SUPPLIERS)
    products = spark.createDataFrame([(1, "Pen", "S", 5, P, 1, OLD, OLD), (2, "Cup", "S", 5, P, None, OLD, OLD)],
                                     S.PRODUCTS)
    employees = spark.createDataFrame([(1, "A", "a", "owner", False, OLD, OLD), (2, "B", "b", "admin", True, OLD, OLD)],
                                      S.EMPLOYEES)
    return suppliers, products, employees


def test_product_changes_keep_columns_and_answer_every_request(spark, full):
    suppliers, products, _ = full
    reqs = spark.createDataFrame([
        (1, "UPDATE", 1, "Pen 2", "S", 6, P, "Acme", "new@x.com"), (2, "PATCH", 1, "x", "S", 1, P, "", ""),
        (3, None, 1, "x", "S", 1, P, "", ""), (4, "INSERT", None, "Hat", "S", 1, P, "New Co", ""),
        (5, "INSERT", None, "Long", "S", 1, P, "n" * 101, ""), (6, "UPDATE", 2, "Cup", "S", 1, P, "n" * 96, ""),
        (7, "DELETE", None, None, None, None, None, None, None)], S.PRODUCT_CHANGES)
    res = C.apply_product_changes(products, suppliers, reqs, as_of_ts=NOW)
    assert {r.request_id: r.status for r in res.outcomes.collect()} == {
        1: "UPDATED", 2: "ERROR", 3: "ERROR", 4: "INSERTED", 5: "ERROR", 6: "ERROR", 7: "NO_MATCH"}
    rows = {r.id: r for r in res.table.collect()}
    assert (rows[1].created_at, rows[1].updated_at) == (OLD, NOW)
    assert (rows[2].created_at, rows[2].updated_at, rows[2].name) == (OLD, OLD, "Cup")
    assert (rows[3].created_at, rows[3].updated_at) == (NOW, NOW)
    sup = {r.name: r for r in res.suppliers.collect()}
    assert set(sup) == {"Acme", "New Co"} and res.suppliers.columns == suppliers.columns
    assert tuple(sup["Acme"])[2:] == ("new@x.com", "123", "Street 1", OLD)
    assert tuple(sup["New Co"])[3:] == (None, None, NOW)


def test_employee_changes_keep_columns_and_answer_every_request(spark, full):
    employees = full[2]
    reqs = spark.createDataFrame([(1, "UPDATE", 1, "A2", "a2", "admin"), (2, "PATCH", 1, "x", "x", "admin"),
                                  (3, None, None, None, None, None), (4, "INSERT", None, "C", "c", "")], S.EMPLOYEE_CHANGES)
    res = C.apply_employee_changes(employees, reqs, as_of_ts=NOW)
    assert {r.request_id: r.status for r in res.outcomes.collect()} == {
        1: "UPDATED", 2: "ERROR", 3: "ERROR", 4: "INSERTED"}
    rows = {r.id: r for r in res.table.collect()}
    assert (rows[2].created_at, rows[2].updated_at, rows[1].updated_at, rows[3].created_at) == (OLD, OLD, NOW, NOW)


def test_ids_are_not_given_out_again(spark, full):
    suppliers, products, _ = full
    gone = C.apply_product_changes(products, suppliers, spark.createDataFrame(
        [(1, "DELETE", 2, None, None, None, None, None, None)], S.PRODUCT_CHANGES)).table
    added = spark.createDataFrame([(2, "INSERT", None, "Hat", "S", 1, P, "", "")], S.PRODUCT_CHANGES)
    assert {r.id for r in C.apply_product_changes(gone, suppliers, added).table.collect()} == {1, 2}
    assert {r.id for r in C.apply_product_changes(gone, suppliers, added, high_water=2).table.collect()} == {1, 3}


def test_sale_ids_follow_arrival(spark, full):
    reqs = spark.createDataFrame([(1, 1, 1, NOW, None), (2, 1, 1, OLD, None), (3, 1, None, OLD, None), (4, 99, 1, OLD, None)],
                                 S.SALE_REQUESTS)
    res = SA.apply_sale_requests(full[1], reqs)
    assert {r.request_id: r.status for r in res.collect()} == {
        1: "ACCEPTED", 2: "ACCEPTED", 3: "INVALID_QUANTITY", 4: "NOT_FOUND"}
    sold = SA.new_sales_rows(spark.createDataFrame([], S.SALES), res, high_water=40).collect()
    assert {r.id: r.sale_timestamp for r in sold} == {41: OLD, 42: NOW}


def test_validation_covers_suppliers_and_ranges(spark):
    bad = spark.createDataFrame([(1, "n" * 101, "e" * 101, "p" * 31, None, None), (1, None, None, None, None, None)],
                                S.SUPPLIERS.simpleString().replace("struct<", "").rstrip(">").replace(":", " "))
    rules = {r.rule for r in C.validate_table("suppliers", bad).collect()}
    assert rules == {"unique_id", "not_null_name", "length_name", "length_contact_email", "length_phone"}
    wide = spark.createDataFrame([(1, "a", "b", 3_000_000_000, Decimal("123456789.00"), None)],
                                 "id long, name string, category string, quantity long, price decimal(20,2), supplier_id long")
    assert {r.rule for r in C.validate_table("products", wide).collect()} == {"range_price", "range_quantity"}


@pytest.mark.parametrize("sql", [
    "WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT * FROM a",
    "FROM range(3) INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT id",
    "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT 1 WHERE 1 IN (SELECT `java_method`('a', 'b'))",
    "WITH a AS (SELECT try_reflect('a', 'b') AS x) SELECT * FROM a", "INSERT INTO t VALUES (1)", "DROP TABLE t",
    "EXPLAIN INSERT INTO t VALUES (1)"])
def test_console_refuses_what_is_not_reading(spark, tmp_path, sql):
    folder = str(tmp_path / "out")
    with pytest.raises(ConsoleError):
        adhoc_sql(spark, sql.replace("{d}", folder))
    assert not os.path.exists(folder)


@pytest.mark.parametrize("sql", ["SELECT 'reflect(' AS x", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SHOW TABLES",
                                 "VALUES (1), (2);", "FROM range(3) SELECT id", "EXPLAIN SELECT 1", "DESCRIBE QUERY SELECT 1"])
def test_console_reads(spark, sql):
    assert adhoc_sql(spark, sql).df.collect() is not None


def test_cluster_settings():
    far = session_conf("spark://host:7077")
    assert far["spark.sql.shuffle.partitions"] == CLUSTER_CONF["spark.sql.shuffle.partitions"]
    assert session_conf("yarn", 500)["spark.sql.shuffle.partitions"] == "500"
    assert session_conf("local[4]")["spark.sql.shuffle.partitions"] == "8"
    assert far["spark.cleaner.referenceTracking.cleanCheckpoints"] == "true"


def test_every_registered_job_is_there():
    from stockroom.plans.registry import all_queries
    from stockroom.plans.registry_jobs import JOBS
    assert set(JOBS) <= set(all_queries()) and "request_outcomes_complete" in JOBS
