"""Change jobs, id assignment, the ordered sale fold, console and streams."""

import datetime as dt
from decimal import Decimal

import pytest

from stockroom import schemas as S
from stockroom.operators import changes as C
from stockroom.operators import sales as SA
from stockroom.plans.console import ConsoleError, adhoc_sql, check_sql, result_meta
from stockroom.sources.catalog import describe_table, register_views, show_tables


def rows(df):
    return [r.asDict() for r in df.collect()]


def _reqs(spark, items):
    t0 = dt.datetime(2024, 3, 15, 9, 0, 0)
    return spark.createDataFrame(
        [(i + 1, pid, q, t0 + dt.timedelta(minutes=i), 3) for i, (pid, q) in enumerate(items)], S.SALE_REQUESTS)


def test_sale_fold_golden(spark, seed):
    req = _reqs(spark, [(1, 4), (1, 3), (1, 1), (4, 1), (9, 1), (1, 1)])
    got = {r["request_id"]: (r["status"], r["left"]) for r in rows(SA.apply_sale_requests(seed.products, req))}
    assert got == {1: ("ACCEPTED", 1), 2: ("INSUFFICIENT", 1), 3: ("ACCEPTED", 0),
                   4: ("OUT_OF_STOCK", 0), 5: ("NOT_FOUND", None), 6: ("OUT_OF_STOCK", 0)}
    msgs = {r["request_id"]: r["message"] for r in rows(SA.apply_sale_requests(seed.products, req))}
    assert msgs[1] == "Sold 4 x Wireless Mouse for M119.96"
    assert msgs[2] == "Only 1 units available."
    assert msgs[4] == "USB Cable is OUT OF STOCK!"


def test_sale_fold_invalid_and_batches(spark, seed):
    # quantity 0 / -1 rejected without touching stock; many requests per product
    items = [(5, 0), (5, -1)] + [(5, 2)] * 15
    res = SA.apply_sale_requests(seed.products, _reqs(spark, items), n_partitions=3)
    got = sorted((r["request_id"], r["status"], r["left"]) for r in res.collect())
    assert got[0][1] == got[1][1] == "INVALID_QUANTITY"
    accepted = [g for g in got if g[1] == "ACCEPTED"]
    assert len(accepted) == 12 and accepted[-1][2] == 1          # 25 → 1 in steps of 2
    after = {r["id"]: r["quantity"] for r in rows(SA.stock_after_sales(seed.products, res))}
    assert after[5] == 1 and after[1] == 5
    new = rows(SA.new_sales_rows(seed.sales, res))
    assert sorted(r["id"] for r in new) == list(range(3, 15))
    assert all(r["total_amount"] == Decimal("91.98") for r in new)


def test_fold_crosses_arrow_batches(spark, seed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        items = [(3, 1), (5, 4)] * 10
        res = SA.apply_sale_requests(seed.products, _reqs(spark, items), n_partitions=2)
        left = {}
        for r in sorted(res.collect(), key=lambda r: r["request_id"]):
            left[r["product_id"]] = r["left"]
        assert left == {3: 2, 5: 1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_assign_ids_dense(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 AS request_id")
    out = C.assign_ids(df, C.max_id(spark.range(0, 50)))
    got = sorted((r["request_id"], r["id"]) for r in out.collect())
    assert [g[1] for g in got] == list(range(50, 1050))


def _pchanges(spark, items):
    return spark.createDataFrame(items, S.PRODUCT_CHANGES)


def test_product_changes(spark, seed):
    reqs = _pchanges(spark, [
        (1, "INSERT", None, "Stapler", "Stationery", 8, Decimal("3.50"), "Office Hub", "", ),
        (2, "UPDATE", 3, "Chair v2", "Furniture", 11, Decimal("120.00"), "PaperHub", "new@paperhub.com"),
        (3, "DELETE", 4, None, None, None, None, None, None),
        (4, "UPDATE", 4, "Cable v2", "Electronics", 1, Decimal("9.00"), "", ""),
        (5, "UPDATE", 7, "Stapler v2", "Stationery", 9, Decimal("3.75"), "", ""),
        (6, "UPDATE", 99, "Ghost", "X", 1, Decimal("1.00"), "", ""),
    ])
    res = C.apply_product_changes(seed.products, seed.suppliers, reqs)
    out = {r["request_id"]: (r["status"], r["id"]) for r in rows(res.outcomes)}
    assert out == {1: ("INSERTED", 7), 2: ("UPDATED", 3), 3: ("DELETED", 4), 4: ("NO_MATCH", 4),
                   5: ("UPDATED", 7), 6: ("NO_MATCH", 99)}
    table = {r["id"]: r for r in rows(res.table)}
    assert 4 not in table and len(table) == 6
    assert table[7]["name"] == "Stapler v2" and table[7]["supplier_id"] is None
    assert table[3]["supplier_id"] == 2
    sup = {r["name"]: r for r in rows(res.suppliers)}
    assert sup["Office Hub"]["contact_email"] == "info@officehub.com" and sup["Office Hub"]["id"] == 5
    assert sup["PaperHub"]["contact_email"] == "new@paperhub.com"
    cascaded = rows(C.delete_cascade_null(seed.sales, "product_id", res.deleted_ids))
    assert {r["product_id"] for r in cascaded} == {1, 2}
    # idempotent without inserts: re-applying only the updates changes nothing further
    again = C.apply_product_changes(res.table, res.suppliers, reqs.where("op = 'UPDATE'"))
    assert sorted(map(str, rows(again.table))) == sorted(map(str, rows(res.table)))


def test_employee_changes(spark, seed):
    reqs = spark.createDataFrame([
        (1, "INSERT", None, "Ann", "ann", ""),
        (2, "INSERT", None, "Ann Two", "ann", "admin"),
        (3, "INSERT", None, "Dup Owner", "owner", "cashier"),
        (4, "UPDATE", 4, "Jane S", "jane2", "admin"),
        (5, "UPDATE", 3, "John", "admin", "cashier"),
        (6, "UPDATE", 2, "Sys", "sys", ""),
        (7, "DELETE", 1, None, None, None),
    ], S.EMPLOYEE_CHANGES)
    res = C.apply_employee_changes(seed.employees, reqs, as_of_ts=dt.datetime(2024, 1, 1))
    out = {r["request_id"]: r["status"] for r in rows(res.outcomes)}
    assert out == {1: "INSERTED", 2: "DUPLICATE", 3: "DUPLICATE", 4: "UPDATED", 5: "DUPLICATE",
                   6: "ERROR", 7: "DELETED"}
    table = {r["id"]: r for r in rows(res.table)}
    assert table[5]["role"] == "cashier" and table[5]["must_change_password"] is True
    assert table[4]["username"] == "jane2" and 1 not in table
    assert table[4]["updated_at"] == dt.datetime(2024, 1, 1) and table[3]["updated_at"] is None
    assert rows(C.validate_table("employees", res.table)) == []


def test_validate_table(spark, seed):
    bad = seed.products.unionByName(spark.createDataFrame(
        [(1, "Dup", "X", 1, Decimal("1.00"), 42)], S.PRODUCTS_CORE))
    got = {(r["rule"], r["row_key"]) for r in rows(C.validate_table("products", bad, {"suppliers": seed.suppliers}))}
    assert got == {("unique_id", "1"), ("fk_supplier_id", "1")}


def test_form_checks(spark):
    reqs = spark.createDataFrame([(1, "INSERT", None, "  ", "Cat", 1, Decimal("1.00"), "S", ""),
                                  (2, "DELETE", 5, None, None, None, None, None, None),
                                  (3, "UPDATE", 5, " Pen ", "Cat", 1, Decimal("1.00"), " S ", "")],
                                 S.PRODUCT_CHANGES)
    got = {r["request_id"]: (r["ok"], r["name"]) for r in rows(C.validate_product_requests(reqs))}
    assert got == {1: (False, ""), 2: (True, None), 3: (True, "Pen")}
    sale = spark.createDataFrame([(1, 0, 1, None, None), (2, 5, 0, None, None), (3, 5, None, None, None)],
                                 S.SALE_REQUESTS)
    assert [r["ok"] for r in C.validate_sale_requests(sale).orderBy("request_id").collect()] == [False, False, True]


def test_console(spark, seed):
    register_views(spark, seed)
    with pytest.raises(ConsoleError, match="Empty query"):
        check_sql("   ")
    with pytest.raises(ConsoleError, match="disabled"):
        check_sql("drop table products")
    for stmt in ("DELETE FROM products", "INSERT INTO sales VALUES (1)", "TRUNCATE TABLE sales",
                 "CREATE TABLE x AS SELECT 1"):
        with pytest.raises(ConsoleError):
            check_sql(stmt)
    res = adhoc_sql(spark, "WITH c AS (SELECT * FROM v_revenue_by_category) SELECT * FROM c;")
    assert res.kind == "select" and res.df.count() == 2
    meta = result_meta(adhoc_sql(spark, "SELECT * FROM v_inventory_with_supplier WHERE stock_status != 'OK'").df)
    assert meta.first()["row_count"] == 4
    names = {r["tableName"] for r in show_tables(spark).collect()}
    assert {"products", "v_sales_report"} <= names
    assert [r["col_name"] for r in describe_table(spark, "products").collect()][:2] == ["id", "name"]
    bound = adhoc_sql(spark, "SELECT * FROM products WHERE quantity < :n", {"n": 10})
    assert bound.df.count() == 4


def test_stream_equals_batch(spark, seed, tmp_path):
    from stockroom.streaming import streams as R
    req = _reqs(spark, [(1, 4), (1, 3), (1, 1), (4, 1), (9, 1), (1, 1), (5, 0)])
    folder = tmp_path / "feed"
    req.write.parquet(str(folder))
    feed = R.parquet_stream(spark, str(folder))
    out = R.stream_apply_sales(seed.products, feed)
    got = R.read_run(spark, R.run_append(out, "t-r1"), out.schema)
    batch = SA.apply_sale_requests(seed.products, req)
    key = ["request_id", "status", "left", "message"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    alerts = R.read_run(spark, R.run_append(R.stream_stock_alerts(R.stream_apply_sales(
        seed.products, R.parquet_stream(spark, str(folder)))), "t-r4"))
    assert {(r["request_id"], r["alert"]) for r in alerts.collect()} == {(3, "OUT OF STOCK")}


def test_hot_product_split_equals_single_task(spark, seed):
    import random
    rnd = random.Random(7)
    prods = seed.products.withColumn("quantity", __import__("pyspark.sql.functions", fromlist=["col"]).col("quantity") * 9)
    items = [(rnd.choice([1, 1, 1, 3, 5, 2]), rnd.choice([0, 1, 2, 3, 7, 30, 400])) for _ in range(700)]
    req = _reqs(spark, items)
    key = ["request_id", "status", "stock_before", "left"]
    single = sorted(map(tuple, SA.apply_sale_requests(prods, req, hot_rows=None).select(*key).collect()))
    split = sorted(map(tuple, SA.apply_sale_requests(prods, req, n_partitions=7, hot_rows=20)
                       .select(*key).collect()))
    assert split == single
    assert {s[1] for s in single} >= {"ACCEPTED", "INSUFFICIENT", "OUT_OF_STOCK", "INVALID_QUANTITY"}


def test_update_username_first_claim_wins(spark, seed):
    reqs = spark.createDataFrame([
        (1, "UPDATE", 3, "John", "boss", "cashier"),
        (2, "UPDATE", 4, "Jane", "boss", "cashier"),
        (3, "UPDATE", 3, "John D", "boss", "admin"),
    ], S.EMPLOYEE_CHANGES)
    res = C.apply_employee_changes(seed.employees, reqs)
    out = {r["request_id"]: r["status"] for r in rows(res.outcomes)}
    assert out == {1: "UPDATED", 2: "DUPLICATE", 3: "UPDATED"}
    table = {r["id"]: r for r in rows(res.table)}
    assert table[3]["username"] == "boss" and table[3]["role"] == "admin" and table[4]["username"] == "jane"


def test_daily_kpis_stream_non_utc_session(spark, seed, tmp_path):
    from stockroom.streaming import streams as R
    folder = tmp_path / "sales"
    late = seed.sales.withColumn("sale_timestamp", __import__("pyspark.sql.functions", fromlist=["lit"])
                                 .lit(dt.datetime(2024, 3, 15, 23, 30)).cast("timestamp_ntz"))
    late.write.parquet(str(folder))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        agg = R.stream_daily_kpis(R.parquet_stream(spark, str(folder)))
        got = R.read_run(spark, R.run_complete(agg, "t-r2"), agg.schema).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r["day"], r["revenue"], r["items_sold"], r["transactions"]) for r in got] == \
        [(dt.date(2024, 3, 15), Decimal("74.95"), 5, 2)]


def test_stored_tables_prune_dates(spark, seed, tmp_path):
    from stockroom.operators import aggregates as A
    from stockroom.sources.tables import read_retail_tables, write_retail_tables
    from tests.conftest import AS_OF
    for by_dirs in (False, True):
        root = str(tmp_path / f"tables-{by_dirs}")
        write_retail_tables(seed, root, by_date_dirs=by_dirs)
        t = read_retail_tables(spark, root)
        assert t.sales.count() == 2 and t.products.count() == 6
        q = A.daily_sales_kpis(t.sales, AS_OF)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert ("PartitionFilters: [isnotnull(sale_date" in plan) if by_dirs else ("PushedFilters: [IsNotNull(sale_date), EqualTo(sale_date" in plan)
        assert q.first()["transactions"] == 2
    today = A.daily_sales_kpis(seed.sales).first()
    assert today["transactions"] == 0 and today["revenue"] == Decimal("0.00")


def test_price_overflow_is_an_error(spark, seed):
    reqs = spark.createDataFrame(
        [(1, "INSERT", None, "Gold", "Lux", 1, Decimal("123456789012.50"), "", "")],
        "request_id long, op string, id long, name string, category string, quantity int, "
        "price decimal(14,2), supplier string, supplier_contact string")
    res = C.apply_product_changes(seed.products, seed.suppliers, reqs)
    assert [(r["status"], r["id"]) for r in res.outcomes.collect()] == [("ERROR", None)]
    assert res.table.count() == 6


def test_stream_state_across_micro_batches(spark, seed, tmp_path):
    from stockroom.streaming import streams as R
    req = _reqs(spark, [(1, 2), (5, 10), (1, 2), (5, 10), (1, 2), (5, 10), (1, 1)])
    folder = tmp_path / "feed2"
    req.where("request_id <= 3").coalesce(1).write.parquet(str(folder / "a"))
    req.where("request_id > 3").coalesce(1).write.parquet(str(folder / "b"))
    flat = tmp_path / "flat"
    flat.mkdir()
    import glob
    import os
    import shutil
    files = sorted(glob.glob(str(folder / "a" / "*.parquet"))) + sorted(glob.glob(str(folder / "b" / "*.parquet")))
    for i, f in enumerate(files):
        target = flat / f"part-{i}.parquet"
        shutil.copy(f, target)
        os.utime(target, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))   # arrival order
    feed = R.parquet_stream(spark, str(flat), max_files_per_trigger=1)
    out = R.stream_apply_sales(seed.products, feed)
    got = {r["request_id"]: (r["status"], r["left"]) for r in R.read_run(spark, R.run_append(out, "t-r1b"), out.schema).collect()}
    assert got == {1: ("ACCEPTED", 3), 2: ("ACCEPTED", 15), 3: ("ACCEPTED", 1), 4: ("ACCEPTED", 5),
                   5: ("INSUFFICIENT", 1), 6: ("INSUFFICIENT", 5), 7: ("ACCEPTED", 0)}


def test_empty_batches(spark, seed):
    empty_sales_req = spark.createDataFrame([], S.SALE_REQUESTS)
    assert SA.apply_sale_requests(seed.products, empty_sales_req).count() == 0
    assert SA.new_sales_rows(seed.sales, SA.apply_sale_requests(seed.products, empty_sales_req)).count() == 0
    empty_changes = spark.createDataFrame([], S.PRODUCT_CHANGES)
    res = C.apply_product_changes(seed.products, seed.suppliers, empty_changes)
    assert res.table.count() == 6 and res.outcomes.count() == 0 and res.suppliers.count() == 4
    res = C.apply_employee_changes(seed.employees, spark.createDataFrame([], S.EMPLOYEE_CHANGES))
    assert res.table.count() == 4
    # inserts into empty tables start at id 1
    no_products = spark.createDataFrame([], S.PRODUCTS_CORE)
    ins = spark.createDataFrame([(1, "INSERT", None, "A", "B", 1, Decimal("1.00"), "", "")], S.PRODUCT_CHANGES)
    res = C.apply_product_changes(no_products, spark.createDataFrame([], S.SUPPLIERS_CORE), ins)
    assert [r["id"] for r in res.table.collect()] == [1]
    req = _reqs(spark, [(1, 1)])
    assert [r["status"] for r in SA.apply_sale_requests(no_products, req).collect()] == ["NOT_FOUND"]


def test_daily_kpis_append_watermark_drops_late_rows(spark, seed, tmp_path):
    import glob
    import os
    import shutil

    from pyspark.sql import functions as F

    from stockroom.streaming import streams as R
    day = dt.datetime(2024, 3, 10, 12, 0)
    # Spark filters late rows with the previous batch's watermark, so the 10th is
    # emitted (and its state evicted) in the third batch; the fourth one is late.
    batches = [day, day + dt.timedelta(days=3), day + dt.timedelta(days=3, hours=1),
               day + dt.timedelta(hours=2)]
    flat = tmp_path / "sales-stream"
    flat.mkdir()
    for i, ts in enumerate(batches):
        part = tmp_path / f"b{i}"
        (seed.sales.withColumn("sale_timestamp", F.lit(ts).cast("timestamp_ntz"))
         .withColumn("sale_date", F.lit(ts.date())).coalesce(1).write.parquet(str(part)))
        target = flat / f"part-{i}.parquet"
        shutil.copy(glob.glob(str(part / "*.parquet"))[0], target)
        os.utime(target, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))   # arrival order
    agg = R.stream_daily_kpis(R.parquet_stream(spark, str(flat), max_files_per_trigger=1))
    got = R.read_run(spark, R.run_append(agg, "t-r2-append"), agg.schema).collect()
    # only the 10th has closed (watermark = 12th 12:00); the late rows for it were dropped
    assert [(r["day"], r["revenue"], r["transactions"]) for r in got] == \
        [(dt.date(2024, 3, 10), Decimal("74.95"), 2)]


def test_username_free_after_delete(spark, seed):
    reqs = spark.createDataFrame([
        (1, "INSERT", None, "Early", "jane", "cashier"),      # jane still employed → duplicate
        (2, "DELETE", 4, None, None, None),                    # Jane Smith leaves
        (3, "INSERT", None, "New Jane", "jane", "cashier"),   # now free
        (4, "UPDATE", 2, "Sys", "owner", "admin"),            # owner still employed → duplicate
    ], S.EMPLOYEE_CHANGES)
    res = C.apply_employee_changes(seed.employees, reqs)
    out = {r["request_id"]: r["status"] for r in rows(res.outcomes)}
    assert out == {1: "DUPLICATE", 2: "DELETED", 3: "INSERTED", 4: "DUPLICATE"}
    assert sorted(r["username"] for r in rows(res.table)) == ["admin", "cashier", "jane", "owner"]


def test_touch_updated_at_is_zone_free(spark, seed):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        out = C.touch_updated_at(seed.products, F_col("id") == 1, dt.datetime(2024, 1, 1, 9, 30),
                                 F_col("id") == 1)
        r = out.where("id = 1").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r["updated_at"] == dt.datetime(2024, 1, 1, 9, 30) == r["created_at"]


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)


def test_rank_within_group_equals_window_on_skew(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 5 == 0, F.lit(None).cast("string"))
         .when(F.col("id") % 7 == 0, F.lit("small"))
         .otherwise(F.lit("hot")).alias("g"),
        (F.col("id") * 7919 % 3001).alias("k"), F.col("id"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # keep 13 ranges: a group spans many
    try:
        got = C.rank_within_group(df, ["g"], ["k", "id"]).select("id", "position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("id", "position").collect()))


@pytest.mark.parametrize("stock_mult,qty_choices", [
    (20_000, [1, 2, 3, 7, 30, 400, 0]),          # big stock: long accepted prefix, small tail
    (200_000, [50_000, 90_000, 1, 0]),           # huge quantities: tail above the table cap
])
def test_hot_split_big_stock_equals_single_task(spark, seed, stock_mult, qty_choices):
    import random

    from pyspark.sql import functions as F
    rnd = random.Random(11)
    prods = seed.products.withColumn("quantity", (F.col("quantity") * stock_mult).cast("int"))
    items = [(rnd.choice([1, 1, 3, 5, 2]), rnd.choice(qty_choices)) for _ in range(900)]
    req = _reqs(spark, items)
    key = ["request_id", "status", "stock_before", "left"]
    single = sorted(map(tuple, SA.apply_sale_requests(prods, req, hot_rows=None).select(*key).collect()))
    split = sorted(map(tuple, SA.apply_sale_requests(prods, req, n_partitions=6, hot_rows=30)
                       .select(*key).collect()))
    assert split == single
    assert "ACCEPTED" in {s[1] for s in single}


def test_hot_split_with_overflow_row(spark, seed):
    from pyspark.sql import functions as F
    prods = (seed.products.withColumn("quantity", F.lit(5_000_000))
             .withColumn("price", F.when(F.col("id") == 1, F.lit(Decimal("99999.99")))
                         .otherwise(F.col("price")).cast("decimal(10,2)")))
    items = [(1, 3)] * 40 + [(1, 2000)] + [(1, 3)] * 40 + [(1, 1200)] + [(1, 5)] * 40
    req = _reqs(spark, items)
    key = ["request_id", "status", "stock_before", "left"]
    single = sorted(map(tuple, SA.apply_sale_requests(prods, req, hot_rows=None).select(*key).collect()))
    split = sorted(map(tuple, SA.apply_sale_requests(prods, req, n_partitions=4, hot_rows=10)
                       .select(*key).collect()))
    assert split == single
    assert {"AMOUNT_OVERFLOW", "ACCEPTED"} <= {s[1] for s in single}


@pytest.mark.parametrize("choices,stock", [
    ([1, 2, 3], 700), ([30_000, 50_000, 120_000, 1, 25_000, 999_999], 2_000_000), ([10 ** 9, 2 ** 30, 7, 10 ** 8], 2 ** 31 - 1),
    ([2 ** k for k in range(8)], 2 ** 9 + 5), ([3], 0), ([3], -4)])
def test_hot_products_of_any_quantity(spark, choices, stock):
    """Large quantities in several tasks; none holds a product."""
    import random
    rnd = random.Random(len(choices))
    prods = spark.createDataFrame([(p, f"p{p}", "c", stock - 3 * p if stock > 9 else stock, Decimal("0.01"), None)
                                   for p in range(3)], S.PRODUCTS_CORE)
    req = _reqs(spark, [(rnd.choice([0, 0, 0, 1, 2]), rnd.choice(choices)) for _ in range(600)])
    key = ["request_id", "status", "stock_before", "left"]
    single = sorted(map(tuple, SA.apply_sale_requests(prods, req, hot_rows=None).select(*key).collect()))
    split = SA.apply_sale_requests(prods, req, n_partitions=6, hot_rows=20)
    assert sorted(map(tuple, split.select(*key).collect())) == single


def test_cli(tmp_path, capsys):
    from stockroom.__main__ import main
    assert main(["list"]) == 0
    assert "apply_sale_requests" in capsys.readouterr().out
    assert main(["sql", "DELETE FROM products", "--sf-dir", "/root/testdata/sf0.001"]) == 2
    out = tmp_path / "by_cat"
    assert main(["sql", "SELECT category, COUNT(*) AS n FROM products GROUP BY category",
                 "--sf-dir", "/root/testdata/sf0.001", "--out", str(out), "--format", "csv"]) == 0
    assert any(p.name.endswith(".csv") for p in out.iterdir())
    assert main(["query", "revenue_by_category", "--sf-dir", "/root/testdata/sf0.001", "--show", "3"]) == 0


def _simulate(stock: dict, reqs: list) -> dict:
    """Brute force: apply requests one by one in (ts, request_id) order."""
    left = dict(stock)
    out = {}
    for rid, pid, q, ts in sorted(reqs, key=lambda r: (r[3], r[0])):
        if q is None or q < 1:
            out[rid] = ("INVALID_QUANTITY", None)
        elif pid not in left:
            out[rid] = ("NOT_FOUND", None)
        elif left[pid] == 0:
            out[rid] = ("OUT_OF_STOCK", 0)
        elif left[pid] < q:
            out[rid] = ("INSUFFICIENT", left[pid])
        else:
            left[pid] -= q
            out[rid] = ("ACCEPTED", left[pid])
    return out


@pytest.mark.parametrize("seed_value", [1, 2])
def test_sale_fold_against_brute_force(spark, seed_value):
    import random
    rnd = random.Random(seed_value)
    stock = {pid: rnd.choice([0, 1, 5, 40, 300, -2]) for pid in range(1, 6)}
    products = spark.createDataFrame(
        [(pid, f"p{pid}", "c", s, Decimal("1.50"), None) for pid, s in stock.items()], S.PRODUCTS_CORE)
    t0 = dt.datetime(2024, 1, 1)
    reqs = [(i, rnd.choice([1, 2, 3, 4, 5, 9]), rnd.choice([None, -1, 0, 1, 2, 3, 5, 8, 13]),
             t0 + dt.timedelta(minutes=rnd.randint(0, 50))) for i in range(1, 401)]
    df = spark.createDataFrame([(r, p, q, ts, None) for r, p, q, ts in reqs], S.SALE_REQUESTS)
    want = _simulate(stock, reqs)
    for hot_rows in (None, 15):
        got = {r["request_id"]: (r["status"], r["left"]) for r in
               SA.apply_sale_requests(products, df, n_partitions=5, hot_rows=hot_rows).collect()}
        assert got == want, hot_rows


def _simulate_products(products: list, suppliers: list, reqs: list):
    """Brute force: the product API applied one request at a time."""
    sup = {name: [sid, contact] for sid, name, contact in suppliers}
    next_sid = max([s[0] for s in suppliers] or [0]) + 1
    rows = {p[0]: list(p) for p in products}
    next_pid = max(list(rows) or [0]) + 1
    out = {}
    for rid, op, pid, name, cat, qty, price, supplier, contact in sorted(reqs):
        sid = None
        if op in ("INSERT", "UPDATE") and supplier:
            c = contact or "info@" + "".join(supplier.lower().split()) + ".com"
            if supplier in sup:
                sup[supplier][1] = c
            else:
                sup[supplier] = [next_sid, c]
                next_sid += 1
            sid = sup[supplier][0]
        if op == "INSERT":
            rows[next_pid] = [next_pid, name, cat, qty, price, sid]
            out[rid] = ("INSERTED", next_pid)
            next_pid += 1
        elif op == "UPDATE":
            if pid in rows:
                rows[pid] = [pid, name, cat, qty, price, sid]
                out[rid] = ("UPDATED", pid)
            else:
                out[rid] = ("NO_MATCH", pid)
        else:
            out[rid] = ("DELETED", pid) if rows.pop(pid, None) is not None else ("NO_MATCH", pid)
    return rows, {n: tuple(v) for n, v in sup.items()}, out


@pytest.mark.parametrize("seed_value", [5, 6])
def test_product_changes_against_brute_force(spark, seed, seed_value):
    import random
    rnd = random.Random(seed_value)
    base = [tuple(r) for r in seed.products.collect()]
    sups = [tuple(r) for r in seed.suppliers.collect()]
    reqs = []
    for rid in range(1, 121):
        op = rnd.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        pid = None if op == "INSERT" else rnd.randint(1, 14)        # hits base and inserted ids
        reqs.append((rid * 3, op, pid, f"n{rid}", rnd.choice(["A", "B"]), rnd.randint(0, 30),
                     Decimal(rnd.randint(100, 9999)) / 100,
                     rnd.choice(["", "PaperHub", "New Co", "Other Co"]),
                     rnd.choice(["", f"c{rid}@x.com"])))
    rows, sup, want = _simulate_products(base, sups, reqs)
    res = C.apply_product_changes(seed.products, seed.suppliers, spark.createDataFrame(reqs, S.PRODUCT_CHANGES))
    got = {r["request_id"]: (r["status"], r["id"]) for r in res.outcomes.collect()}
    assert got == want
    assert sorted(tuple(r) for r in res.table.collect()) == sorted(tuple(v) for v in rows.values())
    assert {r["name"]: (r["id"], r["contact_email"]) for r in res.suppliers.collect()} == sup


def test_cli_on_stored_tables(spark, seed, tmp_path, capsys):
    from stockroom.__main__ import main
    from stockroom.sources.tables import write_retail_tables
    root = str(tmp_path / "stored")
    write_retail_tables(seed, root)
    out = tmp_path / "low"
    assert main(["sql", "SELECT id, stock_status FROM v_inventory_with_supplier WHERE stock_status <> 'OK'",
                 "--tables", root, "--out", str(out), "--format", "json"]) == 0
    got = spark.read.json(str(out)).orderBy("id").collect()
    assert [(r["id"], r["stock_status"]) for r in got] == [
        (1, "LOW STOCK"), (2, "LOW STOCK"), (4, "OUT OF STOCK"), (6, "LOW STOCK")]
