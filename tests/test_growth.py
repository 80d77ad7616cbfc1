"""What grows with the data: rows and columns that the large steps move."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from stockroom import schemas as S
from stockroom.operators import changes as C
from stockroom.operators import sales as SA
from stockroom.sources.adapters import sale_requests_from_star
from stockroom.sources.versions import apply_batches

REQUEST = "request_id long, product_id long, quantity int, ts timestamp_ntz, cashier_id long"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def requests_of(spark, products: int, each: int):
    start = dt.datetime(2024, 1, 1)
    rows = [(p * 1000 + i, p, (p * 7 + i * 5) % 12, start + dt.timedelta(minutes=(i * 17) % 41), i % 3)
            for p in range(products) for i in range(each)]
    return spark.createDataFrame(rows, REQUEST)


def products_of(spark, n: int, twice: bool = False):
    rows = [(p, f"Product {p}", f"Kind {p % 4}", 3 + p % 50, Decimal("9.90") + p, None) for p in range(1, n)]
    return spark.createDataFrame(rows + rows[:3] * twice, S.PRODUCTS_CORE)


def test_phases_take_only_products_on_several_slices(spark, monkeypatch):
    """a product that lies in one slice is decided there, whatever their number."""
    seen, phase = [], SA._phase

    def counted(rest, stock, n_products, n_slices):
        seen.append(rest.select("product_id").distinct().count())
        return phase(rest, stock, n_products, n_slices)

    monkeypatch.setattr(SA, "_phase", counted)
    products, requests = products_of(spark, 60), requests_of(spark, 60, 30)
    split = SA.apply_sale_requests(products, requests, n_partitions=5, hot_rows=10)
    whole = SA.apply_sale_requests(products, requests, hot_rows=None)
    assert split.columns == whole.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    assert seen and max(seen) <= 4          # 5 slices have 4 borders


def test_split_fold_with_cold_and_crossing_products(spark):
    """cold products may cross slices too; one product may be all there is."""
    products = products_of(spark, 12)
    one = requests_of(spark, 2, 300).where("product_id = 1")
    for requests, parts in ((one, 40), (one.union(requests_of(spark, 14, 9)), 3)):
        split = SA.apply_sale_requests(products, requests, n_partitions=parts, hot_rows=100)
        whole = SA.apply_sale_requests(products, requests, hot_rows=None)
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_split_fold_sets_odd_products_apart(spark, monkeypatch):
    """products without a stock or with requests equal in order go to the phases."""
    seen, phase = set(), SA._phase

    def noted(rest, *sides):
        seen.update(r.product_id for r in rest.select("product_id").distinct().collect())
        return phase(rest, *sides)

    monkeypatch.setattr(SA, "_phase", noted)
    products, requests = products_of(spark, 9), requests_of(spark, 9, 20).where("quantity > 0")
    products = products.withColumn("quantity", F.when(F.col("id") != 4, F.col("quantity"))).union(products.where("id = 6"))
    split = SA.apply_sale_requests(products, requests, n_partitions=1, hot_rows=10).collect()
    assert seen == {4, 6}
    assert {r.stock_before for r in split if r.product_id == 4} == {None}
    assert sum(r.product_id == 6 for r in split) == 2 * requests.where("product_id = 6").count()
    others = SA.apply_sale_requests(products.where("id not in (4, 6)"), requests, hot_rows=None)
    assert (sorted(str(r) for r in split if r.product_id not in (4, 6))
            == sorted(map(str, others.where("product_id not in (4, 6)").collect())))


def test_requests_are_numbered_by_what_they_hold(spark):
    """the columns that only order equal requests are not shuffled, the rows are all there."""
    line = (7, 1, 11, 3, dt.datetime(2024, 1, 1), 5.0)
    lines = spark.createDataFrame(
        [(*line, 1.0, 0.1, 0.0, "A", "F"), (*line, 2.0, 0.0, 0.1, "N", "O"), (7, 0, 12, 3, line[4], 6.0, 1.0, 0.1, 0.0, "A", "F")],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_quantity double,"
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    out = sale_requests_from_star(lines)
    assert sorted((r.request_id, r.product_id, r.quantity) for r in out.collect()) == [(7001, 12, 6), (7002, 11, 5), (7003, 11, 5)]
    window = plan(out).split("Window", 1)[1]
    assert "l_extendedprice" not in window.split("LogicalRDD")[0]


def test_keys_alone_go_to_the_parents(spark, seed):
    """a row's own rules are decided before its keys are joined to their parents."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.validate_table("sales", seed.sales, {"products": seed.products, "employees": seed.employees})
        joined = plan(out).split("Join LeftOuter")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joined) == 3
    assert "product_name" not in joined[0] and "product_name" not in joined[1]
    assert "product_name" in joined[2]
    assert out.count() == 0


def test_repeated_whole_numbers_and_texts(spark):
    """unique values are counted as they are, numbers and texts alike."""
    rows = [(1, "Ann", "ann", "admin", True), (1, "Bob", "ann", "admin", True), (2, "Cy", "1", "owner", True)]
    out = C.validate_table("employees", spark.createDataFrame(rows, S.EMPLOYEES_CORE))
    assert sorted((r.rule, r.row_key, r.detail) for r in out.collect() if r.rule.startswith("unique")) == [
        ("unique_id", "1", "2 rows"), ("unique_username", "ann", "2 rows")]


def test_sale_ids_are_looked_up_once(spark, seed, tmp_path):
    """the largest stored sale id is found in one scan; the new mark goes on from it."""
    seed.sales.write.parquet(str(tmp_path / "sales"))
    tables = replace(seed, sales=spark.read.parquet(str(tmp_path / "sales")))
    requests = spark.createDataFrame([(1, 1, 2, dt.datetime(2024, 1, 1), 3), (2, 3, 1, dt.datetime(2024, 1, 2), 3)], REQUEST)
    for marks, want in (({}, 4), ({"sales": 10}, 12)):
        after, last = apply_batches(tables, marks, sale_requests=requests)
        assert "parquet" not in plan(last["sales"])
        assert last["sales"].collect()[0].last_id == want
        assert after.sales.count() == 4


def test_the_fold_runs_once_for_new_sales(spark, seed):
    """numbering the accepted rows does not run the requests' fold again."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    requests = spark.createDataFrame([(i, 1 + i % 6, 1, dt.datetime(2024, 1, 1), 3) for i in range(40)], REQUEST)
    results = SA.apply_sale_requests(seed.products, requests)
    new = SA.new_sales_rows(seed.sales, results.mapInPandas(counted, results.schema))
    assert new.count() == results.where("status = 'ACCEPTED'").count()
    assert rows.value == 40
