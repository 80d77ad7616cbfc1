"""Stored versions with id marks; cascades of several keys in one scan."""

from decimal import Decimal

from pyspark.sql import functions as F

from stockroom import schemas as S
from stockroom.operators import changes as C
from stockroom.sources import versions as V


def test_ids_survive_runs(spark, seed, tmp_path):
    """The top row of every table is deleted in one run; the next run does not use its id again."""
    root = str(tmp_path / "store")
    assert V.latest_version(spark, root) == 0
    V.first_version(seed, root)
    products = spark.createDataFrame([
        (1, "INSERT", None, "Lamp", "F", 1, Decimal("1.00"), "New Co", ""), (2, "DELETE", 7, None, None, None, None, None, None),
        (3, "DELETE", 1, None, None, None, None, None, None)], S.PRODUCT_CHANGES)
    employees = spark.createDataFrame([
        (1, "INSERT", None, "A", "a", ""), (2, "INSERT", None, "B", "a", ""), (3, "DELETE", 5, None, None, None),
        (4, "DELETE", 3, None, None, None)], S.EMPLOYEE_CHANGES)
    assert V.run_batches(spark, root, product_changes=products, employee_changes=employees) == 2
    tables, marks = V.read_version(spark, root)
    assert marks == {"products": 7, "suppliers": 5, "employees": 6, "sales": 2}
    assert {r.id for r in tables.products.collect()} == {2, 3, 4, 5, 6}
    # both keys of the sale of product 1 by cashier 3 are gone, the row stays
    assert {(r.id, r.product_id, r.cashier_id) for r in tables.sales.collect()} == {(1, None, None), (2, 2, None)}
    # the newest supplier goes too, and the last sale
    tables.suppliers = tables.suppliers.where("id < 5")
    tables.sales = tables.sales.where("id < 2")
    V.write_version(tables, {t: spark.createDataFrame([(marks[t],)], "last_id long") for t in marks}, root, 3)
    more = spark.createDataFrame([(1, "INSERT", None, "Cup", "S", 4, Decimal("2.00"), "Other Co", "")], S.PRODUCT_CHANGES)
    hire = spark.createDataFrame([(1, "INSERT", None, "C", "c", "")], S.EMPLOYEE_CHANGES)
    sale = spark.createDataFrame([(1, 8, 1, None, None), (2, 8, 9, None, None)], S.SALE_REQUESTS)
    sale = sale.withColumn("ts", F.lit("2024-03-15 10:00:00").cast("timestamp_ntz"))
    assert V.run_batches(spark, root, product_changes=more, employee_changes=hire, sale_requests=sale) == 4
    tables, marks = V.read_version(spark, root)
    assert marks == {"products": 8, "suppliers": 6, "employees": 7, "sales": 3}
    assert {r.id: r.quantity for r in tables.products.where("id > 6").collect()} == {8: 3}
    assert {r.id for r in tables.suppliers.collect()} == {1, 2, 3, 4, 6}
    assert {r.id for r in tables.employees.collect()} == {1, 2, 4, 7}
    assert {(r.id, r.product_id) for r in tables.sales.collect()} == {(1, None), (3, 8)}


def test_a_version_without_marks_is_not_read(spark, seed, tmp_path):
    root = str(tmp_path / "store")
    V.first_version(seed, root)
    from stockroom.sources.tables import write_table
    write_table(seed.products.limit(0), V.version_path(root, 2), "products")
    assert V.latest_version(spark, root) == 1
    assert V.run_batches(spark, root) == 2
    assert V.read_version(spark, root)[0].products.count() == 6


def test_cascades_of_several_keys(spark):
    child = spark.createDataFrame([(1, 1, 10, "x"), (2, 2, None, "y"), (3, None, 10, "z"), (3, None, None, None), (4, 9, 11, "x")],
                                  "id long, a long, b int, c string")
    for small in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        try:
            out = C.cascade_deletes(child, {"a": spark.createDataFrame([(1,), (1,), (None,), (7,)], "id long"),
                                            "b": spark.createDataFrame([(10,)], "id int")})
            assert out.schema == child.schema
            assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
                (1, None, None, "x"), (2, 2, None, "y"), (3, None, None, "z"), (3, None, None, None), (4, 9, 11, "x")]))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
