"""The streaming ledger: restarts, order, chunks, products without stock; closed days."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from stockroom import schemas as S
from stockroom.operators import sales as SA
from stockroom.streaming import streams as R

T0 = dt.datetime(2024, 3, 15, 9)
KEY = ["request_id", "product_id", "quantity", "cashier_id", "ts", "status", "stock_before", "left", "message",
       "product_name", "unit_price", "total_amount", "sale_date"]


def requests(spark, items, start=1):
    """(product, quantity, minute) rows, given in no order."""
    rows = [(start + i, p, q, T0 + dt.timedelta(minutes=m), c) for i, (p, q, m, c) in enumerate(items)]
    random.Random(start).shuffle(rows)
    return spark.createDataFrame(rows, S.SALE_REQUESTS)


def some(r, n, base=0):
    return [(r.choice([1, 1, 1, 2, 3, 5, 99, None]), r.choice([None, 0, -1, 1, 2, 3, 40]), base + r.randrange(n),
             r.choice([None, 2 ** 53 + 1, 7])) for _ in range(n)]


def shown(df):
    return sorted(map(str, df.select(*KEY).collect()))


def test_restart_goes_on_with_the_stock(spark, seed, tmp_path):
    """Two runs from one checkpoint equal the batch job over both parts, the later part after the earlier."""
    r, folder = random.Random(5), str(tmp_path / "feed")
    products = seed.products.withColumn("quantity", F.col("quantity") * 9)
    one, two = requests(spark, some(r, 300)), requests(spark, some(r, 300, base=1000), start=1000)
    one.write.parquet(folder)
    out = R.stream_apply_sales(products, R.parquet_stream(spark, folder))
    run = R.run_append(out, "ledger")
    first = R.read_run(spark, run, out.schema)
    assert shown(first) == shown(SA.apply_sale_requests(products, one))
    two.write.mode("append").parquet(folder)
    again = R.run_append(R.stream_apply_sales(products, R.parquet_stream(spark, folder)), "ledger", run=run)
    assert again == run
    both = R.read_run(spark, run, out.schema)
    assert shown(both) == shown(SA.apply_sale_requests(products, one.unionByName(two)))
    assert {x.status for x in both.select("status").distinct().collect()} >= {
        "ACCEPTED", "INSUFFICIENT", "OUT_OF_STOCK", "INVALID_QUANTITY", "NOT_FOUND"}
    # nothing new: nothing comes out
    R.run_append(R.stream_apply_sales(products, R.parquet_stream(spark, folder)), "ledger", run=run)
    assert R.read_run(spark, run, out.schema).count() == 600


def test_many_chunks_of_one_product(spark, seed, tmp_path, monkeypatch):
    """A product whose requests come in many Arrow chunks and go out in many slices."""
    monkeypatch.setattr(R, "SLICE_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        r = random.Random(2)
        products = seed.products.withColumn("quantity", F.lit(400)).withColumn(
            "price", F.when(F.col("id") == 1, F.lit(Decimal("99999999.99"))).otherwise(F.col("price")).cast("decimal(10,2)"))
        feed = requests(spark, [(r.choice([1, 3]), r.choice([1, 1, 2, 300]), r.randrange(500), None) for _ in range(400)])
        feed.write.parquet(str(tmp_path / "feed"))
        out = R.stream_apply_sales(products, R.parquet_stream(spark, str(tmp_path / "feed")))
        got = R.read_run(spark, R.run_append(out, "ledger"), out.schema)
        assert shown(got) == shown(SA.apply_sale_requests(products, feed))
        assert got.where("status = 'AMOUNT_OVERFLOW'").count() > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_feed_is_read_once(spark, seed, tmp_path):
    requests(spark, [(1, 1, 1, None)]).write.parquet(str(tmp_path / "feed"))
    out = R.stream_apply_sales(seed.products, R.parquet_stream(spark, str(tmp_path / "feed")))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1 and "TransformWithState" in plan


def test_a_product_that_came_later_starts_with_its_own_stock(spark, seed, tmp_path):
    folder = str(tmp_path / "feed")
    requests(spark, [(5, 1, 1, None)]).write.parquet(folder)
    out = R.stream_apply_sales(seed.products, R.parquet_stream(spark, folder))
    run = R.run_append(out, "ledger")
    more = seed.products.unionByName(spark.createDataFrame([(50, "New", "N", 3, Decimal("1.00"), None)], S.PRODUCTS_CORE))
    requests(spark, [(50, 2, 5, None), (50, 2, 6, None), (5, 24, 7, None)], start=10).write.mode("append").parquet(folder)
    R.run_append(R.stream_apply_sales(more, R.parquet_stream(spark, folder)), "ledger", run=run)
    got = {x.request_id: (x.status, x.left) for x in R.read_run(spark, run, out.schema).collect()}
    assert got == {1: ("ACCEPTED", 24), 10: ("ACCEPTED", 1), 11: ("INSUFFICIENT", 1), 12: ("ACCEPTED", 0)}
