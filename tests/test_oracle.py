"""Every registered query against its DuckDB oracle on the smallest test data."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from stockroom.plans.oracle import ORACLE_SQL
from stockroom.plans.registry import all_queries
from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "stock_status" in df.columns


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_oracle(spark, con, name):
    df = all_queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE_SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_sale_fold_properties(spark):
    """Per product: start = left + Σ accepted, stock never negative; Σ A1 = A3."""
    from pyspark.sql import functions as F
    res = all_queries()["apply_sale_requests"](spark, SF)
    prods = all_queries()["scan_products"](spark, SF).select(F.col("id").alias("product_id"),
                                                         F.col("quantity").alias("start"))
    per = (res.where("status = 'ACCEPTED'").groupBy("product_id")
           .agg(F.sum("quantity").alias("sold"), F.min("left").alias("min_left")))
    bad = per.join(prods, "product_id").where(
        (F.col("min_left") < 0) | (F.col("start") - F.col("sold") < 0))
    assert bad.count() == 0
    after = all_queries()["stock_after_sales"](spark, SF).select(F.col("id").alias("product_id"), "quantity")
    mismatch = (per.join(prods, "product_id").join(after, "product_id")
                .where(F.col("quantity") != F.col("start") - F.col("sold")))
    assert mismatch.count() == 0
    cat = all_queries()["revenue_by_category"](spark, SF).agg(F.sum("total_revenue")).first()[0]
    assert cat == all_queries()["total_revenue"](spark, SF).first()[0]
