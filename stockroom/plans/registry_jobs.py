"""Registered change and sale jobs (M1–M13) over the test-data request feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import changes as C
from stockroom.operators import sales as S
from stockroom.operators.listings import product_list
from stockroom.plans.console import adhoc_sql, result_meta
from stockroom.plans.registry import Query, _q
from stockroom.session import scratch_path
from stockroom.sources.adapters import (RetailTables, broken_employees, broken_products, broken_sales, broken_suppliers,
                                        closed_suppliers, load_retail_from_star, recased_product_changes,
                                        typed_product_changes)
from stockroom.sources.catalog import register_views
from stockroom.sources.sinks import read_report, write_report
from stockroom.sources.versions import apply_batches, id_marks
from stockroom.streaming import streams as R

AS_OF_TS = dt.datetime(1998, 6, 1, 0, 0, 0)


def _product_changes(t: RetailTables) -> C.ChangeResult:
    return C.apply_product_changes(t.products, t.suppliers, t.product_changes)


def _employee_changes(t: RetailTables) -> C.ChangeResult:
    return C.apply_employee_changes(t.employees, t.employee_changes)


def _sale_results(t: RetailTables) -> DataFrame:
    return S.apply_sale_requests(t.products, t.sale_requests)


def _outcome_counts(t: RetailTables) -> DataFrame:
    """Requests, outcome rows and answered request ids of both change feeds."""
    def counts(feed: str, requests: DataFrame, outcomes: DataFrame) -> DataFrame:
        asked = requests.select(F.lit(1).alias("asked"), F.lit(0).alias("got"), F.lit(None).cast("bigint").alias("id"))
        got = outcomes.select(F.lit(0), F.lit(1), "request_id")
        return asked.union(got).agg(
            F.lit(feed).alias("feed"), F.sum("asked").alias("requests"), F.sum("got").alias("outcomes"),
            F.count_distinct("id").alias("answered"))

    return (counts("product", t.product_changes, _product_changes(t).outcomes)
            .unionByName(counts("employee", t.employee_changes, _employee_changes(t).outcomes)))


def _marks(t: RetailTables) -> DataFrame:
    """The last id of every table after both change batches and the sale requests."""
    return id_marks(apply_batches(t, {}, t.product_changes, t.employee_changes, t.sale_requests)[1])


JOBS: dict[str, Query] = {
    "request_outcomes_complete": _q(_outcome_counts),
    "upsert_suppliers": _q(lambda t: C.upsert_suppliers(t.suppliers, t.product_changes)),
    "upsert_suppliers_any_case": _q(lambda t: C.upsert_suppliers(
        t.suppliers, recased_product_changes(t.product_changes), collation="UTF8_LCASE")),
    "apply_product_changes": _q(lambda t: _product_changes(t).table),
    "product_change_outcomes": _q(lambda t: _product_changes(t).outcomes),
    "assign_ids": _q(lambda t: C.assign_ids(
        t.product_changes.where(F.col("op") == "INSERT").select("request_id"),
        C.max_id(t.products))),
    "delete_cascade_null": _q(lambda t: C.delete_cascade_null(
        t.sales, "product_id", _product_changes(t).deleted_ids)),
    # both keys of sales in one scan, and the supplier key of products
    "cascade_sales_keys": _q(lambda t: C.cascade_deletes(
        t.sales, {"product_id": _product_changes(t).deleted_ids, "cashier_id": _employee_changes(t).deleted_ids})),
    "cascade_product_suppliers": _q(lambda t: C.cascade_deletes(t.products, {"supplier_id": closed_suppliers(t.suppliers)})),
    "id_marks_after_changes": _q(_marks),
    "touch_updated_at": _q(lambda t: C.apply_product_changes(
        t.products, t.suppliers, t.product_changes, as_of_ts=AS_OF_TS).table),
    "apply_employee_changes": _q(lambda t: _employee_changes(t).table),
    "employee_change_outcomes": _q(lambda t: _employee_changes(t).outcomes),
    "validate_products": _q(lambda t: C.validate_table(
        "products", t.products, {"suppliers": t.suppliers})),
    # rows that break every rule, derived from the whole tables
    "validate_broken_products": _q(lambda t: C.validate_table(
        "products", broken_products(t.products), {"suppliers": t.suppliers})),
    "validate_broken_suppliers": _q(lambda t: C.validate_table("suppliers", broken_suppliers(t.suppliers))),
    "validate_broken_employees": _q(lambda t: C.validate_table("employees", broken_employees(t.employees))),
    "validate_broken_sales": _q(lambda t: C.validate_table(
        "sales", broken_sales(t.sales), {"products": t.products, "employees": t.employees})),
    "validate_typed_product_requests": _q(lambda t: C.validate_product_requests(
        typed_product_changes(t.product_changes))),
    # sales checked against the tables after the change batches, without the
    # cascade: rows of deleted products and cashiers are reported as orphans
    "validate_sales_after_changes": _q(lambda t: C.validate_table(
        "sales", t.sales, {"products": _product_changes(t).table,
                           "employees": _employee_changes(t).table})),
    "validate_employees_after_changes": _q(lambda t: C.validate_table(
        "employees", _employee_changes(t).table)),
    "validate_product_requests": _q(lambda t: C.validate_product_requests(t.product_changes)),
    "validate_employee_requests": _q(lambda t: C.validate_employee_requests(t.employee_changes)),
    "validate_sale_requests": _q(lambda t: C.validate_sale_requests(t.sale_requests)),
    "apply_sale_requests": _q(_sale_results),
    # the same job with the hot-product split path taken by every product that
    # has more than 10 requests (exercises the multi-task fold on whole data)
    "apply_sale_requests_split_hot": _q(lambda t: S.apply_sale_requests(
        t.products, t.sale_requests, hot_rows=10)),
    "stock_after_sales": _q(lambda t: S.stock_after_sales(t.products, _sale_results(t))),
    "new_sales_rows": _q(lambda t: S.new_sales_rows(t.sales, _sale_results(t))),
}


# --- console and sinks (S5, S8–S10) ----------------------------------------------


# Console statements (fixed): the "By Category" and "Revenue by Product" quick
# queries, and the low-stock view filter.
BY_CATEGORY_SQL = ("SELECT category, CAST(SUM(quantity) AS BIGINT) AS total_units, "
                   "CAST(SUM(quantity * price) AS DECIMAL(38,2)) AS value FROM products GROUP BY category;")
REVENUE_BY_PRODUCT_SQL = "SELECT * FROM v_revenue_by_product;"
LOW_STOCK_SQL = "SELECT * FROM v_inventory_with_supplier WHERE stock_status = 'LOW STOCK';"


def _console(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, load_retail_from_star(spark, sf_dir))
        return adhoc_sql(spark, sql).df
    return run


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_meta(_console(LOW_STOCK_SQL)(spark, sf_dir))


def _write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_retail_from_star(spark, sf_dir)
    df = product_list(t.products, t.suppliers)
    path = write_report(df, scratch_path(spark, "report"), "json")
    return read_report(spark, path, df.schema, "json")


JOBS.update({
    "adhoc_sql": _console(BY_CATEGORY_SQL),
    "register_views": _console(REVENUE_BY_PRODUCT_SQL),
    "result_meta": _meta,
    "write_report": _write_report,
})


# --- streams (R1–R4), each run to completion with an availableNow trigger ------


def _r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_retail_from_star(spark, sf_dir)
    out = R.stream_apply_sales(t.products, R.feed_stream(spark, sf_dir))
    return R.read_run(spark, R.run_append(out, "apply-sales"), out.schema)


def _r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = R.stream_daily_kpis(R.sales_stream(spark, sf_dir))
    return R.read_run(spark, R.run_complete(agg, "daily-kpis"), agg.schema)


def _r2_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a day comes out once, when the watermark has passed it, and its state goes."""
    agg = R.stream_daily_kpis(R.sales_stream(spark, sf_dir))
    return R.read_run(spark, R.run_append(agg, "daily-kpis-closed"), agg.schema)


def _r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = R.stream_revenue_by_category(R.sales_stream(spark, sf_dir))
    return R.read_run(spark, R.run_complete(agg, "revenue-by-category"), agg.schema)


def _r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load_retail_from_star(spark, sf_dir)
    alerts = R.stream_stock_alerts(R.stream_apply_sales(t.products, R.feed_stream(spark, sf_dir)))
    return R.read_run(spark, R.run_append(alerts, "stock-alerts"), alerts.schema)


JOBS.update({
    "stream_apply_sales": _r1,
    "stream_daily_kpis": _r2,
    "stream_daily_kpis_closed": _r2_closed,
    "stream_revenue_by_category": _r3,
    "stream_stock_alerts": _r4,
})
