"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query derives the retail tables from the star-schema test data through
the adapters and applies one operator to the whole tables.  Parameters are
fixed here (``AS_OF`` is a fixed date inside the test data's range, never the
wall clock).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import aggregates as A
from stockroom.operators import joins as J
from stockroom.operators import listings as L
from stockroom.sources.adapters import RetailTables, load_retail_from_star

AS_OF = dt.date(1998, 6, 1)

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str) -> RetailTables:
    return load_retail_from_star(spark, sf_dir)


def _q(fn: Callable[[RetailTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_t(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def _supplier_detail_json(t: RetailTables) -> DataFrame:
    d = A.supplier_detail(t.products, t.suppliers)
    return d.select("supplier", "contact", "contact_text", "n_items",
                    F.to_json("items").alias("items_json"))


REPORTS: dict[str, Query] = {
    # S1–S4
    "scan_products": _q(lambda t: L.scan_products(t.products)),
    "scan_sales": _q(lambda t: L.scan_sales(t.sales)),
    "scan_suppliers": _q(lambda t: L.scan_suppliers(t.suppliers)),
    "scan_employees": _q(lambda t: L.scan_employees(t.employees)),
    # P1–P11
    "sales_list": _q(lambda t: L.sales_list(t.sales)),
    "product_list": _q(lambda t: L.product_list(t.products, t.suppliers)),
    "supplier_list": _q(lambda t: L.supplier_list(t.suppliers)),
    "employee_roster": _q(lambda t: L.employee_roster(t.employees)),
    "employee_roster_labels": _q(lambda t: L.employee_roster_labels(t.employees)),
    "supplier_per_product": _q(lambda t: L.supplier_per_product(t.products, t.suppliers)),
    "sellable_products": _q(lambda t: L.sellable_products(t.products)),
    "sale_quote": _q(lambda t: L.sale_quote(t.products, t.sale_requests)),
    "inventory_value_lines": _q(lambda t: L.inventory_value_lines(t.products)),
    "inventory_status_lines": _q(lambda t: L.inventory_status_lines(t.products, t.suppliers)),
    "lookup_by_key": _q(lambda t: L.lookup_by_key(t.products, t.sale_requests, "id", "product_id")),
    "supplier_ids_by_name": _q(lambda t: L.supplier_ids_by_name(t.suppliers, t.product_changes)),
    # F1–F7, X11
    "low_stock_items": _q(lambda t: L.low_stock_items(t.products, t.suppliers)),
    "out_of_stock_items": _q(lambda t: L.out_of_stock_items(t.products, t.suppliers)),
    "stock_alerts": _q(lambda t: L.stock_alerts(t.products, t.suppliers)),
    "stock_with_status": _q(lambda t: L.stock_with_status(t.products, t.suppliers, "LOW STOCK")),
    "stock_with_status_out": _q(lambda t: L.stock_with_status(t.products, t.suppliers, "OUT OF STOCK")),
    "quantity_below": _q(lambda t: L.quantity_below(t.products, 10)),
    "sales_on_date": _q(lambda t: L.sales_on_date(t.sales, AS_OF)),
    "sales_on_date_list": _q(lambda t: L.sales_on_date_list(t.sales, AS_OF)),
    "sales_clock_list": _q(lambda t: L.sales_clock_list(t.sales, AS_OF)),
    # T1
    "recent_transactions": _q(lambda t: L.recent_transactions(t.sales, 8)),
    # J1–J4
    "inventory_with_supplier": _q(lambda t: J.inventory_with_supplier(t.products, t.suppliers)),
    "sales_report": _q(lambda t: J.sales_report(t.sales, t.employees)),
    "products_by_supplier": _q(lambda t: J.products_by_supplier(t.products, t.suppliers)),
    "products_by_supplier_items": _q(lambda t: J.products_by_supplier_items(t.products, t.suppliers)),
    "supplier_products_items": _q(lambda t: J.supplier_products_items(t.products, t.suppliers)),
    "supplier_info_items": _q(lambda t: A.supplier_info_items(t.products, t.suppliers)),
    "supplier_products": _q(lambda t: J.supplier_products(t.products, t.suppliers)),
    # A1–A19
    "revenue_by_category": _q(lambda t: A.revenue_by_category(t.sales)),
    "revenue_by_product": _q(lambda t: A.revenue_by_product(t.sales)),
    "total_revenue": _q(lambda t: A.total_revenue(t.sales)),
    "revenue_totals": _q(lambda t: A.revenue_totals(t.sales)),
    "inventory_by_category": _q(lambda t: A.inventory_by_category(t.products)),
    "category_sales": _q(lambda t: A.category_sales(t.sales)),
    "product_sales": _q(lambda t: A.product_sales(t.sales)),
    "category_units": _q(lambda t: A.category_units(t.products)),
    "sales_statement": _q(lambda t: A.sales_statement(t.sales)),
    "inventory_statement": _q(lambda t: A.inventory_statement(t.products)),
    "owner_sales_kpis": _q(lambda t: A.owner_sales_kpis(t.sales)),
    "owner_inventory_kpis": _q(lambda t: A.owner_inventory_kpis(t.products)),
    "daily_sales_kpis": _q(lambda t: A.daily_sales_kpis(t.sales, AS_OF)),
    "cashier_inventory_kpis": _q(lambda t: A.cashier_inventory_kpis(t.products)),
    "supplier_count": _q(lambda t: A.supplier_count(t.products, t.suppliers)),
    "supplier_info": _q(lambda t: A.supplier_info(t.products, t.suppliers)),
    "supplier_detail": _q(_supplier_detail_json),
    "supplier_detail_items": _q(lambda t: A.supplier_detail_items(t.products, t.suppliers)),
    "alert_badge_count": _q(lambda t: A.alert_badge_count(t.products)),
    "stock_notifications": _q(lambda t: A.stock_notifications(t.products)),
    "stock_notification_items": _q(lambda t: A.stock_notification_items(t.products)),
}


def all_queries() -> dict[str, Query]:
    from stockroom.plans.registry_jobs import JOBS      # imports this module's helpers
    return {**REPORTS, **JOBS}
