"""Catalog: the four tables and four reporting views as Spark temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockroom.operators.aggregates import revenue_by_category, revenue_by_product
from stockroom.operators.joins import inventory_with_supplier, sales_report
from stockroom.sources.adapters import RetailTables

VIEW_NAMES = ("employees", "suppliers", "products", "sales", "v_sales_report",
              "v_revenue_by_category", "v_revenue_by_product", "v_inventory_with_supplier")


def register_views(spark: SparkSession, t: RetailTables) -> list[str]:
    """Create or replace the table views and the four reporting views."""
    views: dict[str, DataFrame] = {
        "employees": t.employees.drop("password"),
        "suppliers": t.suppliers,
        "products": t.products,
        "sales": t.sales,
        "v_sales_report": sales_report(t.sales, t.employees),
        "v_revenue_by_category": revenue_by_category(t.sales),
        "v_revenue_by_product": revenue_by_product(t.sales),
        "v_inventory_with_supplier": inventory_with_supplier(t.products, t.suppliers),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def show_tables(spark: SparkSession) -> DataFrame:
    """SHOW TABLES (namespace, tableName, isTemporary) restricted to ours."""
    pattern = "|".join(VIEW_NAMES)
    return spark.sql(f"SHOW TABLES LIKE '{pattern}'")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """DESCRIBE <table> (col_name, data_type, comment)."""
    if name not in VIEW_NAMES:
        raise ValueError(f"unknown table {name!r}")
    return spark.sql(f"DESCRIBE {name}")
