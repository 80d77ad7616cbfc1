"""Joins (J1–J4).

All joins are equi-joins on integer ids.  No broadcast hint is hard-coded: a
supplier or employee dimension grows with the business (at 100 TB it can hold
billions of rows), so the choice is left to Spark's size check —
``spark.sql.autoBroadcastJoinThreshold`` on the planned size and AQE's
re-plan on the measured shuffle size.  A dimension under the threshold is
broadcast; a larger one falls back to a shuffle join on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import line_value, stock_status

# Fixed separators of the two product lists per supplier.
CHEAT_SHEET_SEPARATOR = ","
CONSOLE_SEPARATOR = ", "


def with_supplier(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """products ⟕ suppliers on supplier_id → adds supplier_name, supplier_contact."""
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier_name"),
                         F.col("contact_email").alias("supplier_contact"))
    return products.join(s, products.supplier_id == s._sid, "left").drop("_sid")


def inventory_with_supplier(products: DataFrame, suppliers: DataFrame,
                            ordered: bool = True) -> DataFrame:
    """The inventory view — stock value, supplier contact and stock status."""
    out = (with_supplier(products, suppliers)
           .select("id", "name", "category", "quantity", "price",
                   line_value("quantity", "price").alias("stock_value"),
                   "supplier_name", "supplier_contact",
                   stock_status("quantity").alias("stock_status")))
    return out.orderBy("category", "name", "id") if ordered else out


def sales_report(sales: DataFrame, employees: DataFrame, ordered: bool = True) -> DataFrame:
    """Sales ⟕ employees on cashier_id, newest first."""
    e = employees.select(F.col("id").alias("_eid"), F.col("name").alias("cashier_name"),
                         F.col("username").alias("cashier_username"))
    out = (sales.join(e, sales.cashier_id == e._eid, "left")
           .select("id", "product_name", "category", "unit_price", "quantity", "total_amount",
                   "sale_date", "sale_timestamp", "cashier_name", "cashier_username"))
    return out.orderBy(F.col("sale_timestamp").desc(), F.col("id").desc()) if ordered else out


def _name_list(sep: str) -> F.Column:
    # Deterministic list order (the source leaves it undefined): category, name, id.
    return F.expr(f"listagg(_pname, '{sep}') WITHIN GROUP (ORDER BY _pcat, _pname, _pid)")


def products_by_supplier(products: DataFrame, suppliers: DataFrame,
                         sep: str = CHEAT_SHEET_SEPARATOR) -> DataFrame:
    """Suppliers that have products, with their product names joined by ``sep``.

    Products are reduced to (supplier_id, id, name, category) before the join,
    and the join key is the grouping key's id, so one shuffle on supplier id
    serves both join and aggregation."""
    p = products.where(F.col("supplier_id").isNotNull()).select(
        F.col("supplier_id").alias("_sid"), F.col("id").alias("_pid"),
        F.col("name").alias("_pname"), F.col("category").alias("_pcat"))
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier"))
    return (p.join(s, "_sid")
            .groupBy("_sid", "supplier")
            .agg(_name_list(sep).alias("products")).drop("_sid"))


def products_by_supplier_items(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """J3, split form: one row per product with its place in its supplier's list."""
    from stockroom.operators.changes import rank_within_group
    p = products.where(F.col("supplier_id").isNotNull()).select(
        F.col("supplier_id").alias("_sid"), "id", F.col("name").alias("product"), "category")
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier"))
    ranked = rank_within_group(p.join(s, "_sid"), ["supplier"], ["category", "product", "id"])
    return ranked.select("supplier", "position", "id", "product")


def supplier_products_items(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """J4, split form: as :func:`products_by_supplier_items`, with one row without a
    product for an idle supplier."""
    found = products_by_supplier_items(products, suppliers)
    used = products.where(F.col("supplier_id").isNotNull()).select(F.col("supplier_id").alias("id")).distinct()
    idle = suppliers.join(used, "id", "left_anti").select(
        F.col("name").alias("supplier"), F.lit(1).cast("bigint").alias("position"),
        F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("product"))
    return found.unionByName(idle)


def supplier_products(products: DataFrame, suppliers: DataFrame,
                      sep: str = CONSOLE_SEPARATOR) -> DataFrame:
    """Every supplier with its product names; NULL list for an idle supplier."""
    p = products.where(F.col("supplier_id").isNotNull()).select(
        F.col("supplier_id").alias("_psid"), F.col("id").alias("_pid"),
        F.col("name").alias("_pname"), F.col("category").alias("_pcat"))
    s = suppliers.select(F.col("id").alias("_sid"), F.col("name").alias("supplier"))
    return (s.join(p, s._sid == p._psid, "left")
            .groupBy("supplier")
            .agg(_name_list(sep).alias("products")))


__all__ = ["with_supplier", "inventory_with_supplier", "sales_report",
           "products_by_supplier", "products_by_supplier_items", "supplier_products",
           "supplier_products_items"]
