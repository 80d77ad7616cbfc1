"""Projections, filters and listings.

Sorting happens only at the presentation edge (the listing functions end in
``orderBy``); every aggregate-style consumer should start from the plain
tables so the sort never enters its plan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import (PRODUCT_OPTION_TEMPLATE, ROLE_LABEL_OTHER, ROLE_LABELS,
                                       STATUS_ACTIVE, STATUS_PASSWORD_REQUIRED, clock_text,
                                       dash_if_missing, fill, is_low_stock, is_out_of_stock,
                                       line_value, money_text)
from stockroom.operators.joins import inventory_with_supplier, with_supplier

def _newest_first() -> list[F.Column]:
    return [F.col("sale_timestamp").desc(), F.col("id").desc()]


def _date(d=None) -> F.Column:
    """A date parameter; ``None`` means today (CURDATE(), constant-folded per query)."""
    if d is None:
        return F.current_date()
    if isinstance(d, F.Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


# --- S1–S4 table scans ---------------------------------------------------------

def scan_products(products: DataFrame) -> DataFrame:
    return products


def scan_sales(sales: DataFrame) -> DataFrame:
    """All sales, newest first (``id`` breaks timestamp ties)."""
    return sales.orderBy(*_newest_first())


def scan_suppliers(suppliers: DataFrame) -> DataFrame:
    return suppliers


def scan_employees(employees: DataFrame) -> DataFrame:
    return employees.drop("password")


# --- P1–P11 -------------------------------------------------------------------

def _sales_columns(sales: DataFrame) -> DataFrame:
    return sales.select(
        "id",
        F.col("product_id").alias("productId"),
        F.col("product_name").alias("productName"),
        "category",
        F.col("unit_price").alias("amount"),
        "quantity",
        "total_amount",
        F.col("sale_date").alias("date"),
        F.col("sale_timestamp").alias("timestamp"))


def sales_list(sales: DataFrame) -> DataFrame:
    """API sales listing, newest first."""
    return _sales_columns(sales).orderBy(F.col("timestamp").desc(), F.col("id").desc())


def product_list(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Products with supplier name and contact, by category, name."""
    return (with_supplier(products, suppliers)
            .select("id", "name", "category", "quantity", "price",
                    F.col("supplier_name").alias("supplier"),
                    F.col("supplier_contact").alias("supplierContact"))
            .orderBy("category", "name", "id"))


def supplier_list(suppliers: DataFrame) -> DataFrame:
    """All suppliers by name."""
    return suppliers.orderBy("name", "id")


def employee_roster(employees: DataFrame) -> DataFrame:
    """Employee listing without passwords, by id."""
    return employees.select("id", "name", "username", "role",
                            F.col("must_change_password").alias("mustChangePassword")).orderBy("id")


def employee_roster_labels(employees: DataFrame) -> DataFrame:
    """P5: roster with display role and account status."""
    role = F.col("role")
    label = (F.when(role == "admin", ROLE_LABELS["admin"])
             .when(role == "owner", ROLE_LABELS["owner"])
             .otherwise(ROLE_LABEL_OTHER))
    status = F.when(F.coalesce(F.col("must_change_password"), F.lit(False)),
                    STATUS_PASSWORD_REQUIRED).otherwise(STATUS_ACTIVE)
    return employees.select("id", "name", "username", label.alias("role_label"),
                            status.alias("status")).orderBy("id")


def supplier_per_product(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Product, supplier or '-', contact or '-', price text."""
    return (with_supplier(products, suppliers)
            .select("id", "name",
                    dash_if_missing("supplier_name").alias("supplier"),
                    dash_if_missing("supplier_contact").alias("contact"),
                    money_text("price").alias("price_text"),
                    "category")
            .orderBy("category", "name", "id").drop("category"))


def sellable_products(products: DataFrame) -> DataFrame:
    """Sale-form option label; products with zero stock are disabled."""
    label = fill(PRODUCT_OPTION_TEMPLATE, name="name", price=money_text("price"), quantity="quantity")
    return (products.select("id", label.alias("label"), "price",
                            is_out_of_stock("quantity").alias("disabled"), "category", "name")
            .orderBy("category", "name", "id").drop("category", "name"))


def sale_quote(products: DataFrame, quotes: DataFrame) -> DataFrame:
    """Running total of a sale form: price × quantity, ``M0.00`` when the
    product is unknown or disabled.  ``quotes(request_id, product_id, quantity)``.

    Quotes are the large side; products are joined by id (Spark broadcasts them
    only when their measured size is under the broadcast threshold)."""
    p = products.select(F.col("id").alias("_pid"), F.col("price").alias("_price"),
                        F.col("quantity").alias("_stock"))
    j = quotes.join(p, quotes.product_id == p._pid, "left")
    sellable = F.col("_pid").isNotNull() & (F.col("_stock") != 0)
    qty = F.coalesce(F.col("quantity"), F.lit(0))
    total = F.when(sellable, line_value(qty, F.col("_price"))).otherwise(F.lit(0).cast("decimal(20,2)"))
    return j.select("request_id", "product_id", "quantity", money_text(total).alias("quote"))


def inventory_value_lines(products: DataFrame) -> DataFrame:
    """Per product quantity × price as money text."""
    return (products.select("id", "name", "category", "quantity",
                            money_text("price").alias("price_text"),
                            money_text(line_value("quantity", "price")).alias("value_text"))
            .orderBy("category", "name", "id"))


def inventory_status_lines(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """P10: cashier inventory table."""
    return (with_supplier(products, suppliers)
            .select("id", "name", "category", money_text("price").alias("price_text"),
                    "quantity", dash_if_missing("supplier_name").alias("supplier"))
            .orderBy("category", "name", "id"))


def lookup_by_key(table: DataFrame, keys: DataFrame, table_key: str = "id",
                  keys_key: str | None = None) -> DataFrame:
    """Rows of ``table`` whose key appears in a batch of keys (semi join).

    Keys are reduced to the distinct ones on the way into their shuffle, so a key
    that most of the batch repeats costs one row per task."""
    kk = keys_key or table_key
    k = keys.select(F.col(kk).alias("_key")).where("_key is not null").distinct()
    return table.join(k, table[table_key] == k._key, "left_semi")


def supplier_ids_by_name(suppliers: DataFrame, names: DataFrame, name_col: str = "supplier",
                         collation: str | None = None) -> DataFrame:
    """Supplier id for each distinct requested name (NULL if unknown); names are
    equal under ``collation``."""
    n = names.select(F.col(name_col).alias("supplier")).where(F.col("supplier").isNotNull()).distinct()
    s = suppliers.select(F.col("name").alias("_sname"), F.col("id").alias("supplier_id"))
    same = (n.supplier == s._sname if collation is None
            else F.collate(n.supplier, collation) == F.collate(s._sname, collation))
    return n.join(s, same, "left").select("supplier", "supplier_id")


# --- F1–F7 filters ------------------------------------------------------------

def low_stock_items(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """dashboard low stock, 0 < quantity < 10, product-list columns."""
    return product_list(products.where(is_low_stock("quantity")), suppliers)


def out_of_stock_items(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """quantity = 0, product-list columns."""
    return product_list(products.where(is_out_of_stock("quantity")), suppliers)


def stock_alerts(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """inventory view rows whose status is not OK (includes negative stock)."""
    return inventory_with_supplier(products.where(F.col("quantity") < 10), suppliers)


def stock_with_status(products: DataFrame, suppliers: DataFrame, status: str) -> DataFrame:
    """inventory view rows with one status.  The status predicate is
    rewritten onto ``quantity`` so it reaches the Parquet scan."""
    q = F.col("quantity")
    pushed = {"OUT OF STOCK": q == 0, "LOW STOCK": (q != 0) & (q < 10), "OK": q >= 10}.get(status)
    base = products.where(pushed) if pushed is not None else products
    view = inventory_with_supplier(base, suppliers)
    return view.where(F.col("stock_status") == status)


def quantity_below(products: DataFrame, n: int = 10) -> DataFrame:
    """``SELECT * FROM products WHERE quantity < n``."""
    return products.where(F.col("quantity") < n)


def sales_on_date(sales: DataFrame, d=None) -> DataFrame:
    """raw sales of one date (partition-pruned on stored tables)."""
    return sales.where(F.col("sale_date") == _date(d))


def sales_on_date_list(sales: DataFrame, d=None) -> DataFrame:
    """F6 with the API renames, newest first."""
    return sales_list(sales_on_date(sales, d))


def sales_clock_list(sales: DataFrame, d=None) -> DataFrame:
    """X11: cashier's list of one day's sales: clock time, product, totals as text."""
    day = sales_on_date(sales, d)
    total = F.coalesce(F.col("total_amount"),
                       (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")))
    return (day.select("id", clock_text("sale_timestamp").alias("time"),
                       F.col("product_name").alias("productName"), "category", "quantity",
                       money_text("unit_price").alias("unit_price_text"),
                       money_text(total).alias("total_text"), "sale_timestamp")
            .orderBy(F.col("sale_timestamp").desc(), F.col("id").desc())
            .drop("sale_timestamp"))


# --- T1 -----------------------------------------------------------------------

def recent_transactions(sales: DataFrame, n: int = 8) -> DataFrame:
    """Newest ``n`` sales (a top-k: planned as TakeOrderedAndProject)."""
    total = F.coalesce(F.col("total_amount"),
                       (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")))
    return (sales.orderBy(*_newest_first()).limit(n)
            .select("id", F.col("product_name").alias("productName"), "category", "quantity",
                    money_text(total).alias("amount_text"), F.col("sale_date").alias("date")))


__all__ = [
    "scan_products", "scan_sales", "scan_suppliers", "scan_employees", "sales_list",
    "product_list", "supplier_list", "employee_roster", "employee_roster_labels",
    "supplier_per_product", "sellable_products", "sale_quote", "inventory_value_lines",
    "inventory_status_lines", "lookup_by_key", "supplier_ids_by_name", "low_stock_items",
    "out_of_stock_items", "stock_alerts", "stock_with_status", "quantity_below",
    "sales_on_date", "sales_on_date_list", "sales_clock_list", "recent_transactions",
]
