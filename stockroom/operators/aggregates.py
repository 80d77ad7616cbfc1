"""Aggregations.

All are hash aggregates on Spark's partial/final path: each task combines its
rows first, so only one partial row per group and task crosses the shuffle —
a hot category or supplier costs one partial row per task, not its row count.
Dashboard figures that the source computes in several passes (counts of low
and out-of-stock items, the notification texts) are single-pass conditional
aggregates here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import (ALL_HEALTHY_MESSAGE, LOW_STOCK, LOW_STOCK_ITEM_TEMPLATE,
                                       NOTIFICATION_TEMPLATE, OUT_OF_STOCK, dash_if_missing, fill, is_low_stock, is_out_of_stock,
                                       line_value, money_sum, money_text)
from stockroom.operators.joins import with_supplier
from stockroom.operators.listings import _date
from stockroom.schemas import MONEY_SUM


def _key(name: str, collation: str | None) -> F.Column:
    """Grouping key, optionally under a collation (e.g. ``UTF8_LCASE`` for the
    case-insensitive grouping of a default MySQL collation, ``UNICODE_CI_AI``
    to also ignore accents).  Spark's default is binary."""
    return F.collate(F.col(name), collation).alias(name) if collation else F.col(name)


def _newest() -> F.Column:
    """Position of a group's first row in the newest-first sales list — the
    order in which the dashboards' insertion-ordered maps show groups."""
    return F.max(F.struct("sale_timestamp", "id"))


def _first_listed() -> F.Column:
    """Position of a group's first row in the (category, name, id) product list."""
    return F.min(F.struct("category", "name", "id"))


def _units(x="quantity") -> F.Column:
    return F.sum(F.col(x)).cast("bigint")


def _fallback_total() -> F.Column:
    """``total_amount || unit_price × quantity``."""
    return F.coalesce(F.col("total_amount"),
                      (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")))


def avg_money(total: F.Column, n: F.Column) -> F.Column:
    """total / n rounded HALF_UP (away from zero) to cents, exactly; 0 when n = 0.

    Done in integer cents — (2|c| + n) div 2n, sign restored — so an already
    rounded decimal quotient is never rounded a second time."""
    cents = (total * 100).cast("decimal(38,0)")
    num = (F.abs(cents) * 2 + n.cast("decimal(38,0)")).cast("decimal(38,0)")
    den = (n * 2).cast("decimal(38,0)")
    whole = ((num - num % den) / den).cast("decimal(38,0)")      # exact: divisible
    avg_cents = F.signum(cents).cast("decimal(38,0)") * whole
    return F.when(n == 0, F.lit(0).cast(MONEY_SUM)).otherwise(
        (avg_cents.cast("decimal(38,0)") / F.lit(100)).cast(MONEY_SUM))


# --- SQL view aggregates -------------------------------------------------------

def revenue_by_category(sales: DataFrame, ordered: bool = True,
                        collation: str | None = None) -> DataFrame:
    """A1: units and revenue per category, revenue desc."""
    out = sales.groupBy(_key("category", collation)).agg(_units().alias("total_units_sold"),
                                         money_sum("total_amount").alias("total_revenue"))
    return out.orderBy(F.col("total_revenue").desc(), "category") if ordered else out


def revenue_by_product(sales: DataFrame, ordered: bool = True,
                       collation: str | None = None) -> DataFrame:
    """A2: units and revenue per (product_name, category), revenue desc."""
    out = sales.groupBy(_key("product_name", collation), _key("category", collation)).agg(
        _units().alias("total_units_sold"), money_sum("total_amount").alias("total_revenue"))
    return (out.orderBy(F.col("total_revenue").desc(), "product_name", "category")
            if ordered else out)


def total_revenue(sales: DataFrame) -> DataFrame:
    """A3: SUM(total_amount) (NULL over no rows, like SQL)."""
    return sales.agg(money_sum("total_amount").alias("total_revenue"))


def revenue_totals(sales: DataFrame) -> DataFrame:
    """A4: SUM(total_amount), COUNT(*)."""
    return sales.agg(money_sum("total_amount").alias("total_revenue"),
                     F.count(F.lit(1)).alias("total_orders"))


def inventory_by_category(products: DataFrame, collation: str | None = None) -> DataFrame:
    """A5: units and stock value per category."""
    return products.groupBy(_key("category", collation)).agg(
        _units().alias("total_units"),
        F.sum(line_value("quantity", "price")).cast(MONEY_SUM).alias("value"))


# --- dashboard aggregates (JavaScript rules: empty sums are 0) -----------------

def category_sales(sales: DataFrame, collation: str | None = None) -> DataFrame:
    """Revenue per category with the total fallback, as value and text."""
    rev = F.coalesce(F.sum(_fallback_total()).cast(MONEY_SUM), F.lit(0).cast(MONEY_SUM))
    return (sales.groupBy(_key("category", collation)).agg(rev.alias("revenue"), _newest().alias("_first"))
            .orderBy(F.col("_first").desc()).drop("_first")
            .withColumn("revenue_text", money_text("revenue")))


def product_sales(sales: DataFrame, collation: str | None = None) -> DataFrame:
    """Revenue per product *name* (not name+category, unlike A2)."""
    rev = F.coalesce(F.sum(_fallback_total()).cast(MONEY_SUM), F.lit(0).cast(MONEY_SUM))
    return (sales.groupBy(_key("product_name", collation)).agg(rev.alias("revenue"), _newest().alias("_first"))
            .orderBy(F.col("_first").desc()).drop("_first")
            .withColumn("revenue_text", money_text("revenue")))


def category_units(products: DataFrame, collation: str | None = None) -> DataFrame:
    """Stock units per category."""
    return (products.groupBy(_key("category", collation)).agg(_units().alias("units"))
            .orderBy("category"))


def sales_statement(sales: DataFrame) -> DataFrame:
    """Number of sales, revenue, average sale (0 when there are none)."""
    agg = sales.agg(F.count(F.lit(1)).alias("total_sales"),
                    F.coalesce(F.sum(_fallback_total()).cast(MONEY_SUM),
                               F.lit(0).cast(MONEY_SUM)).alias("total_revenue"))
    return (agg.withColumn("average_sale", avg_money(F.col("total_revenue"), F.col("total_sales")))
            .withColumn("revenue_text", money_text("total_revenue"))
            .withColumn("average_text", money_text("average_sale")))


def inventory_statement(products: DataFrame) -> DataFrame:
    """A10: products, units, value, low and out-of-stock counts in one pass."""
    return (products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.coalesce(_units(), F.lit(0).cast("bigint")).alias("total_units"),
        F.coalesce(F.sum(line_value("quantity", "price")).cast(MONEY_SUM),
                   F.lit(0).cast(MONEY_SUM)).alias("total_value"),
        F.count_if(is_low_stock("quantity")).alias("low_stock_items"),
        F.count_if(is_out_of_stock("quantity")).alias("out_of_stock_items"))
        .withColumn("total_value_text", money_text("total_value")))


def owner_sales_kpis(sales: DataFrame) -> DataFrame:
    """Total revenue and total orders."""
    return (sales.agg(F.coalesce(F.sum(_fallback_total()).cast(MONEY_SUM),
                                 F.lit(0).cast(MONEY_SUM)).alias("total_revenue"),
                      F.count(F.lit(1)).alias("total_orders"))
            .withColumn("revenue_text", money_text("total_revenue")))


def owner_inventory_kpis(products: DataFrame) -> DataFrame:
    """Products, units, inventory value."""
    return (products.agg(F.count(F.lit(1)).alias("total_products"),
                         F.coalesce(_units(), F.lit(0).cast("bigint")).alias("total_units"),
                         F.coalesce(F.sum(line_value("quantity", "price")).cast(MONEY_SUM),
                                    F.lit(0).cast(MONEY_SUM)).alias("inventory_value"))
            .withColumn("value_text", money_text("inventory_value")))


def daily_sales_kpis(sales: DataFrame, d=None) -> DataFrame:
    """Revenue, items sold and transactions on one date (0s when none)."""
    day = sales.where(F.col("sale_date") == _date(d))
    return (day.agg(F.coalesce(F.sum(_fallback_total()).cast(MONEY_SUM),
                               F.lit(0).cast(MONEY_SUM)).alias("revenue"),
                    F.coalesce(_units(), F.lit(0).cast("bigint")).alias("items_sold"),
                    F.count(F.lit(1)).alias("transactions"))
            .withColumn("revenue_text", money_text("revenue")))


def cashier_inventory_kpis(products: DataFrame) -> DataFrame:
    """Products and units."""
    return products.agg(F.count(F.lit(1)).alias("total_products"),
                        F.coalesce(_units(), F.lit(0).cast("bigint")).alias("total_units"))


def supplier_count(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Distinct supplier names among products; a NULL supplier counts as one."""
    j = with_supplier(products.select("supplier_id"), suppliers)
    return j.agg((F.count_distinct("supplier_name")
                  + F.coalesce(F.max(F.col("supplier_name").isNull().cast("int")), F.lit(0)))
                 .cast("bigint").alias("supplier_count"))


def supplier_info(products: DataFrame, suppliers: DataFrame, sep: str = ", ") -> DataFrame:
    """Product names per supplier (NULL supplier is its own group)."""
    j = with_supplier(products.select("id", "name", "category", "supplier_id"), suppliers)
    names = F.expr(f"listagg(name, '{sep}') WITHIN GROUP (ORDER BY category, name, id)")
    return (j.groupBy(F.col("supplier_name").alias("supplier"))
            .agg(names.alias("products"), _first_listed().alias("_first"))
            .orderBy("_first").drop("_first"))


def supplier_info_items(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A16, split form: one row per product with its place in its supplier's list."""
    from stockroom.operators.changes import rank_within_group
    j = with_supplier(products.select("id", "name", "category", "supplier_id"), suppliers)
    ranked = rank_within_group(j.withColumnRenamed("supplier_name", "supplier"),
                               ["supplier"], ["category", "name", "id"])
    return ranked.select("supplier", "position", "id", F.col("name").alias("product"))


def supplier_detail(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Per supplier its contact and the array of its items, in
    (category, name, id) order: ``items: array<struct<name, category, price, quantity>>``."""
    j = with_supplier(products.select("id", "name", "category", "price", "quantity",
                                      "supplier_id"), suppliers)
    items = F.sort_array(F.collect_list(F.struct("category", "name", "id", "price", "quantity")))
    g = (j.groupBy(F.col("supplier_name").alias("supplier")).agg(
        F.min("supplier_contact").alias("contact"), items.alias("_items"),
        _first_listed().alias("_first")).orderBy("_first"))
    shaped = F.transform("_items", lambda x: F.struct(
        x["name"].alias("name"), x["category"].alias("category"),
        x["price"].alias("price"), x["quantity"].alias("quantity")))
    return g.select("supplier", "contact", dash_if_missing("contact").alias("contact_text"),
                    F.size("_items").alias("n_items"), shaped.alias("items"))


def supplier_detail_items(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A17, split form: one row per item with its position on the supplier's card.

    Same content as :func:`supplier_detail` without building one array per
    supplier, so a supplier holding a third of all products is spread over
    many tasks (positions via :func:`rank_within_group`)."""
    from stockroom.operators.changes import rank_within_group
    j = with_supplier(products.select("id", "name", "category", "price", "quantity",
                                      "supplier_id"), suppliers)
    ranked = rank_within_group(j.withColumnRenamed("supplier_name", "supplier"),
                               ["supplier"], ["category", "name", "id"])
    return ranked.select("supplier", dash_if_missing("supplier_contact").alias("contact_text"),
                         "position", "id", "name", "category", "price", "quantity")


def stock_notification_items(products: DataFrame) -> DataFrame:
    """A19, split form: one row per product named in a notification, with its
    position in the OUT or LOW list (the texts joined by ', ' give the messages)."""
    from stockroom.operators.changes import rank_within_group
    q = F.col("quantity")
    cand = products.where((q >= 0) & (q < 10)).select(
        "id", "category", "name",
        F.when(q == 0, F.lit(OUT_OF_STOCK)).otherwise(F.lit(LOW_STOCK)).alias("kind"),
        F.when(q == 0, F.col("name"))
         .otherwise(fill(LOW_STOCK_ITEM_TEMPLATE, name="name", quantity=q)).alias("text"))
    return rank_within_group(cand, ["kind"], ["category", "name", "id"]).select(
        "kind", "position", "id", "text")


def alert_badge_count(products: DataFrame) -> DataFrame:
    """Low + out count; the badge text is NULL (hidden) when it is 0."""
    n = F.count_if(is_low_stock("quantity") | is_out_of_stock("quantity"))
    return (products.agg(n.alias("badge_count"))
            .withColumn("badge_text", F.nullif(F.col("badge_count").cast("string"), F.lit("0"))))


def stock_notifications(products: DataFrame) -> DataFrame:
    """The OUT message row before the LOW message row, or one 'healthy' row.

    Only products with 0 <= quantity < 10 can appear, so that filter is
    applied before the (single, global) aggregate."""
    q = F.col("quantity")
    cand = products.where((q >= 0) & (q < 10)).select(
        "id", "category", "name",
        F.when(q == 0, F.col("name")).alias("_out"),
        F.when(q > 0, fill(LOW_STOCK_ITEM_TEMPLATE, name="name", quantity=q)).alias("_low"))
    agg = cand.agg(
        F.expr("listagg(_out, ', ') WITHIN GROUP (ORDER BY category, name, id)").alias("o"),
        F.expr("listagg(_low, ', ') WITHIN GROUP (ORDER BY category, name, id)").alias("l"))
    rows = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit(OUT_OF_STOCK).alias("kind"),
                 fill(NOTIFICATION_TEMPLATE, kind=F.lit(OUT_OF_STOCK), names="o").alias("message")),
        F.struct(F.lit(2).alias("seq"), F.lit(LOW_STOCK).alias("kind"),
                 fill(NOTIFICATION_TEMPLATE, kind=F.lit(LOW_STOCK), names="l").alias("message")),
        F.struct(F.lit(3).alias("seq"), F.lit("OK").alias("kind"),
                 F.when(F.col("o").isNull() & F.col("l").isNull(),
                        F.lit(ALL_HEALTHY_MESSAGE)).alias("message")))
    return (agg.select(F.explode(rows).alias("r")).select("r.*")
            .where(F.col("message").isNotNull()))


__all__ = [
    "avg_money", "revenue_by_category", "revenue_by_product", "total_revenue", "revenue_totals",
    "inventory_by_category", "category_sales", "product_sales", "category_units",
    "sales_statement", "inventory_statement", "owner_sales_kpis", "owner_inventory_kpis",
    "daily_sales_kpis", "cashier_inventory_kpis", "supplier_count", "supplier_info",
    "supplier_detail", "supplier_detail_items", "alert_badge_count", "stock_notifications",
    "stock_notification_items",
]
