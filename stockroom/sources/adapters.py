"""Adapters: derive the four retail tables and the request feeds from the
driver's TPC-H-like star schema (``part supplier customer orders lineitem events``).

These are the test-data mapping only; a deployment stores the retail tables
themselves (see :mod:`stockroom.sources.tables`).  Each adapter is a plain
DataFrame plan so Catalyst prunes the star columns it does not need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.schemas import MONEY

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed parameters of the test-data mapping.
NO_SUPPLIER_EVERY = 17          # every 17th product has no supplier
NO_CASHIER_EVERY = 10           # sales of every 10th customer have no cashier
MISSING_PRODUCT_EVERY = 97      # sale requests of every 97th order name product -1
REQUEST_QTY_MOD = 12            # request quantity = line quantity mod 12 (0 is invalid)
FEED_EVENT = "purchase"


def read_star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stamp(minutes: str) -> F.Column:
    """A zone-less time stamp so many minutes after the start of 1990."""
    return F.expr(f"timestampadd(MINUTE, {minutes}, timestamp_ntz'1990-01-01 00:00:00')")


def suppliers_from_star(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("info@"), F.lower(F.replace(F.col("s_name"), F.lit(" "), F.lit(""))),
                 F.lit(".com")).alias("contact_email"),
        F.concat(F.lit("+265 "), F.col("s_suppkey").cast("string")).alias("phone"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
        stamp("s_suppkey").alias("created_at"))


def employees_from_star(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lower("c_name").alias("username"),
        F.when(F.col("c_mktsegment") == "BUILDING", "owner")
         .when(F.col("c_mktsegment") == "MACHINERY", "admin")
         .otherwise("cashier").alias("role"),
        (F.col("c_acctbal") < 0).alias("must_change_password"),
        stamp("c_custkey").alias("created_at"),
        stamp("c_custkey * 2").alias("updated_at"))


def products_from_star(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    # One supplier per part: the smallest supplier key that ships it.  A partial
    # (map-side) aggregate, so lineitem is reduced before the shuffle.
    first_supplier = lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("sk"))
    return (part.join(first_supplier, part.p_partkey == first_supplier.l_partkey, "left")
            .select(
                F.col("p_partkey").alias("id"),
                F.col("p_name").alias("name"),
                F.col("p_type").alias("category"),
                (F.col("p_size") - 1).cast("int").alias("quantity"),
                F.col("p_retailprice").cast(MONEY).alias("price"),
                F.when(F.col("p_partkey") % NO_SUPPLIER_EVERY == 0, F.lit(None).cast("bigint"))
                 .otherwise(F.col("sk")).alias("supplier_id"),
                stamp("p_partkey").alias("created_at"),
                stamp("p_partkey * 2").alias("updated_at")))


def _line_id() -> F.Column:
    """Sales / request id: order key × 1000 + rank of the line inside its order.

    (l_orderkey, l_linenumber) is not unique in the test data; the window is
    partitioned by order, so each window group is one order's handful of lines.
    Lines that tie in this order are equal in every column that sales and requests
    take from them, so any rank among them gives the same rows; the columns after
    quantity would only widen the shuffle.
    """
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return (F.col("l_orderkey") * 1000 + F.row_number().over(w)).cast("bigint")


def sales_from_star(lineitem: DataFrame, part: DataFrame, orders: DataFrame,
                    with_id: bool = True) -> DataFrame:
    price = F.col("p_retailprice").cast(MONEY)
    qty = F.col("l_quantity").cast("int")
    joined = (lineitem
              .join(part, lineitem.l_partkey == part.p_partkey)
              .join(orders, lineitem.l_orderkey == orders.o_orderkey))
    cols = [
        F.col("l_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        price.alias("unit_price"),
        qty.alias("quantity"),
        (price * qty.cast("decimal(10,0)")).cast(MONEY).alias("total_amount"),
        F.to_date("l_shipdate").alias("sale_date"),
        F.col("l_shipdate").alias("sale_timestamp"),
        F.when(F.col("o_custkey") % NO_CASHIER_EVERY == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias("cashier_id"),
    ]
    if with_id:
        cols.insert(0, _line_id().alias("id"))
    return joined.select(*cols)


def sale_requests_from_star(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _line_id().alias("request_id"),
        F.when(F.col("l_orderkey") % MISSING_PRODUCT_EVERY == 0, F.lit(-1).cast("bigint"))
         .otherwise(F.col("l_partkey")).alias("product_id"),
        (F.col("l_quantity").cast("int") % REQUEST_QTY_MOD).alias("quantity"),
        F.col("l_shipdate").alias("ts"),
        F.lit(None).cast("bigint").alias("cashier_id"))


def sale_feed_from_star(events: DataFrame) -> DataFrame:
    """Purchase events as a sale-request feed (works on a streaming DataFrame too)."""
    return (events.where(F.col("event_type") == FEED_EVENT)
            .select(F.col("event_id").alias("request_id"),
                    F.col("ts"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
                    (F.col("event_id") % 5 + 1).cast("int").alias("quantity"),
                    F.col("user_id").alias("cashier_id")))


def product_changes_from_star(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("request_id"),
        # a few requests have an unknown operation or none
        F.when(k % 37 == 0, F.lit(None).cast("string")).when(k % 41 == 0, "PATCH")
         .when(k % 5 == 0, "DELETE").when(k % 5 == 1, "INSERT").otherwise("UPDATE").alias("op"),
        F.when(k % 5 == 1, F.lit(None).cast("bigint"))
         .when(k % 19 == 0, F.lit(10000000) + k)
         .otherwise((k * 7) % 251).alias("id"),
        F.when(k % 11 == 0, F.lit(" ")).otherwise(F.concat("p_name", F.lit(" v2"))).alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("int").alias("quantity"),
        (F.col("p_retailprice") + 1).cast(MONEY).alias("price"),
        F.when(k % 13 == 0, F.lit(""))
         .when(k % 43 == 0, F.repeat(F.lit("long "), 25))      # does not fit a supplier name
         .otherwise(F.concat(F.lit("New Vendor "), (k % 7).cast("string"))).alias("supplier"),
        F.when(k % 3 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("v"), k.cast("string"), F.lit("@x.com"))).alias("supplier_contact"))


def employee_changes_from_star(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("request_id"),
        F.when(k % 37 == 0, F.lit(None).cast("string")).when(k % 41 == 0, "PATCH")
         .when(k % 4 == 0, "DELETE").when(k % 4 == 1, "INSERT").otherwise("UPDATE").alias("op"),
        F.when(k % 4 == 1, F.lit(None).cast("bigint")).otherwise((k * 3) % 401).alias("id"),
        F.when(k % 29 == 0, F.lit("")).otherwise(F.concat("c_name", F.lit(" v2"))).alias("name"),
        F.when(k % 6 == 1, F.lower("c_name"))
         .when(k % 10 == 5, F.concat(F.lit("new"), (k % 40).cast("string")))
         .otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("username"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("admin")).alias("role"))


def broken_products(products: DataFrame) -> DataFrame:
    """The products with violations of every rule on some rows, in columns wide enough
    to hold them; every 19th row is there twice."""
    k = F.col("id")
    rows = products.select(
        "id", F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.repeat("name", F.lit(20))).otherwise(F.col("name")).alias("name"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.repeat("category", F.lit(20))).otherwise(F.col("category")).alias("category"),
        F.when(k % 31 == 0, F.lit(None).cast("bigint")).when(k % 17 == 0, F.lit(3000000000)).otherwise(F.col("quantity").cast("bigint")).alias("quantity"),
        F.when(k % 37 == 0, F.lit(None).cast("decimal(20,2)"))
         .when(k % 23 == 0, F.col("price").cast("decimal(20,2)") + F.lit(200000000).cast("decimal(20,2)"))
         .otherwise(F.col("price").cast("decimal(20,2)")).cast("decimal(20,2)").alias("price"),
        F.when(k % 29 == 0, F.col("supplier_id") + 1000000).otherwise(F.col("supplier_id")).alias("supplier_id"))
    return rows.unionByName(rows.where(k % 19 == 0))


def broken_suppliers(suppliers: DataFrame) -> DataFrame:
    """The suppliers with violations of every rule on some rows; every 6th row is there twice."""
    k = F.col("id")
    rows = suppliers.select(
        "id", F.when(k % 3 == 0, F.lit("Same Name")).when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.repeat("name", F.lit(9)))
        .otherwise(F.col("name")).alias("name"),
        F.when(k % 2 == 0, F.repeat("contact_email", F.lit(9))).otherwise(F.col("contact_email")).alias("contact_email"),
        F.when(k % 4 == 0, F.repeat("phone", F.lit(9))).otherwise(F.col("phone")).alias("phone"), "address", "created_at")
    return rows.unionByName(rows.where(k % 6 == 0))


def broken_employees(employees: DataFrame) -> DataFrame:
    """The employees with violations of every rule on some rows; every 23rd row is there twice."""
    k, none = F.col("id"), F.lit(None).cast("string")
    rows = employees.select(
        "id", F.when(k % 5 == 0, none).when(k % 7 == 0, F.repeat("name", F.lit(20))).otherwise(F.col("name")).alias("name"),
        F.when(k % 3 == 0, F.lit("same")).when(k % 11 == 0, F.repeat("username", F.lit(9))).when(k % 13 == 0, none)
        .otherwise(F.col("username")).alias("username"),
        F.when(k % 17 == 0, none).when(k % 19 == 0, F.lit("boss")).otherwise(F.col("role")).alias("role"), "must_change_password")
    return rows.unionByName(rows.where(k % 23 == 0))


def broken_sales(sales: DataFrame) -> DataFrame:
    """The sales with violations of every rule on some rows; every 43rd row is there twice."""
    k, none = F.col("id"), F.lit(None).cast("string")
    wide = "decimal(20,2)"
    rows = sales.select(
        "id", F.when(k % 37 == 0, F.col("product_id") + 10000000).otherwise(F.col("product_id")).alias("product_id"),
        F.when(k % 5 == 0, none).when(k % 7 == 0, F.repeat("product_name", F.lit(40))).otherwise(F.col("product_name")).alias("product_name"),
        F.when(k % 11 == 0, none).when(k % 13 == 0, F.repeat("category", F.lit(20))).otherwise(F.col("category")).alias("category"),
        F.when(k % 17 == 0, F.lit(None).cast(wide)).when(k % 19 == 0, (F.col("unit_price").cast(wide) + 99999999).cast(wide))
        .otherwise(F.col("unit_price").cast(wide)).cast(wide).alias("unit_price"),
        F.when(k % 23 == 0, F.lit(None).cast("int")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(k % 29 == 0, (F.col("total_amount").cast(wide) + 1).cast(wide)).otherwise(F.col("total_amount").cast(wide)).cast(wide).alias("total_amount"),
        F.when(k % 31 == 0, F.lit(None).cast("date")).otherwise(F.col("sale_date")).alias("sale_date"), "sale_timestamp",
        F.when(k % 41 == 0, F.col("cashier_id") + 10000000).otherwise(F.col("cashier_id")).alias("cashier_id"))
    return rows.unionByName(rows.where(k % 43 == 0))


def recased_product_changes(requests: DataFrame) -> DataFrame:
    """Product requests that spell their suppliers in upper and lower case in turn."""
    k = F.col("request_id")
    return requests.withColumn("supplier", F.when(k % 2 == 0, F.upper("supplier")).when(k % 3 == 0, F.lower("supplier"))
                               .otherwise(F.col("supplier")))


def closed_suppliers(suppliers: DataFrame) -> DataFrame:
    """Some suppliers as rows to delete."""
    return suppliers.where(F.col("id") % 4 == 1).select("id")


def typed_product_changes(requests: DataFrame) -> DataFrame:
    """Product requests as typed into a form: quantity and price are text, some no numbers."""
    k = F.col("request_id")
    return requests.withColumn("quantity", F.when(k % 6 == 0, F.lit("many")).when(k % 8 == 0, F.lit("0x"))
                               .otherwise(F.concat(F.lit(" "), F.col("quantity").cast("string"), F.lit(" pcs")))) \
        .withColumn("price", F.when(k % 9 == 0, F.lit("MK 5")).otherwise(F.concat(F.col("price").cast("string"), F.lit("/-"))))


@dataclass
class RetailTables:
    """The four retail tables (plus request feeds) as DataFrames."""

    products: DataFrame
    suppliers: DataFrame
    employees: DataFrame
    sales: DataFrame
    sale_requests: DataFrame | None = None
    product_changes: DataFrame | None = None
    employee_changes: DataFrame | None = None
    sale_feed: DataFrame | None = None


def load_retail_from_star(spark: SparkSession, sf_dir: str) -> RetailTables:
    t = {n: read_star(spark, sf_dir, n) for n in
         ("customer", "supplier", "part", "orders", "lineitem", "events")}
    return RetailTables(
        products=products_from_star(t["part"], t["lineitem"]),
        suppliers=suppliers_from_star(t["supplier"]),
        employees=employees_from_star(t["customer"]),
        sales=sales_from_star(t["lineitem"], t["part"], t["orders"]),
        sale_requests=sale_requests_from_star(t["lineitem"]),
        product_changes=product_changes_from_star(t["part"]),
        employee_changes=employee_changes_from_star(t["customer"]),
        sale_feed=sale_feed_from_star(t["events"]),
    )
