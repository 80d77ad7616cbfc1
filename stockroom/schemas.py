"""Declared schemas of the four retail tables and of the request feeds.

Fixed, declared — no inference.  ``password`` is never loaded.
"""

from dataclasses import dataclass, field

from pyspark.sql.types import (BooleanType, DataType, DateType, DecimalType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampNTZType)

MONEY = DecimalType(10, 2)          # DECIMAL(10,2) column type of the tables
MONEY_SUM = DecimalType(38, 2)      # type of every money SUM we report
LINE_VALUE = DecimalType(20, 2)     # quantity × price of one row (INT × DECIMAL(10,2) fits)

EMPLOYEES_CORE = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), False),
    StructField("username", StringType(), False),
    StructField("role", StringType(), False),
    StructField("must_change_password", BooleanType(), False),
])

SUPPLIERS_CORE = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), False),
    StructField("contact_email", StringType(), True),
])

PRODUCTS_CORE = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), False),
    StructField("category", StringType(), False),
    StructField("quantity", IntegerType(), False),
    StructField("price", MONEY, False),
    StructField("supplier_id", LongType(), True),
])

# The stored tables also keep time stamps and contact details.
CREATED = StructField("created_at", TimestampNTZType(), True)
UPDATED = StructField("updated_at", TimestampNTZType(), True)
EMPLOYEES = StructType([*EMPLOYEES_CORE.fields, CREATED, UPDATED])
SUPPLIERS = StructType([*SUPPLIERS_CORE.fields, StructField("phone", StringType(), True),
                        StructField("address", StringType(), True), CREATED])
PRODUCTS = StructType([*PRODUCTS_CORE.fields, CREATED, UPDATED])

SALES = StructType([
    StructField("id", LongType(), False),
    StructField("product_id", LongType(), True),
    StructField("product_name", StringType(), False),
    StructField("category", StringType(), False),
    StructField("unit_price", MONEY, False),
    StructField("quantity", IntegerType(), False),
    StructField("total_amount", MONEY, False),
    StructField("sale_date", DateType(), False),
    StructField("sale_timestamp", TimestampNTZType(), True),
    StructField("cashier_id", LongType(), True),
])

TABLES = {"employees": EMPLOYEES, "suppliers": SUPPLIERS, "products": PRODUCTS, "sales": SALES}

# Request feeds (request_id gives arrival order).
SALE_REQUESTS = StructType([
    StructField("request_id", LongType(), False),
    StructField("product_id", LongType(), True),
    StructField("quantity", IntegerType(), True),
    StructField("ts", TimestampNTZType(), True),
    StructField("cashier_id", LongType(), True),
])

PRODUCT_CHANGES = StructType([
    StructField("request_id", LongType(), False),
    StructField("op", StringType(), True),
    StructField("id", LongType(), True),
    StructField("name", StringType(), True),
    StructField("category", StringType(), True),
    StructField("quantity", IntegerType(), True),
    StructField("price", MONEY, True),
    StructField("supplier", StringType(), True),
    StructField("supplier_contact", StringType(), True),
])

EMPLOYEE_CHANGES = StructType([
    StructField("request_id", LongType(), False),
    StructField("op", StringType(), True),
    StructField("id", LongType(), True),
    StructField("name", StringType(), True),
    StructField("username", StringType(), True),
    StructField("role", StringType(), True),
])

# Fixed values of the data model.
ROLES = ("owner", "admin", "cashier")
DEFAULT_ROLE = "cashier"
LOW_STOCK_LIMIT = 10
NAME_MAX = {"employees": 100, "suppliers": 100, "products": 150, "sales": 150}
CATEGORY_MAX = 80
USERNAME_MAX = 50
EMAIL_MAX = 100
PHONE_MAX = 30


# --- declared rules (M7) ----------------------------------------------------------

@dataclass(frozen=True)
class Rules:
    """What a table's rows must fulfil, beside a key ``id`` that is there and unique."""

    not_null: tuple[str, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    one_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    fits: dict[str, DataType] = field(default_factory=dict)           # the value fits the column's type
    unique: tuple[str, ...] = ()
    references: dict[str, str] = field(default_factory=dict)          # key column -> parent table
    product: dict[str, tuple[str, str]] = field(default_factory=dict)  # generated: the product of two columns


RULES = {
    "products": Rules(
        not_null=("name", "category", "quantity", "price"), max_length={"name": NAME_MAX["products"], "category": CATEGORY_MAX},
        fits={"price": MONEY, "quantity": IntegerType()}, references={"supplier_id": "suppliers"}),
    "employees": Rules(
        not_null=("name", "username", "role"), max_length={"name": NAME_MAX["employees"], "username": USERNAME_MAX},
        one_of={"role": ROLES}, unique=("username",)),
    "suppliers": Rules(
        not_null=("name",), max_length={"name": NAME_MAX["suppliers"], "contact_email": EMAIL_MAX, "phone": PHONE_MAX},
        unique=("name",)),
    "sales": Rules(
        not_null=("product_name", "category", "unit_price", "quantity", "sale_date"),
        max_length={"product_name": NAME_MAX["sales"], "category": CATEGORY_MAX},
        references={"product_id": "products", "cashier_id": "employees"}, product={"total_amount": ("unit_price", "quantity")}),
}
