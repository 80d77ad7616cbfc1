import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockroom import schemas as S  # noqa: E402
from stockroom.session import build_session  # noqa: E402
from stockroom.sources.adapters import RetailTables  # noqa: E402

AS_OF = dt.date(2024, 3, 15)
TS = dt.datetime(2024, 3, 15, 10, 30, 0)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8)
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    """The reference's seed rows (FIXTURES §2)."""
    employees = spark.createDataFrame([
        (1, "Store Owner", "owner", "owner", False),
        (2, "System Admin", "admin", "admin", False),
        (3, "John Doe", "cashier", "cashier", False),
        (4, "Jane Smith", "jane", "cashier", True)], S.EMPLOYEES_CORE)
    suppliers = spark.createDataFrame([
        (1, "TechSupply Ltd", "tech@supply.com"), (2, "PaperHub", "orders@paperhub.com"),
        (3, "ErgoFurnish", "sales@ergofurnish.com"), (4, "CableMaster", "support@cablemaster.com")],
        S.SUPPLIERS_CORE)
    products = spark.createDataFrame([
        (1, "Wireless Mouse", "Electronics", 5, Decimal("29.99"), 1),
        (2, "Notebook", "Stationery", 3, Decimal("4.99"), 2),
        (3, "Office Chair", "Furniture", 12, Decimal("129.99"), 3),
        (4, "USB Cable", "Electronics", 0, Decimal("9.99"), 4),
        (5, "Desk Lamp", "Furniture", 25, Decimal("45.99"), 3),
        (6, "Printer Paper", "Stationery", 2, Decimal("12.99"), 2)], S.PRODUCTS_CORE)
    sales = spark.createDataFrame([
        (1, 1, "Wireless Mouse", "Electronics", Decimal("29.99"), 2, Decimal("59.98"), AS_OF, TS, 3),
        (2, 2, "Notebook", "Stationery", Decimal("4.99"), 3, Decimal("14.97"), AS_OF, TS, 3)], S.SALES)
    return RetailTables(products=products, suppliers=suppliers, employees=employees, sales=sales)
