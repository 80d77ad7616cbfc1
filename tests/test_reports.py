"""Seed-row goldens (FIXTURES §2) and edge rows for the report operators."""

from decimal import Decimal

from pyspark.sql import functions as F

from stockroom import schemas as S
from stockroom.functions import exprs as X
from stockroom.operators import aggregates as A
from stockroom.operators import joins as J
from stockroom.operators import listings as L
from tests.conftest import AS_OF


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_inventory_statement(seed):
    r = rows(A.inventory_statement(seed.products))[0]
    assert r["total_products"] == 6 and r["total_units"] == 47
    assert r["total_value"] == Decimal("2900.53") and r["total_value_text"] == "M2900.53"
    assert r["low_stock_items"] == 3 and r["out_of_stock_items"] == 1


def test_inventory_by_category(seed):
    got = {r["category"]: (r["total_units"], r["value"]) for r in rows(A.inventory_by_category(seed.products))}
    assert got == {"Electronics": (5, Decimal("149.95")), "Furniture": (37, Decimal("2709.63")),
                   "Stationery": (5, Decimal("40.95"))}


def test_low_and_out(seed):
    assert {r["id"] for r in rows(L.low_stock_items(seed.products, seed.suppliers))} == {1, 2, 6}
    assert {r["id"] for r in rows(L.out_of_stock_items(seed.products, seed.suppliers))} == {4}
    assert rows(A.alert_badge_count(seed.products))[0] == {"badge_count": 4, "badge_text": "4"}


def test_stock_notifications(seed):
    got = [(r["kind"], r["message"]) for r in A.stock_notifications(seed.products).orderBy("seq").collect()]
    assert got == [("OUT OF STOCK", "OUT OF STOCK: USB Cable"),
                   ("LOW STOCK", "LOW STOCK: Wireless Mouse (5 left), Notebook (3 left), Printer Paper (2 left)")]


def test_stock_notifications_healthy(spark, seed):
    healthy = seed.products.withColumn("quantity", F.lit(50))
    got = rows(A.stock_notifications(healthy))
    assert [r["message"] for r in got] == ["All stock levels are healthy."]
    assert rows(A.alert_badge_count(healthy))[0] == {"badge_count": 0, "badge_text": None}


def test_revenue(seed):
    got = {r["category"]: (r["total_units_sold"], r["total_revenue"])
           for r in rows(A.revenue_by_category(seed.sales))}
    assert got == {"Electronics": (2, Decimal("59.98")), "Stationery": (3, Decimal("14.97"))}
    st = rows(A.sales_statement(seed.sales))[0]
    assert st["total_sales"] == 2 and st["total_revenue"] == Decimal("74.95")
    assert st["average_sale"] == Decimal("37.48") and st["average_text"] == "M37.48"
    k = rows(A.daily_sales_kpis(seed.sales, AS_OF))[0]
    assert (k["revenue"], k["items_sold"], k["transactions"]) == (Decimal("74.95"), 5, 2)
    # metamorphic: Σ A1 = A3
    assert sum(v[1] for v in got.values()) == rows(A.total_revenue(seed.sales))[0]["total_revenue"]


def test_empty_sales(spark):
    empty = spark.createDataFrame([], S.SALES)
    st = rows(A.sales_statement(empty))[0]
    assert st == {"total_sales": 0, "total_revenue": Decimal("0.00"), "average_sale": Decimal("0.00"),
                  "revenue_text": "M0.00", "average_text": "M0.00"}
    assert rows(A.total_revenue(empty))[0]["total_revenue"] is None


def test_suppliers(seed):
    got = {r["supplier"]: r["products"] for r in rows(J.supplier_products(seed.products, seed.suppliers))}
    assert got == {"CableMaster": "USB Cable", "ErgoFurnish": "Desk Lamp, Office Chair",
                   "PaperHub": "Notebook, Printer Paper", "TechSupply Ltd": "Wireless Mouse"}
    assert rows(A.supplier_count(seed.products, seed.suppliers))[0]["supplier_count"] == 4


def test_supplier_null_group(spark, seed):
    extra = spark.createDataFrame([(7, "Loose Item", "Misc", 1, Decimal("1.00"), None)], S.PRODUCTS_CORE)
    p = seed.products.unionByName(extra)
    assert rows(A.supplier_count(p, seed.suppliers))[0]["supplier_count"] == 5
    info = {r["supplier"]: r["products"] for r in rows(A.supplier_info(p, seed.suppliers))}
    assert info[None] == "Loose Item"
    detail = {r["supplier"]: r for r in rows(A.supplier_detail(p, seed.suppliers))}
    assert detail[None]["contact_text"] == "-"
    assert [i["name"] for i in detail["ErgoFurnish"]["items"]] == ["Desk Lamp", "Office Chair"]
    spp = {r["name"]: r["supplier"] for r in rows(L.supplier_per_product(p, seed.suppliers))}
    assert spp["Loose Item"] == "-"


def test_idle_supplier_gets_null_list(spark, seed):
    s = seed.suppliers.unionByName(spark.createDataFrame([(5, "Idle Co", None)], S.SUPPLIERS_CORE))
    got = {r["supplier"]: r["products"] for r in rows(J.supplier_products(seed.products, s))}
    assert got["Idle Co"] is None
    assert "Idle Co" not in {r["supplier"] for r in rows(J.products_by_supplier(seed.products, s))}


def test_sales_report(seed):
    for r in rows(J.sales_report(seed.sales, seed.employees)):
        assert (r["cashier_name"], r["cashier_username"]) == ("John Doe", "cashier")


def test_stock_status_boundaries(spark):
    df = spark.createDataFrame([(q,) for q in (-1, 0, 1, 9, 10)], "quantity int")
    got = {r["quantity"]: (r["s"], r["low"], r["out"]) for r in df.select(
        "quantity", X.stock_status("quantity").alias("s"), X.is_low_stock("quantity").alias("low"),
        X.is_out_of_stock("quantity").alias("out")).collect()}
    assert got == {-1: ("LOW STOCK", False, False), 0: ("OUT OF STOCK", False, True),
                   1: ("LOW STOCK", True, False), 9: ("LOW STOCK", True, False), 10: ("OK", False, False)}


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Big  Vendor Co ", "12abc", " -3.5e1x", None)],
                               "s string, i string, f string, n string")
    r = df.select(X.js_trim("s").alias("t"), X.default_contact_email("s").alias("e"),
                  X.parse_int("i").alias("pi"), X.parse_float("f").alias("pf"),
                  X.falsy_default("n", "cashier").alias("d"), X.parse_int("n").alias("pn")).first()
    assert r["t"] == "Big  Vendor Co" and r["e"] == "info@bigvendorco.com"
    assert r["pi"] == 12 and r["pf"] == -35.0 and r["d"] == "cashier" and r["pn"] is None


def test_recent_transactions_top_k(seed):
    got = rows(L.recent_transactions(seed.sales, 1))
    assert len(got) == 1 and got[0]["id"] == 2       # same timestamp → higher id first
    plan = L.recent_transactions(seed.sales, 8)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_sale_quote(spark, seed):
    quotes = spark.createDataFrame([(1, 1, 3), (2, 4, 2), (3, 99, 1), (4, 2, None)],
                                   "request_id long, product_id long, quantity int")
    got = {r["request_id"]: r["quote"] for r in rows(L.sale_quote(seed.products, quotes))}
    assert got == {1: "M89.97", 2: "M0.00", 3: "M0.00", 4: "M0.00"}


def test_case_insensitive_grouping(spark, seed):
    from decimal import Decimal as D
    extra = spark.createDataFrame(
        [(3, 1, "wireless mouse", "electronics", D("29.99"), 1, D("29.99"), AS_OF, None, None)], S.SALES)
    sales = seed.sales.unionByName(extra)
    assert len(rows(A.revenue_by_category(sales))) == 3
    got = rows(A.revenue_by_category(sales, collation="UTF8_LCASE"))
    assert len(got) == 2
    assert {r["category"].lower(): r["total_revenue"] for r in got}["electronics"] == D("89.97")
    assert len(rows(A.product_sales(sales, collation="UTF8_LCASE"))) == 2


def test_badge_equals_low_plus_out(seed):
    badge = rows(A.alert_badge_count(seed.products))[0]["badge_count"]
    low = L.low_stock_items(seed.products, seed.suppliers).count()
    out = L.out_of_stock_items(seed.products, seed.suppliers).count()
    assert badge == low + out


def test_js_number_parsing(spark):
    df = spark.createDataFrame([(" 0x1A", "-Infinity"), ("-0x10z", " .5e1abc"), ("abc", "+Infinityx"),
                                ("  -12.9", "1e"), (None, None), ("0x", "."), ("-0Xg", "e5"), ("0", "0x5")],
                               "i string, f string")
    got = [(r["pi"], r["pf"]) for r in df.select(X.parse_int("i").alias("pi"),
                                                  X.parse_float("f").alias("pf")).collect()]
    assert got == [(26, float("-inf")), (-16, 5.0), (None, float("inf")), (-12, 1.0), (None, None),
                   (None, None), (None, None), (0, 0.0)]
