"""Every declared rule is met by some row of the broken feeds, and reported."""

import pytest

from stockroom.plans.registry import all_queries
from stockroom.schemas import RULES

SF = "/root/testdata/sf0.001"


def names(rules):
    out = {"unique_id"} | {f"not_null_{c}" for c in rules.not_null} | {f"length_{c}" for c in rules.max_length}
    out |= {f"enum_{c}" for c in rules.one_of} | {f"range_{c}" for c in rules.fits} | {f"unique_{c}" for c in rules.unique}
    out |= {f"fk_{c}" for c in rules.references} | {f"{k}_{c}" for c in rules.product for k in ("range", "generated")}
    return out


@pytest.mark.parametrize("table", ["products", "employees", "suppliers", "sales"])
def test_every_rule_has_a_row(spark, table):
    found = all_queries()[f"validate_broken_{table}"](spark, SF).select("rule").distinct().collect()
    missing = names(RULES[table]) - {r.rule for r in found}
    assert not missing, missing


def test_names_under_a_collation(spark, seed):
    """ACME and Acme are one supplier, one lookup, one duplicate."""
    from decimal import Decimal

    from stockroom import schemas as S
    from stockroom.operators import changes as C
    from stockroom.operators.listings import supplier_ids_by_name
    reqs = spark.createDataFrame([
        (1, "INSERT", None, "Pen", "S", 1, Decimal("1.00"), "ACME", "a@x.com"), (2, "INSERT", None, "Cup", "S", 1, Decimal("1.00"), "Acme", ""),
        (3, "UPDATE", 1, "Mouse", "E", 1, Decimal("1.00"), "paperhub", "p@x.com")], S.PRODUCT_CHANGES)
    res = C.apply_product_changes(seed.products, seed.suppliers, reqs, collation="UTF8_LCASE")
    sup = {r.id: (r.name, r.contact_email) for r in res.suppliers.collect()}
    assert sup[5] == ("ACME", "info@acme.com") and sup[2] == ("PaperHub", "p@x.com") and len(sup) == 5
    assert {r.id: r.supplier_id for r in res.table.collect() if r.id in (1, 7, 8)} == {1: 2, 7: 5, 8: 5}
    assert C.apply_product_changes(seed.products, seed.suppliers, reqs).suppliers.count() == 7
    names = spark.createDataFrame([("TECHSUPPLY LTD",), ("nobody",)], "supplier string")
    assert {tuple(r) for r in supplier_ids_by_name(seed.suppliers, names, collation="UTF8_LCASE").collect()} == {
        ("TECHSUPPLY LTD", 1), ("nobody", None)}
    twice = seed.employees.unionByName(spark.createDataFrame([(9, "X", "JANE", "admin", False)], S.EMPLOYEES_CORE))
    assert C.validate_table("employees", twice).count() == 0
    assert [(r.rule, r.row_key) for r in C.validate_table("employees", twice, collation="UTF8_LCASE").collect()] == [
        ("unique_username", "JANE")]
