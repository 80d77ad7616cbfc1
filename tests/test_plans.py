"""Physical-plan properties the scale design relies on (checked on stored tables)."""

import pytest

from stockroom.operators import aggregates as A
from stockroom.operators import changes as C
from stockroom.operators import joins as J
from stockroom.operators import listings as L
from stockroom.operators import sales as SA
from stockroom.session import scratch_path
from stockroom.sources.adapters import load_retail_from_star
from stockroom.sources.tables import read_stored, write_retail_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    root = scratch_path(spark, "plan-tables")
    write_retail_tables(load_retail_from_star(spark, SF), root)
    return read_stored(spark, root)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_and_pruning_reach_the_scan(stored):
    p = plan(A.daily_sales_kpis(stored.sales, "1998-06-01"))
    assert "PushedFilters: [IsNotNull(sale_date), EqualTo(sale_date,1998-06-01)]" in p
    assert "ReadSchema: struct<unit_price:decimal(10,2),quantity:int,total_amount:decimal(10,2),sale_date:date>" in p


def test_status_filter_is_pushed_as_quantity_predicate(stored):
    p = plan(L.stock_with_status(stored.products, stored.suppliers, "OUT OF STOCK"))
    assert "EqualTo(quantity,0)" in p


def test_aggregates_combine_before_the_shuffle(stored):
    p = plan(A.revenue_by_category(stored.sales, ordered=False))
    assert p.count("HashAggregate") >= 2 and "partial_sum" in p


def test_dimension_join_uses_size_checked_broadcast(stored):
    p = final_plan(J.inventory_with_supplier(stored.products, stored.suppliers, ordered=False))
    assert "BroadcastHashJoin" in p and "BroadcastNestedLoopJoin" not in p and "Cartesian" not in p


def test_top_k_is_take_ordered(stored):
    assert "TakeOrderedAndProject" in plan(L.recent_transactions(stored.sales, 8))


def test_sale_fold_shuffles_requests_once_by_product(stored):
    res = SA.apply_sale_requests(stored.products, stored.sale_requests)
    p = plan(res)
    assert p.count("hashpartitioning(product_id") == 1
    assert "MapInArrow" in p and "rangepartitioning" not in p
    assert "BroadcastNestedLoopJoin" not in p and "Cartesian" not in p


def test_id_assignment_has_no_single_partition_window_over_rows(stored):
    out = C.assign_ids(stored.sale_requests.select("request_id"), C.max_id(stored.sales))
    p = final_plan(out)
    # row numbers are computed inside each range partition, never over all rows at once
    assert "row_number() windowspecdefinition(_part" in p
    assert "row_number() windowspecdefinition(request_id" not in p


def test_no_cartesian_products_in_reports(spark):
    from stockroom.plans.registry import REPORTS
    for name, q in REPORTS.items():
        p = plan(q(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
