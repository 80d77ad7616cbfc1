"""Benchmark: headline queries over stored retail tables.

Reads the star-schema test data at $BENCH_SF_DIR (default /root/testdata/sf0.1),
stores the retail tables and request feeds once as Parquet (the ``load`` step,
reported but not part of the total), then times warm runs of the headline
queries on local[$BENCH_CPUS] with a ``noop`` sink (median of $BENCH_RUNS).
Prints one JSON line.  ``BENCH_EVENT_LOG=1`` also writes Spark's event log
(stage and task times) to a fresh scratch folder named in the output.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockroom.operators import aggregates as A  # noqa: E402
from stockroom.operators import changes as C  # noqa: E402
from stockroom.operators import joins as J  # noqa: E402
from stockroom.operators import listings as L  # noqa: E402
from stockroom.operators import sales as SA  # noqa: E402
from stockroom.session import build_session, scratch_path  # noqa: E402
from stockroom.sources.adapters import load_retail_from_star  # noqa: E402
from stockroom.sources.tables import read_stored, write_retail_tables  # noqa: E402
from stockroom.streaming import streams as R  # noqa: E402

AS_OF = "1998-06-01"


def headline(t):
    return {
        "revenue_by_category": lambda: A.revenue_by_category(t.sales),
        "revenue_by_product": lambda: A.revenue_by_product(t.sales),
        "inventory_statement": lambda: A.inventory_statement(t.products),
        "inventory_with_supplier": lambda: J.inventory_with_supplier(t.products, t.suppliers),
        "sales_report": lambda: J.sales_report(t.sales, t.employees),
        "recent_transactions": lambda: L.recent_transactions(t.sales, 8),
        "daily_sales_kpis": lambda: A.daily_sales_kpis(t.sales, AS_OF),
        "supplier_detail": lambda: A.supplier_detail(t.products, t.suppliers),
        "supplier_products": lambda: J.supplier_products(t.products, t.suppliers),
        "stock_notifications": lambda: A.stock_notifications(t.products),
        "apply_product_changes": lambda: C.apply_product_changes(
            t.products, t.suppliers, t.product_changes).table,
        "apply_employee_changes": lambda: C.apply_employee_changes(
            t.employees, t.employee_changes).table,
        "apply_sale_requests": lambda: SA.apply_sale_requests(t.products, t.sale_requests),
    }


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    extra = {"spark.driver.memory": "16g"}
    event_dir = None
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage/task times without the UI: Spark's event log in a fresh scratch folder
        import tempfile
        event_dir = tempfile.mkdtemp(prefix="stockroom-events-")
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{event_dir}"})
    spark = build_session(f"local[{cpus}]", max(8, 2 * cpus), extra=extra)
    root = scratch_path(spark, "bench-tables")
    load_s = timed(lambda: write_retail_tables(load_retail_from_star(spark, sf_dir), root))
    t = read_stored(spark, root)

    results: dict[str, float] = {}
    for name, build in headline(t).items():
        run_noop(build())                       # warm-up (JIT, file listing, Python workers)
        results[name] = round(statistics.median(timed(lambda: run_noop(build())) for _ in range(runs)), 3)

    def stream_once():
        out = R.stream_apply_sales(t.products, R.parquet_stream(spark, f"{root}/sale_feed"))
        R.run_append(out, "bench-r1")
    stream_once()
    results["stream_apply_sales"] = round(statistics.median(timed(stream_once) for _ in range(runs)), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "load_sec": round(load_s, 3),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "runs": runs, **({"event_log": event_dir} if event_dir else {})}))


if __name__ == "__main__":
    main()
