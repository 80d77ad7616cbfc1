"""Versions of the stored tables: each run of request batches reads the latest version and
writes the next one, with the id marks that later runs go on from.

A version is a folder with the four tables and a ``marks`` table (table_name, last_id): the
last id each table has given out, whether its row is still there or not, so that an id is
never given out twice (AUTO_INCREMENT).  The marks are written last and commit the
version: a run that dies leaves a folder without marks, which is never read and whose
number the next run takes again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.operators import changes as C
from stockroom.operators import sales as S
from stockroom.schemas import TABLES
from stockroom.sources.adapters import RetailTables
from stockroom.sources.tables import read_retail_tables, write_table

MARKS = "table_name string, last_id bigint"


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version-{version:09d}"


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the last committed version, 0 if there is none."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "version-*/marks/_SUCCESS"))
    return max((int(f.getPath().getParent().getParent().getName().split("-")[1]) for f in done or []), default=0)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> tuple[RetailTables, dict[str, int]]:
    """The tables of a version (the latest) and the last id of each."""
    path = version_path(root, version or latest_version(spark, root))
    marks = spark.read.schema(MARKS).parquet(f"{path}/marks").collect()      # a row a table
    return read_retail_tables(spark, path), {m.table_name: m.last_id for m in marks}


def id_marks(last_ids: dict[str, DataFrame]) -> DataFrame:
    """table_name, last_id from one-row frames ``last_id``."""
    out = None
    for table, frame in last_ids.items():
        row = frame.select(F.lit(table).alias("table_name"), F.col("last_id").cast("bigint").alias("last_id"))
        out = row if out is None else out.unionByName(row)
    return out


def write_version(tables: RetailTables, last_ids: dict[str, DataFrame], root: str, version: int) -> str:
    path = version_path(root, version)
    for t in TABLES:
        write_table(getattr(tables, t), path, t)
    id_marks(last_ids).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks")
    return path


def first_version(tables: RetailTables, root: str) -> str:
    nothing = {t: getattr(tables, t).limit(0) for t in TABLES}
    return write_version(tables, {t: C.last_id(nothing[t], getattr(tables, t)) for t in TABLES}, root, 1)


def apply_batches(tables: RetailTables, marks: dict[str, int], product_changes: DataFrame | None = None,
                  employee_changes: DataFrame | None = None, sale_requests: DataFrame | None = None,
                  as_of_ts=None) -> tuple[RetailTables, dict[str, DataFrame]]:
    """The tables after the batches, in this order (product changes with the suppliers they
    name, employee changes, sales), and the last id of each.  Sales of deleted products
    and cashiers keep their rows and lose the key, in one scan."""
    out = replace(tables)
    none = {t: getattr(tables, t).select("id").limit(0) for t in TABLES}
    last = {t: C.last_id(none[t], getattr(tables, t), marks.get(t)) for t in TABLES}
    gone: dict[str, DataFrame] = {}
    if product_changes is not None:
        res = C.apply_product_changes(tables.products, tables.suppliers, product_changes, as_of_ts,
                                      marks.get("products"), marks.get("suppliers"))
        out.products, out.suppliers = res.table, res.suppliers
        last["products"] = res.last_id
        last["suppliers"] = C.last_id(res.suppliers, tables.suppliers, marks.get("suppliers"))
        gone["product_id"] = res.deleted_ids
    if employee_changes is not None:
        res = C.apply_employee_changes(tables.employees, employee_changes, as_of_ts, marks.get("employees"))
        out.employees, last["employees"] = res.table, res.last_id
        gone["cashier_id"] = res.deleted_ids
    if gone:
        out.sales = C.cascade_deletes(tables.sales, gone)
    if sale_requests is not None:
        results = S.apply_sale_requests(out.products, sale_requests)
        # the last sale id before the batch (the cascade keeps every row): found in one scan, used twice
        before = last["sales"].select(F.col("last_id").alias("id")).checkpoint()
        new = S.new_sales_rows(before, results).checkpoint()
        out.products = S.stock_after_sales(out.products, results)
        last["sales"] = C.last_id(new, before)
        out.sales = out.sales.unionByName(new.select(*out.sales.columns))
    return out, last


def run_batches(spark: SparkSession, root: str, **batches) -> int:
    """Applies request batches to the latest version and writes the next; its number."""
    version = latest_version(spark, root)
    tables, marks = read_version(spark, root, version)
    after, last = apply_batches(tables, marks, **batches)
    write_version(after, last, root, version + 1)
    return version + 1


__all__ = ["latest_version", "read_version", "write_version", "first_version", "apply_batches", "run_batches", "id_marks"]
