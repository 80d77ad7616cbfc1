"""Sale requests applied to stock in arrival order.

Per product, requests are taken in (ts, request_id) order; a request is

* ``INVALID_QUANTITY`` if its quantity is NULL or < 1,
* ``NOT_FOUND`` if the product does not exist,
* ``OUT_OF_STOCK`` if the stock is 0,
* ``INSUFFICIENT`` if the stock is below the quantity,
* ``AMOUNT_OVERFLOW`` if price × quantity does not fit DECIMAL(10,2),
* else ``ACCEPTED``: the stock drops by the quantity and a sale row is written.

A rejected request leaves the stock alone, so later, smaller requests may
still pass — this is a fold, not a running sum.  The first two outcomes do
not depend on order and are decided with plain column expressions; only the
rest goes through the fold.

The fold is the one place Python runs per row.  Spark hash-partitions the
requests by product and sorts each partition by (product, ts, request_id);
``mapInArrow`` then walks the Arrow batches of a partition carrying a
single integer of state, so memory is one batch whatever the product's size.
The per-product serial order is what the source gets from its row lock;
different products run in parallel.  A product with more than ``HOT_ROWS``
requests is not left to one task: see the split path below (phases of prefix
sums over range slices of the product's order, no Python).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stockroom.functions.exprs import (INVALID_SALE_MESSAGE, NOT_FOUND_MESSAGE,
                                       insufficient_message, out_of_stock_message,
                                       sold_message, utc_date)
from stockroom.operators.changes import assign_ids, next_after
from stockroom.schemas import MONEY
from stockroom.session import ensure_checkpoint_dir

# Fixed outcome labels of a sale request.
ACCEPTED = "ACCEPTED"
INSUFFICIENT = "INSUFFICIENT"
OUT_OF_STOCK_STATUS = "OUT_OF_STOCK"
INVALID_QUANTITY = "INVALID_QUANTITY"
NOT_FOUND = "NOT_FOUND"
AMOUNT_OVERFLOW = "AMOUNT_OVERFLOW"
OVERFLOW_MESSAGE = "Out of range value for column 'total_amount'"

# Requests per product above which its fold is split over several tasks.
HOT_ROWS = 1_000_000
# Rows of a per-product side (hot ids, their stocks, slices) up to which it is broadcast.
SMALL_SIDE = 200_000

# Status codes used inside the fold (small ints travel cheaply through Arrow).
OUT_OF_STOCK_CODE = 3
_CODES = {1: ACCEPTED, 2: INSUFFICIENT, OUT_OF_STOCK_CODE: OUT_OF_STOCK_STATUS, 4: AMOUNT_OVERFLOW}

FOLD_COLUMNS = [
    StructField("_code", IntegerType(), False),
    StructField("stock_before", IntegerType(), False),
    StructField("left", IntegerType(), False),
]


def step(stock: int, q: int, overflow: bool) -> tuple[int, int]:
    """One request against the current stock → (status code, stock after)."""
    if stock == 0:
        return 3, stock
    if stock < q:
        return 2, stock
    if overflow:
        return 4, stock
    return 1, stock - q


def fold_stock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one partition sorted by (product_id, ts, request_id).

    Reads product_id, quantity, stock0, overflow; every other column passes
    through as it is, so no join is needed to bring the request back and no value
    changes its type.  State carried across batches: the current product and its stock."""
    cur_pid = None
    stock = 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        pids, qty, start, ovf = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                                 for c in ("product_id", "quantity", "stock0", "overflow"))
        code = np.empty(n, dtype=np.int32)
        before = np.empty(n, dtype=np.int32)
        after = np.empty(n, dtype=np.int32)
        # first row of each product run inside the batch
        starts = np.flatnonzero(pids[1:] != pids[:-1]) + 1
        pl, ql, sl, ol = pids.tolist(), qty.tolist(), start.tolist(), ovf.tolist()
        i = 0
        while i < n:
            pid = pl[i]
            if pid != cur_pid:
                cur_pid, stock = pid, sl[i]
            if stock == 0:
                # the rest of this product's run is out of stock: fill at once
                k = np.searchsorted(starts, i, side="right")
                end = int(starts[k]) if k < len(starts) else n
                code[i:end], before[i:end], after[i:end] = OUT_OF_STOCK_CODE, 0, 0
                i = end
                continue
            before[i] = stock
            code[i], stock = step(stock, ql[i], ol[i])
            after[i] = stock
            i += 1
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (code, before, after))],
                                         names=[*b.schema.names, *(f.name for f in FOLD_COLUMNS)])


# --- hot products: one product's sequence decided by many tasks ----------------
#
# A product with more requests than ``hot_rows`` is not left to one task of a hash
# partitioning.  The requests are range-partitioned on (product_id, ts, request_id), so
# none but a product that lies in a slice as a whole is folded there.  A product that
# spans several slices is decided in phases of plain prefix sums, by what is known of a
# stock R that only falls:
#   * let M be the largest quantity that still fits (q <= R) and h = min(R div 2, M);
#   * requests for at most h units ("small") are all accepted as long as the stock is
#     above h, so the stock before every request is R minus a running sum;
#   * of the others only those that fit are accepted: the first of them, or the small
#     request that brings the stock down to h, ends the phase (an accepted large one
#     leaves at most R div 2, since it takes more than h = R div 2);
#   * without such a request the phase decides all that is left.
# A phase leaves a stock of at most max(R div 2, M), and M at most after the first, so
# there are at most some 32 of them whatever the quantities (1 + log2 of the largest
# quantity in practice).  Requests that overflow the amount never change the stock.
# Exact, and no task holds more than its slice of a product.


def _side(df: DataFrame, rows: int) -> DataFrame:
    """The small side of a join, of a known number of rows: broadcast up to SMALL_SIDE,
    else left to a shuffle join."""
    return F.broadcast(df) if rows <= SMALL_SIDE else df.hint("shuffle_hash")


def _phase(rest: DataFrame, stock: DataFrame, n_products: int, n_slices: int) -> DataFrame:
    """The requests ``rest`` with the stock before and after each and whether it may end
    the phase; right up to the request that ends it.  ``stock``: product_id, R."""
    free = ~F.col("overflow")
    rows = rest.join(_side(stock, n_products), "product_id")
    top = rows.where(free & (F.col("quantity") <= F.col("R"))).groupBy("product_id").agg(F.max("quantity").alias("M"))
    level = stock.join(_side(top, n_products), "product_id", "left").select(
        "product_id", "R", F.least(F.floor(F.col("R") / 2), F.coalesce("M", F.lit(0))).cast("long").alias("h"))
    rows = rest.join(_side(level, n_products), "product_id")
    takes = F.when(free & (F.col("quantity") <= F.col("h")), F.col("quantity").cast("long")).otherwise(F.lit(0).cast("long"))
    # prefix sums: totals of the slices, then running sums inside them
    totals = rows.groupBy("product_id", "_part").agg(F.sum(takes).alias("_sum"))
    earlier = Window.partitionBy("product_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("product_id", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum0"))
    inside = (Window.partitionBy("product_id", "_part").orderBy("ts", "request_id")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("R") - F.col("_sum0") - F.sum(takes).over(inside) + takes
    fits = free & (F.col("quantity") <= F.col("_before"))
    after = F.col("_before") - F.when(F.col("_fits"), F.col("quantity")).otherwise(F.lit(0))
    return (rows.join(_side(starts, n_slices), ["product_id", "_part"])
            .withColumn("_before", before).withColumn("_fits", fits).withColumn("_after", after)
            .withColumn("_ends", F.col("_fits") & ((F.col("quantity") > F.col("h")) | (F.col("_after") <= F.col("h")))))


def _sliced(rows: DataFrame, n_partitions: int | None) -> DataFrame:
    """``rows`` in sorted range slices of (product_id, ts, request_id), written; ``_part`` is the slice."""
    ensure_checkpoint_dir(rows.sparkSession)
    keys = ("product_id", "ts", "request_id")
    spread = (rows.repartitionByRange(n_partitions, *keys) if n_partitions
              else rows.repartitionByRange(*keys))      # AQE may merge adjacent ranges
    return spread.sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)


def tied_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """product_id of neighbouring rows that are equal in all columns; partitions are sorted."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if last is None else [last, b])
        last = b.slice(b.num_rows - 1)
        n, same = t.num_rows - 1, None
        for c in (t.column(i) for i in range(t.num_columns)):
            a, z = c.slice(0, n), c.slice(1)
            equal = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z)))
            same = equal if same is None else pc.and_(same, equal)
        tied = t.column(0).slice(1).filter(same).unique()
        yield pa.RecordBatch.from_arrays([tied], names=["product_id"])


def _fold_slices(slices: DataFrame, hot: DataFrame, n_partitions: int | None) -> DataFrame:
    """Outcomes (as :func:`fold_stock` gives them) of sliced requests, see :func:`_sliced`.

    A product that lies in one slice is folded there, without another shuffle.  The others
    are set apart: at most one product crosses from a slice to the next, so they are fewer
    than the slices; with them go products without a stock or with requests that the order
    can't tell apart.  The hot ones of these are decided in phases, the others in one task."""
    tied = (slices.select("product_id", "ts", "request_id").sortWithinPartitions("product_id", "ts", "request_id")
            .mapInArrow(tied_products, "product_id long"))
    odd = (slices.groupBy("product_id").agg(F.min("_part").alias("_from"), F.max("_part").alias("_to"),
                                            F.count_if(F.col("stock0").isNull()).alias("_none"))
           .where("_from < _to or _none > 0").select("product_id").union(tied).distinct())
    apart = (odd.join(hot.withColumn("_hot", F.lit(True)), "product_id", "left")
             .select("product_id", F.coalesce("_hot", F.lit(False)).alias("_hot")).checkpoint(eager=True))
    n, n_hot = apart.count(), apart.where("_hot").count()
    inside = slices.join(_side(apart.select("product_id"), n), "product_id", "left_anti").drop("_part")
    cold = slices.join(_side(apart.where("not _hot").select("product_id"), n), "product_id", "left_semi").drop("_part")
    # a join that isn't a broadcast moves the rows: products then go whole to one task again
    decided = (_walk(inside) if n <= SMALL_SIDE else _fold(inside, n_partitions)).unionByName(_fold(cold, n_partitions))
    across = slices.join(_side(apart.where("_hot").select("product_id"), n), "product_id", "left_semi")
    return decided.unionByName(_fold_hot(across)) if n_hot else decided


def _fold_hot(rest: DataFrame) -> DataFrame:
    """Outcomes (as :func:`fold_stock` gives them) of the sliced requests of hot products."""
    ensure_checkpoint_dir(rest.sparkSession)
    columns = [c for c in rest.columns if c != "_part"]
    # one row a slice; products and slices only get fewer, so their numbers bound every side
    slices = (rest.groupBy("product_id", "_part").agg(F.max("stock0").cast("long").alias("R")).checkpoint(eager=True))
    stock = slices.groupBy("product_id").agg(F.max("R").alias("R"))
    n_products, n_slices = slices.select("product_id").distinct().count(), slices.count()
    code = (F.when(F.col("_before") == 0, F.lit(3)).when(F.col("_before") < F.col("quantity"), F.lit(2))
            .when(F.col("overflow"), F.lit(4)).otherwise(F.lit(1)))
    here, end = F.struct("ts", "request_id"), F.struct("_last.ts", "_last.request_id")
    later = F.col("_last").isNotNull() & (here > end)
    decided: DataFrame | None = None
    while True:
        rows = _phase(rest, stock, n_products, n_slices).checkpoint(eager=True)
        last = (rows.where("_ends").groupBy("product_id")
                .agg(F.min(F.struct("ts", "request_id", "_after")).alias("_last")).checkpoint(eager=True))
        rows = rows.join(_side(last, n_products), "product_id", "left")
        done = rows.where(~later).select(
            *columns, code.cast("int").alias("_code"), F.col("_before").cast("int").alias("stock_before"),
            F.col("_after").cast("int").alias("left"))
        decided = done if decided is None else decided.unionByName(done)
        if last.isEmpty():
            return decided
        stock = last.select("product_id", F.col("_last._after").alias("R"))
        rest = rows.where(later).select(*columns, "_part")


def hot_products(products: DataFrame, requests: DataFrame, hot_rows: int) -> DataFrame:
    """product_id of existing products with more than ``hot_rows`` valid requests, written:
    one column-pruned partial aggregate, at most #requests / hot_rows rows."""
    ensure_checkpoint_dir(requests.sparkSession)
    counts = (requests.where(F.col("quantity") >= 1).groupBy("product_id")
              .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows))
    exists = products.select(F.col("id").alias("product_id"))
    return counts.join(exists, "product_id", "left_semi").select("product_id").checkpoint(eager=True)


def _fold(ready: DataFrame, n_partitions: int | None) -> DataFrame:
    """Run :func:`fold_stock` with Spark doing the partitioning and ordering."""
    # Without an explicit count AQE may coalesce the hash partitions (a
    # product still stays inside one partition).
    return _walk(ready.repartition(n_partitions, "product_id") if n_partitions
                 else ready.repartition("product_id"))


def _walk(spread: DataFrame) -> DataFrame:
    """:func:`fold_stock` over partitions that hold every product of theirs whole."""
    laid_out = spread.sortWithinPartitions("product_id", "ts", "request_id")
    out_schema = StructType(laid_out.schema.fields + FOLD_COLUMNS)
    return laid_out.mapInArrow(fold_stock, out_schema)


def apply_sale_requests(products: DataFrame, requests: DataFrame,
                        n_partitions: int | None = None,
                        hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Outcome of every sale request, with the sale row fields when accepted.

    Products with more than ``hot_rows`` requests are folded by the split
    path, several tasks per product; ``hot_rows=None`` folds every product in
    a single task.

    Output: request_id, product_id, quantity, ts, cashier_id, status,
    stock_before, left, message, product_name, category, unit_price,
    total_amount, sale_date."""
    hot = hot_products(products, requests, hot_rows) if hot_rows else None
    if hot is not None and not hot.isEmpty():
        return _apply_split(products, requests, hot, n_partitions)
    j = prepare_requests(products, requests)
    decided = _fold(j.where(F.col("_pre").isNull()).drop("_pre", "_pid"), n_partitions)
    return decorate_outcomes(decided.withColumn("_pre", F.lit(None).cast("string")).unionByName(_undecided(j.drop("_pid"))))


def _undecided(j: DataFrame) -> DataFrame:
    """The requests that take no part in the fold, with the fold's columns as NULL."""
    none = [F.lit(None).cast("int").alias(c) for c in ("_code", "stock_before", "left")]
    return j.where(F.col("_pre").isNotNull()).select("*", *none)


def _apply_split(products: DataFrame, requests: DataFrame, hot: DataFrame, n_partitions: int | None) -> DataFrame:
    """:func:`apply_sale_requests` with products of ``hot`` folded by several tasks.

    All requests are written once in range slices, in the columns that decide them alone;
    the names and prices come back at the end, to the requests that show any.  ``_which``
    tells the rows of an id that is there twice apart (equal rows need not be)."""
    which = Window.partitionBy("id").orderBy("quantity", "price", "name", "category")
    stored = products.select("id", "name", "category", "price", "quantity", F.row_number().over(which).alias("_which"))
    j = prepare_requests(stored, requests, "_which")
    slices = _sliced(j.select("request_id", "product_id", "quantity", "ts", "cashier_id", "_pre", "stock0",
                              "overflow", "_which"), n_partitions)
    decided = _fold_slices(slices.where(F.col("_pre").isNull()).drop("_pre"), hot, n_partitions)
    decided = decided.withColumn("_pre", F.lit(None).cast("string"))
    named = stored.select(F.col("id").alias("product_id"), "_which", F.col("name").alias("product_name"), "category",
                          F.col("price").alias("unit_price"))
    shown = F.col("_code").isin(1, OUT_OF_STOCK_CODE)
    plain = decided.where(~shown).unionByName(_undecided(slices.drop("_part")))
    plain = plain.select("*", *[F.lit(None).cast(named.schema[c].dataType).alias(c) for c in named.columns[2:]])
    rows = decided.where(shown).join(named, ["product_id", "_which"]).unionByName(plain)
    return decorate_outcomes(rows.withColumn("total_amount", _total()))


def decorate_outcomes(df: DataFrame) -> DataFrame:
    """Status, message and sale fields from the fold's code (or the
    order-independent pre-decision ``_pre``)."""
    status_of = F.create_map(*[x for k, v in _CODES.items() for x in (F.lit(k), F.lit(v))])
    status = F.coalesce(F.col("_pre"), status_of[F.col("_code")])
    df = df.withColumn("status", status)
    st = F.col("status")
    message = (F.when(st == ACCEPTED, sold_message("quantity", "product_name", "total_amount"))
               .when(st == OUT_OF_STOCK_STATUS, out_of_stock_message("product_name"))
               .when(st == INSUFFICIENT, insufficient_message("stock_before"))
               .when(st == AMOUNT_OVERFLOW, F.lit(OVERFLOW_MESSAGE))
               .when(st == NOT_FOUND, F.lit(NOT_FOUND_MESSAGE))
               .otherwise(F.lit(INVALID_SALE_MESSAGE)))
    accepted = st == ACCEPTED
    return df.select(
        "request_id", "product_id", "quantity", "ts", "cashier_id", "status",
        "stock_before", "left", message.alias("message"),
        F.when(accepted, F.col("product_name")).alias("product_name"),
        F.when(accepted, F.col("category")).alias("category"),
        F.when(accepted, F.col("unit_price")).alias("unit_price"),
        F.when(accepted, F.col("total_amount")).alias("total_amount"),
        F.when(accepted, utc_date("ts")).alias("sale_date"))


def _total() -> F.Column:
    """The amount of a request, NULL if it does not fit."""
    return (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")).try_cast(MONEY)


def prepare_requests(products: DataFrame, requests: DataFrame, *more: str) -> DataFrame:
    """Requests joined to their product (and its columns ``more``), with the order-independent
    outcome (``_pre``: INVALID_QUANTITY / NOT_FOUND) and the overflow flag decided."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"),
                        "category", F.col("price").alias("unit_price"),
                        F.col("quantity").alias("stock0"), *more)
    r = requests.select("request_id", "product_id", "quantity", "ts", "cashier_id")
    invalid = F.col("quantity").isNull() | (F.col("quantity") < 1)
    # An invalid quantity is decided without its product and takes no part in the join.
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in p.schema.fields]
    j = (r.where(~invalid).join(p, F.col("product_id") == F.col("_pid"), "left")
         .unionByName(r.where(invalid).select("*", *nothing)))
    return (j.withColumn("_pre", F.when(invalid, F.lit(INVALID_QUANTITY))
                         .when(F.col("_pid").isNull(), F.lit(NOT_FOUND)))
            .withColumn("total_amount", _total())
            .withColumn("overflow", F.col("total_amount").isNull()))


def stock_after_sales(products: DataFrame, results: DataFrame) -> DataFrame:
    """Product table with quantities reduced by the accepted requests."""
    sold = (results.where(F.col("status") == ACCEPTED)
            .groupBy("product_id").agg(F.sum("quantity").alias("_sold")))
    j = products.join(sold, products.id == sold.product_id, "left")
    return j.select(*[(F.col("quantity") - F.coalesce(F.col("_sold"), F.lit(0))).cast("int").alias(c)
                      if c == "quantity" else products[c] for c in products.columns])


def new_sales_rows(sales: DataFrame, results: DataFrame, high_water: int | None = None) -> DataFrame:
    """Accepted requests as ``sales`` rows in arrival order (ts, request_id), ids
    continuing after the table's or the stored ``high_water`` mark.

    The accepted rows are written before they are numbered: a range partitioning samples
    its input, and would run the whole fold for each sample."""
    ensure_checkpoint_dir(results.sparkSession)
    acc = results.where(F.col("status") == ACCEPTED).select(
        "request_id", "product_id", "product_name", "category", "unit_price", "quantity",
        "total_amount", "sale_date", F.col("ts").alias("sale_timestamp"), "cashier_id")
    return assign_ids(acc.checkpoint(), next_after(sales, high_water), ["sale_timestamp", "request_id"]).select(
        "id", "product_id", "product_name", "category", "unit_price", "quantity",
        "total_amount", "sale_date", "sale_timestamp", "cashier_id")


__all__ = ["ACCEPTED", "INSUFFICIENT", "OUT_OF_STOCK_STATUS", "INVALID_QUANTITY", "NOT_FOUND",
           "AMOUNT_OVERFLOW", "step", "fold_stock", "prepare_requests", "decorate_outcomes", "apply_sale_requests", "stock_after_sales",
           "new_sales_rows"]
