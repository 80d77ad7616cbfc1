"""Structured Streaming versions of the sale ledger and live figures.

* R1 ``stream_apply_sales`` — M11 on an unbounded feed, read once.  A stateful
  processor (``transformWithStateInPandas``, RocksDB) keeps one integer a product,
  the stock left.  A product's first request brings the stock it starts with, from the
  stream-static join that also tells unknown products, so that products without
  requests have no state (an initial state would load them all).  Inside a
  micro-batch a product's requests are folded in order of (ts, request_id): the
  chunks that arrive are kept as numbers only (some 40 bytes a request, bounded by
  the trigger size), sorted and given out in slices; across micro-batches earlier
  batches come first.  With one batch per key (or a feed that arrives in ts order)
  the result equals M11.  Requests that need no stock to decide are spread over
  lanes of their own, which keep no state.
* R2 ``stream_daily_kpis`` — A13 for every day: tumbling 1-day event-time
  windows with a 1-day watermark (late data older than that is dropped).
* R3 ``stream_revenue_by_category`` — A1 kept live.
* R4 ``stream_stock_alerts`` — accepted sales that take a product into low
  stock (< 10) or out of stock (0), derived from R1's output stream.

Sinks are Parquet (append) or, for complete-mode aggregates, a
``foreachBatch`` that overwrites a Parquet table; checkpoints and outputs go
under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

from stockroom.functions.exprs import LOW_STOCK, OUT_OF_STOCK, money_sum
from stockroom.operators.sales import (ACCEPTED, INVALID_QUANTITY, NOT_FOUND, OUT_OF_STOCK_CODE, decorate_outcomes,
                                       step)
from stockroom.schemas import LOW_STOCK_LIMIT, MONEY, MONEY_SUM
from stockroom.session import scratch_path
from stockroom.sources.adapters import sale_feed_from_star, sales_from_star

WATERMARK = "1 day"          # fixed: lateness tolerated before a day closes
DAY = "1 day"

STATE_SCHEMA = StructType([StructField("left", IntegerType(), False)])


# --- sources --------------------------------------------------------------------

def parquet_stream(spark: SparkSession, folder: str, file_glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``folder`` (optionally only names matching
    ``file_glob``) as a stream; the schema is taken from the existing files."""
    r = spark.read
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    schema = r.parquet(folder).schema
    rs = spark.readStream.schema(schema)
    if file_glob:
        rs = rs.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        rs = rs.option("maxFilesPerTrigger", max_files_per_trigger)
    return rs.parquet(folder)


def event_time(col: str, spark: SparkSession) -> F.Column:
    """Zone-less timestamp (wall clock in UTC) → instant, for watermarks/windows."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.from_utc_timestamp(F.col(col).cast("timestamp"), tz)


def window_day(col: str, spark: SparkSession) -> F.Column:
    """The UTC calendar date a 1-day window starts on."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.to_date(F.to_utc_timestamp(F.col(col), tz))


# --- R1 -------------------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

# Lanes for requests that need no stock, a shuffle partition; lane 0 is the products' own.
LANES_A_PARTITION = 2
# Stands for NULL in number columns, which pandas would turn into floats.  (The chunks'
# columns must not start with an underscore: the worker renames those.)
NONE = -(2 ** 62)
# Rows of one product given out at a time.
SLICE_ROWS = 20_000

OUTCOME_NUMBERS = ("request_id", "product_id", "quantity", "cashier_id", "cents")
LEDGER_SCHEMA = StructType(
    [StructField(c, LongType(), False) for c in OUTCOME_NUMBERS]
    + [StructField("ts", TimestampNTZType(), True), StructField("pre", StringType(), True),
       StructField("product_name", StringType(), True), StructField("category", StringType(), True)]
    + [StructField(c, IntegerType(), False) for c in ("_code", "stock_before", "left")])


class StockLedger(StatefulProcessor):
    """Folds a product's requests over its stock, the only state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("left", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[1] != 0:                                   # a lane without stock
            for chunk in rows:
                if len(chunk):
                    yield chunk.assign(_code=0, stock_before=0, left=0)[LEDGER_SCHEMA.names]
            return
        first, parts = None, []
        for chunk in rows:
            if not len(chunk):                            # an empty chunk may come without columns
                continue
            first = chunk.iloc[0] if first is None else first
            parts.append([chunk[c].to_numpy() for c in ("ts", "request_id", "quantity", "cashier_id", "overflow")])
        if first is None:
            return
        ts, request, quantity, cashier, overflow = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((request, ts))
        # the first request of a product brings its stock
        stock = int(self.stock.get()[0]) if self.stock.exists() else int(first["stock0"])
        for low in range(0, len(order), SLICE_ROWS):
            at = order[low:low + SLICE_ROWS]
            code, before, left = (np.zeros(len(at), dtype=np.int32) for _ in range(3))
            for i, (q, o) in enumerate(zip(quantity[at].tolist(), overflow[at].tolist(), strict=True)):
                if stock == 0:                            # nothing changes any more
                    code[i:] = OUT_OF_STOCK_CODE
                    break
                before[i] = stock
                code[i], stock = step(stock, q, o)
                left[i] = stock
            yield pd.DataFrame({
                "request_id": request[at], "product_id": int(first["product_id"]), "quantity": quantity[at],
                "cashier_id": cashier[at], "cents": int(first["cents"]), "ts": ts[at], "pre": None,
                "product_name": first["product_name"], "category": first["category"],
                "_code": code, "stock_before": before, "left": left})[LEDGER_SCHEMA.names]
        self.stock.update((stock,))

    def close(self) -> None:
        pass


def stream_apply_sales(products: DataFrame, feed: DataFrame) -> DataFrame:
    """Streaming sale outcomes (same columns as M11).

    Start it on a session with the RocksDB state store (:func:`run_append` sees to it)."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"), "category",
                        (F.col("price") * 100).cast("long").alias("cents"), F.col("quantity").alias("stock0"))
    r = feed.select("request_id", "product_id", "quantity", "ts", "cashier_id")
    invalid = F.col("quantity").isNull() | (F.col("quantity") < 1)
    # an invalid request's product isn't looked up
    j = r.join(p, (F.col("product_id") == F.col("_pid")) & ~invalid, "left")
    pre = (F.when(invalid, F.lit(INVALID_QUANTITY)).when(F.col("_pid").isNull(), F.lit(NOT_FOUND)))
    price = (F.col("cents") / F.lit(100)).cast(MONEY)
    total = (price * F.col("quantity").cast("decimal(10,0)")).try_cast(MONEY)
    lanes = LANES_A_PARTITION * int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = {c: F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c) for c in OUTCOME_NUMBERS}
    lane = F.when(F.col("pre").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("request_id"), F.lit(lanes)))
    rows = j.withColumn("pre", pre).select(
        F.when(F.col("pre").isNull(), F.col("product_id")).otherwise(F.lit(NONE)).cast("long").alias("product"),
        lane.cast("long").alias("lane"), *number.values(), "ts", "pre", "product_name", "category",
        F.coalesce("stock0", F.lit(0)).alias("stock0"), total.isNull().alias("overflow"))
    out = rows.groupBy("product", "lane").transformWithStateInPandas(StockLedger(), LEDGER_SCHEMA, "Append", "None")
    schema = {f.name: f.dataType for f in r.schema.fields}
    back = {c: F.nullif(F.col(c), F.lit(NONE).cast("long")) for c in OUTCOME_NUMBERS}
    decided = F.col("_code") != 0
    out = out.select(
        *[back[c].cast(schema[c]).alias(c) for c in ("request_id", "product_id", "quantity", "cashier_id")],
        "ts", F.col("pre").alias("_pre"), "product_name", "category",
        (back["cents"] / F.lit(100)).cast(MONEY).alias("unit_price"),
        *[F.when(decided, F.col(c)).alias(c) for c in ("_code", "stock_before", "left")])
    total = (F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")).try_cast(MONEY)
    return decorate_outcomes(out.withColumn("total_amount", total))


# --- R2, R3 ---------------------------------------------------------------------

def stream_daily_kpis(sales: DataFrame) -> DataFrame:
    """R2: revenue, items sold and transactions per UTC day (event time)."""
    spark = sales.sparkSession
    s = sales.withColumn("_et", event_time("sale_timestamp", spark)).withWatermark("_et", WATERMARK)
    agg = s.groupBy(F.window("_et", DAY).alias("w")).agg(
        F.coalesce(money_sum("total_amount"), F.lit(0).cast(MONEY_SUM)).alias("revenue"),
        F.sum("quantity").cast("bigint").alias("items_sold"),
        F.count(F.lit(1)).alias("transactions"))
    return agg.select(window_day("w.start", spark).alias("day"), "revenue", "items_sold", "transactions")


def stream_revenue_by_category(sales: DataFrame) -> DataFrame:
    """Units and revenue per category, updated as sales arrive."""
    return sales.groupBy("category").agg(
        F.sum("quantity").cast("bigint").alias("total_units_sold"),
        money_sum("total_amount").alias("total_revenue"))


# --- R4 -------------------------------------------------------------------------

def stream_stock_alerts(outcomes: DataFrame) -> DataFrame:
    """Accepted sales that move a product into LOW STOCK or OUT OF STOCK."""
    left, before = F.col("left"), F.col("stock_before")
    kind = (F.when(left == 0, F.lit(OUT_OF_STOCK))
            .when((left > 0) & (left < LOW_STOCK_LIMIT) & (before >= LOW_STOCK_LIMIT), F.lit(LOW_STOCK)))
    return (outcomes.where(F.col("status") == ACCEPTED)
            .withColumn("alert", kind).where(F.col("alert").isNotNull())
            .select("request_id", "product_id", "ts", "alert", "stock_before", "left"))


# --- running a stream to completion ---------------------------------------------

@dataclass
class StreamRun:
    output: str
    checkpoint: str


def _state_in_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep several kinds of state, which only the RocksDB store holds;
    a session that has another one set keeps it for what it started before."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def run_append(df: DataFrame, name: str, available_now: bool = True, run: StreamRun | None = None) -> StreamRun:
    """Append-mode stream → Parquet folder; blocks until the input is drained.  ``run``:
    an earlier run to go on with, from its checkpoint."""
    spark = df.sparkSession
    _state_in_rocksdb(spark)
    run = run or StreamRun(scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt"))
    w = df.writeStream.format("parquet").option("path", run.output).option("checkpointLocation", run.checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w).outputMode("append").start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return run


def run_complete(df: DataFrame, name: str) -> StreamRun:
    """Complete-mode aggregate → each epoch overwrites a Parquet table."""
    spark = df.sparkSession
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return StreamRun(out, ck)


def read_run(spark: SparkSession, run: StreamRun, schema: StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(run.output)


# --- test-data drivers ----------------------------------------------------------

def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_feed_from_star(parquet_stream(spark, sf_dir, "events.parquet"))


def sales_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a stream, joined stream-static to part and orders → sale rows."""
    base = sf_dir.rstrip("/")
    lines = parquet_stream(spark, base, "lineitem.parquet")
    part = spark.read.parquet(f"{base}/part.parquet")
    orders = spark.read.parquet(f"{base}/orders.parquet")
    return sales_from_star(lines, part, orders, with_id=False)


__all__ = ["WATERMARK", "parquet_stream", "event_time", "window_day", "stream_apply_sales",
           "stream_daily_kpis", "stream_revenue_by_category", "stream_stock_alerts", "run_append",
           "run_complete", "read_run", "feed_stream", "sales_stream", "StreamRun",
]
