"""Sharding by a keyed permutation of global row numbers.

Every row has a global row number r in [0, N).  A Feistel network over the
mixed radix a x b >= N (a, b close to the square root of N) permutes the
numbers; results outside [0, N) are walked along their cycle until they fall
inside.  With p the permuted number and S shards, ``shard = p mod S`` and
``slot = p div S``: shard sizes differ by at most one row, slots are gapless,
and both can be computed (and inverted) from r, N and the seed alone.

Row numbers come from stored order where the table is read from files
(``stored_order=True``), else from the key: rows are spread over ROW_BUCKETS
buckets by a hash of the key and numbered bucket by bucket, so nothing is
sorted in one task and the numbers do not depend on files or partitions.

Defined results: null texts count as no text; rows without a key are ordered
by their text; rows equal in key and text are interchangeable, and each has a
number of its own; an empty table gives an empty table; input columns named
like an output column are replaced by it.  Rows equal in every column share a
bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import ROW_BUCKETS, before, drop_clashes, key_bucket

SHARDS = 16
SEED = 20240229
ROUNDS = 8
OUTPUT = ("row_number", "position", "shard", "slot")
# A table of one row per input file is broadcast up to this many files.
MAX_BROADCAST_FILES = 50_000


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """Round function: a 64-bit finaliser of value and round key."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(key)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64 for i in range(ROUNDS)]


def radix(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a)


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of [0, n), or its inverse, for an array of numbers."""
    a, b = radix(n)
    ua, ub = np.uint64(a), np.uint64(b)
    keys = list(enumerate(round_keys(seed)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x // ub, x % ub
        for i, key in reversed(keys) if inverse else keys:
            if i % 2 == 0:
                step = mixed(right, key) % ua
                left = (left + (ua - step if inverse else step)) % ua
            else:
                step = mixed(left, key) % ub
                right = (right + (ub - step if inverse else step)) % ub
        return left * ub + right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def position_of(row_number: Column, n_rows: Column, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), int(n.iloc[0]), seed) if len(r) else r, dtype="int64")

    return place(row_number, n_rows)


def with_key_numbers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Row numbers by (bucket of the key, key, text checksum)."""
    df = (docs.withColumn("_crc", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
          .withColumn("_bucket", key_bucket(F.col(key), F.col(text), ROW_BUCKETS)))
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = (before(counts, [], "_bucket", "_n", "_before")
               .withColumn("_rows", F.sum("_n").over(Window.partitionBy())).drop("_n"))
    w = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), F.col("_crc"),
                                              F.col(text).isNotNull())
    return (df.withColumn("_rank", F.row_number().over(w) - 1)
            .join(F.broadcast(offsets), "_bucket")      # at most ROW_BUCKETS rows
            .withColumn("row_number", F.col("_before") + F.col("_rank"))
            .drop("_crc", "_bucket", "_rank", "_before"))


def has_stored_order(docs: DataFrame) -> bool:
    """Whether the frame is a plain file scan, whose rows have a file and an index."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return True
    except AnalysisException:
        return False


def with_stored_numbers(docs: DataFrame) -> DataFrame:
    """Row numbers in stored order: files by name, rows by their index in the file."""
    df = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    counts = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    offsets = (before(counts, [], "_file", "_n", "_before")
               .withColumn("_rows", F.sum("_n").over(Window.partitionBy())).drop("_n"))
    if len(docs.inputFiles()) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return df.join(offsets, "_file").withColumn("row_number", F.col("_before") + F.col("_index")).drop(
        "_file", "_index", "_before")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id",
          text: str = "text", stored_order: bool = False) -> DataFrame:
    """The input columns plus row_number, position, shard and slot of every row.

    ``stored_order`` needs a plain file scan; other frames are numbered by key."""
    clean = drop_clashes(docs, *OUTPUT) if {c.lower() for c in docs.columns} & set(OUTPUT) else docs
    numbered = (with_stored_numbers(clean) if stored_order and has_stored_order(clean)
                else with_key_numbers(clean, key, text))
    return (numbered.withColumn("position", position_of(F.col("row_number"), F.col("_rows"), seed))
            .withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
            .withColumn("slot", F.expr(f"position div {int(shards)}"))
            .drop("_rows"))


def op1_documents(docs: DataFrame) -> DataFrame:
    """The contract's digest columns over the whole table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", F.col("text"), (F.octet_length(text).cast("long") + 1).alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = narrow.select("doc_id", "size", "text_crc32",
                           F.when(F.col("text").isNull(), F.lit(None)).otherwise(
                               F.col("text_crc32").cast("string")).alias("text"))
    return shard(narrow).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
