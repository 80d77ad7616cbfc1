"""Helpers shared by the training-data operators (columns, numbering, components)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.session import ensure_checkpoint_dir

# Fixed value: the white space that ends a word (space, tab, LF, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]"

# Order of rows inside one numbering bucket is by key; the bucket itself is a
# multiplicative hash of the key, so consecutive keys spread over all buckets.
HASH_PRIME = 2147483647
HASH_FACTOR = 48271
ROW_BUCKETS = 16384


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` evaluated once per row.

    Catalyst may paste a projected expression into a lambda, where it would run
    once per element; a lambda variable cannot be pasted."""
    return F.transform(F.array(value), body)[0]


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """Input columns named like an output column give way to the output column."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def key_bucket(key: Column, text: Column, buckets: int) -> Column:
    """Bucket of a row by its integer key; rows without a key go by their text."""
    k = F.coalesce(key.cast("long"), F.crc32(text.cast("binary")), F.lit(0).cast("long"))
    spread = F.pmod(F.pmod(k, F.lit(HASH_PRIME)) * F.lit(HASH_FACTOR), F.lit(HASH_PRIME))
    return F.pmod(spread, F.lit(buckets)).cast("int")


def before(counts: DataFrame, group: list[str], order: str, n: str, out: str) -> DataFrame:
    """Running sum of ``n`` over the earlier rows of ``order`` within ``group``."""
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def rank_in_group(df: DataFrame, group: list[str], bucket: str, order: list[Column],
                  out: str) -> DataFrame:
    """0-based rank of every row of ``group`` by (bucket, order), split by bucket.

    A group of any size is sorted bucket by bucket; only one row per bucket meets
    in the running sum, so no task holds a whole group."""
    keys = [*group, bucket]
    counts = before(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), group, bucket, "_n", "_before")
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w) - 1)
    return (ranked.join(counts.drop("_n"), keys)
            .withColumn(out, (F.col("_before") + F.col("_rank")).cast("long"))
            .drop("_rank", "_before"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Rounds of hooking every node to its smallest neighbour's label and then
    following labels once (label doubling), so a chain of n links takes about
    log n rounds.  Each round is written to the session's checkpoint folder;
    only the number of changed labels comes to the driver.  Null ends and self
    links are ignored; an empty table gives an empty table."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    links = e.union(e.select("y", "x")).distinct().checkpoint()
    labels = links.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).checkpoint()
    while True:
        # the smallest label among a node's neighbours ...
        near = (links.join(labels.select(F.col("x").alias("y"), "label"), "y")
                .groupBy("x").agg(F.min("label").alias("low")))
        # ... is proposed to the node itself and to the root it hangs under
        own = labels.join(near, "x")
        moves = (own.select("x", F.least("label", "low").alias("low"))
                 .union(own.where("low < label").select(F.col("label").alias("x"), "low")))
        hooked = moves.groupBy("x").agg(F.min("low").alias("label"))
        root = hooked.select(F.col("x").alias("label"), F.col("label").alias("root"))
        jumped = (hooked.join(root, "label", "left")
                  .select("x", F.least("label", F.coalesce("root", "label")).alias("label")).checkpoint())
        changed = (jumped.join(labels.withColumnRenamed("label", "old"), "x")
                   .where("label <> old").limit(1).count())
        labels = jumped
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))


def text_key(key: Column, text: Column) -> list[Column]:
    """Columns that find a row again: its integer key (else a hash of its text) and
    a hash of its text."""
    return [F.coalesce(key.cast("long"), F.xxhash64(text), F.lit(0).cast("long")).alias("_fetch"),
            F.xxhash64(text).alias("_th")]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends instead of with the driver's
    garbage, so a job of many actions keeps those of one.  For results that are written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``df`` for use as the small side of a join: broadcast if it has at most
    ``most`` rows, else left to a shuffled hash join.  ``df`` should be written."""
    n = df.count()
    return (F.broadcast(df) if n <= most else df.hint("shuffle_hash")), n


# --- SimHash ------------------------------------------------------------------

# Bit lanes of a 64-bit word: one bit in every eighth (sixteenth) place.
LANES = {8: 0x0101010101010101, 16: 0x0001000100010001}


def majority(sums: list[Column], n: Column) -> Column:
    """The SimHash of ``n`` hashes from the sums of their bits in ``len(sums)`` words of
    lanes, lane k of each bit group shifted by k.  The lanes' top bits must be free."""
    width = len(sums)
    mask = F.lit(LANES[width]).cast("long")
    need = (F.lit((1 << (width - 2)) - 1) - F.floor(n / 2)).cast("long") * mask
    bits = [F.shiftleft(F.shiftrightunsigned(s + need, width - 2).bitwiseAND(mask), k) for k, s in enumerate(sums)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes: each bit is set when more than half of the
    hashes have it.  An element that occurs several times counts as often.

    Bits are summed side by side in lanes of 8 bits (up to 63 hashes) or 16 bits (up
    to 16383), whose top bits stay free; longer arrays sum bit by bit."""

    def in_lanes(h: Column, width: int) -> Column:
        lanes, mask = range(width), F.lit(LANES[width]).cast("long")
        zero = F.struct(*[F.lit(0).cast("long").alias(f"l{k}") for k in lanes])
        sums = F.aggregate(h, zero, lambda acc, x: F.struct(*[
            (acc[f"l{k}"] + F.shiftrightunsigned(x, k).bitwiseAND(mask)).alias(f"l{k}") for k in lanes]))
        return let(sums, lambda s: majority([s[f"l{k}"] for k in lanes], F.size(h)))

    def bit_by_bit(h: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
            lambda acc, b: F.when(
                2 * F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + F.getbit(x, b).cast("long")) > F.size(h),
                acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc))

    return let(hashes, lambda h: F.when(F.size(h) <= 63, in_lanes(h, 8))
               .when(F.size(h) <= 16383, in_lanes(h, 16)).otherwise(bit_by_bit(h)))
