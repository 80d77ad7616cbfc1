"""Benchmark decontamination by SimHash windows the size of the benchmark items.

Words are lower-cased; shingles have ``width`` words (an item with fewer words: all
of its words).  A window has as many shingles as the item it is held against.

1. Windows.  Only windows that can reach the similarity are formed: they start at a
   shingle that occurs in some item of that size, and at least ``percent`` of their
   shingles do.  (Shifting any other window to its first such shingle loses none of
   them, so no match is missed.)
2. Fingerprints.  Each window and each item has a 64-bit SimHash of its shingles.  All
   pairs within RADIUS bits are found by multi-index blocks: of BLOCKS blocks of bits,
   one differs in at most RADIUS div BLOCKS bits.  Items are entered under their blocks,
   windows look up all values within that many bits (697 of 65,536 in 16 bits); a pair
   is taken at its first such block.  Random fingerprints meet in some 4 % of pairs.
3. Verification.  The weighted similarity is exact: a shingle weighs as often as it
   occurs, and sum of minima over sum of maxima must be at least ``percent`` %.

The benchmark's shingles and items are broadcast up to BROADCAST_ROWS rows, the
found windows likewise; beyond that Spark joins by shuffle.  Texts are not shuffled
in the broadcast case.  Expressions are Spark's own throughout.

Defined results: null and blank texts and items match nothing; repeated items each
match; a document and an item give one row, the best window (ties: the first); rows
equal in key and text count as one document; a null key stays null; an empty table
gives an empty table; only the key and text columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import few, let, simhash, text_key, words
from stockroom.session import ensure_checkpoint_dir

WIDTH, PERCENT = 5, 80
RADIUS = 15
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
BLOCK_RADIUS = RADIUS // BLOCKS         # BLOCKS blocks with more bits apart have over RADIUS together
# What a block may differ by.
PROBES = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS]
BROADCAST_ROWS = 1_000_000


def shingles(w: Column, width: int) -> Column:
    """Hashes of the ``width``-word windows of an array of words (empty if too few)."""
    return F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))).otherwise(
            F.array().cast("array<bigint>"))


def text_shingles(text: Column, width: int) -> Column:
    return let(words(F.lower(text)), lambda w: shingles(w, width))


def item_shingles(benchmark: DataFrame, item: str, width: int) -> DataFrame:
    """(item_id, width, m, shingles): the items by their own shingle width."""
    w = benchmark.select(F.col(item).alias("item_id"), words(F.lower(F.col("text"))).alias("w"))
    sized = w.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(width)))
    cases = [F.when(F.col("width") == k, shingles(F.col("w"), k)) for k in range(1, width + 1)]
    return sized.select("item_id", "width", F.coalesce(*cases).alias("shingles")).withColumn(
        "m", F.size("shingles"))


def shingle_counts(h: Column) -> Column:
    """Sorted distinct shingles with their counts, as array<struct<x, n>>, from an array of hashes."""
    # a sorted array's runs: each start, up to the next one
    runs = lambda a: let(F.filter(F.transform(
        a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), i)), lambda i: i.isNotNull()), lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(a, i).alias("x"),
                                      (F.coalesce(F.get(at, k + 1), F.size(a)) - i).cast("long").alias("n"))))
    return let(F.array_sort(h), runs)


def common_weight(a: Column, b: Column) -> Column:
    """Sum over the distinct shingles of the smaller of their counts, for two arrays of
    ``shingle_counts``.  One map lookup a shingle."""
    theirs = F.map_from_entries(b)
    return let(theirs, lambda m: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.least(
        x["n"], F.coalesce(F.element_at(m, x["x"]), F.lit(0).cast("long")))))


def block(fingerprint: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, j * BLOCK_BITS).bitwiseAND(
        F.lit((1 << BLOCK_BITS) - 1))


def window_starts(docs: DataFrame, items: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """(_fetch, _th, m, starts): the windows of each document worth a fingerprint."""
    index, _ = few(items.where(F.col("width") == width)
                   .select(F.explode("shingles").alias("shingle"), "m").distinct().checkpoint(), BROADCAST_ROWS)
    hits = (docs.select(*text_key(F.col(key), F.col("text")),
                        F.posexplode(text_shingles(F.col("text"), width)).alias("at", "shingle"))
            .join(index, "shingle").select("_fetch", "_th", "m", "at"))
    per = hits.groupBy("_fetch", "_th", "m").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # from its start, a window must hold ceil(percent * m) such shingles
    starts = let(F.struct("at", "m", F.expr(f"({percent} * m + 99) div 100").alias("need")),
                 lambda s: F.filter(s["at"], lambda p, i: F.coalesce(
                     F.get(s["at"], i + s["need"].cast("int") - 1) < p + s["m"], F.lit(False))))
    return per.withColumn("starts", starts).where(F.size("starts") > 0).select("_fetch", "_th", "m", "starts")


def windows(docs: DataFrame, items: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """(doc_id, _fetch, _th, m, start, shingles, fingerprint) of every window."""
    found = (window_starts(docs, items, key, width, percent)
             .groupBy("_fetch", "_th").agg(F.collect_list(F.struct("m", "starts")).alias("sizes")).checkpoint())
    wanted, _ = few(found, BROADCAST_ROWS)
    rows = (docs.select(F.col(key).alias("doc_id"), "text", *text_key(F.col(key), F.col("text")))
            .join(wanted, ["_fetch", "_th"])
            .select("doc_id", "_fetch", "_th", text_shingles(F.col("text"), width).alias("all"),
                    F.explode("sizes").alias("s"))
            .select("doc_id", "_fetch", "_th", "all", F.col("s.m").alias("m"), F.explode("s.starts").alias("start"))
            .select("doc_id", "_fetch", "_th", "m", "start",
                    F.slice("all", F.col("start") + 1, F.col("m")).alias("shingles")))
    return rows.withColumn("fingerprint", simhash(F.col("shingles")))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id",
            width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, common, total,
    similarity, start (word number of the window), size (its shingles)."""
    ensure_checkpoint_dir(docs.sparkSession)
    items = item_shingles(benchmark, item, width).checkpoint()
    shorter = [r["width"] for r in items.select("width").distinct().collect()]     # at most ``width`` values
    sides = [one_width(docs, items, key, k, percent) for k in sorted(shorter)] or [
        one_width(docs, items, key, width, percent)]
    return best_windows(reduce(DataFrame.union, sides))


def within_radius(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of equal ``m`` whose ``fingerprint`` and ``mark`` differ in at most RADIUS bits.

    ``theirs`` (written) is entered BLOCKS times and broadcast up to BROADCAST_ROWS entries."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    index, _ = few(theirs.select("*", blocks).withColumn("value", block(F.col("mark"), F.col("block"))).checkpoint(),
                   BROADCAST_ROWS)
    probes = (ours.select("*", blocks)
              .withColumn("value", F.explode(let(block(F.col("fingerprint"), F.col("block")), lambda v: F.transform(
                  F.array(*[F.lit(x) for x in PROBES]).cast("array<bigint>"), lambda x: x.bitwiseXOR(v))))))
    differ = F.col("fingerprint").bitwiseXOR(F.col("mark"))
    first = F.forall(F.when(F.col("block") > 0, F.sequence(F.lit(0), F.col("block") - 1))
                     .otherwise(F.array().cast("array<int>")),
                     lambda j: F.bit_count(block(differ, j)) > BLOCK_RADIUS)
    return (probes.join(index, ["m", "block", "value"])
            .where((F.bit_count(differ) <= RADIUS) & first).drop("block", "value"))


def one_width(docs: DataFrame, items: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    theirs = (items.where(F.col("width") == width)
              .select("item_id", "m", F.col("shingles").alias("theirs"), simhash(F.col("shingles")).alias("mark")))
    ours = windows(docs, items, key, width, percent)
    pairs = within_radius(ours, theirs.checkpoint())
    common = pairs.withColumn("common", common_weight(shingle_counts(F.col("shingles")), shingle_counts(F.col("theirs"))))
    return (common.withColumn("total", F.size("shingles") + F.size("theirs") - F.col("common"))
            .where(F.lit(100) * F.col("common") >= F.lit(percent) * F.col("total"))
            .select("doc_id", "_fetch", "_th", "item_id", "common", "total", "start", F.col("m").alias("size")))


def best_windows(found: DataFrame) -> DataFrame:
    rank = F.struct((F.col("common") / F.col("total")).alias("similarity"), (-F.col("start")).alias("back"),
                    "common", "total", "size")
    return (found.groupBy("_fetch", "_th", "item_id").agg(F.max(rank).alias("b"), F.first("doc_id").alias("doc_id"))
            .select("doc_id", "_fetch", "_th", "item_id", "b.common", "b.total", "b.similarity",
                    (-F.col("b.back")).cast("long").alias("start"), F.col("b.size").cast("long").alias("size")))


def op9_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs.select("doc_id", "text"), benchmark).drop("_fetch", "_th")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    leaks, _ = few(matches(docs.select(key, "text"), benchmark, key).select("_fetch", "_th").distinct().checkpoint(),
                   BROADCAST_ROWS)
    named = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*named).alias("_row"), *text_key(F.col(key), F.col("text")))
    return rows.join(leaks, ["_fetch", "_th"], "left_anti").select("_row.*")


# All windows that start at a benchmark shingle, held against the items exactly.
SQL = f"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
items AS (
  SELECT item_id, least(len(w), {WIDTH}) AS width,
         list_transform(range(0, len(w) - least(len(w), {WIDTH}) + 1),
                        lambda i: array_to_string(w[i + 1:i + least(len(w), {WIDTH})], ' ')) AS sh
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT DISTINCT unnest(sh) AS shingle, width, len(sh) AS m FROM items),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
widths AS (SELECT DISTINCT width FROM items),
docs AS (
  SELECT doc_id, width, list_transform(range(0, len(w) - width + 1),
                                       lambda i: array_to_string(w[i + 1:i + width], ' ')) AS sh
  FROM doc_words, widths WHERE len(w) >= width),
places AS (SELECT doc_id, width, unnest(sh) AS shingle, generate_subscripts(sh, 1) - 1 AS p FROM docs),
hits AS (SELECT DISTINCT doc_id, width, m, p FROM places JOIN sizes USING (shingle, width)),
starts AS (
  SELECT a.doc_id, a.width, a.m, a.p FROM hits a JOIN hits b
    ON a.doc_id = b.doc_id AND a.width = b.width AND a.m = b.m AND b.p >= a.p AND b.p < a.p + a.m
  GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * a.m),
cut AS (
  SELECT s.doc_id, s.m, s.p, s.width, d.sh[s.p + 1:s.p + s.m] AS win
  FROM starts s JOIN docs d ON s.doc_id = d.doc_id AND s.width = d.width),
cut_counts AS (
  SELECT doc_id, m, p, width, len(win) AS n, x, count(*) AS c
  FROM (SELECT *, unnest(win) AS x FROM cut) GROUP BY ALL),
item_counts AS (SELECT item_id, width, len(sh) AS m, x, count(*) AS c FROM (SELECT *, unnest(sh) AS x FROM items) GROUP BY ALL),
pairs AS (
  SELECT a.doc_id, b.item_id, a.p, a.m, a.n, sum(least(a.c, b.c))::BIGINT AS common
  FROM cut_counts a JOIN item_counts b ON a.x = b.x AND a.m = b.m AND a.width = b.width
  GROUP BY ALL),
scored AS (SELECT *, (n + m - common)::BIGINT AS total FROM pairs)
SELECT doc_id, item_id, common, total, common / total AS similarity, p::BIGINT AS start, m::BIGINT AS size
FROM scored WHERE 100 * common >= {PERCENT} * total
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / total DESC, p) = 1
"""
