"""N-gram Jaccard join with prefix filters under several token orders.

A document's set is its distinct ``width``-word shingles (the whole sequence when
it has fewer words), ASCII lower-cased, as 64-bit hashes.  Two sets link when
100 * intersection >= ``percent`` * union.

1. Documents with equal sets form a class (128-bit digest); classes are compared.
2. Three global token orders put tokens of many documents last and break ties by
   different mixings.  Linked sets share a token in their prefixes under every
   order.  The first order's prefixes form an inverted index; a pair that meets
   there must pass the length and position bounds and must share prefix tokens
   under the other two orders as well, before any set is looked at.  Bitmaps of
   BITMAP bits bound the sets' difference from below and drop near misses.
3. Round one compares each index list's member of the lowest position with the
   others and joins verified pairs into components.  Round two takes the pairs
   left over: members of one list that are in different components.  So a large
   group of near copies costs pairs in proportion to its size, and every link
   between different components is still found.
4. Survivors are verified exactly on their whole sets; components are closed over
   all verified links.

How common a token is comes from counts over all documents: every task counts its
batch and passes on what it met twice or more; the sums are cut to HEAVY_TOKENS
tokens, the most common ones, so the table sent to tasks has a fixed size.  The
counts only choose an order, and any order gives the same result.

Defined results: null and blank texts have an empty set, link with nothing and are
their own component; equal texts share a component; a null doc_id never becomes a
component id; repeated rows each keep their row; an empty table gives an empty
table; only the key and text columns are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import components
from stockroom.session import ensure_checkpoint_dir, scratch_path

WIDTH, PERCENT = 5, 80
HEAVY_TOKENS = 1 << 18
# Ids of the sets to fetch are broadcast up to this many (8 bytes each), else joined.
BROADCAST_IDS = 1_000_000
# Text hashed at a time, in bytes, and tokens counted at a time.
CHUNK_BYTES = 1 << 19
CHUNK_TOKENS = 1 << 20
BITMAP = 1024
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


# --- sets of hashed shingles ------------------------------------------------

def finalise(x: np.ndarray, key: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(key)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return z ^ (z >> np.uint64(33))


@lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value per byte (A-Z as a-z), and which bytes end words."""
    codes = np.arange(256)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return finalise(lower.astype(np.uint64) + np.uint64(1), 0x2545F4914F6CDD1D), space


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    back = pow(base, -1, 2**64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, dtype=np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, back, dtype=np.uint64)])
    return up, down


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the documents data[bounds[i]:bounds[i+1]], and word counts."""
    n_docs = len(bounds) - 1
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(n_docs, dtype=np.int64)
    value, space = byte_tables()
    word = ~space[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True                              # a word ends where its document does
    starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | cut[:-1]))
    ends = np.flatnonzero(word & (np.r_[~word[1:], True] | cut[1:])) + 1
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = powers(size)
    with np.errstate(over="ignore"):
        total = np.cumsum(value[data] * up[:len(data)])
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        hashes = finalise((total[ends - 1] - before) * down[starts], 1) + (ends - starts).astype(np.uint64)
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes per row) for chunks of whole texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, dtype=np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        low, high = int(offsets[first]), int(offsets[last])
        hashes, counts = word_hashes(data[low:high], offsets[first:last + 1] - low)
        yield first, sets_of(hashes, counts, width)
        first = last


def sets_of(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    step = finalise(np.arange(1, width + 1, dtype=np.uint64), 0x27D4EB2F165667C5) | np.uint64(1)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, dtype=np.uint64)
        partial = []
        for k in range(width):
            if k < n:
                rolled[:n - k] += hashes[k:] * step[k]
            partial.append(rolled.copy() if k < width - 1 and (counts == k + 1).any() else None)
        whole = finalise(rolled, width)
    starts = np.r_[0, np.cumsum(counts)]
    out = []
    for i, m in enumerate(counts):
        s = starts[i]
        if m >= width:
            out.append(np.unique(whole[s:s + m - width + 1]))
        elif m:
            out.append(finalise(partial[m - 1][s:s + 1], int(m)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_batches(df: DataFrame) -> DataFrame:
    return df.where(F.octet_length("text") > 0)


# --- how common tokens are ----------------------------------------------------

def heavy_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common tokens and the size class of their counts."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for first, sets in shingle_sets(batch.column(0), width):
                held += sets
                size += sum(map(len, sets))
                if size >= CHUNK_TOKENS:
                    yield counted(held)
                    held, size = [], 0
            yield counted(held)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_counts=True)
        tokens, n = tokens[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(n.astype(np.int64))], ["token", "n"])

    counts = (text_batches(docs.select("text")).mapInArrow(repeated, "token long, n long")
              .groupBy("token").agg(F.sum("n").alias("n"))
              .select("token", F.floor(F.log2("n")).cast("int").alias("size")).checkpoint())
    # whole size classes from the top, as many as fit
    room, lowest = HEAVY_TOKENS, 64
    for size, n in sorted(((r["size"], r["count"]) for r in counts.groupBy("size").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        lowest = size
    top = counts.where(F.col("size") >= lowest).toArrow()
    tokens = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("size").to_numpy().astype(np.uint64)[order]


def ordered(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Sort key of tokens under the k-th order: size class, then a mixing of its own."""
    names, size = heavy
    key = finalise(tokens, ORDERS[k]) >> np.uint64(8)
    if len(names):
        at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        key |= np.where(names[at] == tokens, size[at], np.uint64(0)) << np.uint64(56)
    return key


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a linked set must have one: all but the least overlap, plus one."""
    return n - -(-percent * n // 100) + 1 if n else 0


# --- sketches -------------------------------------------------------------------

def sketches(docs: DataFrame, key: str, width: int, percent: int,
             heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: doc_id, fetch and th (where to find its text), n, digest d1 d2, its
    prefixes under the three orders (hashes, the last two cut to 32 bits) and bitmap."""
    schema = ("doc_id long, fetch long, th long, n long, d1 long, d2 long, "
              "o1 array<long>, o2 array<int>, o3 array<int>, bits array<long>")
    sent = docs.sparkSession.sparkContext.broadcast(heavy)      # HEAVY_TOKENS entries at most

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        names = ["doc_id", "fetch", "th", "n", "d1", "d2", "o1", "o2", "o3", "bits"]
        for batch in batches:
            for first, sets in shingle_sets(batch.column(3), width):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                d1 = np.array([finalise(s, 7).sum() for s in sets], dtype=np.uint64)
                d2 = np.array([finalise(s, 11).sum() for s in sets], dtype=np.uint64)
                flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
                cuts = np.r_[0, np.cumsum(n)]
                columns = []
                for k in range(len(ORDERS)):
                    keys = ordered(flat, table, k)
                    parts = []
                    for i, s in enumerate(sets):
                        own = keys[cuts[i]:cuts[i + 1]]
                        p = prefix_length(len(s), percent)
                        at = np.argpartition(own, p - 1)[:p] if p < len(s) else np.arange(len(s))
                        parts.append(s[at[np.argsort(own[at])]])
                    sizes = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
                    tokens = signed(np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]))
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(sizes), pa.array(tokens if k == 0 else tokens.astype(np.int32))))
                marks = np.zeros((len(sets), BITMAP), dtype=bool)
                marks[np.repeat(np.arange(len(sets)), n), flat % np.uint64(BITMAP)] = True
                bits = np.packbits(marks, axis=1).view(np.int64).reshape(-1)
                columns.append(pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITMAP // 64)), pa.array(bits)))
                empty = n == 0
                rows = slice(first, first + len(sets))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c)[rows] for c in range(3)], pa.array(n),
                    pa.array(signed(d1), mask=empty), pa.array(signed(d2), mask=empty), *columns], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), fetch_key(F.col(key), F.col("text")).alias("fetch"),
                       F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    return rows.mapInArrow(sketch, schema)


def fetch_key(key: Column, text: Column) -> Column:
    return F.coalesce(key.cast("long"), F.xxhash64(text))


# --- pairs ------------------------------------------------------------------------

def may_link(na: str, i: str, nb: str, j: str, percent: int) -> Column:
    """Upper bound of the similarity of two sets whose first common token in the
    order is at places i and j: nothing before it is common."""
    return F.expr(f"100 * least({na} - {i}, {nb} - {j}) >= "
                  f"{percent} * ({i} + {j} + greatest({na} - {i}, {nb} - {j}))")


def of_nodes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sketches of the classes that a pair names."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().checkpoint()
    few = nodes.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(nodes) if few else nodes.hint("shuffle_hash"), "node", "left_semi")


def share_other_orders(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose prefixes also meet under the second and third order and whose
    bitmaps differ in no more places than linked sets may have tokens apart."""
    pairs = pairs.checkpoint()
    found = of_nodes(rows, pairs)
    side = lambda x: found.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"),
                                  F.col("o2").alias(f"{x}2"), F.col("o3").alias(f"{x}3"),
                                  F.col("bits").alias(f"{x}_bits"))
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda acc, x: acc + x)
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(apart * (100 + percent) <= (100 - percent) * (F.col("an") + F.col("bn")))
            .where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, key: str, width: int,
             percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the exact overlap of their whole sets."""
    pairs = pairs.checkpoint()
    wanted = of_nodes(rows, pairs).select("node", "fetch", "th").checkpoint()
    few = wanted.count() <= BROADCAST_IDS

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), width):
                tokens = signed(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]))
                sizes = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[first:first + len(sets)],
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(tokens))], ["node", "tokens"])

    texts = text_batches(docs.select(fetch_key(F.col(key), F.col("text")).alias("fetch"),
                                     F.xxhash64("text").alias("th"), F.col("text").alias("text")))
    texts = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["fetch", "th"])
    # a repeated row's set once; both sides of the pairs below read the same exchange
    found = (texts.select("node", "text").mapInArrow(whole, "node long, tokens array<long>")
             .groupBy("node").agg(F.first("tokens").alias("tokens")))
    side = lambda x: found.select(F.col("node").alias(x), F.col("tokens").alias(f"{x}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both))
            .select("a", "b").checkpoint())


def grouped(docs: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, fetch, th, n, component (a class number; null for an empty
    set) and component_id."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    heavy = heavy_tokens(docs, width)
    path = scratch_path(spark, "jaccard-sketches")
    (sketches(docs, key, width, percent, heavy)
     .withColumn("node", F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path)

    classes = (rows.where("n > 0").groupBy("d1", "d2")
               .agg(F.min("node").alias("node"), F.min("doc_id").alias("low")).checkpoint())

    # the first order's index: one row per prefix token of a class
    postings = (rows.select("node", "n", "o1").join(classes.select("node"), "node", "left_semi")
                .select("node", "n", F.posexplode("o1").alias("place", "token")).repartition("token"))
    by = Window.partitionBy("token").orderBy("place", "n", "node")
    lists = (postings.withColumn("head", F.first(F.struct("node", "n", "place")).over(by))
             .withColumn("after", F.lead("node").over(by))
             .where("head.node <> node or after is not null").drop("after").checkpoint())

    star = (lists.where("head.node <> node")
            .where(may_link("n", "place", "head.n", "head.place", percent))
            .select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
            .distinct())
    links = verified(share_other_orders(star, rows, percent), docs, rows, key, width, percent)
    joined = components(links)

    # round two: members of one list that are still in different components
    labelled = (lists.select("token", "node", "n", "place").join(joined, "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
    open_lists = (labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                  .where("x <> y").select("token"))
    left = labelled.join(open_lists, "token").checkpoint()
    a, b = left.alias("a"), left.alias("b")
    cross = (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node"))
                    & (F.col("a.component") != F.col("b.component"))
                    & may_link("a.n", "a.place", "b.n", "b.place", percent))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    more = verified(share_other_orders(cross, rows, percent), docs, rows, key, width, percent)
    parts = components(links.union(more))

    labels = (classes.join(parts.withColumnRenamed("component", "root"), "node", "left")
              .withColumn("component", F.coalesce("root", "node")).drop("root"))
    lows = labels.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = labels.join(lows, "component").select("d1", "d2", "component", "component_id")
    return (rows.select("doc_id", "fetch", "th", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("d1", "d2"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) per row."""
    return grouped(docs, key, width, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", width: int = WIDTH,
                percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the smallest key stays,
    a row without a key only where no member has one.  Rows with an empty set all stay;
    of rows equal in key and text one stays."""
    members = grouped(docs, key, width, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fetch", "th")
    picks = (members.where("component is not null").groupBy("component").agg(F.min(rank).alias("p"))
             .select(F.col("p.fetch").alias("_fetch"), F.col("p.th").alias("_th")))
    named = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*named).alias("_row"), fetch_key(F.col(key), F.col("text")).alias("_fetch"),
                       F.xxhash64("text").alias("_th"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("_full"))
    one = Window.partitionBy("_fetch", "_th").orderBy("_th")
    kept = (rows.where("_full").join(picks, ["_fetch", "_th"], "left_semi")
            .withColumn("_copy", F.row_number().over(one)).where("_copy = 1"))
    return kept.select("_row.*").union(rows.where(~F.coalesce("_full", F.lit(False))).select("_row.*"))


def op5_documents(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), width=3, percent=90)


# Every pair that shares a shingle, counted; components by reachability.
SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM split),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
lows AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN lows ON doc_id = a
"""
