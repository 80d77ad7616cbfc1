"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are numbered and cut into blocks of ``block_rows``.  A source
with ``a`` of the ``A`` integer parts has weight a/A; its i-th block (from 0) is
released at slot floor(i*A/a) and due by slot ceil((i+1)*A/a).  In every slot the
released block with the earliest deadline runs (ties: source name), so after t
slots each source has run within less than one block of t*a/A.  The schedule
repeats every A slots, so one period is computed once as a table of A rows and
a block finds its slot by arithmetic: ``slot = (i div a) * A + slot in period``.

No row is dropped or repeated: once a source is used up its later slots stay
empty, and the sources left keep their slots, order and shares to one another.

Target parts: the caller's (source, parts) table, or by default PARTS shared in
proportion to the square root of each source's rows (at least one part each).

Defined results: a null source counts as the source ''; rows without a key go by
their text; rows equal in key are ordered by the checksum of their text; an empty
table gives an empty table; input columns named like an output column are
replaced by it; sources missing from a given table get one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockroom.llm.common import drop_clashes, key_bucket, rank_in_group

PARTS = 1000
BLOCK_ROWS = 16
SOURCE_BUCKETS = 1024
OUTPUT = ("block", "in_block", "parts", "release", "deadline", "slot")
# The period table is broadcast up to this many rows.
MAX_BROADCAST_SLOTS = 200_000


def target_parts(docs: DataFrame, source: str, parts: int) -> DataFrame:
    """(source, parts): shares by the square root of the sources' row counts."""
    counts = (docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source"))
              .agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("_root")))
    total = F.sum("_root").over(Window.partitionBy())              # one row per source
    return counts.select("_source", F.greatest(F.lit(1), F.round(
        F.lit(parts) * F.col("_root") / total).cast("int")).alias("_parts"))


def period(targets: DataFrame) -> DataFrame:
    """One period of the schedule: (_source, _turn, _parts, _total, _at).

    One row per slot; ``_turn`` counts the source's blocks within the period.  The
    shares add up to one, so some released block is waiting in every slot."""
    row = targets.agg(F.sort_array(F.collect_list(F.struct("_source", "_parts"))).alias("s"),
                      F.sum("_parts").cast("int").alias("total")).where("total > 0")
    # done: blocks run so far per source; plan: the source and turn of every slot
    steps = """
      aggregate(sequence(0, total - 1),
        named_struct('done', transform(s, x -> 0),
                     'plan', cast(array() as array<struct<i:int,turn:int>>)),
        (acc, t) -> transform(array(
            array_min(filter(transform(s, (x, i) ->
              if(cast(acc.done[i] as long) * total div x._parts <= t and acc.done[i] < x._parts,
                 named_struct('due', (cast(acc.done[i] + 1 as long) * total + x._parts - 1) div x._parts, 'i', i),
                 null)), y -> y is not null))),
          next -> named_struct(
            'done', transform(acc.done, (d, i) -> if(i = next.i, d + 1, d)),
            'plan', array_append(acc.plan, named_struct('i', next.i, 'turn', acc.done[next.i]))))[0],
        acc -> acc.plan)"""
    slots = row.select("s", "total", F.posexplode(F.expr(steps)).alias("_at", "p"))
    return slots.select(
        F.expr("s[p.i]._source").alias("_source"), F.col("p.turn").alias("_turn"),
        F.expr("s[p.i]._parts").alias("_parts"), F.col("total").alias("_total"), "_at")


def mix(docs: DataFrame, targets: DataFrame | None = None, parts: int = PARTS,
        block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source",
        text: str = "text") -> DataFrame:
    """The input columns plus block, in_block, parts, release, deadline and slot.

    (slot, in_block) orders the rows of the mixture and is unique."""
    df = drop_clashes(docs, *OUTPUT) if {c.lower() for c in docs.columns} & set(OUTPUT) else docs
    wanted = target_parts(df, source, parts)
    if targets is not None:
        given = targets.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source")).agg(
            F.max("parts").cast("int").alias("_given"))
        wanted = wanted.join(given, "_source", "left").select(
            "_source", F.greatest(F.lit(1), F.coalesce("_given", F.lit(1))).alias("_parts"))
    table = period(wanted)
    slots = wanted.agg(F.sum("_parts")).first()[0] or 0
    if slots <= MAX_BROADCAST_SLOTS:
        table = F.broadcast(table)
    body = F.coalesce(F.col(text), F.lit("")) if text in df.columns else F.lit("")
    keyed = (df.withColumn("_source", F.coalesce(F.col(source), F.lit("")))
             .withColumn("_bucket", key_bucket(F.col(key), body, SOURCE_BUCKETS))
             .withColumn("_crc", F.crc32(body.cast("binary"))))
    ranked = rank_in_group(keyed, ["_source"], "_bucket",
                           [F.col(key).asc_nulls_first(), F.col("_crc")], "_row")
    shares = F.broadcast(wanted) if slots <= MAX_BROADCAST_SLOTS else wanted
    blocks = (ranked.join(shares, "_source")
              .withColumn("block", F.expr(f"_row div {int(block_rows)}"))
              .withColumn("in_block", F.pmod("_row", F.lit(block_rows)).cast("int"))
              .withColumn("_turn", F.pmod("block", F.col("_parts")).cast("int"))
              .withColumnRenamed("_parts", "parts"))
    return (blocks.join(table.drop("_parts"), ["_source", "_turn"])
            .withColumn("release", F.expr("block * _total div parts"))
            .withColumn("deadline", F.expr("((block + 1) * _total + parts - 1) div parts"))
            .withColumn("slot", F.expr("(block div parts) * _total + _at"))
            .select(*[F.col(f"`{c}`") for c in df.columns], *OUTPUT))


def op6_documents(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).drop("text")


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """The documents sorted by the schedule, with their own columns only."""
    return mix(docs).orderBy("slot", "in_block").select(*[F.col(f"`{c}`") for c in docs.columns])


# The schedule of one period, slot by slot, over a list of finished blocks per source.
SQL = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce(source, '') AS src, sqrt(count(*)::DOUBLE) AS root FROM documents GROUP BY 1),
shares AS (
  SELECT src, greatest(1, round({PARTS} * root / (SELECT sum(root) FROM counts))::INTEGER) AS parts
  FROM counts),
lists AS (
  SELECT list(src ORDER BY src) AS srcs, list(parts ORDER BY src) AS ps, sum(parts)::BIGINT AS total FROM shares),
sched(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(ps, lambda x: 0::BIGINT), NULL::BIGINT FROM lists
  UNION ALL
  SELECT t + 1,
         list_transform(range(1, len(done) + 1), lambda i: done[i] + (i = nxt)::BIGINT),
         nxt
  FROM (
    SELECT s.t, s.done,
      (list_min(list_transform(range(1, len(l.ps) + 1), lambda i:
         CASE WHEN s.done[i] < l.ps[i] AND (s.done[i] * l.total) // l.ps[i] <= s.t + 1
              THEN ((s.done[i] + 1) * l.total + l.ps[i] - 1) // l.ps[i] * 1000000 + i
              ELSE 9000000000000000 END)) % 1000000)::BIGINT AS nxt
    FROM sched s, lists l WHERE s.t + 1 < l.total)
),
slots AS (SELECT l.srcs[pick] AS src, done[pick] - 1 AS turn, t AS place FROM sched, lists l WHERE pick IS NOT NULL),
ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         row_number() OVER (PARTITION BY coalesce(source, '')
           ORDER BY (((doc_id % 2147483647) * 48271) % 2147483647) % {SOURCE_BUCKETS}, doc_id) - 1 AS r
  FROM documents),
blocks AS (
  SELECT doc_id, source, ranked.src, r // {BLOCK_ROWS} AS block, (r % {BLOCK_ROWS})::INTEGER AS in_block, parts
  FROM ranked JOIN shares ON ranked.src = shares.src)
SELECT doc_id, source, block, in_block, parts,
       (block * total) // parts AS release, ((block + 1) * total + parts - 1) // parts AS deadline,
       (block // parts) * total + place AS slot
FROM blocks JOIN slots ON blocks.src = slots.src AND block % parts = slots.turn, lists
"""
