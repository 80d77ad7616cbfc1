"""A UNIQUE column over a batch of requests: who may take which value, exactly as if the
requests came one after the other.

A *claim* is a wish of one row (``id``) to hold one value (``u``) from its request ``r``
on: the rows of the table (``kind`` 'B'), inserts ('I') and updates ('U').  A claim is
accepted if no other row holds the value at that moment.  A row holds the value of its
last accepted claim until its next accepted claim or its ``death`` (the request that
deletes it); claims of a refused insert's later updates match no row.

Claims are decided in rounds, all values and all rows at once.  In each round a value has a
first undecided claim and, before it, a last accepted one, the holder.  The holder's next
claim that isn't refused bounds its stay from below (``lo``), its next accepted claim from
above (``hi``).  So, by one aggregate per value:

* everybody else's claims before ``lo`` are refused, however many there are;
* the first undecided claim is accepted if the holder has gone by then (``hi``), and with
  it its own stay refuses everything up to its own ``lo``.

The earliest undecided claim is decided in every round, so rounds come to an end; their
number is that of hand-overs depending on each other.  Rows that no undecided claim depends
on leave the rounds.  What is left after ``max_rounds`` are long chains of hand-overs:
these are split into connected groups of rows and values, and each group is replayed in
order of requests by one streaming pass, which holds the group's rows and values but not
its requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockroom.session import ensure_checkpoint_dir

PENDING, ACCEPTED, REFUSED, NO_ROW = "P", "A", "D", "X"
BASE, INSERT, UPDATE = "B", "I", "U"
# The table's own claims come before every request, a row that is never deleted dies after all.
BEFORE_ALL, NEVER = -(2 ** 62), 2 ** 62
MAX_ROUNDS = 12


def _round(claims: DataFrame) -> DataFrame:
    """One round: the claims with new status and whether any undecided claim depends on them."""
    pending = F.col("status") == PENDING
    first = claims.where(pending).groupBy("u").agg(F.min("r").alias("_fp"))
    rows = claims.join(first, "u", "left")

    per_row = Window.partitionBy("id").orderBy("r")
    later = per_row.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("id")
    live = F.when(~F.col("status").isin(REFUSED, NO_ROW), F.col("r"))
    taken = F.when(F.col("status") == ACCEPTED, F.col("r"))
    rows = (rows.withColumn("_lo", F.least("death", F.coalesce(F.min(live).over(later), F.lit(NEVER))))
            .withColumn("_hi", F.least("death", F.coalesce(F.min(taken).over(later), F.lit(NEVER))))
            .withColumn("_ins", F.max(F.when(F.col("kind") == INSERT, F.col("status"))).over(whole))
            .withColumn("_open", F.max(F.col("_fp").isNotNull()).over(whole)))
    # updates of a row whose insert isn't accepted, or not yet
    blocked = (F.col("kind") == UPDATE) & F.coalesce(F.col("_ins") != ACCEPTED, F.lit(False))
    rows = rows.withColumn("_blocked", blocked)

    holder = F.max(F.when((F.col("status") == ACCEPTED) & (F.col("r") < F.col("_fp")), F.struct("r", "id", "_lo", "_hi")))
    candidate = F.max(F.when(F.col("r") == F.col("_fp"), F.struct("r", "id", "_lo", "_blocked")))
    values = rows.where("_fp is not null").groupBy("u").agg(holder.alias("_h"), candidate.alias("_c"))
    free = F.col("_h").isNull() | (F.col("_h._hi") <= F.col("_c.r")) | (F.col("_h.id") == F.col("_c.id"))
    values = values.withColumn("_takes", ~F.col("_c._blocked") & free)
    rows = rows.join(values, "u", "left")

    def held(by: str):
        return F.coalesce(F.col("r") < F.col(f"{by}._lo"), F.lit(False))

    def own(by: str):
        return F.col("id") == F.col(f"{by}.id")

    status = (F.when(~pending, F.col("status"))
              .when((F.col("kind") == UPDATE) & F.col("_ins").isin(REFUSED, NO_ROW), F.lit(NO_ROW))
              .when(F.col("_blocked"), F.lit(PENDING))        # until its insert is decided
              .when((F.col("r") == F.col("_fp")) & F.col("_takes"), F.lit(ACCEPTED))
              .when(held("_h"), F.when(own("_h"), F.lit(ACCEPTED)).otherwise(F.lit(REFUSED)))
              .when(F.col("_takes") & held("_c"), F.when(own("_c"), F.lit(ACCEPTED)).otherwise(F.lit(REFUSED)))
              .otherwise(F.lit(PENDING)))
    return rows.select("r", "id", "u", "death", "kind", status.alias("status"), "_open")


def _replay(claims: pd.DataFrame, state: dict) -> list[str]:
    """Statuses of some claims of one group, in order; ``state``: who has which value."""
    name, holder = state.setdefault("name", {}), state.setdefault("holder", {})
    gone, out = state.setdefault("gone", set()), []
    for r, i, u, death, kind, status in claims.itertuples(index=False):
        if status == PENDING:
            other = holder.get(u)
            taken = (other is not None and other[0] != i and name.get(other[0]) == u and r < other[1])
            status = NO_ROW if i in gone else REFUSED if taken else ACCEPTED
        if status == REFUSED and kind == INSERT:
            gone.add(i)
        if status == ACCEPTED:
            name[i] = u
            holder[u] = (i, death)
        out.append(status)
    return out


def _components(edges: DataFrame) -> DataFrame:
    """(x, label): the smallest node reachable from each node of the links (a, b)."""
    links = edges.union(edges.select("b", "a")).toDF("x", "y").distinct().checkpoint()
    labels = links.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).checkpoint()
    while True:
        near = links.join(labels.toDF("y", "near"), "y").groupBy("x").agg(F.min("near").alias("near"))
        lower = labels.join(near, "x").select("x", F.least("label", "near").alias("label"))
        step = lower.toDF("label", "further")
        jumped = (lower.join(step, "label", "left")
                  .select("x", F.least("label", F.coalesce("further", "label")).alias("label")).checkpoint())
        moved = jumped.join(labels.toDF("x", "old"), "x").where("label <> old").limit(1).count()
        labels = jumped
        if not moved:
            return labels


def _replay_groups(claims: DataFrame) -> DataFrame:
    """Long chains: every connected group of rows and values in order of its requests."""
    row_node, value_node = F.xxhash64(F.lit(0), "id"), F.xxhash64(F.lit(1), "u")
    groups = _components(claims.select(row_node.alias("a"), value_node.alias("b")))
    rows = (claims.withColumn("x", row_node).join(groups, "x").drop("x")
            .repartition("label").sortWithinPartitions("label", "r", "id"))

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, state = None, {}
        for batch in batches:
            parts = []
            for found, part in batch.groupby("label", sort=False):
                if found != label:
                    label, state = found, {}
                own = part[["r", "id", "u", "death", "kind", "status"]]
                parts.append(own.assign(status=_replay(own, state)))
            if parts:
                yield pd.concat(parts)

    return rows.mapInPandas(play, "r long, id long, u string, death long, kind string, status string")


def decide_claims(claims: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The claims (r, id, u, death, kind) with ``status``: accepted, refused, or no row to
    update.  ``u`` is not null; the table's own values are unique, its rows have
    ``r = BEFORE_ALL``; requests have different ``r``, and a row's claims come after its
    insert and before its death."""
    ensure_checkpoint_dir(claims.sparkSession)
    start = F.when(F.col("kind") == BASE, F.lit(ACCEPTED)).otherwise(F.lit(PENDING))
    todo = claims.select("r", "id", "u", "death", "kind", start.alias("status")).checkpoint()
    done: list[DataFrame] = []
    columns = todo.columns
    for _ in range(max_rounds):
        if not todo.where(F.col("status") == PENDING).limit(1).count():
            break
        after = _round(todo).checkpoint()
        done.append(after.where("not _open").select(*columns))
        todo = after.where("_open").select(*columns)
    else:
        if todo.where(F.col("status") == PENDING).limit(1).count():
            todo = _replay_groups(todo).checkpoint()
    for part in done:
        todo = todo.unionByName(part)
    return todo
