"""Change-request jobs (M1–M10): batches of requests applied to a table.

The source applies one request per HTTP call against MySQL.  Here a whole
batch of requests ``(request_id, op, …)`` — ordered by ``request_id`` — is
applied in one Spark job that produces the new table and one outcome row per
request.  Parquet tables have no UPDATE/DELETE/constraints, so each job is a
DataFrame rewrite (joins, per-key aggregates, union) written to a new path.

Ordering rules that make the batch equal to applying requests one by one:

* an id exists from its INSERT request on (base rows: from the start);
* an UPDATE or DELETE only matches while its id exists — the first DELETE
  ends the row, so later UPDATEs/DELETEs of that id match nothing;
* an UPDATE replaces every field, so the last matching UPDATE wins;
* ids never repeat (AUTO_INCREMENT), so a deleted id cannot come back.

All per-id work is a ``groupBy(id)`` with partial aggregation (``min``,
``max_by``), so an id touched by a third of the batch costs one partial row
per task, not one task holding all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions.exprs import (DUPLICATE_USERNAME_MESSAGE, REQUIRED_FIELDS_MESSAGE,
                                       INVALID_SALE_MESSAGE, default_contact_email,
                                       falsy_default, js_trim, parse_float, parse_int)
from stockroom.schemas import (CATEGORY_MAX, DEFAULT_ROLE, EMAIL_MAX, MONEY, NAME_MAX, ROLES, RULES,
                               USERNAME_MAX, Rules)
from stockroom.operators.unique import (ACCEPTED as TAKEN, BASE, BEFORE_ALL, INSERT, NEVER, REFUSED,
                                        UPDATE, decide_claims)
from stockroom.session import ensure_checkpoint_dir

# Keys below which no id lies, and how many of them NULL keys are spread over.
NO_KEY, SPREAD = -(2 ** 60), 1 << 20

# Fixed outcome labels of a change request.
INSERTED, UPDATED, DELETED, NO_MATCH = "INSERTED", "UPDATED", "DELETED", "NO_MATCH"
DUPLICATE, ERROR = "DUPLICATE", "ERROR"


def one_spelling(df: DataFrame, column: str, collation: str | None, out: str) -> DataFrame:
    """``df`` with ``out``: one spelling for all values of ``column`` that are equal under
    ``collation`` (the smallest of them byte by byte), the value itself without one.

    Values are compared by Spark's collations, in a grouping of the distinct spellings and
    a join back; what follows can then work on plain strings."""
    if collation is None:
        return df.withColumn(out, F.col(column))
    spellings = df.select(F.col(column).alias("_s")).where("_s is not null").distinct()
    same = F.collate("_s", collation)
    reps = spellings.groupBy(same.alias("_same")).agg(F.min("_s").alias("_rep"))
    known = spellings.join(reps, same == F.col("_same")).select("_s", F.col("_rep").alias(out))
    return df.join(known, F.col(column) == F.col("_s"), "left").drop("_s")


def under(c: Column, collation: str | None) -> Column:
    """A text key compared under ``collation`` (None: byte by byte)."""
    return F.collate(c, collation) if collation else c


def _truthy(c: Column) -> Column:
    """JavaScript truthiness of a text field: not NULL and not ''."""
    return c.isNotNull() & (c != "")


# --- M3 -------------------------------------------------------------------------

def max_id(base: DataFrame, id_col: str = "id") -> Column:
    """Largest existing id (0 for an empty table) as a lazy scalar subquery."""
    return base.select(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()


def next_after(base: DataFrame, high_water: int | None = None, id_col: str = "id") -> Column:
    """The id to continue from: the largest id in the table or, if larger, the stored
    ``high_water`` mark, so an id that was given out and deleted is not used again."""
    top = max_id(base, id_col)
    return top if high_water is None else F.greatest(top, F.lit(high_water).cast("bigint"))


def last_id(given: DataFrame, base: DataFrame, high_water: int | None = None) -> DataFrame:
    """One row, ``last_id``: the largest of the ids given out now, those in the table before
    and the stored mark."""
    ids = given.select("id").unionByName(base.select("id")).agg(F.max("id").alias("id"))
    return ids.select(F.greatest(F.coalesce("id", F.lit(0)), F.lit(high_water or 0)).cast("bigint").alias("last_id"))


def assign_ids(rows: DataFrame, start_after: Column, order_col: str | list[str] = "request_id",
               id_col: str = "id") -> DataFrame:
    """M3: AUTO_INCREMENT — number ``rows`` start_after+1, +2, … in ``order_col`` order.

    No single-partition window: rows are range-partitioned on the order key,
    the partition tag is pinned by a reliable checkpoint (so a recomputed or
    re-planned partition cannot change it), per-partition counts (one row per
    partition) give each partition its offset, and a row_number inside each
    partition finishes the job.  Every task holds one balanced range.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    # No explicit count: AQE may merge adjacent ranges, which keeps them ordered.
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    tagged = (rows.repartitionByRange(*order)
              .withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # ≤ n rows: the unpartitioned window and the broadcast are size-bounded.
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    w = Window.partitionBy("_part").orderBy(*order)
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (start_after + F.col("_offset") + F.row_number().over(w)).cast("bigint"))
            .drop("_part", "_offset"))


# --- M4, M6 ---------------------------------------------------------------------

def delete_cascade_null(child: DataFrame, fk: str, deleted_keys: DataFrame,
                        key_col: str = "id") -> DataFrame:
    """M4: ON DELETE SET NULL — null ``child.fk`` where it names a deleted key."""
    d = deleted_keys.select(F.col(key_col).alias("_dk")).distinct()
    cols = [F.when(F.col("_dk").isNotNull(), F.lit(None).cast(child.schema[fk].dataType))
            .otherwise(F.col(fk)).alias(fk) if c == fk else F.col(c) for c in child.columns]
    return child.join(d, child[fk] == d._dk, "left").select(*cols)


def cascade_deletes(child: DataFrame, deleted: dict[str, DataFrame], key_col: str = "id") -> DataFrame:
    """M4 for several foreign keys at once: ``deleted`` maps each key column of ``child`` to
    the frame of deleted parents; one scan of ``child`` nulls them all.

    The deleted keys are distinct first, so every join keeps the child's rows; Spark's size
    check broadcasts them where they are few.  Where a join shuffles, rows whose key is NULL
    (which match nothing) are dealt by a hash of the other columns instead of meeting in
    one task: a NULL key takes a spread key below every real one."""
    out = child
    for fk, parents in deleted.items():
        kind = child.schema[fk].dataType
        gone = parents.select(F.col(key_col).cast("long").alias("_dk")).where("_dk is not null").distinct()
        spread = NO_KEY - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in child.columns]), F.lit(SPREAD))
        key = F.coalesce(F.col(f"`{fk}`").cast("long"), spread)
        out = (out.withColumn("_fk", key).join(gone, F.col("_fk") == F.col("_dk"), "left")
               .withColumn(fk, F.when(F.col("_dk").isNull(), F.col(f"`{fk}`")).otherwise(F.lit(None).cast(kind)))
               .drop("_fk", "_dk"))
    return out


def delete_cascade_remove(parent: DataFrame, deleted_keys: DataFrame, key_col: str = "id") -> DataFrame:
    """Parent rows that survive a delete (anti join)."""
    d = deleted_keys.select(F.col(key_col).alias("_dk"))
    return parent.join(d, parent[key_col] == d._dk, "left_anti")


def _stamp(as_of_ts) -> Column:
    if isinstance(as_of_ts, Column):
        return as_of_ts
    # zone-less wall clock: go through its text, never through an instant
    text = as_of_ts.isoformat(sep=" ") if hasattr(as_of_ts, "isoformat") else str(as_of_ts)
    return F.lit(text).cast("timestamp_ntz")


def touch_updated_at(df: DataFrame, changed: Column, as_of_ts, inserted: Column | None = None) -> DataFrame:
    """M6: ``updated_at`` = as_of_ts on changed rows; ``created_at`` on inserted rows."""
    ts = _stamp(as_of_ts)
    cur_u = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    cur_c = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    out = df.withColumn("updated_at", F.when(changed, ts).otherwise(cur_u))
    if inserted is not None:
        out = out.withColumn("created_at", F.when(inserted, ts).otherwise(cur_c))
    return out


# --- shared per-id resolution ---------------------------------------------------

def _resolve_ops(universe: DataFrame, ops: DataFrame, update_ok: Column | None = None) -> DataFrame:
    """Outcome of each UPDATE/DELETE request against ids that exist from ``_start``.

    ``universe(id, _start)``: base ids have ``_start`` NULL, inserted ids their
    INSERT request_id.  ``update_ok`` (a column of ``ops``) marks updates that
    would be accepted when matched; a matched but not-ok update is an ERROR.
    Returns ops with ``status`` plus ``_del_at`` per id."""
    u = universe.select(F.col("id").alias("_uid"), "_start")
    j = ops.join(u, ops.id == u._uid, "left")
    alive_from = F.col("_uid").isNotNull() & (F.col("_start").isNull() | (F.col("request_id") > F.col("_start")))
    j = j.withColumn("_live", alive_from)
    # First effective DELETE per id (partial aggregate on id).
    first_del = (j.where(F.col("_live") & (F.col("op") == "DELETE"))
                 .groupBy("id").agg(F.min("request_id").alias("_del_at")))
    j = j.join(first_del, "id", "left")
    before_del = F.col("_del_at").isNull() | (F.col("request_id") < F.col("_del_at"))
    ok = update_ok if update_ok is not None else F.lit(True)
    status = (F.when(~F.col("_live"), F.lit(NO_MATCH))
              .when(F.col("op") == "DELETE",
                    F.when(F.col("request_id") == F.col("_del_at"), F.lit(DELETED)).otherwise(F.lit(NO_MATCH)))
              .when(~before_del, F.lit(NO_MATCH))
              .when(ok, F.lit(UPDATED))
              .otherwise(F.lit(ERROR)))
    return j.withColumn("status", status)


@dataclass
class ChangeResult:
    table: DataFrame            # the new table
    outcomes: DataFrame         # request_id, op, id, status, message
    deleted_ids: DataFrame      # id of every row removed
    suppliers: DataFrame | None = None
    last_id: DataFrame | None = None    # one row: the last id given out, used or not


# --- M1 -------------------------------------------------------------------------

def supplier_requests(requests: DataFrame) -> DataFrame:
    """INSERT/UPDATE requests that carry a supplier name, with the contact to store.

    A name or contact longer than its column fails the whole request, so the
    supplier is left alone."""
    return (requests.where(F.col("op").isin("INSERT", "UPDATE") & _truthy(F.col("supplier"))
                           & _supplier_fits())
            .select("request_id", F.col("supplier").alias("name"), _contact().alias("contact")))


def _contact() -> Column:
    return falsy_default("supplier_contact", default_contact_email(F.col("supplier")))


def _supplier_fits() -> Column:
    return (~F.coalesce(_truthy(F.col("supplier")), F.lit(False))
            | ((F.length("supplier") <= NAME_MAX["suppliers"]) & (F.length(_contact()) <= EMAIL_MAX)))


def _nulls(df: DataFrame, names: list[str]) -> list[Column]:
    """NULL columns of the types ``df`` gives ``names``."""
    return [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]


def upsert_suppliers(suppliers: DataFrame, requests: DataFrame, as_of_ts=None,
                     high_water: int | None = None, collation: str | None = None) -> DataFrame:
    """M1: INSERT … ON DUPLICATE KEY UPDATE contact_email, by unique name.

    Applies to every INSERT/UPDATE request with a supplier, whatever later
    happens to the product (no transaction spans the two statements).  The
    last request per name sets the contact; new names get ids in order of
    their first request.  Every other column of the table is kept; a new row has
    NULL there, but for ``created_at`` when ``as_of_ts`` is given.  Under ``collation``
    names may differ in spelling: a stored name stays, a new one is that of its first
    request."""
    reqs = supplier_requests(requests)
    per_name = reqs.groupBy(under(F.col("name"), collation).alias("_key")).agg(
        F.max_by("contact", "request_id").alias("_contact"),
        F.min_by("name", "request_id").alias("name"),
        F.min("request_id").alias("_first")).drop("_key")
    base = suppliers.withColumnRenamed("name", "_bname")
    j = per_name.join(base, under(per_name.name, collation) == under(base._bname, collation), "full")
    kept = {"name": F.col("_bname"), "contact_email": F.coalesce("_contact", "contact_email")}
    existing = (j.where(F.col("_bname").isNotNull())
                .select(*[kept.get(c, F.col(c)).alias(c) for c in suppliers.columns]))
    new = (j.where(F.col("_bname").isNull())
           .select(F.col("name"), F.col("_contact").alias("contact_email"), F.col("_first")))
    new = assign_ids(new, next_after(suppliers, high_water), order_col="_first").drop("_first")
    new = new.select("*", *_nulls(suppliers, [c for c in suppliers.columns if c not in new.columns]))
    if as_of_ts is not None and "created_at" in suppliers.columns:
        new = new.withColumn("created_at", _stamp(as_of_ts))
    return existing.unionByName(new)


# --- M2 -------------------------------------------------------------------------

def _product_fields_ok() -> Column:
    price = F.col("price")
    return (F.col("name").isNotNull() & F.col("category").isNotNull()
            & F.col("quantity").isNotNull() & price.isNotNull()
            & (F.length("name") <= NAME_MAX["products"]) & (F.length("category") <= CATEGORY_MAX))


def apply_product_changes(products: DataFrame, suppliers: DataFrame, requests: DataFrame,
                          as_of_ts=None, high_water: int | None = None,
                          supplier_high_water: int | None = None, collation: str | None = None) -> ChangeResult:
    """M2: INSERT (new id) / UPDATE (all fields, by id) / DELETE (by id).

    ``supplier_id`` is the id of the named supplier after M1, NULL when the
    request's supplier is blank (an UPDATE with a blank supplier clears it); ``collation``
    is the one under which supplier names are equal."""
    new_suppliers = upsert_suppliers(suppliers, requests, as_of_ts, supplier_high_water, collation)
    sid = new_suppliers.select(F.col("name").alias("_sname"), F.col("id").alias("_sid"))
    # A price that does not fit DECIMAL(10,2) makes the statement fail →
    # the request is an ERROR, the batch goes on (try_cast, not an ANSI error).
    reqs = requests.select("request_id", "op", "id", "name", "category", "quantity",
                           F.col("price").try_cast(MONEY).alias("price"), "supplier",
                           _supplier_fits().alias("_fits"))
    reqs = (reqs.join(sid, _truthy(reqs.supplier) & (under(reqs.supplier, collation) == under(sid._sname, collation)), "left")
            .withColumn("supplier_id", F.col("_sid")).drop("_sname", "_sid")
            .withColumn("_ok", F.coalesce(_product_fields_ok() & F.col("_fits"), F.lit(False))))

    ins_req = reqs.where(F.col("op") == "INSERT")
    inserted = assign_ids(ins_req.where("_ok").drop("id"), next_after(products, high_water))
    ins_fail = ins_req.where(~F.col("_ok")).select("request_id", "op", F.lit(None).cast("bigint").alias("id"),
                                                   F.lit(ERROR).alias("status"))

    universe = (products.select("id", F.lit(None).cast("bigint").alias("_start"))
                .unionByName(inserted.select("id", F.col("request_id").alias("_start"))))
    ops = reqs.where(F.col("op").isin("UPDATE", "DELETE") & F.col("id").isNotNull())
    resolved = _resolve_ops(universe, ops, F.col("_ok")).checkpoint(eager=True)

    last_update = (resolved.where(F.col("status") == UPDATED).groupBy("id").agg(
        F.max_by(F.struct("name", "category", "quantity", "price", "supplier_id"),
                 "request_id").alias("_u")))
    deleted = resolved.where(F.col("status") == DELETED).select("id")

    cols = ["id", "name", "category", "quantity", "price", "supplier_id"]
    others = [c for c in products.columns if c not in cols]          # kept as they are
    current = (products.select(*cols, *others, F.lit(False).alias("_ins"))
               .unionByName(inserted.select(*cols, *_nulls(products, others), F.lit(True).alias("_ins"))))
    current = delete_cascade_remove(current, deleted)
    cur = current.join(last_update, "id", "left")
    changed = F.col("_u").isNotNull()
    table = cur.select(
        "id",
        *[F.when(changed, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c)
          for c in ("name", "category", "quantity", "price", "supplier_id")],
        *others, (changed | F.col("_ins")).alias("_changed"), "_ins")
    if as_of_ts is not None:
        table = touch_updated_at(table, F.col("_changed"), as_of_ts, F.col("_ins"))
    table = table.drop("_changed", "_ins")

    outcomes = (inserted.select("request_id", "op", "id", F.lit(INSERTED).alias("status"))
                .unionByName(ins_fail)
                .unionByName(resolved.select("request_id", "op", "id", "status"))
                .unionByName(reqs.where(F.col("op").isin("UPDATE", "DELETE") & F.col("id").isNull())
                             .select("request_id", "op", "id", F.lit(NO_MATCH).alias("status")))
                .unionByName(_unknown_ops(reqs)))
    return ChangeResult(table=table, outcomes=outcomes, deleted_ids=deleted, suppliers=new_suppliers,
                        last_id=last_id(inserted, products, high_water))


def _unknown_ops(reqs: DataFrame) -> DataFrame:
    """Requests whose operation is missing or none of the three: an ERROR each."""
    known = F.coalesce(F.col("op").isin("INSERT", "UPDATE", "DELETE"), F.lit(False))
    return reqs.where(~known).select("request_id", "op", "id", F.lit(ERROR).alias("status"))


# --- M5 -------------------------------------------------------------------------

def apply_employee_changes(employees: DataFrame, requests: DataFrame, as_of_ts=None,
                           high_water: int | None = None, collation: str | None = None) -> ChangeResult:
    """M5: employee INSERT/UPDATE/DELETE, as if the requests came one after the other.

    * INSERT: role defaults to 'cashier' when blank, must_change_password is TRUE.
      Every insert whose fields fit takes the next id; one that is refused as a
      duplicate leaves its id unused, as AUTO_INCREMENT does.
    * UPDATE: name, username and role replace the row's; the role must be one of
      owner/admin/cashier (strict ENUM).
    * DELETE: removes the row (sales keep their history, cashier set NULL via M4).

    Fields that do not fit are an ERROR, found before the username is looked up.  A
    username held by another row at that moment is a DUPLICATE ('Username already
    exists'); a rename or a delete frees the old one.  :func:`decide_claims` settles
    who holds which username when.  ``collation`` names the collation under which
    usernames are equal (None: byte by byte)."""
    reqs = requests.select("request_id", "op", "id", "name", "username", "role")
    fits = (F.col("name").isNotNull() & F.col("username").isNotNull()
            & (F.length("name") <= NAME_MAX["employees"]) & (F.length("username") <= USERNAME_MAX)
            & F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))
    reqs = (reqs.withColumn("role", F.when(F.col("op") == "INSERT", falsy_default("role", DEFAULT_ROLE))
                            .otherwise(F.col("role")))
            .withColumn("_ok", F.coalesce(fits, F.lit(False))))
    inserts = assign_ids(reqs.where((F.col("op") == "INSERT") & F.col("_ok")).drop("id"),
                         next_after(employees, high_water)).checkpoint(eager=True)

    # how long each row lives: from its insert to the first delete after it
    rows = (employees.select("id", F.lit(BEFORE_ALL).alias("_start"), "username", F.lit(BASE).alias("kind"))
            .unionByName(inserts.select("id", F.col("request_id").alias("_start"), "username", F.lit(INSERT).alias("kind"))))
    ops = reqs.where(F.col("op").isin("UPDATE", "DELETE") & F.col("id").isNotNull())
    ops = ops.join(rows.select("id", "_start"), "id", "left")
    lives = F.coalesce(F.col("request_id") > F.col("_start"), F.lit(False))
    deaths = (ops.where(lives & (F.col("op") == "DELETE")).groupBy("id").agg(F.min("request_id").alias("death")))
    ops = (ops.join(deaths, "id", "left").withColumn("death", F.coalesce("death", F.lit(NEVER)))
           .withColumn("_lives", lives & (F.col("request_id") <= F.col("death"))).checkpoint(eager=True))

    claims = (rows.join(deaths, "id", "left")
              .select(F.col("_start").alias("r"), "id", "username", F.coalesce("death", F.lit(NEVER)).alias("death"), "kind")
              .unionByName(ops.where(F.col("_lives") & (F.col("op") == "UPDATE") & F.col("_ok"))
                           .select(F.col("request_id").alias("r"), "id", "username", "death",
                                   F.lit(UPDATE).alias("kind")))
              .where("username is not null"))
    decided = decide_claims(one_spelling(claims, "username", collation, "u"))
    verdict = decided.where(F.col("kind") != BASE).select(F.col("r").alias("request_id"), F.col("status").alias("_verdict"))
    # a refused insert leaves no row behind
    never = decided.where((F.col("kind") == INSERT) & (F.col("status") == REFUSED)).select("id").withColumn("_never", F.lit(True))

    ins = (inserts.join(verdict, "request_id")
           .withColumn("status", F.when(F.col("_verdict") == TAKEN, F.lit(INSERTED)).otherwise(F.lit(DUPLICATE))))
    status = (F.when(~F.col("_lives") | F.col("_never").isNotNull(), F.lit(NO_MATCH))
              .when(F.col("op") == "DELETE", F.lit(DELETED))
              .when(~F.col("_ok"), F.lit(ERROR))
              .when(F.col("_verdict") == TAKEN, F.lit(UPDATED)).otherwise(F.lit(DUPLICATE)))
    resolved = (ops.join(verdict, "request_id", "left").join(never, "id", "left")
                .withColumn("status", status).checkpoint(eager=True))      # read by three consumers below

    last_update = (resolved.where(F.col("status") == UPDATED).groupBy("id").agg(
        F.max_by(F.struct("name", "username", "role"), "request_id").alias("_u")))
    deleted = resolved.where(F.col("status") == DELETED).select("id")
    inserted = ins.where(F.col("status") == INSERTED)
    cols = ["id", "name", "username", "role", "must_change_password"]
    others = [c for c in employees.columns if c not in cols]         # kept as they are
    current = (employees.select(*cols, *others, F.lit(False).alias("_ins"))
               .unionByName(inserted.select("id", "name", "username", "role",
                                            F.lit(True).alias("must_change_password"),
                                            *_nulls(employees, others),
                                            F.lit(True).alias("_ins"))))
    current = delete_cascade_remove(current, deleted)
    cur = current.join(last_update, "id", "left")
    changed = F.col("_u").isNotNull()
    table = cur.select("id", *[F.when(changed, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c)
                               for c in ("name", "username", "role")],
                       "must_change_password", *others, (changed | F.col("_ins")).alias("_changed"), "_ins")
    if as_of_ts is not None:
        table = touch_updated_at(table, F.col("_changed"), as_of_ts, F.col("_ins"))
    table = table.drop("_changed", "_ins")

    msg = F.when(F.col("status") == DUPLICATE, F.lit(DUPLICATE_USERNAME_MESSAGE))
    no_id = F.lit(None).cast("bigint")
    outcomes = (ins.select("request_id", "op", F.when(F.col("status") == INSERTED, F.col("id")).alias("id"), "status")
                .unionByName(reqs.where((F.col("op") == "INSERT") & ~F.col("_ok"))
                             .select("request_id", "op", no_id.alias("id"), F.lit(ERROR).alias("status")))
                .unionByName(resolved.select("request_id", "op", "id", "status"))
                .unionByName(reqs.where(F.col("op").isin("UPDATE", "DELETE") & F.col("id").isNull())
                             .select("request_id", "op", "id", F.lit(NO_MATCH).alias("status")))
                .unionByName(_unknown_ops(reqs))
                .withColumn("message", msg))
    return ChangeResult(table=table, outcomes=outcomes, deleted_ids=deleted, last_id=last_id(inserts, employees, high_water))


# --- M7 -------------------------------------------------------------------------

def _row_rules(rules: Rules, columns: list[str], parents: dict[str, DataFrame]) -> list[tuple[str, Column, Column]]:
    """(rule, violated, detail) of every rule that one row and its parents' keys decide."""
    c, none = F.col, F.lit(None).cast("string")
    out = [("not_null_id", c("id").isNull(), none)]
    out += [(f"not_null_{x}", c(x).isNull(), none) for x in rules.not_null]
    out += [(f"enum_{x}", ~c(x).isin(*values), c(x).cast("string")) for x, values in rules.one_of.items()]
    out += [(f"length_{x}", F.length(x) > n, none) for x, n in rules.max_length.items()]
    out += [(f"range_{x}", c(x).isNotNull() & c(x).try_cast(kind).isNull(), c(x).cast("string"))
            for x, kind in rules.fits.items()]
    for x, (price, n) in rules.product.items():
        expect = (c(price) * c(n).cast("decimal(10,0)")).try_cast(MONEY)
        out += [(f"range_{x}", c(price).isNotNull() & c(n).isNotNull() & expect.isNull(), none),
                (f"generated_{x}", ~c(x).eqNullSafe(expect), none)]
    out += [(f"fk_{x}", c(x).isNotNull() & c(f"_parent_{x}").isNull(), c(x).cast("string"))
            for x, parent in rules.references.items() if parent in parents]
    # a rule about a column that the frame lacks has nothing to check
    return [r for r in out if r[0].split("_", 1)[1] in columns or not r[0].startswith("length_")]


def validate_table(table: str, df: DataFrame, parents: dict[str, DataFrame] | None = None,
                   collation: str | None = None) -> DataFrame:
    """M7: one row per violation of the declared rules (``schemas.RULES``) of a table.

    The rules of a row alone are decided first, so that only the row's key, its violations
    and its foreign keys go on to the parents: their distinct keys are joined (NULL keys,
    which refer to nothing, are dealt apart as in :func:`cascade_deletes`) and all violated
    rules exploded.  All UNIQUE rules together are one aggregate over (column, value), one
    row a repeated value (under ``collation`` its smallest spelling); whole numbers are
    compared as numbers, other values as text."""
    parents, rules = parents or {}, RULES[table]
    linked = {fk: parents[parent] for fk, parent in rules.references.items() if parent in parents}
    checks = _row_rules(rules, df.columns, parents)
    hit = lambda rule, bad, detail: F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
    found = lambda hits: F.filter(F.array(*hits), lambda h: h.isNotNull())
    alone = found([hit(*r) for r in checks if r[0] not in {f"fk_{fk}" for fk in linked}])
    spread = NO_KEY - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SPREAD))
    rows = df.select("id", *[c for c in linked if c != "id"], alone.alias("_alone"),
                     *[F.coalesce(F.col(fk).cast("long"), spread).alias(f"_key_{fk}") for fk in linked])
    for fk, parent in linked.items():
        keys = parent.select(F.col("id").cast("long").alias(f"_parent_{fk}")).where(f"_parent_{fk} is not null").distinct()
        rows = rows.join(keys, F.col(f"_key_{fk}") == F.col(f"_parent_{fk}"), "left").drop(f"_key_{fk}")
    orphans = found([hit(*r) for r in checks if r[0] in {f"fk_{fk}" for fk in linked}]) if linked else None
    hits = F.col("_alone") if orphans is None else F.concat("_alone", orphans)
    by_row = (rows.select(F.col("id").cast("string").alias("row_key"), F.explode(hits).alias("h"))
              .select(F.lit(table).alias("table_name"), "h.rule", "row_key", "h.detail"))
    unique = ["id", *rules.unique]
    whole = [c for c in unique if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")]
    repeated = _repeated(df, [c for c in unique if c not in whole], "string", collation) if whole != unique else None
    if whole:
        numbers = _repeated(df, whole, "long", None)
        repeated = numbers if repeated is None else repeated.unionByName(numbers)
    return by_row.unionByName(repeated.select(
        F.lit(table).alias("table_name"), "rule", "row_key",
        F.concat(F.col("_n").cast("string"), F.lit(" rows")).alias("detail")))


def _repeated(df: DataFrame, columns: list[str], kind: str, collation: str | None) -> DataFrame:
    """(rule, row_key, _n): the values, as ``kind``, that some of ``columns`` has in several rows."""
    values = F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).cast(kind).alias("value")) for i, c in enumerate(columns)])
    counts = (df.select(F.inline(values)).where("value is not null")
              .groupBy("at", under(F.col("value"), collation).alias("_key"))
              .agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    rule = F.element_at(F.array(*[F.lit(f"unique_{c}") for c in columns]), F.col("at") + 1)
    return counts.select(rule.alias("rule"), F.col("value").cast("string").alias("row_key"), "_n")


# --- M8–M10 (form checks) -------------------------------------------------------

def validate_product_requests(requests: DataFrame) -> DataFrame:
    """M8: trimmed text fields; name, category, quantity, price, supplier required
    for INSERT/UPDATE.  Quantity and price as typed (text) are parsed; what is no number
    counts as missing."""
    t = requests
    if t.schema["quantity"].dataType.typeName() == "string":
        t = t.withColumn("quantity", parse_int("quantity").try_cast("int"))
    if t.schema["price"].dataType.typeName() == "string":
        t = t.withColumn("price", parse_float("price").try_cast(MONEY))
    for c in ("name", "category", "supplier", "supplier_contact"):
        if c in t.columns:
            t = t.withColumn(c, js_trim(F.col(c)))
    needs = F.coalesce(F.col("op").isin("INSERT", "UPDATE"), F.lit(False))
    ok = (~needs) | (_truthy(F.col("name")) & _truthy(F.col("category")) & F.col("quantity").isNotNull()
                     & F.col("price").isNotNull() & _truthy(F.col("supplier")))
    return (t.withColumn("ok", ok)
            .withColumn("reason", F.when(~F.col("ok"), F.lit(REQUIRED_FIELDS_MESSAGE))))


def validate_employee_requests(requests: DataFrame) -> DataFrame:
    """M9: trimmed name and username required for INSERT/UPDATE."""
    t = requests.withColumn("name", js_trim(F.col("name"))).withColumn("username", js_trim(F.col("username")))
    needs = F.coalesce(F.col("op").isin("INSERT", "UPDATE"), F.lit(False))
    ok = (~needs) | (_truthy(F.col("name")) & _truthy(F.col("username")))
    return (t.withColumn("ok", ok)
            .withColumn("reason", F.when(~F.col("ok"), F.lit(REQUIRED_FIELDS_MESSAGE))))


def validate_sale_requests(requests: DataFrame) -> DataFrame:
    """A product id (non-zero) and, when given, a quantity ≥ 1 (JavaScript
    lets an unparsable quantity through: ``NaN < 1`` is false)."""
    ok = (F.col("product_id").isNotNull() & (F.col("product_id") != 0)
          & ~F.coalesce(F.col("quantity") < 1, F.lit(False)))
    return (requests.withColumn("ok", ok)
            .withColumn("reason", F.when(~F.col("ok"), F.lit(INVALID_SALE_MESSAGE))))


__all__ = [
    "INSERTED", "UPDATED", "DELETED", "NO_MATCH", "DUPLICATE", "ERROR", "ChangeResult",
    "max_id", "next_after", "last_id", "one_spelling", "assign_ids", "delete_cascade_null", "cascade_deletes", "delete_cascade_remove", "touch_updated_at",
    "supplier_requests", "upsert_suppliers", "apply_product_changes", "apply_employee_changes",
    "validate_table", "validate_product_requests", "validate_employee_requests",
    "validate_sale_requests", "rank_within_group",
]


# --- positions inside groups without a group-sized task -------------------------

def rank_within_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                      pos_col: str = "position") -> DataFrame:
    """1-based position of each row inside its group, in ``order_cols`` order.

    A ``row_number() OVER (PARTITION BY group …)`` sorts a whole group in one
    task; here a group of any size is spread over range partitions of
    (group, order), the partition tag is pinned by a checkpoint, rows are
    counted per (group, partition) — at most #groups + #partitions rows — and
    each slice's offset is the sum of the group's earlier slices (a window
    whose groups hold at most #partitions rows).  Order keys must make rows
    unique.  NULL group keys form their own group."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tagged = (df.repartitionByRange(*group_cols, *order_cols)
              .withColumn("_part", F.spark_partition_id())
              .checkpoint(eager=True))
    keys = [F.col(c) for c in group_cols]
    counts = tagged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_part")
    offsets = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_part").alias("_gp"),
                            (F.sum("_n").over(w) - F.col("_n")).alias("_offset"))
    cond = F.col("_part") == F.col("_gp")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    local = Window.partitionBy(*group_cols, "_part").orderBy(*order_cols)
    return (tagged.join(offsets, cond)
            .withColumn(pos_col, (F.col("_offset") + F.row_number().over(local)).cast("bigint"))
            .drop("_part", "_gp", "_offset", *[f"_g_{c}" for c in group_cols]))
