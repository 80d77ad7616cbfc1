"""Employee batches and unique claims against a simulator that steps request by request."""

import random

import pytest

from stockroom import schemas as S
from stockroom.operators import changes as C
from stockroom.operators import unique as U

ROLES = ("owner", "admin", "cashier")


def simulate(employees, requests, fold=lambda u: u):
    """The employee API, one request at a time: rows by id and an outcome per request."""
    rows = {e[0]: list(e) for e in employees}
    next_id, out = max(rows, default=0) + 1, {}

    def held(user, but=None):
        return any(fold(e[2]) == fold(user) for i, e in rows.items() if i != but)

    for rid, op, eid, name, user, role in sorted(requests, key=lambda r: r[0]):
        fits = name is not None and user is not None and len(name) <= 100 and len(user) <= 50
        if op == "INSERT":
            role = role or "cashier"
            if not fits or role not in ROLES:
                out[rid] = ("ERROR", None)
                continue
            if held(user):
                out[rid] = ("DUPLICATE", None)
            else:
                rows[next_id] = [next_id, name, user, role, True]
                out[rid] = ("INSERTED", next_id)
            next_id += 1                                  # a refused insert's number is used up
        elif eid not in rows:
            out[rid] = ("NO_MATCH", eid)
        elif op == "DELETE":
            del rows[eid]
            out[rid] = ("DELETED", eid)
        elif not fits or role not in ROLES:
            out[rid] = ("ERROR", eid)
        elif held(user, eid):
            out[rid] = ("DUPLICATE", eid)
        else:
            rows[eid][1:4] = [name, user, role]
            out[rid] = ("UPDATED", eid)
    return rows, out


def check(spark, employees, requests, **how):
    fold = (lambda u: u.lower()) if how.get("collation") else (lambda u: u)
    rows, want = simulate([tuple(r) for r in employees.collect()], requests, fold)
    res = C.apply_employee_changes(employees, spark.createDataFrame(requests, S.EMPLOYEE_CHANGES), **how)
    got = [(r.request_id, (r.status, r.id)) for r in res.outcomes.collect()]
    assert len(got) == len(requests) and dict(got) == want
    assert sorted(map(str, (tuple(r) for r in res.table.collect()))) == sorted(str(tuple(v)) for v in rows.values())
    names = [fold(r.username) for r in res.table.select("username").where("username is not null").collect()]
    assert len(names) == len(set(names))
    return want


def test_renames_and_update_then_insert(spark, seed):
    """A name freed by a rename or by the delete of a new row is free; one taken by an update is not."""
    want = check(spark, seed.employees, [
        (1, "UPDATE", 1, "Own", "x", "owner"), (2, "INSERT", None, "X", "x", ""),          # taken by the update
        (3, "INSERT", None, "O", "owner", ""),                                              # freed by the rename
        (4, "DELETE", 6, None, None, None), (5, "UPDATE", 2, "Sys", "owner", "admin"),     # freed by the delete
        (6, "UPDATE", 5, "No", "y", "admin"), (7, "DELETE", 5, None, None, None),          # id 5 was refused
        (8, "INSERT", None, None, "z", ""), (9, "INSERT", None, "Z", "z", "boss"),         # errors use no number
        (10, "INSERT", None, "Z", "z", ""), (11, "UPDATE", 7, "Z", "admin", "admin"), (12, "UPDATE", 7, "Z", "owner", "admin")])
    assert {k: v[0] for k, v in want.items()} == {
        1: "UPDATED", 2: "DUPLICATE", 3: "INSERTED", 4: "DELETED", 5: "UPDATED", 6: "NO_MATCH", 7: "NO_MATCH",
        8: "ERROR", 9: "ERROR", 10: "INSERTED", 11: "UPDATED", 12: "DUPLICATE"}


@pytest.mark.parametrize("seed_value", range(4))
def test_random_batches(spark, seed, seed_value):
    r = random.Random(seed_value)
    pool = ["owner", "admin", "cashier", "jane", *(f"u{i}" for i in range(r.choice([2, 8])))]
    requests = []
    for rid in range(1, 90):
        op = r.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"] if r.random() < 0.9 else ["DELETE"])
        if op == "DELETE" and r.random() < 0.6:
            op = "UPDATE"
        requests.append((rid, op, None if op == "INSERT" else r.randint(1, 14), r.choice([f"n{rid}", f"n{rid}", None]) if r.random() < 0.1 else f"n{rid}",
                         r.choice(pool), r.choice(["admin", "cashier", "owner", "boss", ""]) if r.random() < 0.3 else "admin"))
    check(spark, seed.employees, requests)


def test_usernames_under_a_collation(spark, seed):
    requests = [(1, "INSERT", None, "A", "ADMIN", ""), (2, "INSERT", None, "B", "Bob", ""), (3, "UPDATE", 3, "C", "bOB", "cashier"),
                (4, "UPDATE", 6, "B", "BOB", "admin"), (5, "DELETE", 2, None, None, None), (6, "UPDATE", 4, "D", "Admin", "admin")]
    want = check(spark, seed.employees, requests, collation="UTF8_LCASE")
    assert [want[i][0] for i in range(1, 7)] == ["DUPLICATE", "INSERTED", "DUPLICATE", "UPDATED", "DELETED", "UPDATED"]
    plain = check(spark, seed.employees, requests)
    assert plain[1][0] == "INSERTED" and plain[3][0] == "UPDATED"


def claims_of(r, n_ids, n_values, n):
    """Random claims of some rows, and their statuses by stepping through them."""
    death = {i: r.choice([U.NEVER, U.NEVER, r.randint(1, n)]) for i in range(n_ids)}
    inserted = {i: r.randint(1, n) for i in range(n_ids, 2 * n_ids)}
    rows = [(U.BEFORE_ALL, i, f"v{i}", death[i], U.BASE) for i in range(n_ids)]
    taken = set(inserted.values())
    inserted = {i: t for i, t in inserted.items() if list(inserted.values()).index(t) == i - n_ids}
    rows += [(t, i, f"v{r.randrange(n_values)}", U.NEVER, U.INSERT) for i, t in inserted.items()]
    for t in range(1, n + 1):
        alive = [i for i in death if death[i] > t] + [i for i, s in inserted.items() if s < t]
        if t not in taken and alive:
            i = r.choice(alive)
            rows.append((t, i, f"v{r.randrange(n_values)}", death.get(i, U.NEVER), U.UPDATE))
    name, out = {}, {}
    for t, i, u, _, kind in sorted(rows):
        if kind == U.UPDATE and i not in name:
            out[t, i] = U.NO_ROW
        elif any(v == u and j != i and death.get(j, U.NEVER) > t for j, v in name.items()):
            out[t, i] = U.REFUSED
        else:
            name[i], out[t, i] = u, U.ACCEPTED
    return rows, out


@pytest.mark.parametrize("rounds", [0, 1, 2, 30])
def test_claims_by_rounds_and_replay(spark, rounds):
    """Rounds alone, replay alone and both together give the stepped statuses."""
    r = random.Random(rounds)
    for n_ids, n_values, n in ((2, 3, 30), (6, 8, 60), (4, 20, 80)):
        rows, want = claims_of(r, n_ids, n_values, n)
        df = spark.createDataFrame(rows, "r long, id long, u string, death long, kind string")
        assert {(x.r, x.id): x.status for x in U.decide_claims(df, rounds).collect()} == want


def test_hot_value_and_hot_row_take_few_rounds(spark, monkeypatch):
    """A value that thousands want and a row that is renamed a thousand times."""
    rounds = []
    real = U._round
    monkeypatch.setattr(U, "_round", lambda c: rounds.append(1) or real(c))
    rows = [(U.BEFORE_ALL, 1, "admin", U.NEVER, U.BASE), (U.BEFORE_ALL, 2, "b", U.NEVER, U.BASE)]
    rows += [(t, 10 + t, "admin", U.NEVER, U.INSERT) for t in range(1, 3000)]
    rows += [(t, 2, f"w{t}", U.NEVER, U.UPDATE) for t in range(3000, 4000)]
    got = U.decide_claims(spark.createDataFrame(rows, "r long, id long, u string, death long, kind string"))
    assert {(x.kind, x.status): x["count"] for x in got.groupBy("kind", "status").count().collect()} == {
        ("B", "A"): 2, ("I", "D"): 2999, ("U", "A"): 1000}
    assert len(rounds) <= 2


def test_one_spelling(spark):
    df = spark.createDataFrame([("Ab",), ("aB",), ("x",), (None,), ("É",), ("é",)], "v string")
    got = {(r.v, r.k) for r in C.one_spelling(df, "v", "UTF8_LCASE", "k").collect()}
    assert got == {("Ab", "Ab"), ("aB", "Ab"), ("x", "x"), (None, None), ("É", "É"), ("é", "É")}
    assert {r.k for r in C.one_spelling(df, "v", None, "k").collect()} == {"Ab", "aB", "x", None, "É", "é"}
