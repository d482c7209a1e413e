"""Caches and registration as folds, against plain loops; kept tables."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.operators.caches import Entries, cached
from tessera.operators.mutations import registered
from tessera.plans import registry
from tessera.session import kept

START = datetime(2024, 1, 1)


def plain_cache(requests, ttl, most):
    """requests: (cache, id, seconds, key), by a loop over all of them."""
    stores, out = {}, {}
    for c, i, at, key in sorted(requests, key=lambda r: (r[2], r[1])):
        store = stores.setdefault(c, {})
        if key in store and at - store[key] < ttl:
            out[c, i] = True
            continue
        store.pop(key, None)
        store[key] = at
        if len(store) > most:
            del store[min(store, key=store.get)]
        out[c, i] = False
    return out


@pytest.mark.parametrize(("ttl", "most"), [(300, 3), (50, 100), (5000, 2), (0, 5)])
def test_cache_equals_a_loop(spark, ttl, most):
    rng = random.Random(ttl)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 1, 5, 40, 400])
        rows.append((rng.choice([1, 1, 1, 2]), i, at, rng.choice(["a", "b", "c", "d", "null", None])))
    df = spark.createDataFrame([(c, i, START + timedelta(seconds=s), k) for c, i, s, k in rows], "c long, i long, at timestamp, k string")
    got = {(r["c"], r["i"]): r["hit"] for r in cached(df.repartition(5), "c", "k", "at", "i", ttl * 10**6, most).collect()}
    assert got == plain_cache(rows, ttl, most)


def test_a_hit_renews_nothing_and_the_oldest_of_101_goes(spark):
    e = Entries(300, 100)
    assert [e.asks("x", s)[0] for s in (0, 200, 400, 500)] == [False, True, False, True]
    e = Entries(10_000, 100)
    assert not any(e.asks(f"k{k}", k)[1] for k in range(100))
    assert e.asks("k0", 150) == (True, None) and e.asks("k100", 200) == (False, "k0") and e.asks("k0", 201) == (False, "k1")
    rows = [(1, k, START + timedelta(seconds=k), f"k{k % 101}") for k in range(202)]
    got = cached(spark.createDataFrame(rows, "c long, i long, at timestamp, k string"), "c", "k", "at", "i", 10**12, 100).orderBy("i").collect()
    assert not any(r["hit"] for r in got) and [r["evicted"] for r in got] == [None] * 100 + [f"k{k % 101}" for k in range(102)]


def test_empty_cache(spark):
    assert cached(spark.createDataFrame([], "c long, i long, at timestamp, k string"), "c", "k", "at", "i", 1).collect() == []


def plain_register(new, old):
    emails, names, out = {e for _, e, _ in old}, {n for _, _, n in old}, {}
    for i, email, name in sorted(new):
        out[i] = "email_taken" if email is not None and email in emails else "name_taken" if name is not None and name in names else "ok"
        if out[i] == "ok":
            emails.add(email)
            names.add(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_registration_in_order(spark, seed):
    """Few names and emails: chains in which a refused row frees its other value for a later one; one email that a third of all rows want."""
    rng = random.Random(seed)
    row = lambda i: (i, "hot" if rng.random() < 0.3 else rng.choice([None, *[f"e{k}" for k in range(15)]]), rng.choice([None, *[f"n{k}" for k in range(25)]]))
    old, new = [row(i) for i in range(3)], [row(i) for i in range(100, 180)]
    old = [r for r in old if r[1] != "hot"]
    frame = lambda rows: spark.createDataFrame(rows, "id long, email string, name string")
    got = {r["id"]: r["outcome"] for r in registered(frame(new), frame(old), "id", ["email", "name"]).collect()}
    assert got == plain_register(new, old)


def test_registration_of_none(spark):
    none = spark.createDataFrame([], "id long, email string, name string")
    assert registered(none, none, "id", ["email", "name"]).collect() == []


def test_kept_tables_are_let_go(spark):
    with kept(spark.range(10)) as df:
        assert df.is_cached and df.count() == df.agg({"id": "sum"}).count() * 10
    assert not df.is_cached


def test_a_name_is_registered_once():
    with pytest.raises(ValueError, match="already"):
        registry.query(name="vector_search")(lambda t: None)


def test_rounds_end_with_an_answer_or_at_the_bound(spark):
    from pyspark.sql import functions as F

    from tessera.operators.relational import bounded, by_key

    rows = [(1, k, k == 3) for k in range(9)] + [(2, k, False) for k in range(9)] + [(3, 7, None), (3, 9, True)] + [(4, k, k == 6) for k in range(9)]
    got = bounded(spark.createDataFrame(rows, "k long, p long, done boolean"), "k", "p", F.col("done"), 5).collect()
    assert sorted(tuple(r) for r in got) == [(1, 4, True, 3), (2, 5, False, None), (3, 2, True, 9), (4, 5, False, None)]
    assert by_key(spark.createDataFrame(rows, "k long, p long, done boolean"), "k", 1).count() == 1


def test_answers_of_the_wrong_party(spark):
    from pyspark.sql import functions as F

    from tessera.operators.relational import answered

    day = lambda d: datetime(2024, 1, d)
    invitations = [(k, 1, 2, "pending", day(9)) for k in range(6)] + [(6, 1, 2, "pending", day(1)), (7, 1, 2, "accepted", None), (8, 1, 2, "pending", None)]
    answers = [(0, 2, "accept"), (1, 2, "reject"), (2, 1, "cancel"), (3, 1, "accept"), (4, 2, "cancel"), (5, 2, "shrug"), (6, 2, "accept"), (7, 2, "reject")]
    df = answered(spark.createDataFrame(invitations, "id long, from_user long, to_user long, status string, expires_at timestamp"), spark.createDataFrame(answers, "id long, user long, action string"), F.lit(day(5)))
    assert {r["id"]: (r["status"], r["outcome"]) for r in df.collect()} == {
        0: ("accepted", "done"), 1: ("rejected", "done"), 2: ("cancelled", "done"), 3: ("pending", "not_found"), 4: ("pending", "not_found"), 5: ("pending", "not_found"), 6: ("cancelled", "expired"), 7: ("accepted", "not_found"), 8: ("pending", None),
    }
