"""Operator 3 against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neighbours
from tessera.llm.neighbours import hadamard, nearest, turned

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "1 as v", "2 as block").repartition(3)


def vectors(n, dim=64, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def brute(rows, q, k=10):
    v = {i: np.array(e, dtype=np.float32).astype(np.float64) for i, e, _ in rows if i is not None and e and all(c is not None and math.isfinite(c) for c in e) and any(e)}
    d = sorted((float(np.sqrt(((x - v[q]) ** 2).sum())), i) for i, x in v.items() if i != q)
    return [(i, s) for s, i in d[:k]]


def search(spark, rows):
    got: dict = {}
    for r in nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in got.items()}


def test_recall_and_scores(spark):
    rows = [(i, x.tolist(), 0) for i, x in enumerate(vectors(3000))]
    got = search(spark, rows)
    assert set(got) == set(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        want = brute(rows, q)
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(i != q for _, i, _ in found)
        exact = dict(brute(rows, q, 3000))
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want})
    assert hits / (10 * len(got)) >= 0.9


def test_few_rows_ties_and_bad_vectors(spark):
    e = [float(k == 0) for k in range(8)]
    rows = [(0, e, 0), (7, e, 0), (3, e, 0), (5, [0.5] * 8, 0), (100, [0.0] * 8, 0), (200, None, 0), (300, [float("nan")] * 8, 0), (400, [1.0, None] + [0.0] * 6, 0), (None, e, 0), (500, [1.0], 0), (600, [float("inf")] + [0.0] * 7, 0)]
    got = search(spark, rows)
    assert got == {0: [(1, 3, 0.0), (2, 7, 0.0), (3, 5, brute([(0, e, 0), (5, [0.5] * 8, 0)], 0)[0][1])]}


def test_one_bucket_holds_most(spark):
    x = vectors(300, 16)
    same = x[0].tolist()
    rows = [(i, same, 0) for i in range(3000)] + [(3000 + i, v.tolist(), 0) for i, v in enumerate(x)]
    got = search(spark, rows)
    assert [i for _, i, _ in got[1500]] == list(range(10)) and len(got) == 33


def test_repeated_ids_hide_no_neighbours(spark):
    # so near to each other that one bucket of each table holds them all
    x = vectors(1, 8, seed=4)[0] + 1e-3 * np.random.default_rng(4).normal(size=(21, 8))
    rows = [(i + 1, v.tolist(), 0) for i, v in enumerate(x[:20])] + [(100, x[20].tolist(), 0)]
    want = [i for i, _ in brute(rows, 100)]
    copies = [rows[want[0] - 1]] * 12 + [rows[-1]] * 12
    assert [i for _, i, _ in search(spark, rows + copies)[100]] == want
    # one id with many vectors, all nearer than any other row, is one neighbour
    many = [(50, (x[20] + 1e-5 * j).tolist(), 0) for j in range(1, 14)]
    assert [i for _, i, _ in search(spark, rows + many)[100]] == [50, *want[:9]]
    # fewer than ten others
    few = [r for r in rows if r[0] in (100, *want[:5])]
    assert [i for _, i, _ in search(spark, few + copies)[100]] == want[:5]


def test_every_row_many_times(spark):
    for dim, n in ((2, 200), (64, 300)):
        rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors(n, dim, seed=5))]
        got = search(spark, rows * 12)
        assert {q: [i for _, i, _ in x] for q, x in got.items()} == {q: [i for _, i, _ in x] for q, x in search(spark, rows).items()}
        hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in brute(rows, q)}) for q in range(0, n, 100))
        assert hits >= 0.9 * 10 * len(got) and all(len(x) == 10 for x in got.values())


def test_recall_holds_at_other_lengths_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "GROUP", 300)
    for dim in (5, 256):
        rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors(2500, dim, seed=6))]
        got = search(spark, rows)
        assert sum(len({i for _, i, _ in got[q]} & {i for i, _ in brute(rows, q)}) for q in got) >= 0.9 * 10 * len(got)


def test_few_candidates_where_rows_stand_in_clusters():
    """Probing shrinks where neighbours are near: of 200,000 rows in clusters a query looks at few."""
    rng = np.random.default_rng(3)
    centres = vectors(20_000, 64, seed=7).astype(float)
    near = np.repeat(centres[:50], 10, axis=0) + 0.05 * rng.normal(size=(500, 64)) / 8
    plan = neighbours.planned(200_000, 64, centres[:50], np.repeat(np.arange(50), 10), neighbours.unit(near), 3)
    assert plan.probes * 3 / (plan.n_inner * np.prod([2 * g for g in plan.groups])) < 0.01


def test_empty(spark):
    assert search(spark, []) == {}


def test_rotation_keeps_lengths():
    x = vectors(5, 64).astype(float)
    assert np.allclose(np.linalg.norm(turned(x, 3), axis=1), 1) and np.allclose(hadamard(hadamard(x)), x)
