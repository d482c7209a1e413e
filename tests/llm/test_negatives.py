"""Operator 12 against brute force."""

import math
import random

import numpy as np
import pytest

from tessera.llm import negatives
from tessera.llm.negatives import hard_negatives, mine_embeddings, products, usable

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    some = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        some[(i, label, q)] = None
    out = []
    for a in some:
        if a[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2], strict=True)), b) for b in some if b != a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, pos in [s for s in scored if s[1][1] == a[1]][:5]:
            near = [s for s in scored if s[1][1] != a[1] and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(a[0], pos[0], k, n[0], p, s) for k, (s, n) in enumerate(near, 1)]
    return sorted(out)


def frame(spark, rows):
    clashes = ("id", "v", "rk", "w", "x", "y", "dim", "top", "base", "same")
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in clashes]).repartition(3)


def check(spark, rows):
    got = sorted(tuple(r) for r in mine_embeddings(frame(spark, rows)).collect())
    assert got == brute(rows)
    return got


def vectors(seed, n, dim=6, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    labels = rng.integers(0, 10, n)
    x = centres[labels // 3] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(k), [float(y) for y in np.float32(v)], int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    assert len(check(spark, vectors(seed, 700))) > 50


def test_many_digits_and_blocks(spark, monkeypatch):
    """Digits of three bits, blocks of a few rows: every round, and buckets over several blocks."""
    for name, value in (("DIGIT", 3), ("ROWS", 60), ("ANCHORS", 3), ("TILE", 2)):
        monkeypatch.setattr(negatives, name, value)
    check(spark, vectors(3, 600, dim=4))


def test_ties_and_copies(spark):
    """One vector under a third of all ids, more ties than any window takes; repeated rows count once."""
    rows = vectors(4, 300)
    rows = [(k, rows[0][1], c) if k % 3 == 0 else (k, v, c) for k, v, c in rows]
    check(spark, rows + rows[:40] * 5)


def test_awkward_rows(spark):
    rows = vectors(5, 220)
    odd = [(300, None, 1), (400, [0.5, None], 1), (500, [float("nan")] * 6, 1), (600, [float("inf")] * 6, 2), (None, rows[0][1], 1), (700, rows[0][1], None)]
    odd += [(800, [], 3), (801, [], 3), (802, [], 4), (900, [0.1, 0.2], 1), (901, [0.1, 0.2], 1), (902, [0.1, 0.2], 2), (1000, [0.0] * 6, 1), (1100, [-x for x in rows[100][1]], 5)]
    check(spark, rows + odd)


def test_large_components_are_exact(spark):
    """Products beyond 2**53 are longs still; vectors whose length no long can take are left out."""
    rng = random.Random(6)
    rows = [(k, [rng.uniform(-1, 1) * 3e5 * 2 for _ in range(6)], k % 3) for k in range(120)]
    assert len(check(spark, rows)) > 5
    big = [(1000 + k, [3.0e38] * 6, k % 3) for k in range(10)]
    assert sorted(tuple(r) for r in mine_embeddings(frame(spark, rows + big)).collect()) == brute(rows)


def test_products_in_either_way():
    rng = np.random.default_rng(1)
    a, b = (np.floor(rng.normal(size=(5, 8)) * s) for s in (2.0**26, 2.0**29))
    assert products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def test_no_rows_no_anchors_no_positives(spark):
    assert mine_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
    assert check(spark, [(k, [1.0, 0.0], 1) for k in range(1, 30)]) == []
    assert check(spark, [(100, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]) == []


def test_other_windows(spark):
    """Any share of the positive's score, any number of rows."""
    rows = vectors(7, 250)
    got = hard_negatives(usable(frame(spark, rows)), negatives.F.col("id") < 4, 2, 3, 50, 95).collect()
    assert got and all(50 * r["positive_score"] <= 100 * r["negative_score"] <= 95 * r["positive_score"] and r["rank"] <= 3 for r in got)
