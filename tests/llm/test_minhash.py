"""Operator 8 against brute force."""

import random

import numpy as np

from tessera.llm import minhash
from tessera.llm.components import components
from tessera.llm.minhash import near_duplicates

from .fixtures import SCHEMA, corpus, documents, with_clashes, words


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    big = 1 << 62
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, big), big if r[0] is None else r[0])
    out = []
    for i, r in enumerate(rows):
        c = least[find(i)]
        c = r[0] if not s[i] else None if c == big else c
        out.append((r[0], len(s[i]), c, r[0] == c))
    return sorted(out, key=str)


def near_family(rng, n, edits):
    base = words(rng, 120).split(" ")
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    return out


def check(spark, rows):
    got = sorted((tuple(r) for r in near_duplicates(with_clashes(documents(spark, rows))).drop("ord", "th").collect()), key=str)
    assert got == brute(rows)
    return got


def test_equals_brute_force(spark):
    got = check(spark, corpus(3))
    assert sum(not r[3] for r in got) > 5


def test_families_near_the_threshold(spark):
    """Chains and clusters with similarities around 3/4: a link may be the only one that joins two parts."""
    rng = random.Random(11)
    texts = [t for e in (2, 3, 4, 5, 6) for t in near_family(rng, 14, e)]
    check(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])


def test_common_passage_is_no_link(spark):
    rng = random.Random(12)
    p = words(rng, 80)
    texts = [p + " " + words(rng, 60) for _ in range(60)] + near_family(rng, 40, 3)
    check(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])


def test_large_loose_buckets(spark):
    """Many outside the largest component, some of them linked."""
    rng = random.Random(14)
    p = words(rng, 150)
    texts = [p + " " + words(rng, rng.randint(30, 70)) for _ in range(150)]
    texts += [t + " " + words(rng, 3) for t in texts[:20]] + [p + " " + words(rng, 12) for _ in range(40)]
    check(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])


def test_sets_that_share_a_hash_stay_apart(spark):
    """A first hash that is the same for all sets of one size: the second one tells them apart."""
    plain = minhash.set_hashes

    def weak(vals, sizes):
        return sizes[sizes > 0].astype(np.uint64), plain(vals, sizes)[1]

    rng = random.Random(15)
    texts = [words(rng, 40) for _ in range(20)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts + texts[:5])]
    assert sorted((tuple(r) for r in near_duplicates(documents(spark, rows), weak).drop("ord", "th").collect()), key=str) == brute(rows)


def test_short_texts(spark):
    rng = random.Random(13)
    check(spark, [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "en", "s", 1) for k in range(80)])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i * 7919 % 10007, (i + 1) * 7919 % 10007) for i in range(1, 60)] + [(20000, 20000 + i) for i in range(1, 40)]
    frame = spark.createDataFrame(edges, "x long, y long")
    check_labels({r["node"]: r["comp"] for r in components(frame).collect()}, edges)


def check_labels(got, edges):
    assert len({got[a] for a, _ in edges[:59]}) == 1 and len({got[b] for _, b in edges[59:]}) == 1 and len(set(got.values())) == 2
