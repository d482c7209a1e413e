"""Operator 11 against plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.merkle import Parents, folded, leaf_digest, manifest, siblings, tampered_documents, verified

from .fixtures import SCHEMA, corpus, documents, with_clashes


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row):
    doc_id, text, lang, source, n = row
    return sha(*map(field, (doc_id, source, lang, n, text)))


def tree(nodes, arity):
    """(root, for each node the pairs of what stands left and right of it, level by level)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for s, k in zip(steps, at, strict=True):
            run, j = runs[k // arity], k % arity
            s.append(("".join(run[:j]), "".join(run[j + 1 :])))
        at, nodes = [k // arity for k in at], [sha(*run) for run in runs]
    return nodes[0], steps


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    made = []
    for _, group in sorted(groups.items()):
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((group, *tree([leaf(r) for r in group], arity)))
    root, tops = tree([m[1] for m in made], arity) if made else (None, [])
    out = []
    for (group, subroot, steps), top in zip(made, tops, strict=True):
        for r, own in zip(group, steps, strict=True):
            touched = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:4], r[4] + 1)) if touched else leaf(r)
            for a, b in own + top:
                h = sha(a, h, b)
            out.append((r[0], leaf(r), subroot, root, sha(*[x for s in own + top for x in s]), h, h == root))
            assert out[-1][6] != touched
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(spark, rows, arity=2, block=merkle.BLOCK):
    got = verified(tampered_documents(with_clashes(documents(spark, rows)), arity, block)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, arity)


@pytest.mark.parametrize("arity", [2, 3, 7])
def test_equals_recursion(spark, arity):
    rows = corpus(3)
    check(spark, rows + [(7, "x", "", "s", 1), (7, "y", "", "s", (1 << 63) - 1), (8, "ö", "zz", None, None)], arity)


def test_several_rounds_and_a_hot_group(spark):
    """Blocks of four nodes: many rounds; a group that holds nearly all rows, and many groups of one."""
    rng = random.Random(5)
    rows = [(rng.randrange(400), f"text {k % 50}", "en", "s", k) for k in range(301)] + [(k, "t", f"l{k}", "s", 1) for k in range(9)]
    check(spark, rows + [rows[0]] * 40, block=4)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_small_tables(spark, n):
    check(spark, [(k, "t", "en", "s", 1) for k in range(n)])
    check(spark, [(k, "t", f"l{k}", "s", 1) for k in range(n)])


def test_empty_table(spark):
    assert verified(tampered_documents(spark.createDataFrame([], SCHEMA))).collect() == []


def test_parents_take_children_in_any_order():
    for n in (1, 2, 5, 8, 23):
        digests, order = [sha(str(k)) for k in range(n)], list(range(n))
        random.Random(n).shuffle(order)
        p = Parents(n, 2, 8)
        for k in order:
            p.add(k, digests[k])
        assert p.top == [(0, tree(digests, 2)[0])] and not p.open


def test_a_proof_shows_a_change_and_other_tables_have_manifests(spark):
    rows = spark.createDataFrame([(k, f"g{k % 2}", k * k) for k in range(20)], "id long, part string, v long")
    made = manifest(rows, leaf_digest(rows["id"], rows["v"]), "part", "id", {"v": rows["v"]})
    assert made.columns == ["id", "leaf", "subroot", "root", "proof", "v"]
    right, wrong = leaf_digest(F.col("id"), F.col("v")), leaf_digest(F.col("id"), F.col("v") + 1)
    got = made.select((folded(right, F.col("proof")) == F.col("root")).alias("a"), (folded(wrong, F.col("proof")) == F.col("root")).alias("b"), F.length(siblings(F.col("proof"))).alias("n")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(True, False)} and all(r["n"] % 64 == 0 for r in got)


def test_hot_rows_are_long_texts(spark):
    check(spark, [(1, "ü" * 3_000_000, "en", "s", 1), (2, "", "en", "s", 2), (3, None, "en", "s", 3)])
