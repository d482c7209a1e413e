"""Operator 2 against a plain implementation."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.mixing import mix, mixed_documents

from .fixtures import SCHEMA, corpus, documents, with_clashes


def targets(sizes, weights, most=3):
    """By giving out and resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        level = total / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            total -= out[s]
        free -= full
    return out


def brute(rows, weights=(1, 2, 3)):
    size = [len((r[1] or "").encode().split()) for r in rows]
    by = defaultdict(int)
    for r, s in zip(rows, size, strict=True):
        by[r[3]] += s
    goal = targets(by, weights)
    before, out = defaultdict(int), []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r, s in sorted(zip(rows, size, strict=True), key=lambda x: md5(f"mix:{'null' if x[0][0] is None else x[0][0]}:{md5(x[0][1] or '')}")):
        budget = int(goal[r[3]])
        times = budget // by[r[3]] if by[r[3]] else 0
        extra = max(0, min(s, budget - times * by[r[3]] - before[r[3]]))
        before[r[3]] += s
        out.append((r[0], s, by[r[3]], float(goal[r[3]]), times * s + extra))
    return sorted(out, key=str)


@pytest.mark.parametrize("weights", [(1, 2, 3), (1,), (1, 50)])
def test_equals_plain(spark, weights):
    rows = corpus(3)
    got = sorted((tuple(r) for r in mix(with_clashes(documents(spark, rows)), list(weights)).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    want = brute(rows, weights)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert all(g[4] <= 3 * g[1] for g in got)


def test_documents_come_as_often_as_taken(spark):
    rows = [r for r in corpus(4) if r[0] is not None]
    docs = documents(spark, rows)
    took = defaultdict(int)
    for r in mix(docs).collect():
        took[r["doc_id"]] += r["taken"]
    got = defaultdict(int)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert dict(got) == {k: v for k, v in took.items() if v}


def test_clashing_names_and_many_equal_rows(spark):
    rows = [(None, "one two three", "en", "a", 1)] * 9000 + [(None, f"other words {k}", "en", "a", 1) for k in range(50)] + [(1, "x y", "en", "b", 1), (2, None, "en", None, 0)]
    clash = ["m_size", "m_key", "m_row", "m", "size", "key", "copy", "with.dot"]
    docs = documents(spark, rows).selectExpr("*", *[f"'z' as `{c}`" for c in clash])
    took = defaultdict(int)
    for r in mix(docs).collect():
        took[r["source"]] += r["taken"]
    assert sum(took.values()) == sum(len((r[1] or "").split()) for r in rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["source"]] += len(r["text"].split())
        assert all(r[c] == "z" for c in clash)
    assert dict(got) == {k: v for k, v in took.items() if v}


def test_a_most_below_the_share_leaves_words_out(spark):
    docs = documents(spark, [(1, "a b c d", "en", "s", 1), (2, "a b", "en", "t", 1)])
    assert {r["doc_id"]: r["taken"] for r in mix(docs, [1.0], 0.5).collect()} == {1: 2, 2: 1}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
    nothing = documents(spark, [(1, None, "en", "s", 0), (2, "", "en", None, 0)])
    assert sorted(r["taken"] for r in mix(nothing).collect()) == [0, 0]


def test_many_copies_of_a_row_are_dealt_out(spark, monkeypatch):
    """A row repeated more often than a task makes copies at once comes out as often, from several tasks."""
    monkeypatch.setattr(mixing, "_COPIES", 16)
    rows = [(1, "a b c", "en", "s0", 5)] * 150 + [(k, "w " * (k % 5), "en", f"s{k % 3}", 1) for k in range(2, 40)]
    docs = documents(spark, rows)
    got = mix(docs).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 1 for r in got) == 150
    assert sum(r["taken"] for r in got) == sum({(r["source_size"], r["target"]): int(r["target"]) for r in got}.values())
    out = mixed_documents(docs).select("doc_id", "text", F.spark_partition_id().alias("p")).collect()
    one = [r for r in out if r["doc_id"] == 1]
    assert sum(len(r["text"].split()) for r in one) == sum(r["taken"] for r in got if r["doc_id"] == 1) and len({r["p"] for r in one}) > 1


def test_levels_of_many_sources(spark):
    """Sources of very different sizes, ties among them: targets against filling up step by step."""
    rng = random.Random(5)
    sizes = {f"s{k:03d}": rng.choice([1, 2, 3, 50, 50, 400, 10_000]) for k in range(120)} | {None: 7}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame, [1.0, 2.0, 3.0], 3.0).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and 3 * sizes[s] < level * weight[s]}
        if not more:
            break
        full |= more
    assert len(full) > 20 and all(abs(got[s] - (3 * sizes[s] if s in full else level * weight[s])) < 1e-6 for s in sizes)
