"""Operator 5 against brute force."""

import random

import numpy as np

from tessera.llm import lines
from tessera.llm.common import MAX_LONG
from tessera.llm.lines import dedup_lines

from .fixtures import SCHEMA, corpus, documents, with_clashes, words


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows):
    lines = sorted((MAX_LONG if d is None else d, j, x) for d, t, *_ in {r[:2] for r in rows} for j, x in enumerate((t or "").split("\n")) if x.encode().split())
    gone = {}
    for k, (d, j, x) in enumerate(lines):
        if any(within_one(x, y) and (e, i) < (d, j) for e, i, y in lines[:k]):
            gone.setdefault(d, set()).add(j)
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        drop = gone.get(MAX_LONG if d is None else d, set())
        out.append((d, sum(bool(x.encode().split()) for x in ls), len(drop), "\n".join(x for j, x in enumerate(ls) if j not in drop)))
    return sorted(out, key=str)


def edited(rng, x):
    i, c = rng.randrange(len(x)), rng.choice("abé 中")
    return rng.choice([x[:i] + c + x[i:], x[:i] + x[i + 1 :], x[:i] + c + x[i + 1 :]])


def check(spark, rows):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["kept"]) for r in dedup_lines(with_clashes(documents(spark, rows))).collect()), key=str)
    assert got == brute(rows)
    return got


def test_edits(spark):
    rng = random.Random(5)
    base = [words(rng, n).replace("\n", " ") for n in (1, 2, 4, 5, 8, 20, 60) for _ in range(3)]
    pool = base + [edited(rng, x) for x in base for _ in range(4) if x] + [edited(rng, edited(rng, x)) for x in base if len(x) > 3]
    rows = [(k, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(1, 6))), "en", "s", 1) for k in range(70)]
    assert sum(r[2] for r in check(spark, rows)) > 50


def test_short_lines(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join("".join(rng.choice("ab é中") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 5))), "en", "s", 1) for k in range(40)]
    assert sum(r[2] for r in check(spark, rows)) > 10


def test_corpus(spark):
    seen, rows = set(), []
    for r in corpus(6):
        if r[0] is None or r[0] not in seen:
            rows.append(r)
            seen.add(r[0])
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][:1]
    check(spark, [*rows, rows[0]])


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "bitmap", lambda keys, name: np.full(1, (1 << 64) - 1, dtype=np.uint64))
    blank, long = " " * 24, "a line of more than twenty characters"
    texts = [blank, f"{blank}\n{long}\n{' ' * 25}", f"{' ' * 12}x{' ' * 11}\n\t{' ' * 23}", f"{long}s\n{blank}\n{blank}", f"{' ' * 30}\n{' ' * 30}"]
    assert sum(r[2] for r in check(spark, [(k, x, "en", "s", 1) for k, x in enumerate(texts)])) == 1


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
