"""Operators 4 and 9 against brute force over small corpora."""

import hashlib
import random

import pytest

from tessera.llm import windows as W
from tessera.llm.common import MAX_LONG
from tessera.llm.substrings import dedup_substrings, dedup_suffixes

from .fixtures import SCHEMA, corpus, documents, with_clashes, words


def brute(rows, width, words):
    first, docs = {}, []
    for doc_id, text, *_ in rows:
        units = (text or "").encode().split() if words else (text or "").encode()
        docs.append((doc_id, MAX_LONG if doc_id is None else doc_id, units))
    for _, o, u in docs:
        for i in range(len(u) - width + 1):
            k = tuple(u[i : i + width]) if words else u[i : i + width]
            first[k] = min(first.get(k, (o, i)), (o, 0 if words else i))
            if words:
                first[k] = (min(first[k][0], o), 0)
    out = []
    for doc_id, o, u in docs:
        gone = set()
        for i in range(len(u) - width + 1):
            k = tuple(u[i : i + width]) if words else u[i : i + width]
            if first[k] < (o, 0 if words else i):
                gone.update(range(i, i + width))
        kept = [u[i : i + 1] if not words else u[i] for i in range(len(u)) if i not in gone]
        data = b" ".join(kept) if words else b"".join(kept)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc_id, len(u), len(gone), spans, hashlib.sha256(data).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("is_words", [True, False])
def test_equals_brute_force(spark, is_words, seed):
    rows = corpus(seed)
    f, width = (dedup_substrings, 50) if is_words else (dedup_suffixes, 100)
    got = sorted((tuple(r) for r in f(with_clashes(documents(spark, rows))).collect()), key=str)
    want = brute(rows, width, is_words)
    assert got == want
    assert sum(r[2] for r in want) > 1000


def test_every_window_compared_across_borders(spark, monkeypatch):
    """Many tasks for few tokens, and tiny chunks: most tokens lie at a border."""
    rows = [(k, "common passage " * 3 + " ".join(f"w{k % 3}x{i}" for i in range(80)) + f" own{k}", "en", "s", 1) for k in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        for is_words, f, width in ((True, dedup_substrings, 50), (False, dedup_suffixes, 100)):
            got = sorted((tuple(r) for r in f(documents(spark, rows)).collect()), key=str)
            assert got == brute(rows, width, is_words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_small_chunks_settle_alike():
    docs = [t.encode() for _, t, *_ in corpus(5) if t]
    for w in (W.WORDS_50, W.BYTES_100):
        r = W.runs_of(docs, w)
        assert (r.n > 0).all() and len(r.key) == len(r.start)
        covered = sum(int(x) for x in r.n)
        sizes = [len(d.split()) if w.words else len(d) for d in docs]
        assert covered == sum(max(0, s - w.width + 1) for s in sizes)


@pytest.mark.parametrize("w", [W.WORDS_50, W.BYTES_100])
def test_pieces_hold_every_window_once(w):
    for seed in range(20):
        rng = random.Random(seed)
        text = b"".join(rng.choice([b"a", b"bc ", b" ", b"\n", b"x" * 150]) for _ in range(rng.choice([0, 30, 400, 3000])))
        units = text.split() if w.words else text
        got = {}
        for piece, first in W.pieces(text, w, rng.choice([64, 300, 2000])):
            u = piece.split() if w.words else piece
            for i in range(len(u) - w.width + 1):
                assert first + i not in got
                got[first + i] = u[i : i + w.width]
        assert got == {i: units[i : i + w.width] for i in range(len(units) - w.width + 1)}


def test_texts_longer_than_a_slice(spark):
    """Over a megabyte, with passages across the ends of pieces and a word of 200,000 letters."""
    rng = random.Random(4)
    passage = words(rng, 3000)
    long = " ".join([words(rng, 20_000), passage, words(rng, 60_000), "y" * 200_000, words(rng, 60_000), passage, words(rng, 30_000)])
    assert len(long.encode()) > 1_200_000
    rows = [(1, passage[500:9000], "en", "s", 1), (2, long, "en", "s", 1), (3, long[700_000:1_200_000], "en", "s", 1)]
    for is_words, f, width in ((True, dedup_substrings, 50), (False, dedup_suffixes, 100)):
        assert sorted((tuple(r) for r in f(documents(spark, rows)).collect()), key=str) == brute(rows, width, is_words)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).collect() == [] and dedup_suffixes(empty).collect() == []


def test_kept_text(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "en", "s", 1), (2, "start " + " ".join(f"w{i}" for i in range(60)) + " end", "en", "s", 1)]
    got = {r["doc_id"]: r["kept"] for r in dedup_substrings(documents(spark, rows), with_text=True).collect()}
    assert got[2] == "start end" and got[1].startswith("w0 ")
