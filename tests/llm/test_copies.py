"""Thousands of copies of a row, and of a near copy of it under one id: equal to brute force over the different rows, and linear."""

import random
from collections import Counter

import pytest

from tessera.llm.langid import identify_held_out
from tessera.llm.lines import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.quality import quality
from tessera.llm.substrings import dedup_substrings, dedup_suffixes

from . import test_lines, test_minhash, test_windows
from .fixtures import corpus, documents, words

COPIES = 2000


@pytest.fixture(scope="module")
def rows():
    """The different rows, and how often each one comes."""
    rng = random.Random(21)
    text = "\n".join(words(rng, 12).replace("\n", " ") for _ in range(40))
    near = text[:200] + "q" + text[201:-30]
    more = {}
    for r in corpus(9, 20):
        more.setdefault(r[:2], r)
    out = {(500, text, "en", "s", 1): COPIES, (700, near, "en", "s", 1): COPIES, (600, text + " and more", "en", "s", 1): 1}
    return out | dict.fromkeys((r for r in more.values() if r[0] is not None), 1)


def same(got, want, rows):
    """got: the rows that came out; want: those for the different rows, each expected as often as its doc_id's."""
    times = {r[0]: n for r, n in rows.items()}
    assert Counter(got) == Counter({w: times[w[0]] for w in want})


def frame(spark, rows):
    return documents(spark, [r for r, n in rows.items() for _ in range(n)])


def test_substrings_and_suffixes(spark, rows):
    docs = frame(spark, rows).persist()
    for is_words, f, width in ((True, dedup_substrings, 50), (False, dedup_suffixes, 100)):
        same([tuple(r) for r in f(docs).collect()], test_windows.brute(list(rows), width, is_words), rows)
    docs.unpersist()


def test_line_dedup(spark, rows):
    got = dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_removed", "kept").collect()
    same([tuple(r) for r in got], test_lines.brute(list(rows)), rows)


def test_near_duplicates(spark, rows):
    got = near_duplicates(frame(spark, rows)).drop("ord", "th").collect()
    same([tuple(r) for r in got], test_minhash.brute(list(rows)), rows)


def test_narrow_operators(spark, rows):
    """Quality, language and the mix: each copy gets a row; the mix takes all copies of a row one after the other."""
    docs = frame(spark, rows).persist()
    n = sum(rows.values())
    assert quality(docs).count() == n == identify_held_out(docs).count()
    by_source = {}
    for r in mix(docs).collect():
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
        assert r["taken"] <= 3 * r["size"]
    assert sum(map(len, by_source.values())) == n
    assert all(abs(sum(r["taken"] for r in got) - target) < 1 for (_, target), got in by_source.items())
    docs.unpersist()
