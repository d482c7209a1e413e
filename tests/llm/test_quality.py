"""Operator 6 against a plain implementation."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.quality import cascade, ordered_rules, quality, standard_rules, text_stats

from .fixtures import SCHEMA, corpus, documents, with_clashes


def plain(text):
    t = text or ""
    w = t.encode().split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


JUNK = [(900, "word### " * 80, "en", "s", 1), (901, "LOUD WORDS HERE " * 60, "en", "s", 1), (902, "same words again " * 60, "en", "s", 1), (903, "a\nb\na\n a\n\n", "en", "s", 1), (904, "x\x0by\x0cz\rq\t" * 30, "en", "s", 1)]


def test_statistics(spark):
    rows = corpus(3) + JUNK
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality(with_clashes(documents(spark, rows))).collect()}
    assert got == {(r[0], *plain(r[1])) for r in rows}


def test_verdicts(spark):
    rows = corpus(3) + JUNK
    out = {r["doc_id"]: r for r in quality(documents(spark, rows)).collect()}
    for r in rows:
        n, _, _, _, repeats = plain(r[1])
        if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1:
            assert out[r[0]]["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
            assert out[r[0]]["kept"] in ((False,) if out[r[0]]["base_failed"] or r in JUNK else (True,))


def test_order_changes_no_verdict(spark):
    docs = documents(spark, corpus(5) + JUNK)
    rules = standard_rules()
    stats = text_stats(docs)
    order = [r["name"] for r in ordered_rules(docs, rules)]
    assert sorted(order) == sorted(rules)
    assert stats.where(cascade(rules, order) != cascade(rules, order[::-1])).count() == 0
    assert stats.where(cascade({"null": F.lit(None).cast("boolean")}, ["null"])).count() == 0


def test_costs_are_those_of_the_rules(spark):
    """A rule that reads a long text over and over costs more than a comparison, whatever else the machine does."""
    docs = documents(spark, [(k, "some words " * 400, "en", "s", 1) for k in range(40)])
    dear = F.length(F.regexp_replace(F.regexp_replace("text", "[aeiou]", "xy"), "[xy]+", "zz")) < 0
    got = {r["name"]: r["seconds"] for r in ordered_rules(docs, {"cheap": F.col("n_words") < 0, "dear": dear})}
    assert got["dear"] > 5 * got["cheap"] > 0


def test_empty(spark):
    assert quality(spark.createDataFrame([], SCHEMA)).collect() == []
