"""Operator 13: trees against plain loops, statistics against plain counts, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import boosting
from tessera.llm.boosting import STATISTICS, Trees, classify, classify_held_out, fit, grow, statistics

from .fixtures import SCHEMA, corpus, documents, with_clashes, words

LABELS = "doc_id long, quality int, toxic int, text string, y double"


def labelled(n=400, seed=3):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.choice([20, 60, 200]))
        if not good:
            text = rng.choice([text.upper(), (text.split()[0] + " ") * 60, " ".join(w + "###" for w in text.split())])
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(good), 0, "x", 0.0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    got = classify_held_out(with_clashes(documents(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["predicted"] == labels[r["doc_id"]][1] for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_labels_of_held_out_rows_play_no_part(spark):
    rows, labels = labelled(150)
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q, 1, "x", 0.0) for k, q, *_ in labels]
    docs = documents(spark, rows)
    one, two = (sorted(tuple(r) for r in classify_held_out(docs, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert one == two


def plain_score(t: Trees, x):
    z = t.base
    for feature, cut, value in zip(t.feature.tolist(), t.cut.tolist(), t.value.tolist(), strict=True):
        k = 0
        while k < len(feature):
            k = 2 * k + 1 + (x[feature[k]] > cut[k])
        z += value[k - len(feature)]
    return 1 / (1 + np.exp(-z))


def plain_first_cut(x, y, bins):
    """The best cut of all rows, by trying each."""
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + boosting.RIDGE)
    best = (-1.0, 0, 0.0)
    for j in range(x.shape[1]):
        for c in sorted(set(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower").tolist())):
            left = x[:, j] <= c
            if min(left.sum(), (~left).sum()) >= boosting.LEAST_ROWS:
                got = gain(left) + gain(~left) - gain(np.ones(len(y), dtype=bool))
                if got > best[0] + 1e-9:
                    best = (got, j, c)
    return best[1:]


def test_trees_against_loops():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    t = grow(x, y, trees=20, depth=3, bins=16)
    assert np.allclose(t.scores(x), [plain_score(t, r) for r in x])
    assert ((t.scores(x) > 0.5) == y).mean() > 0.95
    assert (t.feature[0, 0], t.cut[0, 0]) == plain_first_cut(x, y, 16)
    assert grow(x, y, trees=20, depth=3, bins=16).value.tolist() == t.value.tolist()


@pytest.mark.parametrize("y", [[], [1.0] * 30, [0.0] * 30])
def test_nothing_to_tell_apart(y):
    t = grow(np.zeros((len(y), len(STATISTICS))), np.array(y))
    s = t.scores(np.zeros((3, len(STATISTICS))))
    assert np.allclose(s, (sum(y) + 1) / (len(y) + 2))


def test_statistics_against_counts():
    text = "One TWO  two two#\n\n- The end. 12\nOne TWO  two two#\nüber"
    got = dict(zip(STATISTICS, statistics([text.encode()])[0], strict=True))
    data, w = text.encode(), text.split()
    n, lines = len(data), [x for x in text.split("\n") if x.strip()]
    share = lambda s: sum(c in s for c in text) / n
    assert np.allclose([got["log_bytes"], got["digit"], got["symbols"], got["line_ends"]], [np.log1p(n), share("12"), share("#"), share("\n")])
    assert np.isclose(got["upper"], sum(c.isupper() for c in text) / n) and np.isclose(got["high"], 2 / n)
    assert np.isclose(got["repeated_bytes"], sum(a == b for a, b in zip(data, data[1:], strict=False)) / n)
    assert np.isclose(got["log_words"], np.log1p(len(w))) and np.isclose(got["word_bytes"], np.mean([len(x.encode()) for x in w]))
    assert np.isclose(got["capital_words"], 2 / len(w)) and np.isclose(got["marked_words"], 2 / len(w)) and np.isclose(got["bare_words"], 2 / len(w))
    assert np.isclose(got["log_lines"], np.log1p(len(lines))) and np.isclose(got["repeated_lines"], 1 / len(lines)) and got["ended_lines"] == 0
    threes = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    assert np.isclose(got["distinct_words"], len(set(w)) / len(w)) and np.isclose(got["distinct_threes"], len(set(threes)) / len(threes)) and np.isclose(got["top_word"], 2 / len(w))


def test_long_texts_in_pieces():
    rng = random.Random(4)
    part = words(rng, 30_000)
    one, many = statistics([part.encode()])[0], statistics([" ".join([part] * 20).encode(), b"y" * 5_000_000, b""])
    named = dict(zip(STATISTICS, zip(one, many[0], strict=True), strict=True))
    for name in ("lower", "upper", "word_bytes", "word_spread", "short_words", "line_words"):
        assert np.isclose(*named[name], rtol=0.01), name
    assert np.isclose(named["distinct_words"][1] * 20, named["distinct_words"][0], rtol=0.01)
    assert np.isfinite(many).all() and many[1][STATISTICS.index("lower")] == 1


def test_awkward_rows(spark):
    rows = corpus(4)
    labels = spark.createDataFrame([(k, k % 2, 0, "x", 0.0) for k in range(30)] + [(1, 0, 0, "x", 0.0), (2, None, 0, "x", 0.0), (3, 7, 0, "x", 0.0), (None, 1, 0, "x", 0.0)], LABELS)
    got = classify_held_out(documents(spark, rows), labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by_text = {}
    for r in classify(documents(spark, rows), fit(documents(spark, rows), labels, "quality")).collect():
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by_text[rows[0][0]]) == 1 and by_text[60] == by_text[61]


def test_no_labels_and_no_rows(spark):
    none, docs = spark.createDataFrame([], LABELS), documents(spark, corpus(2)[:5])
    assert {r["score"] for r in classify_held_out(docs, none).collect()} == {0.5}
    assert classify_held_out(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_many_rows_of_one_labelled_id(spark):
    """Copies of a labelled document count once in fitting, and get a row each."""
    rows, labels = labelled(60)
    copies = [rows[0]] * 3000
    docs, known = documents(spark, rows + copies), spark.createDataFrame(labels, LABELS)
    assert fit(docs, known, "quality").value.tolist() == fit(documents(spark, rows), known, "quality").value.tolist()
    assert classify_held_out(docs, known).count() == 3060
