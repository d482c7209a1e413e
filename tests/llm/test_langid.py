"""Operator 7: codes, held-out accuracy, and awkward rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import langid
from tessera.llm.langid import codewords, fit, identify, identify_held_out

from .fixtures import SCHEMA, corpus, documents, with_clashes

LANGS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ü"], "cc": ["eau", "que", "é", "tion"], "dd": ["the", "ing", "wh", "ou"], "ee": ["ñ", "cio", "dad", "el"], "ff": ["szcz", "rz", "ow", "y"]}


def texts(n, langs, seed=5, mixed=False):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = rng.choice(langs)
        w = [rng.choice(LANGS[lang]) + rng.choice(LANGS[lang]) for _ in range(rng.choice([4, 20, 90]))]
        rows.append((k, " ".join(w), lang, f"s{k % 3}", 1))
    return rows


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc", "dd"], list(LANGS)])
def test_held_out_accuracy(spark, langs):
    rows = texts(400, langs)
    got = {r["doc_id"]: r for r in identify_held_out(with_clashes(documents(spark, rows))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    rows = corpus(3) + [(900, "123 456 !!", "en", "s", 1)]
    got = identify_held_out(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (60, 61, 62, 900)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"und", "en", "de"}


def test_nothing_or_one_language_learned(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert identify_held_out(empty).collect() == []
    docs = documents(spark, [(1, "some text", None, "s", 1), (2, None, None, "s", 1)])
    assert {(r["lang_pred"], r["score"]) for r in identify(docs, fit(docs)).collect()} == {("und", 0.0)}
    one = documents(spark, [(1, "some text", "en", "s", 1), (2, None, None, "s", 1)])
    assert {(r["doc_id"], r["lang_pred"]) for r in identify(one, fit(one)).collect()} == {(1, "en"), (2, "und")}


def test_copies_are_sampled_one_by_one(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(langid, "written", lambda df, what: (sizes.append(df.count()) if what == "languages" else None) or df)
    copy = texts(1, ["ff"], seed=9)[0][1]
    docs = documents(spark, texts(600, ["aa"]) + [(1000 + k, copy, "ff", "s", 1) for k in range(600)])
    model = fit(docs, 30)
    assert 40 <= sizes[0] <= 90
    assert {r["lang_pred"] for r in identify(docs.where("lang = 'ff'"), model).collect()} == {"ff"}
    fit(docs.select("text", "lang"), 0)
    assert sizes[1] >= 2


def plain_model(rows, code, names):
    """Log-odds of hashed n-grams and trust of each bit, by loops."""

    def grams(text):
        data = [(c if c >= 128 else c - 0 if 97 <= c <= 122 else 32) for c in text.lower().encode()] + [32] * 4
        for i in range(len(text.lower().encode()) + 1):
            h = 0
            for k in (1, 2, 3):
                h = (h * 0x01000193 + data[i + k - 1] * 0x9E3779B1 + k) % 2**32
                yield (h * 0x85EBCA6B) % 2**32 >> 16

    counts = {name: Counter() for name in names}
    for _, text, lang, *_ in rows:
        counts[lang].update(grams(text))
    rate = {name: defaultdict(float, {g: n / sum(c.values()) for g, n in c.items()}) for name, c in counts.items()}

    def odds(g, j):
        plus, minus = ([rate[n][g] for n, w in zip(names, code, strict=True) if w[j] == side] for side in (1, -1))
        return math.log(sum(plus) / len(plus) + 1e-6) - math.log(sum(minus) / len(minus) + 1e-6)

    def bits(text):
        gs = list(grams(text))
        return [max(-8, min(8, sum(odds(g, j) for g in gs) / math.sqrt(len(gs) / 3) / 4)) for j in range(len(code[0]))]

    trust = []
    for name, word in zip(names, code, strict=True):
        mine = [bits(r[1]) for r in rows if r[2] == name]
        t = [(sum(b[j] * word[j] > 0 for b in mine) + 1) / (len(mine) + 2) for j in range(len(word))]
        trust.append([x / sum(t) for x in t])

    def predict(text):
        loss = [sum(math.log1p(math.exp(-z * w)) * t for z, w, t in zip(bits(text), word, tr, strict=True)) for word, tr in zip(code, trust, strict=True)]
        shares = [math.exp(-(x - min(loss)) * len(code[0])) for x in loss]
        best, second = sorted(loss)[:2]
        return names[loss.index(best)], 1 / sum(shares), second - best < 0.1 * math.log(2)

    return predict


@pytest.mark.parametrize("langs", [["aa", "bb", "cc"], list(LANGS)])
def test_equals_brute_force(spark, langs):
    """Every prediction, score and flag against plain loops, with all rows in the fitting sample; texts of two languages among them."""
    rows = texts(60, langs, seed=2)
    rng = random.Random(1)
    both = [(100 + k, " ".join(rng.choice(LANGS[x]) + rng.choice(LANGS[x]) for x in rng.sample(langs, 2) for _ in range(3)), "aa", "s", 1) for k in range(20)]
    model = fit(documents(spark, rows))
    predict = plain_model(rows, model.code.tolist(), sorted(langs))
    got = {r["doc_id"]: r for r in identify(documents(spark, rows + both), model).collect()}
    for r in rows + both:
        lang, score, close = predict(r[1])
        assert (got[r[0]]["lang_pred"], got[r[0]]["ambiguous"]) == (lang, close) and abs(got[r[0]]["score"] - score) < 1e-4


def test_every_label_is_learned(spark):
    """300 values of lang, more than are gathered at a time; those with a text of their own are told apart."""
    rng = random.Random(8)
    own = {f"label {k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(300)}
    rows = [(k * 4 + j, " ".join(rng.choice(w) for _ in range(25)), name, "s", 1) for k, (name, w) in enumerate(own.items()) for j in range(3)]
    docs = documents(spark, rows)
    model = fit(docs)
    assert model.names == sorted(own) and len(model.names) > 4 * langid.BLOCK
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.97


def test_pieces_change_nothing():
    """Texts over a slice are scored in pieces, cut at white space or, where there is none, anywhere."""
    rng = random.Random(2)
    table = np.frombuffer(rng.randbytes(2**16 * 3 * 2), dtype=np.int16).reshape(-1, 3).astype(np.float32) / 1000
    model = langid.Model(["aa", "bb"], codewords(4)[:2, :3], table, np.ones((2, 3)))
    long = [" ".join(rng.choice(LANGS[rng.choice(list(LANGS))]) for _ in range(n)) for n in (1, 40, 3000)] + ["üÉx" * 4000, "ß" * 9000 + " " * 9000, ""]
    whole = model.bits(long)
    for most in (1, 7, 500):
        total, size = np.zeros((len(long), 3)), np.zeros(len(long))
        for of, pieces, ahead in langid.lots(long, most):
            assert sum(map(len, pieces)) <= 2 * most + 2 + max(map(len, pieces))
            places, starts, ends = langid.grams(pieces, ahead)
            for k, lo, hi in zip(of, starts.tolist(), ends.tolist(), strict=True):
                total[k] += sum(table[p[lo:hi]].sum(axis=0, dtype=float) for p in places)
                size[k] += hi - lo
        assert np.allclose(np.clip(total / np.sqrt(size)[:, None] / 4, -8, 8), whole, atol=1e-4)
        assert size.tolist() == [len(t.lower().encode()) + 1 for t in long]


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 8, 40):
        m = codewords(n)
        gaps = [(m[a] != m[b]).sum() for a in range(n) for b in range(a)]
        assert min(gaps) >= 1 and all(abs(c.sum()) < n for c in m.T)
    assert min((codewords(8)[a] != codewords(8)[b]).sum() for a in range(8) for b in range(a)) >= 5
