"""Small corpora with planted copies, and the awkward rows every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["the", "an", "tion", "in", "er", "ou", "re", "st", "é", "ß", "th"]


def words(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.08:
            out[-1] += ".\n"
    return " ".join(out)


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Exact copies, near copies, shared passages, repeats within a text, and nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    passages = [words(rng, k) for k in (20, 60, 90, 200)]
    base = [words(rng, rng.choice([5, 30, 80, 150, 300])) for _ in range(12)]
    rows = []
    for k in range(n):
        kind = rng.randrange(6)
        text = words(rng, rng.choice([3, 40, 120, 260]))
        if kind == 0:
            text = rng.choice(base)
        elif kind == 1:
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = words(rng, 1)
            text = " ".join(w)
        elif kind == 2:
            text = words(rng, 30) + " " + rng.choice(passages) + " " + words(rng, 30)
        elif kind == 3:
            p = rng.choice(passages)
            text = p + " " + words(rng, 10) + " " + p
        rows.append((k * 3 % n, text, rng.choice(["en", "de"]), f"src{rng.randrange(4)}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \n\t ", "en", "src0", 4), (n + 3, "a " * 400, "en", "src1", 800), (n + 4, "x" * 700, "de", None, 700)]
    rows += [rows[0], (None, rows[1][1], "en", "src0", 1), (None, words(rng, 70), "en", "src2", 1)]
    rows.append((n + 5, words(rng, 4000), "en", "src3", 1))
    return rows


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def with_clashes(docs: DataFrame) -> DataFrame:
    """Further columns whose names operators use themselves."""
    extra = ("ord", "th", "key", "n", "a", "b", "size", "start", "n_words", "kept", "range", "words", "line", "component_id")
    return docs.selectExpr("*", *[f"'x' as {c}" for c in extra])
