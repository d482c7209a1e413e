"""Quality rules as a short-circuit cascade, by DataFrame operations alone.

Each rule is a Column that is true for a row to be rejected. On a bounded sample every rule's cost (its own time in the JVM) and
selectivity (share rejected) are measured; rules with more rejection per cost come first in one CASE expression, whose later branches
aren't evaluated once one holds. The order changes the cost alone, never the verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .mixing import WORD

#: Characters that are counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of the sample on which rules are ordered (a bound for the driver's work, of no effect on verdicts).
SAMPLE_ROWS = 2000


def text_stats(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every row of docs (and the columns `more`).

    Null text has no words, characters or lines, and stays null. n_lines and n_dup_lines count lines with a word; a line
    is a duplicate if it equals an earlier one of its text. n_repeat_words counts the words in windows of three that the
    text has twice or more: windows are compared by 64-bit hashes within one text, in two steps, of which the second
    (positions sorted by hash) runs only where a hash occurs twice. All is computed within the row; nothing is shuffled.
    """
    t = F.coalesce(F.col("s_text"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("s_text"), *[docs[c] for c in more])
    rows = rows.select("*", F.regexp_extract_all(t, F.lit(f"({WORD})")).alias("s_words"))
    rows = rows.select("*", F.expr("if(size(s_words) < 3, array(), transform(sequence(0, size(s_words) - 3), i -> xxhash64(s_words[i], s_words[i + 1], s_words[i + 2])))").alias("s_grams"))
    rows = rows.select(
        "*",
        F.expr("if(size(array_distinct(s_grams)) < size(s_grams), sort_array(transform(s_grams, (h, i) -> struct(h, i))), array())").alias("s_sorted"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("s_lines"),
    )
    repeats = "filter(s_sorted, (e, k) -> (k > 0 and element_at(s_sorted, if(k > 0, k, 1)).h = e.h) or (k + 1 < size(s_sorted) and element_at(s_sorted, if(k + 1 < size(s_sorted), k + 2, 1)).h = e.h))"
    return rows.select(
        "doc_id",
        F.col("s_text").alias("text"),
        *more,
        F.size("s_words").cast("long").alias("n_words"),
        F.length(F.array_join("s_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("s_lines").cast("long").alias("n_lines"),
        (F.size("s_lines") - F.size(F.array_distinct("s_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(array_distinct(flatten(transform({repeats}, e -> array(e.i, e.i + 1, e.i + 2)))))").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def standard_rules() -> dict[str, Column]:
    """Rejections over the columns of text_stats; the last ones read the text again and cost the most."""
    t = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 20 * F.col("n_words"),
        "few_letters": 2 * letters < F.col("word_chars"),
        "capitals": 2 * capitals > letters,
        "ellipses": F.expr("3 * regexp_count(text, '(?m)(\\\\.\\\\.\\\\.|…)[ \\\\t\\\\r]*$') > n_lines"),
        "bullets": F.expr("10 * regexp_count(text, '(?m)^[ \\\\t]*[-•*][ \\\\t]') > 9 * n_lines"),
    }


def ordered_rules(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """The rules by rejection per cost, best first: name, rejects (share of the sample), seconds; measured on about sample_rows rows.

    All rules are measured in one job, row by row between two readings of the clock of the JVM, so what Spark does besides
    doesn't count. Each has a branch of its own over the sample, so none is spared what another has computed.
    """
    sample = written(text_stats(docs.sample(min(1.0, sample_rows / max(docs.count(), 1)), seed)), "quality-sample")
    clock = lambda: F.java_method(F.lit("java.lang.System"), F.lit("nanoTime"))
    branches = [sample.select(F.lit(name).alias("name"), F.struct(clock().alias("a"), F.coalesce(c, F.lit(False)).alias("hit"), clock().alias("b")).alias("m")) for name, c in rules.items()]
    if not branches:
        return []
    seconds = F.sum(F.col("m.b").cast("long") - F.col("m.a").cast("long")) / F.lit(1e9)
    got = reduce(DataFrame.unionAll, branches).groupBy("name").agg(F.avg(F.col("m.hit").cast("int")).alias("rejects"), seconds.alias("seconds"))
    found = {r["name"]: (r["rejects"], r["seconds"]) for r in got.collect()}
    out = [{"name": name, "rejects": found.get(name, (0.0, 0.0))[0], "seconds": max(found.get(name, (0.0, 0.0))[1], 1e-9)} for name in rules]
    return sorted(out, key=lambda r: (-r["rejects"] / r["seconds"], r["name"]))


def cascade(rules: dict[str, Column], order: list[str], first: Column | None = None) -> Column:
    """True where `first` or any rule rejects, tested in this order until one does. A null verdict of a rule doesn't reject."""
    named = ([first] if first is not None else []) + [rules[name] for name in order]
    out = F.lit(False)
    for c in reversed(named):
        out = F.when(F.coalesce(c, F.lit(False)), F.lit(True)).otherwise(out)
    return out


def quality(docs: DataFrame, *more: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """text_stats of every row of docs (with the columns `more`), base_failed and kept (false if the base test or any rule rejects).

    Null and empty texts fail the base test. Rows are judged one by one: a null doc_id, repeated rows and further columns
    make no difference; no rows give no rows.
    """
    rules = standard_rules() if rules is None else rules
    order = [r["name"] for r in ordered_rules(docs, rules)]
    stats = text_stats(docs, *more)
    return stats.select("*", base_failed().alias("base_failed"), (~cascade(rules, order, base_failed())).alias("kept"))


def keep(docs: DataFrame, *more: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows of quality() that are kept.

    The row number makes the optimizer leave the filter above the statistics; below, it would copy their expressions into
    the condition over and over.
    """
    return quality(docs, *more, rules=rules).withColumn("s_row", F.monotonically_increasing_id()).where("kept and s_row >= 0").drop("s_row")
