"""Mixing sources to target weights, by DataFrame operations alone.

Every row gets a hash-random key. Within its source it is sorted by ranges of the key: as keys are spread evenly, fixed
ranges of equal width are as good as sampled ones. Sums of sizes by (source, range) give each range its offset; within a
range a running sum does the rest. So no source, however large, is summed in one task. The mix takes rows in that order
until a source's budget is used up to the word, starting over (another epoch) where the source is too small. Texts are
read once: their sizes and keys are written, equal rows as one with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the key within a source. Each is a quarter of a permille of a source, so none outgrows a task.
RANGES = 4096
#: Copies of a row that are made at once.
_COPIES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: str, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _repeated(df: DataFrame, times: str, name: str, heavy: Column | None = None) -> DataFrame:
    """Each row so many times, numbered from 0 in `name`; rows with none go. No array is longer than _COPIES times itself allows.

    heavy: which rows are to be repeated by many tasks. They become a row for each _COPIES of theirs, which are dealt out before they are
    repeated in turn.
    """
    n = F.col(times)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {_COPIES}")))
    within = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(_COPIES - 1).cast("long"), n - 1 - F.col("m_hi") * _COPIES)))
    numbered = lambda rows: rows.withColumn("m_lo", within).withColumn(name, F.col("m_hi") * _COPIES + F.col("m_lo")).drop("m_hi", "m_lo")
    some = df.where(n > 0)
    if heavy is None:
        return numbered(some.withColumn("m_hi", blocks))
    dealt = some.where(heavy).withColumn("m_hi", blocks).repartition(n_partitions(df.sparkSession), "m_hi", "m_key")
    return numbered(some.where(~heavy).withColumn("m_hi", blocks)).union(numbered(dealt))


def source_targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """A row for each source of sizes (source, source_size): with its weight and target.

    Sources by code point, null last, take the weights in turn: range partitions are numbered within, and from the numbers
    of rows in those before (one row a partition). They share the sum of all sizes by weight, none above most times its own
    size: what the full ones cannot take goes to the others by weight. That level (words to a weight) is found in one
    pass over the sources in the order in which they fill up, with running sums by range.
    """
    placed = sizes.repartitionByRange(n_partitions(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = written(placed, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.join(parts, "part").withColumn("weight", F.element_at(turn, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    ranked = written(ranked.select("source", "source_size", "weight", (F.col("source_size") * F.lit(float(most))).alias("most")), "sources")
    # sources in the order in which they fill up: with all before it full, a source sees this level; the first that isn't full under its own sets it
    filled = F.col("most") / F.col("weight")
    placed = ranked.repartitionByRange(n_partitions(sizes.sparkSession), filled, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    placed = written(placed, "sources")
    sums = placed.groupBy("part").agg(F.sum("most").alias("m"), F.sum("weight").alias("w"))
    sums = sums.select("part", F.coalesce(F.sum("m").over(before), F.lit(0.0)).alias("m_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    earlier = Window.partitionBy("part").orderBy(filled, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, x: F.col(x) + F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.sum("weight").alias("w")).first()
    level = (F.lit(float(whole["n"])) - upto("most", "m_before")) / (F.lit(float(whole["w"] or 1)) - upto("weight", "w_before"))
    seen = placed.join(sums, "part").select(filled.alias("filled"), level.alias("level"))
    level = seen.where("level <= filled").agg(F.min(F.struct("filled", (-F.col("level")).alias("less")))["less"].alias("level")).first()["level"]
    level = float("inf") if level is None else -level
    return ranked.select("source", "source_size", "weight", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def _taken(docs: DataFrame, weights: list[float], most: float, seed: str, ranges: int) -> tuple[DataFrame, bool]:
    """For each distinct (doc_id, source, key): m (rows), size, source_size, target, epochs, and extra, the words of all m beyond whole epochs; and whether any m is over _COPIES."""
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), _key(seed, doc_id, docs["text"]).alias("key"))
    rows = rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("m"))
    rows = written(rows.withColumn("range", F.expr(f"cast(floor(cast(conv(substring(key, 1, 8), 16, 10) as long) * {ranges}D / 4294967296D) as int)")), "sizes")
    heavy = not rows.where(F.col("m") > _COPIES).isEmpty()
    by_range = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("m")).alias("in_range"))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("in_range").alias("source_size")), list(weights), most)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.withColumn("offset", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), "offset")
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    plan = offsets.join(targets, offsets["o_source"].eqNullSafe(targets["t_source"])).drop("t_source")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("m")).over(within), F.lit(0)))
    placed = placed.join(plan, placed["source"].eqNullSafe(plan["o_source"]) & (placed["range"] == plan["o_range"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size") * F.col("m"), rest - F.col("offset") - F.col("before")))
    out = placed.withColumn("epochs", epochs.cast("long")).withColumn("extra", extra.cast("long"))
    return out.select("doc_id", "source", "key", "m", "size", "source_size", "target", "epochs", "extra"), heavy


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), most: float = 3.0, seed: str = "mix", ranges: int = RANGES) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (its source's) and taken, the words that the mix takes of it.

    size is the number of words; null text has none. A source's rows are taken in the order of their keys, each whole
    and as often as whole epochs fit in the target, the last one up to the word at which the target (rounded down) is
    reached; so no row is taken more than most times, and the sum of taken is the target less a fraction of a word.
    The key is the MD5 of the seed, doc_id and text: reruns agree, and rows that share a doc_id, null too, are spread. A
    null source is a source of its own, in the last place. Equal rows are taken one after the other. No rows give no
    rows. Further columns of docs are left out. Only sizes and keys are shuffled, never text.
    """
    took, heavy = _taken(docs, weights, most, seed, ranges)
    rows = _repeated(took.withColumnRenamed("key", "m_key"), "m", "copy", F.col("m") > _COPIES if heavy else None)
    here = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("copy") * F.col("size")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + here).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of docs as the mix takes them, with all their columns: once for each epoch, the last time cut to the words that are left.

    A row of which nothing is taken goes. A cut text is its first words, joined by single spaces. Rows equal in doc_id,
    source and text stand for one another: as many come out as the mix takes of them all. Columns of docs may have any
    names: they travel in one struct. Nulls, ties and empty tables as for mix.
    """
    whole = lambda key, source: F.md5(F.concat(key, F.coalesce(F.concat(F.lit(":"), source), F.lit("null"))))
    took, heavy = _taken(docs, weights, most, seed, RANGES)
    took = took.select(whole(F.col("key"), F.col("source")).alias("m_key"), F.col("size").alias("m_size"), (F.col("m") * F.col("epochs") * F.col("size") + F.col("extra")).alias("m_all"))
    key = whole(_key(seed, docs["doc_id"].cast("long"), docs["text"]), docs["source"])
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("m_row"), key.alias("m_key")).dropDuplicates(["m_key"])
    out = rows.join(took.where("m_all > 0"), "m_key").withColumn("m_times", F.ceil(F.try_divide("m_all", "m_size")))
    out = _repeated(out, "m_times", "m_copy", F.col("m_times") > 4 * _COPIES if heavy else None).withColumn("m_words", F.least(F.col("m_size"), F.col("m_all") - F.col("m_copy") * F.col("m_size")))
    text = F.col("m_row")["text"]
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("m_words").cast("int")), " ")
    kept = F.when(F.col("m_words") < F.col("m_size"), cut).otherwise(text)
    return out.select(*[(kept if c == "text" else F.col("m_row")[c]).alias(c) for c in docs.columns])
