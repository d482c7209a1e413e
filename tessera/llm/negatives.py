"""Hard-negative mining by distributed radix selection.

Scores are integer inner products of quantised vectors. For every anchor and positive the window of scores just under the
positive's holds its hard negatives; the first k rows of a window are found without gathering the window:

1. Rows and anchors are dealt into blocks; each pair of blocks meets in one task, which scores it by a matrix product.
2. A score counts by its distance from the top of its window. The highest digit of the distances gives a histogram for each
   window; histograms are added up over the blocks, and show in which bucket the k-th row lies. Its next digit is looked at
   in the same way, until the distance of the k-th row is known.
3. Rows nearer than that distance qualify, and of those just at it as many as are left, by the least ids. Only they are gathered.

A block reports no bucket beyond the one in which it has k rows itself, and no more than k rows at the last distance, so
ties of any number travel as k rows a block. Positives are found in the same way, in a window that holds all scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written

SCALE = 256
#: Bits of a digit.
DIGIT = 10
#: Rows and anchors of a block, as expected numbers; a task scores TILE anchors at a time.
ROWS, ANCHORS, TILE = 4096, 2048, 128
#: Least rows of a block, where there are fewer rows than partitions could take.
LEAST_ROWS = 128
#: Squared length from which a vector takes no part, as its score with itself would be no long.
TOO_LONG = float(1 << 60)


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, v (quantised), rk (a number for each different row, the same in every run), of the rows that take part.

    These have an id, a label and a vector whose components are all finite; a vector of no components is one too, and scores 0.
    Rows that agree in all three are one.
    """
    x = rows[vector]
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    some = rows.where(rows[id_].isNotNull() & rows[label].isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    # finite doubles may be too large for floor(), which gives longs: such vectors are too long by far
    small = F.forall(x, lambda c: F.abs(c) < 2.0**40)
    out = some.where(small).select(rows[id_].cast("long").alias("id"), rows[label].cast("long").alias("label"), quantised(x).alias("v"))
    out = out.where(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c) < TOO_LONG)
    return out.withColumn("rk", F.xxhash64("id", "label", "v")).dropDuplicates(["id", "label", "v"])


# ---- blocks ----------------------------------------------------------------------------------------------


def _vectors(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, as exact longs.

    A double holds them, and every partial sum, as long as the product of the greatest lengths is under 2**53; beyond, whole numbers are multiplied.
    """
    most = lambda x: np.sqrt((x * x).sum(axis=1).max(initial=0))
    if most(a) * most(b) < 1 << 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _windows_of_scores(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of the block: its place, its windows, and the ids, distances to no window yet, of the rows on its side.

    Rows come with vectors as long as the anchor's only; the anchor's own row is left out.
    """
    ids, labels, rks = (rows.column(c).to_numpy() for c in ("id", "label", "rk"))
    a_labels, a_rks, same = anchors.column("label").to_numpy(), anchors.column("rk").to_numpy(), anchors.column("same").to_pylist()
    windows, x, y = anchors.column("windows").to_pylist(), _vectors(rows), _vectors(anchors)
    for lo in range(0, len(y), TILE):
        scores = products(y[lo : lo + TILE], x)
        for k, s in enumerate(scores, lo):
            side = np.flatnonzero((labels == a_labels[k]) & (rks != a_rks[k]) if same[k] else labels != a_labels[k])
            yield k, windows[k], ids[side], rks[side], s[side]


def _histograms(rows: pa.Table, anchors: pa.Table, k: int, shift: int) -> pa.Table:
    """w, bucket, c: for each window, how many rows the block has at each value of the digit, up to the bucket of its k-th row."""
    w, bucket, c = [], [], []
    if rows.num_rows and anchors.num_rows:
        for _, windows, _, _, score in _windows_of_scores(rows, anchors):
            for x in windows:
                far = x["top"] - score
                at = far[(far >= x["base"]) & (far <= x["end"])] - x["base"]
                if len(at):
                    if len(at) > 4 * k:
                        at = at[at <= np.partition(at, k - 1)[k - 1]] if shift == 0 else at[(at >> shift) <= (np.partition(at, k - 1)[k - 1] >> shift)]
                    b, n = np.unique(at >> shift, return_counts=True)
                    w.append(np.full(len(b), x["w"]))
                    bucket.append(b)
                    c.append(n)
    join = lambda p: np.concatenate(p) if p else np.zeros(0, dtype=np.int64)
    return pa.table({"w": pa.array(join(w), pa.int64()), "bucket": pa.array(join(bucket), pa.int64()), "c": pa.array(join(c), pa.int64())})


def _qualifying(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """w, id, rk, score: the block's rows nearer than each window's last distance, and of those at it no more than are needed, by the least ids."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        for _, windows, ids, rks, score in _windows_of_scores(rows, anchors):
            for x in windows:
                far = x["top"] - score
                near, tied = np.flatnonzero((far >= 0) & (far < x["base"])), np.flatnonzero(far == x["base"])
                if len(tied) > x["need"]:
                    tied = tied[np.lexsort((rks[tied], ids[tied]))[: x["need"]]]
                take = np.concatenate((near, tied))
                if len(take):
                    out.append((np.full(len(take), x["w"]), ids[take], rks[take], score[take]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, dtype=np.int64)] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("w", "id", "rk", "score"), cols, strict=True)})


def _with(f, *more):
    """f over a pair of blocks, with further arguments; Spark tells by the number of parameters what it is to pass."""
    return lambda rows, anchors: f(rows, anchors, *more)


class _Blocks:
    """Rows in blocks by a hash, and what a pass over all pairs of blocks gives."""

    def __init__(self, rows: DataFrame, n_rows: int):
        self.rows = rows
        self.n_rows = max(1, -(-n_rows // ROWS), min(n_partitions(rows.sparkSession), n_rows // LEAST_ROWS))

    def meet(self, anchors: DataFrame, n_anchors: int, f, schema: str) -> DataFrame:
        """f(rows, anchors) for each pair of a block of rows and one of anchors (rk, label, v, same, windows)."""
        n_anchors = max(1, -(-n_anchors // ANCHORS))
        side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = self.rows.select("id", "label", "v", "rk", F.size("v").alias("dim"), F.pmod("rk", F.lit(self.n_rows)).cast("int").alias("x"), side(n_anchors).alias("y"))
        them = anchors.select("rk", "label", "v", "same", "windows", F.size("v").alias("dim"), side(self.n_rows).alias("x"), F.pmod("rk", F.lit(n_anchors)).cast("int").alias("y"))
        cell = ["x", "y", "dim"]
        return rows.groupBy(*cell).cogroup(them.groupBy(*cell)).applyInArrow(f, schema)


def first_rows(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """w, id, rk, score, rank: the first k rows of every window, by the highest score and then the least id.

    anchors: rk, label, v. windows: w (a number), a (its anchor's rk), top (its highest score), width (how far its scores go
    down); same: whether it holds rows of the anchor's label (never its own row) or of all others. Windows live in a written
    table, a row each; base and end are the bounds of the distances in question, need how many rows these must still give.
    """
    blocks = _Blocks(rows, n_rows)
    state = written(windows.select("w", "a", "top", F.lit(0).cast("long").alias("base"), F.col("width").alias("end"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("short")), "windows")
    widest = state.agg(F.max("end")).first()[0]
    if widest is None:
        return state.select("w", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("rk"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    fields = ("w", "top", "base", "end", "need")

    def packed(windows: DataFrame) -> DataFrame:
        of = windows.groupBy("a").agg(F.collect_list(F.struct(*fields)).alias("windows")).withColumnRenamed("a", "rk")
        return anchors.join(of, "rk").withColumn("same", F.lit(same))

    shift = max(0, -(-int(widest).bit_length() // DIGIT) - 1) * DIGIT
    while shift >= 0:
        counts = blocks.meet(packed(state.where("not short")), n_anchors, _with(_histograms, k, shift), "w long, bucket long, c long")
        counts = counts.groupBy("w", "bucket").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto).join(state.select("w", "need"), "w")
        kth = counts.where("upto >= need").groupBy("w").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("c")).alias("before"))).alias("m")).select("w", "m.bucket", "m.before")
        base = F.col("base") + F.col("bucket") * F.lit(1 << shift)
        found = F.col("bucket").isNotNull()
        state = written(
            state.join(kth, "w", "left").select(
                "w", "a", "top",
                F.when(found, base).when(F.col("short"), F.col("base")).otherwise(F.col("end")).alias("base"),
                F.when(found, F.least("end", base + F.lit((1 << shift) - 1))).otherwise(F.col("end")).alias("end"),
                F.when(found, F.col("need") - F.col("before")).otherwise(F.col("need")).alias("need"),
                (F.col("short") | ~found).alias("short"),
            ),
            "windows",
        )
        shift -= DIGIT
    got = blocks.meet(packed(state), n_anchors, _with(_qualifying), "w long, id long, rk long, score long")
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id", "rk"))
    return got.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: those of usable(); is_anchor is a condition on id. An anchor's positives are its first `positives` other rows of its label, a positive's
    negatives the first `negatives` rows of other labels with least * positive_score <= 100 * negative_score <= most *
    positive_score (least <= most <= 100), ranked from 1. Vectors of another length than the anchor's are no candidates. Rows of one id that differ otherwise are rows like any others. No anchors, or none with
    positives and negatives, give no rows.
    """
    rows = written(rows, "vectors")
    n_rows = rows.count()
    anchors = written(rows.where(is_anchor).select("id", "rk", "label", "v"), "anchors")
    n_anchors = anchors.count()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    longest = rows.agg(F.max(length)).first()[0] or 0.0
    top = (F.ceil(length * F.lit(longest) * 1.000001) + 1).cast("long")  # no score is higher, nor lower than its negative
    every = anchors.select(F.col("rk").alias("w"), F.col("rk").alias("a"), top.alias("top"), (top * 2).alias("width"))
    liked = written(first_rows(rows, n_rows, anchors, n_anchors, every, True, positives), "positives")
    pairs = written(liked.select(F.xxhash64("w", "rk").alias("p"), F.col("w").alias("a"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    # the highest and the lowest score of the window
    high, low = F.floor(score * most / 100), F.ceil(score * least / 100)
    window = pairs.select(F.col("p").alias("w"), "a", high.cast("long").alias("top"), (high - low).cast("long").alias("width"))
    mined = first_rows(rows, n_rows, anchors, n_anchors, window.where("width >= 0"), False, negatives)
    out = mined.select(F.col("w").alias("p"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(pairs, "p")
    ids = anchors.select(F.col("rk").alias("a"), F.col("id").alias("anchor_id"))
    return out.join(ids, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of each hundredth vector, after every seventh label has moved on by one: see op12_negatives."""
    moved = F.when(embeddings["vec_id"] % 7 == 0, F.pmod(embeddings["label"].cast("long") + 1, F.lit(10))).otherwise(embeddings["label"].cast("long"))
    rows = usable(embeddings.select(embeddings["vec_id"].alias("vec_id"), embeddings["embedding"].alias("embedding"), moved.alias("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)
