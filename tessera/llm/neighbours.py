"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation (three times: random signs, then a fast Hadamard transform) and goes to its
nearest signed axis. Several such axes, the last one among the first few components only, make the code of a bucket, so
their number grows with the rows (see Plan). Each table has rotations of its own; every row is in one bucket of every
table. A query probes the buckets whose axes are nearest to it, and what it finds there is ranked by the exact distance.

How many buckets must be probed for a recall of TARGET is measured: the neighbours of at most SAMPLE queries are found
exactly, and the rank at which a query would have probed a neighbour's bucket is known for each of them. Buckets become
coarser until that takes MOST_PROBES at most; with one bucket the search is exact.

A code begins with its group. Only groups are shuffled: a row once in each table, a query once in each group that it
probes, with the codes to look into there. A group with more than BLOCK rows or queries is split into blocks of either.
Vectors that many rows share are searched, and searched for, once. Queries that find fewer than k rows although there are
more search all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bitmap, column, in_bitmap, longs, mixed, written

TABLES = 3
#: Share of the sampled queries' neighbours that probing must reach; queries in that sample.
TARGET, SAMPLE = 0.97, 64
MOST_PROBES = 4096
#: Rows that a bucket and a group have on average.
BUCKET, GROUP = 16, 2048
#: Rows, and queries, of a group that one task compares.
BLOCK = 8192
_AT_ONCE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; rows have a power of two of components."""
    rows, n, h = len(x), x.shape[1], 1
    while h < n:
        y = x.reshape(rows, -1, 2, h)
        x = np.concatenate((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=-1).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def padded(size: int) -> int:
    return 1 << max(1, (size - 1).bit_length())


def turned(x: np.ndarray, turn: int) -> np.ndarray:
    """Rows after a pseudo-rotation, filled up with zeros to a power of two of components."""
    n = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for k in range(3):
        signs = mixed(np.arange(n, dtype=U64) + U64((turn * 3 + k + 1) * 1_000_003)) >> U64(63)
        x = hadamard(x * (1.0 - 2.0 * signs.astype(float)))
    return x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(n: float, size: int) -> list[int]:
    """Components among whose signed axes each part of a code chooses, for about n codes."""
    out = []
    while n >= 2:
        out.append(min(size, 1 << int(np.log2(n)) >> 1))
        n /= 2 * out[-1]
    return out


@dataclass
class Plan:
    """groups and inner: the parts of a code that name the group, and those within it; probes: codes that a query looks into, per table."""

    groups: list[int]
    inner: list[int]
    probes: int = 1

    @property
    def n_inner(self) -> int:
        return int(np.prod([2 * p for p in self.inner], dtype=np.int64))

    def scores(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each part the signed axes' values: components, then their negatives."""
        out = []
        for k, size in enumerate(self.groups + self.inner):
            y = turned(x, table * 32 + k)[:, :size]
            out.append(np.concatenate((y, -y), axis=1))
        return out

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(x), dtype=np.int64)
        for s in self.scores(x, table):
            code = code * s.shape[1] + s.argmax(axis=1)
        return code

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """The codes nearest to each row, nearest first; their number is probes, or all.

        Nearness adds over parts, so of each part no more than `probes` axes matter, and the best of a few parts are the
        sums of what is best in them: they are put together part by part, keeping `probes` of them.
        """
        code, loss = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for s in self.scores(x, table):
            more = (s.max(axis=1, keepdims=True) - s) ** 2
            loss = (loss[:, :, None] + more[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * s.shape[1] + np.arange(s.shape[1])).reshape(len(x), -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
            loss, code = np.take_along_axis(loss, best, axis=1), np.take_along_axis(code, best, axis=1)
        return code


def planned(n: int, size: int, asked: np.ndarray, of: np.ndarray, found: np.ndarray, tables: int, target: float = TARGET) -> Plan:
    """The finest plan for n rows by which at most MOST_PROBES codes reach the target: found are neighbours of the rows asked[of]."""
    buckets = n / BUCKET
    while True:
        groups = _axes(min(n / GROUP, buckets), padded(size))
        plan = Plan(groups, _axes(buckets / np.prod([2 * p for p in groups]), padded(size)), MOST_PROBES)
        if not len(found):
            return plan
        rank = np.full((tables, len(found)), MOST_PROBES, dtype=np.int64)
        for t in range(tables):
            hit = plan.probed(asked, t)[of] == plan.codes(found, t)[:, None]
            rank[t] = np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES)
        plan.probes = int(np.sort(rank.min(axis=0))[int(np.ceil(target * len(found))) - 1]) + 1
        if plan.probes <= MOST_PROBES:
            return plan
        buckets /= 4


def matrix(b: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    lists = b.column(b.schema.get_field_index(name))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _sampled(batches: Iterator[pa.RecordBatch], ids: list[int], asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k rows of each batch nearest to each sampled query."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            x, own = matrix(b), longs(b, "id")
            for s, q in enumerate(asked):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                d[own == ids[s]] = np.inf
                best = np.argpartition(d, min(k * (k + 2), len(d)) - 1)[: k * (k + 2)]  # a row comes k + 1 times at most
                best = best[np.lexsort((own[best], d[best]))]
                best = best[np.sort(np.unique(own[best], return_index=True)[1])][:k]
                best = best[np.isfinite(d[best])]
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(best), s)), "id": pa.array(own[best]), "d": pa.array(d[best]), "v": column(b, "v").take(pa.array(best))})


def _sizes(batches: Iterator[pa.RecordBatch], plan: Plan, tables: int, asks: bool) -> Iterator[pa.RecordBatch]:
    """How many rows (or queries) of a batch go to each group."""
    for whole in batches:
        for at in range(0, whole.num_rows, _AT_ONCE):
            x = unit(matrix(whole.slice(at, _AT_ONCE)))
            for t in range(tables):
                code = plan.probed(x, t) if asks else plan.codes(x, t)[:, None]
                g = np.concatenate([np.unique(c) for c in code // plan.n_inner])
                grp, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(grp), t, dtype=np.int32)), "grp": pa.array(grp), "n": pa.array(n)})


def _dealt(batches: Iterator[pa.RecordBatch], plan: Plan, tables: int, asks: bool) -> Iterator[pa.RecordBatch]:
    """A row for each table, with its code; a query for each group that it probes, with its codes there."""
    for whole in batches:
        for at in range(0, whole.num_rows, _AT_ONCE):
            b = whole.slice(at, _AT_ONCE)
            x = unit(matrix(b))
            for t in range(tables):
                code = np.sort(plan.probed(x, t) if asks else plan.codes(x, t)[:, None], axis=1)
                row = np.repeat(np.arange(len(x)), code.shape[1])
                grp, inner = code.ravel() // plan.n_inner, code.ravel() % plan.n_inner
                new = np.ones(len(row), dtype=bool)
                new[1:] = (np.diff(row) != 0) | (np.diff(grp) != 0)
                start = np.flatnonzero(new)
                offs = pa.array(np.append(start, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_pydict(
                    {
                        "t": pa.array(np.full(len(start), t, dtype=np.int32)),
                        "grp": pa.array(grp[start]),
                        "asked": pa.array(np.full(len(start), asks)),
                        "id": column(b, "id").take(pa.array(row[start])),
                        "codes": pa.ListArray.from_arrays(offs, pa.array(inner)),
                        "v": column(b, "v").take(pa.array(row[start])),
                    }
                )


def _nearest(k: int):
    """Of a group's rows the k nearest to each of its queries among those with the query's codes (a null list: all); one row an id."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asked = group.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        ids, out = group.column("id").to_numpy(), []
        if asked.any() and not asked.all():
            x, lists = matrix(group), group.column("codes").combine_chunks()
            every = lists.is_null().to_numpy(zero_copy_only=False)
            codes, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            here = np.flatnonzero(~asked)
            of = codes[ends[here] - 1] if len(codes) else np.zeros(len(here), dtype=np.int64)
            o = np.argsort(of, kind="stable")
            rows, own, of = x[here[o]], ids[here[o]], of[o]
            for q in np.flatnonzero(asked).tolist():
                if every[q]:
                    some = np.arange(len(own))
                else:
                    asks = codes[(ends[q - 1] if q else 0) : ends[q]]
                    lo, hi = np.searchsorted(of, asks, "left"), np.searchsorted(of, asks, "right")
                    some = np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
                if not len(some):
                    continue
                d = np.sqrt(((rows[some] - x[q]) ** 2).sum(axis=1))
                o = np.lexsort((own[some], d))
                o = o[np.sort(np.unique(own[some][o], return_index=True)[1])][:k]  # the nearest row of each id
                out.append((np.full(len(o), ids[q]), own[some][o], d[o]))
        q, own, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table({"a": pa.array(q, pa.int64()), "vec_id": pa.array(own, pa.int64()), "score": pa.array(d, pa.float64())})

    return run


_FOUND = "a long, vec_id long, score double"


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each query, each row once."""
    once = found.groupBy(by, "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def _compared(rows: DataFrame, asks: DataFrame, sizes: DataFrame, key: list[str], k: int) -> DataFrame:
    """What the rows and queries with one key find; sizes names the keys to be split: n blocks of rows (rb) and of queries (qb)."""
    both = rows.unionByName(asks).join(sizes, key, "left")
    rb, qb = F.coalesce("rb", F.lit(1)), F.coalesce("qb", F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    copies = F.sequence(F.lit(0), F.when(F.col("asked"), rb).otherwise(qb) - 1)
    both = both.withColumn("copy", F.explode(copies)).withColumn("own", own(F.when(F.col("asked"), qb).otherwise(rb)))
    both = both.select(*key, F.when(F.col("asked"), F.col("copy")).otherwise(F.col("own")).alias("rblock"), F.when(F.col("asked"), F.col("own")).otherwise(F.col("copy")).alias("qblock"), "asked", "id", "codes", "v")
    return both.groupBy(*key, "rblock", "qblock").applyInArrow(_nearest(k), _FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each query by Euclidean distance, ties to smaller vec_id.

    vectors has vec_id and embedding; is_query is a condition on its columns. Null, zero and non-finite vectors, ones with
    a null or non-finite component, of another length than most, or without a vec_id take no part. Rows with one vec_id
    are taken as one if their vectors are equal, and are never neighbours of each other. A query gets k rows, or all
    others where there are fewer. Further columns are left out. No rows give no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    fine = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = fine.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    size = fine.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.where(F.size("v") == size["size"]).withColumn("hv", F.xxhash64("v"))
    kind, n = dict(fine.dtypes)["v"], fine.select("id").distinct().count()

    # vectors of more than k + 1 rows: their k + 1 least ids are enough as neighbours, one query as a query
    common = spark.sparkContext.broadcast(bitmap(fine.groupBy("hv").count().where(F.col("count") > k + 1), "hv"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(in_bitmap(common.value, longs(b, "hv")))], names=[*b.schema.names, "often"])

    fine = fine.mapInArrow(marked, f"id long, v {kind}, asks boolean, hv long, often boolean")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = fine.where("often").select("id", "v").distinct().withColumn("place", first).where(F.col("place") <= k + 1).select("id", "v")
    rows = fine.where("not often").select("id", "v").unionByName(few)
    who = fine.where("asks").select(F.when(F.col("often"), F.col("hv")).otherwise(F.xxhash64("id", "v")).alias("a"), F.col("id").alias("query_id"), "v")
    asks = written(who.groupBy("a").agg(F.min_by("v", "query_id").alias("v"), F.min("query_id").alias("one")).select(F.col("a").alias("id"), "v", "one"), "queries")

    # how far to probe
    sample = asks.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked, ones = matrix(sample), sample.column("one").to_pylist()
    near = rows.mapInArrow(lambda it: _sampled(it, ones, asked, k), f"s long, id long, d double, v {kind}").dropDuplicates(["s", "id"])
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("d", "id"))).where(F.col("place") <= k).select("s", "v").toArrow()
    plan = planned(n, size["size"], unit(asked), near.column("s").to_numpy(), unit(matrix(near)) if near.num_rows else np.zeros((0, size["size"])), tables, target)

    group_sizes = lambda df, asks: df.mapInArrow(lambda it: _sizes(it, plan, tables, asks), "t int, grp long, n long").groupBy("t", "grp").agg(F.sum("n").alias("n"))
    full = group_sizes(rows.select("v"), False).where(F.col("n") > BLOCK).select("t", "grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("rb"))
    many = group_sizes(asks.select("v"), True).where(F.col("n") > BLOCK).select("t", "grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("qb"))
    split = written(full.join(many, ["t", "grp"], "full"), "large-groups")
    schema = f"t int, grp long, asked boolean, id long, codes array<long>, v {kind}"
    deal = lambda df, asks: df.select("id", "v").mapInArrow(lambda it: _dealt(it, plan, tables, asks), schema)
    found = _compared(deal(rows, False), deal(asks, True), split, ["t", "grp"], k + 1)
    best = written(_best(found, "a", k + 1), "nearest")
    others = F.col("vec_id") != F.col("query_id")
    answers = lambda best: _best(best.join(who.select("a", "query_id").distinct(), "a").where(others), "query_id", k)
    out = written(answers(best), "answers")

    # queries that found too few
    enough = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select("query_id")
    short = written(who.join(enough, "query_id", "left_anti"), "short-queries")
    if not short.isEmpty():
        parts = max(1, n // BLOCK)
        asks = short.select("a", "v").dropDuplicates(["a"])
        sizes = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(1).alias("rb"), F.lit(asks.count() // BLOCK + 1).alias("qb"))
        every = lambda df, asked: df.select(F.lit(asked).alias("asked"), "id", F.lit(None).cast("array<long>").alias("codes"), "v")
        here = every(rows, False).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int"))
        there = every(asks.withColumnRenamed("a", "id"), True).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        again = _best(_compared(here, there, sizes, ["part"], k + 1), "a", k + 1)
        exact = _best(again.join(short.select("a", "query_id").distinct(), "a").where(others), "query_id", k)
        out = out.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
