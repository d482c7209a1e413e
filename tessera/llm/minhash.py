"""Near-duplicates by min-max hashing: exact links at a similarity of 3/4, and their components.

A document's set is that of its five-word shingles. Each permutation (a multiply-and-add of the shingles' hashes) gives
two values, its minimum and its maximum, so half as many are evaluated; each equals another set's with the sets'
similarity as its probability. Four values (two permutations) make a band, 48 bands a signature: two sets with a
similarity of 3/4 miss each other in all bands with a probability of about 1e-8 (1e-6 for sets of a few shingles).

Documents with equal sets are one node (their hashes of 128 bits are equal). Links are confirmed on full sets, and only as
many are looked for as components need, never all pairs of a bucket:

1. Each bucket's members are compared with one of them, another one in each band. Confirmed links are contracted.
2. Buckets that still hold several components may hide links. The sets of their members are joined exactly, by prefix
   filtering: two sets at 3/4 share one of each other's rarest shingles (a quarter of them and one), so common passages
   meet only where they make up three quarters of a text. Of a shingle's members those outside its largest component are
   compared with the others, in blocks, so no task gets a whole bucket. Only pairs that a sketch of their sets leaves
   possible come out of that join (see parities; no link is lost by it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_LONG, U64, as_longs, bitmap, column, gram_hashes, in_bitmap, joined_bytes, keyed, longs, mixed, one_each, sliced, span_hashes, word_spans, written
from .components import components

SHINGLE = 5
BANDS = 48
#: Members of a bucket that one task compares with what is outside its largest component.
BLOCK = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct shingles, sorted, one text after the other; a text under five words has one, of all."""
    data, starts, _ = joined_bytes(texts)
    data = _LOWER[data]
    ws, we = word_spans(data)
    h = span_hashes(data, ws, we)
    first = np.searchsorted(ws, starts)
    n_words = np.diff(np.append(first, len(ws)))
    doc = np.repeat(np.arange(len(texts)), n_words)
    grams = gram_hashes(h, SHINGLE)
    valid = doc[: len(grams)] == doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    of, vals = [doc[: len(grams)][valid]], [grams[valid]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n_words == k)
        if len(short):
            of.append(short)
            vals.append(mixed(gram_hashes(h, k)[first[short]] + U64(k)))
    doc, vals = np.concatenate(of), np.concatenate(vals)
    o = np.lexsort((vals, doc))
    doc, vals = doc[o], vals[o]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (np.diff(doc) != 0) | (vals[1:] != vals[:-1])
    return vals[new], np.bincount(doc[new], minlength=len(texts))


def set_hashes(vals: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set that isn't empty, 128 bits together."""
    offs = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(offs):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=U64)
    one = mixed(np.add.reduceat(mixed(vals), offs) + sizes[sizes > 0].astype(U64))
    return one, mixed(np.add.reduceat(mixed(vals + U64(7)), offs) + U64(5))


def band_keys(vals: np.ndarray, sizes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """For each set that isn't empty its bands' keys, a row of `bands`."""
    offs = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(offs):
        return np.zeros((0, bands), dtype=U64)
    a, b = _constants(2 * bands, 1) | U64(1), _constants(2 * bands, 2)
    c = _constants(4, 3) | U64(1)
    out = np.empty((len(offs), bands), dtype=U64)
    for j in range(bands):
        key = np.full(len(offs), j, dtype=U64)
        for k in (0, 1):
            x = vals * a[2 * j + k] + b[2 * j + k]
            key = mixed(key + np.minimum.reduceat(x, offs) * c[2 * k] + np.maximum.reduceat(x, offs) * c[2 * k + 1])
        out[:, j] = key
    return out


def _signed(batches: Iterator[pa.RecordBatch], hashes=set_hashes) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        vals, sizes = shingle_sets(column(b, "text").cast(pa.binary()).to_pylist())
        bands, some = band_keys(vals, sizes), sizes > 0
        ids = np.zeros((2, len(sizes)), dtype=np.int64)
        ids[:, some] = [as_longs(x) for x in hashes(vals, sizes)]
        offs = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": column(b, "doc_id"),
                "ord": column(b, "ord"),
                "th": column(b, "th"),
                "rk": column(b, "rk"),
                "n": pa.array(sizes, pa.int64()),
                "sid": pa.array(ids[0], mask=~some),
                "check": pa.array(ids[1], mask=~some),
                "bands": pa.ListArray.from_arrays(pa.array(offs), pa.array(as_longs(bands.ravel()))),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch], wanted: Broadcast, hashes=set_hashes) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        keep = np.flatnonzero(in_bitmap(wanted.value, longs(b, "rk")))
        if not len(keep):
            continue
        texts = column(b, "text").cast(pa.binary()).take(pa.array(keep)).to_pylist()
        vals, sizes = shingle_sets(texts)
        sid, check = hashes(vals, sizes)
        some = np.flatnonzero(sizes > 0)
        offs = np.concatenate(([0], np.cumsum(sizes[some]))).astype(np.int32)
        par = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * SKETCH), pa.array(parities(vals, sizes[some]).ravel()))
        yield pa.RecordBatch.from_pydict({"sid": pa.array(as_longs(sid)), "check": pa.array(as_longs(check)), "rk": pa.array(longs(b, "rk")[keep[some]]), "set": pa.ListArray.from_arrays(pa.array(offs), pa.array(as_longs(vals))), "par": par})


#: Longs of a parity sketch.
SKETCH = 16


def parities(vals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set (none empty) a bitmap in which each element has turned one bit around.

    Bits that differ between two sets' sketches are at most as many as elements that only one of them has: a bound that
    holds always, on what is left of the similarity.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mixed(vals + U64(99)) & U64(SKETCH * 64 - 1)).astype(np.int64)
    odd = np.bincount(row * (SKETCH * 64) + bit, minlength=len(sizes) * SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(-1, SKETCH)


def _possible() -> Column:
    """Whether sets of sizes n and l_n with sketches par and l_par may be at 3/4: then at most a seventh of their sizes is not shared."""
    differ = " + ".join(f"bit_count(par[{k}] ^ l_par[{k}])" for k in range(SKETCH))
    return F.expr(f"4 * least(n, l_n) >= 3 * greatest(n, l_n) and 7 * ({differ}) <= n + l_n")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (x, y), with the rows that stand for their sets (x_rk, y_rk), those whose full sets have a similarity of 3/4 or more."""
    left = sets.select(F.col("sid").alias("y"), F.col("rk").alias("y_rk"), F.col("set").alias("t"))
    right = sets.select(F.col("sid").alias("x"), F.col("rk").alias("x_rk"), F.col("set").alias("s"))
    both = pairs.join(left, ["y", "y_rk"]).join(right, ["x", "x_rk"]).withColumn("i", F.size(F.array_intersect("s", "t")))
    return both.where("100 * i >= 75 * (size(s) + size(t) - i)").select("x", "y")


def _in_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (bk, sid, n, ...) of the buckets with more than one component.

    To each: its component, and the bucket's members (c), the component with most of them (major), and how many others (strays).
    """
    there = _in_components(members, labels)
    by = there.groupBy("bk", "comp").agg(F.count(F.lit(1)).alias("m"))
    top = F.max(F.struct("m", "comp")).alias("top")
    buckets = by.groupBy("bk").agg(F.sum("m").alias("c"), top, F.count(F.lit(1)).alias("k")).where("k > 1")
    buckets = written(buckets.select("bk", "c", F.col("top.comp").alias("major"), (F.col("c") - F.col("top.m")).alias("strays")), "open")
    return written(there.join(buckets, "bk"), "there")


#: Slots (log2) in which shingles are counted: 4 MB of logarithms, whatever the input.
SLOTS_LOG2 = 22


def _slot(vals: np.ndarray) -> np.ndarray:
    return (vals & U64((1 << SLOTS_LOG2) - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a batch have the shingles of each slot."""
    for b in batches:
        slot, n = np.unique(_slot(column(b, "set").flatten().to_numpy().view(U64)), return_counts=True)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "n": pa.array(n)})


def prefix_size(n: int) -> int:
    """So many of a set's first shingles, in any order common to all, that it shares one of them with any set at 3/4."""
    return n - (3 * n + 3) // 4 + 1


def _first(batches: Iterator[pa.RecordBatch], logs: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each set the first shingles, rarest first, without those that no other set has; sets that have none left go."""
    for b in batches:
        rows = []
        for sid, rk, vals in zip(column(b, "sid").to_pylist(), column(b, "rk").to_pylist(), column(b, "set"), strict=True):
            v = vals.values.to_numpy().view(U64)
            rarity = logs.value[_slot(v)]
            alone = int((rarity == 0).sum())
            if (takes := prefix_size(len(v)) - alone) > 0:
                some = v[rarity > 0]
                rows.append((sid, rk, len(v), alone, as_longs(some[np.lexsort((some, rarity[rarity > 0]))[:takes]])))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sid", "rk", "n", "alone", "keys"])


def _prefixes(sets: DataFrame) -> DataFrame:
    """bk (a shingle), sid, rk, n, left: of each set the rarest shingles that another of these sets may have, as far as its prefix goes.

    left is how many of the set's shingles come from this one on, in the order common to all.

    Rarity is read from a table of counts of fixed size; shingles that share a slot count together, which costs some
    order but no result.
    """
    counts = sets.select("set").mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    logs = counts.where("n > 1").select(F.col("slot").cast("int").alias("slot"), F.ceil(F.log2("n")).cast("byte").alias("log")).toArrow()
    table = np.zeros(1 << SLOTS_LOG2, dtype=np.uint8)
    table[logs.column("slot").to_numpy()] = logs.column("log").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)
    first = sets.select("sid", "rk", "set").mapInArrow(lambda it: _first(it, shared), "sid long, rk long, n long, alone long, keys array<long>")
    return first.select("sid", "rk", "n", "alone", F.posexplode("keys").alias("k", "bk")).select("bk", "sid", "rk", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("left"))


def _bands(batches: Iterator[pa.RecordBatch], reps: Broadcast, several: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """bk (and with several: sid, rk, n) of the bands of representatives, with several only those whose key is in it."""
    for b in batches:
        some = np.flatnonzero(in_bitmap(reps.value, longs(b, "rk")) & (longs(b, "n") > 0))
        if not len(some):
            continue
        keys, row = column(b, "bands").take(pa.array(some)).flatten().to_numpy(), np.repeat(some, BANDS)
        if several is None:
            yield pa.RecordBatch.from_pydict({"bk": pa.array(keys)})
            continue
        hit = in_bitmap(several.value, keys)
        yield pa.RecordBatch.from_pydict({"bk": pa.array(keys[hit]), **{c: column(b, c).take(pa.array(row[hit])) for c in ("sid", "rk", "n")}})


def near_duplicates(docs: DataFrame, hashes=set_hashes) -> DataFrame:
    """Per row of docs: doc_id, ord, th (see keyed), n_shingles, component_id, kept.

    component_id is the smallest doc_id that confirmed links reach, its own included; kept tells whether it is the row's
    own. Rows without words (null text included) have no shingles and are linked with nothing. Null doc_ids come after
    all others: such a row's component_id is null unless it reaches a row with one, and kept is true if it doesn't. Rows
    with equal doc_ids are judged by their texts. Ties don't arise: a link is a fact of two sets, tested on 64-bit hashes
    of shingles. Further columns of docs are left out.
    """
    spark = docs.sparkSession
    every = keyed(docs)
    unique = one_each(every)
    rows = unique.withColumn("rk", F.xxhash64("ord", "th"))
    signed = written(rows.mapInArrow(lambda it: _signed(it, hashes), "doc_id long, ord long, th long, rk long, n long, sid long, check long, bands array<long>"), "signatures")
    # sets that differ and yet share sid, if there are any, get another one each; a table of next to no rows, whose size Spark checks
    shared = signed.where("n > 0").groupBy("sid").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("sid", F.lit(True).alias("shared"))
    shared = written(shared, "shared-hashes")
    apart = lambda df: df.join(shared, "sid", "left").withColumn("sid", F.when(F.col("shared"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))).drop("shared", "check")
    signed = apart(signed)
    nodes = signed.where("n > 0").groupBy("sid").agg(F.min(F.struct("ord", "rk")).alias("m"))
    nodes = written(nodes.select("sid", "m.ord", "m.rk"), "nodes")
    share = lambda keys, name: spark.sparkContext.broadcast(bitmap(keys, name))

    # 1: each bucket's members against one
    reps = share(nodes, "rk")
    keys = signed.select("rk", "n", "bands").mapInArrow(lambda it: _bands(it, reps, None), "bk long")
    several = share(keys.groupBy("bk").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "bk")
    members = written(signed.select("rk", "sid", "n", "bands").mapInArrow(lambda it: _bands(it, reps, several), "bk long, sid long, rk long, n long").distinct(), "members")
    for bits in (reps, several):  # each lies on the disks of all workers
        bits.destroy()
    lead = F.min(F.struct(F.xxhash64("sid", "bk").alias("o"), "sid", "n", "rk")).alias("l")
    leads = members.groupBy("bk").agg(lead, F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y")
    leads = written(leads.select("bk", F.col("l.sid").alias("l_sid"), F.col("l.n").alias("l_n"), F.col("l.rk").alias("l_rk")), "buckets")
    members = written(members.join(leads, "bk"), "members")
    wanted = share(members, "rk")
    sets = written(apart(rows.mapInArrow(lambda it: _sets(it, wanted, hashes), "sid long, check long, rk long, set array<long>, par array<long>")), "sets")
    wanted.destroy()
    # a full bitmap lets in further rows; what meets a set must be the row that stands for it
    sketch = sets.select("sid", "rk", "par")
    theirs = sketch.select(F.col("sid").alias("l_sid"), F.col("rk").alias("l_rk"), F.col("par").alias("l_par"))
    pairs = members.where("sid <> l_sid and 4 * least(n, l_n) >= 3 * greatest(n, l_n)").select("sid", "rk", "l_sid", "l_rk", "n", "l_n").distinct()
    pairs = pairs.join(theirs, ["l_sid", "l_rk"]).join(sketch, ["sid", "rk"]).where(_possible()).select(F.col("sid").alias("x"), F.col("rk").alias("x_rk"), F.col("l_sid").alias("y"), F.col("l_rk").alias("y_rk"))
    links = written(_links(pairs, sets), "links")
    labels = components(links)

    # 2: the other pairs of different components, by shared rare shingles
    rest = written(_open(members.where("sid <> l_sid").select("bk", "sid", "rk", "n"), labels).select("sid", "rk").distinct(), "rest")
    them = written(sets.join(rest, ["sid", "rk"], "left_semi"), "open-sets")
    there = written(_open(written(_prefixes(them), "prefixes"), labels).join(sketch, ["sid", "rk"]), "there")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    there = there.withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    stray = there.where("comp <> major").withColumn("r_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    stray = stray.select(F.col("bk").alias("r_bk"), "r_block", *[F.col(c).alias(f"l_{c}") for c in ("sid", "rk", "n", "comp", "par", "left")])
    # sets at 3/4 meet at the first shingle that they share; from there on at least 3/7 of both sizes are left in either
    once = F.expr("bk = r_bk and block = r_block and comp <> l_comp and (comp = major or sid < l_sid) and 7 * least(left, l_left) >= 3 * (n + l_n)")
    ends = F.array_sort(F.array(F.struct("sid", "rk"), F.struct(F.col("l_sid").alias("sid"), F.col("l_rk").alias("rk"))))
    pairs = there.join(stray, once & _possible()).select(ends.alias("e")).select(*[F.col("e")[k][c].alias(n) for k, c, n in ((0, "sid", "x"), (0, "rk", "x_rk"), (1, "sid", "y"), (1, "rk", "y_rk"))]).distinct()
    labels = components(links.union(written(_links(pairs, sets), "links")))

    # component of every node, then of every row
    placed = _in_components(nodes.select("sid", "ord"), labels)
    least = written(placed.groupBy("comp").agg(F.min("ord").alias("least")), "least")
    of_node = written(placed.join(least, "comp").select("sid", "least"), "components")
    out = signed.drop("bands").join(of_node, "sid", "left")
    if unique is not every:  # back to all copies of a row
        out = every.select("doc_id", "ord", "th").join(out.drop("doc_id"), ["ord", "th"])
    component = F.when(F.col("least").isNull(), F.col("doc_id")).when(F.col("least") == MAX_LONG, F.lit(None)).otherwise(F.col("least"))
    return out.select("doc_id", "ord", "th", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
