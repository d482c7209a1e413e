"""Line dedup within one edit, by a deletion-neighbourhood join.

Two lines are within one edit (a character put in, left out or replaced) just when

* deleting one character of the longer one gives the shorter one, or
* deleting the characters at one and the same place gives the same string.

So each line's variants with one character deleted go out as hashed keys, once as they are (to meet whole lines) and once
with the place (to meet each other). The earliest line of each key is all that a line must meet: a minimum, never pairs. What
meets is verified by its edit distance.

Most lines are within one edit of no other, which halves of lines tell beforehand: of two such lines either the first
halves are equal or the second ones. Only lines that share a half with another emit variants, and only of the other half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_longs, bitmap, column, in_bitmap, keyed, longs, mixed, one_each, powers, sha256_hex, sliced, written

_BASE = 0x9E3779B97F4A7C15 | 1


def _hash(tag: bytes, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=tag).digest(), "little", signed=True)


def half_keys(line: str) -> tuple[int, int, int, int]:
    """Keys of the first and second half, as a line of its length and as the longer of two lines.

    Of two lines of n characters with one replaced, and of a line of n and one of n + 1 characters with one put in, the
    first n // 2 or the last n - n // 2 characters are equal.
    """
    n = len(line)
    a, b = n // 2, (n - 1) // 2
    own, less = n.to_bytes(8, "big"), (n - 1).to_bytes(8, "big")
    return _hash(b"P" + own, line[:a]), _hash(b"S" + own, line[a:]), _hash(b"P" + less, line[:b]), _hash(b"S" + less, line[b + 1 :])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a word."""
    for b in sliced(batches):
        row, no, whole, n, keys = [], [], [], [], []
        for k, text in enumerate(column(b, "text").to_pylist()):
            for j, line in enumerate(text.split("\n")):
                data = line.encode("utf-8", "surrogatepass")
                if data.split():
                    row.append(k)
                    no.append(j)
                    whole.append(hashlib.blake2b(data, digest_size=16).digest())
                    n.append(len(line))
                    keys.append(half_keys(line))
        ids = np.frombuffer(b"".join(whole), dtype=np.int64).reshape(-1, 2)
        at = np.array(row, dtype=np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "h": pa.array(ids[:, 0]),
                "g": pa.array(ids[:, 1]),
                "ord": pa.array(longs(b, "ord")[at]),
                "no": pa.array(no, pa.int64()),
                "th": pa.array(longs(b, "th")[at]),
                "keys": pa.array(keys, pa.list_(pa.int64())),
            }
        )


def place_hash(ord_: np.ndarray, no: np.ndarray, th: np.ndarray) -> np.ndarray:
    return mixed(mixed(ord_.astype(np.int64).view(U64) + U64(1)) + mixed(no.astype(np.int64).view(U64) + U64(2)) * U64(3) + th.astype(np.int64).view(U64))


def _sharing(batches: Iterator[pa.RecordBatch], halves: Broadcast) -> Iterator[pa.RecordBatch]:
    """Places of the lines (earliest of equals) that share a half."""
    for b in batches:
        k = np.flatnonzero(in_bitmap(halves.value, column(b, "keys").flatten().to_numpy()).reshape(-1, 4).any(axis=1))
        yield pa.RecordBatch.from_pydict({"place": pa.array(as_longs(place_hash(longs(b, "ord")[k], longs(b, "no")[k], longs(b, "th")[k])))})


def _candidates(batches: Iterator[pa.RecordBatch], places: Broadcast, halves: Broadcast) -> Iterator[pa.RecordBatch]:
    """The texts of those lines, and which part of them may hold the edit."""
    for b in sliced(batches):
        ord_, th = longs(b, "ord"), longs(b, "th")
        row, no, lines = [], [], []
        for k, text in enumerate(column(b, "text").to_pylist()):
            for j, line in enumerate(text.split("\n")):
                row.append(k)
                no.append(j)
                lines.append(line)
        at, j = np.array(row, dtype=np.int64), np.array(no, dtype=np.int64)
        keep = np.flatnonzero(in_bitmap(places.value, place_hash(ord_[at], j, th[at]))) if len(at) else at
        # a full bitmap also lets in lines without a word, which _lines has passed over
        keep = np.array([k for k in keep.tolist() if lines[k].encode("utf-8", "surrogatepass").split()], dtype=np.int64)
        if not len(keep):
            continue
        texts = [lines[k] for k in keep.tolist()]
        hit = in_bitmap(halves.value, np.array([half_keys(x) for x in texts], dtype=np.int64).ravel()).reshape(-1, 4)
        yield pa.RecordBatch.from_pydict(
            {
                "ord": pa.array(ord_[at[keep]]),
                "no": pa.array(j[keep]),
                "th": pa.array(th[at[keep]]),
                "line": pa.array(texts, pa.string()),
                "late": pa.array(hit[:, 0] | hit[:, 2]),
                "early": pa.array(hit[:, 1] | hit[:, 3]),
            }
        )


def variant_keys(line: str, early: bool, late: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Hashes of the line, of it without each character of the parts in question, and of the latter with the place."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64) + U64(1)
    n = len(c)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(c * powers(_BASE, n), out=sums[1:])
    i = np.arange(0 if early else max(0, n // 2 - 1), n if late else min(n, n // 2 + 1))
    less = sums[i] + (sums[n] - sums[i + 1]) * U64(pow(_BASE, -1, 1 << 64))
    cut = mixed(less + U64(n - 1))
    return int(mixed(sums[n:] + U64(n)).view(np.int64)[0]), as_longs(cut), as_longs(mixed(cut + (i + 1).astype(U64) * U64(0xD6E8FEB86659FD93)))


WHOLE, CUT, PLACED = 0, 1, 2


def _variants(batches: Iterator[pa.RecordBatch], wanted: Broadcast | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            key, kind, row = [], [], []
            for k, (line, early, late) in enumerate(zip(column(part, "line").to_pylist(), column(part, "early").to_pylist(), column(part, "late").to_pylist(), strict=True)):
                whole, cut, placed = variant_keys(line, early, late)
                key += [np.array([whole]), np.unique(cut), placed]
                kind.append(np.repeat([WHOLE, CUT, PLACED], [1, len(key[-2]), len(placed)]))
                row.append(np.full(len(kind[-1]), k))
            keys, kinds, at_ = np.concatenate(key), np.concatenate(kind), np.concatenate(row)
            if wanted is not None:
                hit = in_bitmap(wanted.value, keys)
                keys, kinds, at_ = keys[hit], kinds[hit], at_[hit]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "kind": pa.array(kinds.astype(np.int32)), **{x: pa.array(longs(part, x)[at_]) for x in ("ord", "no", "th")}})


def near_lines(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """ord, no, th: lines, each the earliest of its equals, that are one edit from an earlier line."""
    spark = rows.sparkSession
    halves = classes.select("h", F.explode("keys").alias("key")).groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y")
    half_bits = spark.sparkContext.broadcast(bitmap(halves, "key"))
    places = classes.select("ord", "no", "th", "keys").mapInArrow(lambda it: _sharing(it, half_bits), "place long")
    place_bits = spark.sparkContext.broadcast(bitmap(places, "place"))
    cands = written(rows.mapInArrow(lambda it: _candidates(it, place_bits, half_bits), "ord long, no long, th long, line string, late boolean, early boolean"), "line-candidates")
    for bits in (half_bits, place_bits):  # each lies on the disks of all workers
        bits.destroy()
    schema = "key long, kind int, ord long, no long, th long"
    place = F.struct("ord", "no", "th")
    met = cands.mapInArrow(lambda it: _variants(it, None), schema).groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    met_bits = spark.sparkContext.broadcast(bitmap(met, "key"))
    variants = written(cands.mapInArrow(lambda it: _variants(it, met_bits), schema), "line-variants")
    met_bits.destroy()
    at = variants.withColumn("place", place)
    first = at.groupBy("key").agg(*[F.min(F.when(F.col("kind") == kind, F.col("place"))).alias(f"first{kind}") for kind in (WHOLE, CUT, PLACED)])
    both = at.join(written(first, "line-firsts"), "key")
    earlier = F.when(F.col("kind") == WHOLE, F.col(f"first{CUT}")).when(F.col("kind") == CUT, F.col(f"first{WHOLE}")).otherwise(F.col(f"first{PLACED}"))
    pairs = both.select("ord", "no", "th", earlier.alias("m")).where("m < struct(ord, no, th)").distinct()
    mine, theirs = cands.select("ord", "no", "th", "line"), cands.select(F.col("ord").alias("m_ord"), F.col("no").alias("m_no"), F.col("th").alias("m_th"), F.col("line").alias("m_line"))
    pairs = pairs.select("ord", "no", "th", F.col("m.ord").alias("m_ord"), F.col("m.no").alias("m_no"), F.col("m.th").alias("m_th"))
    checked = pairs.join(mine, ["ord", "no", "th"]).join(theirs, ["m_ord", "m_no", "m_th"]).where(F.levenshtein("line", "m_line", 1) >= 0)
    return checked.select("ord", "no", "th").distinct()


def _kept(batches: Iterator[pa.RecordBatch], more: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        n, gone, kept = [], [], []
        for text, out in zip(column(b, "text").to_pylist(), column(b, "gone").to_pylist(), strict=True):
            lines, drop = text.split("\n"), set(out or ())
            n.append(sum(1 for x in lines if x.encode("utf-8", "surrogatepass").split()))
            gone.append(len(drop))
            kept.append("\n".join(x for j, x in enumerate(lines) if j not in drop) if drop else text)
        yield pa.RecordBatch.from_pydict(
            {
                **{x: column(b, x) for x in ("doc_id", "ord", "th", *more)},
                "n_lines": pa.array(n, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array([sha256_hex(x.encode("utf-8", "surrogatepass")) for x in kept], pa.string()),
                "kept": pa.array(kept, pa.string()),
            }
        )


def dedup_lines(docs: DataFrame, *more: str) -> DataFrame:
    """Per row of docs: doc_id, ord, th (see keyed), the columns `more`, n_lines, n_removed, kept_sha256, kept.

    Lines are what \\n separates; n_lines counts those with a word, and only those are ever removed. A line goes if an
    earlier line (smaller doc_id, or before it in its document) equals it or is within one edit of it, a character being a
    code point; whether that line goes itself makes no difference. kept is what stays,
    joined by \\n. Null text counts as empty. Null doc_ids come after all others. Rows with equal doc_ids and different
    texts come in the order of a hash of their texts, line by line; equal rows are looked at once and get equal results. All other columns are left out.
    """
    rows = one_each(keyed(docs))
    lines = written(rows.mapInArrow(lambda it: _lines(it), "h long, g long, ord long, no long, th long, keys array<long>"), "lines")
    place = F.struct("ord", "no", "th")
    classes = lines.groupBy("h", "g").agg(F.min(place).alias("m"), F.first("keys").alias("keys"))
    classes = written(classes.select("h", "g", "m.ord", "m.no", "m.th", "keys"), "line-classes")
    first = classes.select("h", "g", F.struct("ord", "no", "th").alias("m"))
    equal = lines.select("h", "g", "ord", "no", "th").join(first, ["h", "g"]).where("struct(ord, no, th) <> m").select("ord", "no", "th")
    gone = equal.union(near_lines(rows, classes)).groupBy("ord", "th").agg(F.collect_list("no").alias("gone"))
    both = keyed(docs, *more).join(gone.hint("shuffle_hash"), ["ord", "th"], "left")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, ord long, th long, " + "".join(f"`{c}` {kinds[c]}, " for c in more) + "n_lines long, n_removed long, kept_sha256 string, kept string"
    return both.select("doc_id", "ord", "th", *more, "text", "gone").mapInArrow(lambda it: _kept(it, more), schema)
