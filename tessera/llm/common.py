"""What the corpus operators share: shared-folder tables, word arrays, hashes, bounded bitmaps."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1
#: Bytes of text that a Python worker turns into arrays at a time.
SLICE_BYTES = 1 << 20
U64 = np.uint64


# ---- tables in the folder that driver and executors share ---------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else the one set; one of our own only on a local master, where all share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_dir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = set_dir.get() if set_dir.isDefined() else tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{what}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_paths: list[str] = []


def forget_written(spark: SparkSession) -> int:
    """Deletes the tables that this driver's operators wrote, for when no result that reads them is wanted any more; returns how many."""
    path, gone = spark._jvm.org.apache.hadoop.fs.Path, 0
    while _paths:
        p = path(_paths.pop())
        gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return gone


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input for each of the partitions that an operator sorts or ranges by itself.
PARTITION_BYTES = 64 << 20


def partitions_for(df: DataFrame) -> int:
    """The session's shuffle partitions, or more where Spark takes df for larger than PARTITION_BYTES for each.

    Spark takes tables whose size it doesn't know for exabytes; for these the session's number holds.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n_partitions(df.sparkSession), size // PARTITION_BYTES if size < 1 << 53 else 0)


# ---- documents ------------------------------------------------------------------------------------


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ord, th, text, and the columns `more` of docs. ord is doc_id (null: after all others); th tells rows of one doc_id apart.

    Rows that are equal in doc_id and text get the same results, so nothing is multiplied by joining on
    (ord, th) with one row a key on the other side. Other columns of docs play no part, whatever their names.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias("ord"),
        F.xxhash64("text").alias("th"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def one_each(rows: DataFrame) -> DataFrame:
    """The rows of keyed() with one of each (ord, th), however often it is repeated.

    Only where rows are repeated at all do texts travel: those rows are reduced to one before the shuffle. What results from a row
    is then joined back to all of its copies.
    """
    again = written(rows.groupBy("ord", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("ord", "th"), "repeated-rows")
    if again.isEmpty():
        return rows
    alone = rows.join(again, ["ord", "th"], "left_anti").select(*rows.columns)
    return alone.union(rows.join(again, ["ord", "th"], "left_semi").dropDuplicates(["ord", "th"]).select(*rows.columns))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of `column`; a single longer text is a piece of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.schema.get_field_index(column)
        sizes = np.nan_to_num(np.asarray(pc.binary_length(b.column(k)).to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
        ends, at, done = np.cumsum(sizes), 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, to - at)
            done, at = int(ends[to - 1]), to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, a space after each: (bytes, start of each, end of each)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), ends - sizes, ends


# ---- hashes -----------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + (SLICE_BYTES >> 2)), base, dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal contents wherever they stand; spans are in order and apart.

    About SLICE_BYTES are worked on at a time, unless one span is longer.
    """
    out, k = np.empty(len(starts), dtype=U64), 0
    while k < len(starts):
        lo = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, side="right")))
        out[k:to] = _span_hashes(data[lo : ends[to - 1]], starts[k:to] - lo, ends[k:to] - lo)
        k = to
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(pow(_BASE, -1, 1 << 64), n + 1)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))


def gram_hashes(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of m consecutive entries of h; len(h) - m + 1 of them."""
    n = len(h) - m + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for k in range(m):
        out *= U64(_BASE)
        out += h[k : k + n]
    return mixed(out)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space; data ends with a space."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_longs(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


# ---- a bounded set of keys --------------------------------------------------------------------------

#: log2 of the bits of a bitmap: 16 MB, whatever the input. Where it fills up, more rows than needed pass; none is lost.
BITMAP_LOG2 = 27


def bitmap(keys: DataFrame, name: str, log2: int = BITMAP_LOG2) -> np.ndarray:
    """A bitmap of 2**log2 bits with the bit of each key (a long column `name`) set.

    It is gathered as at most 2**log2 / 64 pairs of (place, 64 bits), or-ed in the shuffle before: the bound doesn't
    depend on the input. Tests on it may answer yes wrongly, never no.
    """
    slot = F.col(name).bitwiseAND(F.lit((1 << log2) - 1))
    words = keys.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("bits"))
    got = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 6), dtype=U64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(U64) & U64(len(bits) * 64 - 1)
    return ((bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1)).astype(bool)
