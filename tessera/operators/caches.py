"""A cache with a time to live and a bounded number of entries, as a fold over requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Entries:
    """The entries of one cache: keys and when they were stored.

    A hit leaves an entry as old as it was. A miss stores the key anew, and where there are more than `most` entries then, the one
    stored longest ago goes.
    """

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most, self.stored = ttl, most, {}

    def asks(self, key: str, at: int) -> tuple[bool, str | None]:
        """Whether the key is found, and the key that had to go."""
        if key in self.stored:
            if at - self.stored[key] < self.ttl:
                return True, None
            del self.stored[key]
        self.stored[key] = at
        if len(self.stored) <= self.most:
            return False, None
        gone = min(self.stored, key=self.stored.get)
        del self.stored[gone]
        return False, gone


def cached(requests: DataFrame, cache: str, key: str, at: str, order: str, ttl_us: int, most: int = 100) -> DataFrame:
    """The columns cache, order, at and key of every request, with hit, and evicted: the key that the request put out.

    Requests of one cache come in the order of `at`, then of `order`. Its entries are dead after a pause of ttl_us microseconds, and
    what is dead only ever makes room: so a cache's requests are cut at such pauses, and each part is folded by itself, row by
    row, with no more than `most` entries in memory. evicted doesn't name entries from before a pause. Null keys are a key.
    """
    kinds = dict(requests.dtypes)
    rows = requests.select(F.col(cache).alias("c"), F.col(order).alias("o"), F.col(at).alias("t"), F.col(key).cast("string").alias("k"), F.expr(f"unix_micros(cast(`{at}` as timestamp))").alias("us"))
    each = Window.partitionBy("c").orderBy("us", "o")
    pause = F.coalesce((F.col("us") - F.lag("us").over(each) >= ttl_us).cast("int"), F.lit(0))
    parts = rows.withColumn("part", F.sum(pause).over(each.rowsBetween(Window.unboundedPreceding, 0))) if ttl_us > 0 else rows.withColumn("part", F.col("o"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, entries = None, Entries(ttl_us, most)
        for b in batches:
            hits, gone = [], []
            for c, part, k, us in zip(b["c"], b["part"], b["k"], b["us"], strict=True):
                if (c, part) != here:
                    here, entries = (c, part), Entries(ttl_us, most)
                k = None if pd.isna(k) else k
                hit, out = entries.asks("null" if k is None else f"={k}", us)
                hits.append(hit)
                gone.append(None if out in (None, "null") else out[1:])
            yield b[["c", "o", "t", "k"]].assign(hit=hits, evicted=gone)

    ready = parts.repartition("c", "part").sortWithinPartitions("c", "part", "us", "o").select("c", "part", "us", "o", "t", "k")
    out = ready.mapInPandas(run, f"c {kinds[cache]}, o {kinds[order]}, t {kinds[at]}, k string, hit boolean, evicted string")
    return out.select(F.col("c").alias(cache), F.col("o").alias(order), F.col("t").alias(at), F.col("k").alias(key), "hit", "evicted")
