"""Calls that are made again when the other side asks for patience, and texts embedded by such calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import BLANK

#: Attempts, seconds before the second one (doubled each time), and texts of one call.
ATTEMPTS, FIRST_WAIT, BATCH = 3, 2.0, 20


class RateLimited(RuntimeError):
    """The source asks to come back later; other errors aren't tried again."""


def with_retries(call: Callable, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep):
    """What call gives; where it is refused for its rate, again after waits that double, and its last refusal after so many attempts."""
    for k in range(attempts):
        try:
            return call()
        except RateLimited:
            if k == attempts - 1:
                raise
            sleep(first_wait * 2**k)


def embedded(texts: list[str], embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> list[list[float] | None]:
    """A vector for each text, by calls of up to `batch` texts; blank texts aren't sent, and have none."""
    some = [k for k, x in enumerate(texts) if x and x.strip(BLANK)]
    out: list[list[float] | None] = [None] * len(texts)
    for lo in range(0, len(some), batch):
        part = some[lo : lo + batch]
        got = with_retries(lambda part=part: embed([texts[k] for k in part]), attempts, first_wait)
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        for k, v in zip(part, got, strict=True):
            out[k] = v
    return out


def fetched(requests: DataFrame, key: str, fetch: Callable[[object], str], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> DataFrame:
    """key, body and error of each request: fetch(key) in the tasks, with retries. What fails in the end is a row with its error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["key"]:
                try:
                    rows.append((k, with_retries(lambda k=k: fetch(k), attempts, first_wait), None))
                except Exception as e:
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "body", "error"])

    rows = requests.select(F.col(key).alias("key"))
    return rows.mapInPandas(run, f"key {dict(requests.dtypes)[key]}, body string, error string").withColumnRenamed("key", key)
