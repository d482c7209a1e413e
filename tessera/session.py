"""Session settings that the engine's results rest on, and table access."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName("tessera")
    b = b.master(master) if master else b
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


class Tables:
    """Parquet tables of a folder as attributes: tables.orders. Scans prune columns and push filters down."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def stream(self, name: str, columns: list[str], files: int = 16) -> DataFrame:
        """Columns of a table as a stream of its files, so many a batch. A pattern stands for the path, as a stream takes no single file by its name."""
        schema = getattr(self, name).select(*columns).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{self._folder}/{name}.parque[t]")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share; a folder of our own only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    return f"{found.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table, in the shared folder by default."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df, computed once for all that is written from it inside the block, and let go at its end."""
    try:
        yield df.persist()
    finally:
        df.unpersist()


def timed(page: DataFrame) -> DataFrame:
    """A page's rows, computed now, with elapsed_ms: how long that took. For pages alone, as their rows go through the driver."""
    began = time.perf_counter()
    rows = page.collect()
    ms = int((time.perf_counter() - began) * 1000)
    return page.sparkSession.createDataFrame([(*r, ms) for r in rows], page.schema.add("elapsed_ms", "long"))
