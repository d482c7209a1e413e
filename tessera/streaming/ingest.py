"""Background ingestion: uploads come as a stream of files, each micro-batch is processed once, and statuses and counters follow.

A store is a folder with four tables, each in folders by batch id:

* begun: the documents of a batch, written before anything is processed;
* rows: the chunks of a batch, and a row for each of its documents with its outcome;
* counters: what a batch adds to each knowledge base;
* done: one file of one row, written last. Only batches that are done are read.

Every folder is overwritten as a whole, so a batch that fails anywhere is made again under its id by the restarted stream, from
the same files, and what the first attempt left behind is replaced. A batch that is done isn't made again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.batches import packed, rows_of
from tessera.functions.text import clean_text, token_estimate
from tessera.operators.chunks import spans
from tessera.sources.retries import embedded

ROWS = "doc_id long, kb string, chunk_index int, start_char int, end_char int, content string, embedding array<float>, content_hash string, chunk_count int, status string, error string"
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
ARROW = pa.schema({"doc_id": pa.int64(), "kb": pa.string(), "chunk_index": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "content": pa.string(), "embedding": pa.list_(pa.float32()), "content_hash": pa.string(), "chunk_count": pa.int32(), "status": pa.string(), "error": pa.string()})


def _outcomes(batches: Iterable[pa.RecordBatch], embed: Callable[[list[str]], list[list[float]]] | None, first_wait: float) -> Iterator[pa.RecordBatch]:
    """ROWS of uploads with cleaned texts. Rows of many documents are handed on together, as a table for each costs more than its chunks."""

    def of_one(doc_id: int, kb: str, text: str | None, size: int, overlap: int) -> list[tuple]:
        end = lambda n, status, error=None, digest=None: (doc_id, kb, None, None, None, None, None, digest, n, status, error)
        if not text:
            return [end(0, FAILED, "empty document")]
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        try:
            if not 100 <= size <= 2000 or not 0 <= overlap <= 500:
                raise ValueError("chunk size must be from 100 to 2000, overlap from 0 to 500")
            cut = [(s, e, text[s:e]) for s, e in spans(text, size, overlap)]
            vectors = embedded([x for _, _, x in cut], embed, first_wait=first_wait) if embed else [None] * len(cut)
        except Exception as e:  # any fault of one document is its own
            return [end(0, FAILED, f"{type(e).__name__}: {e}", digest)]
        if not cut:
            return [end(0, FAILED, "no chunks", digest)]
        return [(doc_id, kb, i, s, e, x, v, None, None, None, None) for i, ((s, e, x), v) in enumerate(zip(cut, vectors, strict=True))] + [end(len(cut), COMPLETED, None, digest)]

    return packed((row for b in batches for upload in rows_of(b) for row in of_one(*upload)), ARROW)


def processed(uploads: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, first_wait: float = 2.0) -> DataFrame:
    """ROWS of uploads (doc_id, kb, text, chunk_size, chunk_overlap): each document's chunks, then its outcome.

    A text that is empty when cleaned fails, as does one without chunks and one whose embedding fails; a failed document has no
    chunks. A narrow map over Arrow batches.
    """
    cleaned = uploads.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("kb", "string"))], clean_text(F.col("text")).alias("text"), "chunk_size", "chunk_overlap")
    return cleaned.mapInArrow(lambda it: _outcomes(it, embed, first_wait), ROWS)


@dataclass
class Store:
    """A store under root, a path that driver and executors share."""

    spark: SparkSession
    root: str

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch={batch_id}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, table: str, schema: str) -> DataFrame:
        """A table of all batches, finished or not."""
        if not self._exists(f"{self.root}/{table}"):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")

    def _done(self, table: str, schema: str) -> DataFrame:
        done = self._read("done", "ok boolean").select("batch")
        return self._read(table, schema).join(done, "batch", "left_semi").drop("batch")

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch_id))

    def add(self, uploads: DataFrame, batch_id: int, embed=None, first_wait: float = 2.0) -> None:
        """Processes the uploads of a batch, once."""
        if self._exists(f"{self._path('done', batch_id)}/_SUCCESS"):
            return
        self._write(uploads.select("doc_id"), "begun", batch_id)
        self._write(processed(uploads, embed, first_wait), "rows", batch_id)
        rows = self.spark.read.schema(ROWS).parquet(self._path("rows", batch_id))
        tokens = rows.where("chunk_index is not null").select("kb", F.lit(0).alias("document"), F.lit(1).alias("chunk"), token_estimate(F.col("content")).alias("tokens"))
        documents = rows.where(F.col("status") == COMPLETED).select("kb", F.lit(1).alias("document"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("tokens"))
        added = tokens.union(documents).groupBy("kb").agg(F.sum("document").alias("document_count"), F.sum("chunk").alias("total_chunks"), F.sum("tokens").alias("total_tokens"))
        self._write(added, "counters", batch_id)
        self._write(self.spark.range(1).select(F.lit(True).alias("ok")).coalesce(1), "done", batch_id)

    def chunks(self) -> DataFrame:
        return self._done("rows", ROWS).where("chunk_index is not null").select("doc_id", "kb", "chunk_index", "start_char", "end_char", "content", "embedding")

    def documents(self) -> DataFrame:
        return self._done("rows", ROWS).where("status is not null").select("doc_id", "kb", "status", "error", "chunk_count", "content_hash")

    def counters(self) -> DataFrame:
        """Each knowledge base's documents, chunks and tokens; those without a completed document have no row."""
        added = self._done("counters", "kb string, document_count long, total_chunks long, total_tokens long")
        return added.groupBy("kb").agg(*[F.sum(c).alias(c) for c in ("document_count", "total_chunks", "total_tokens")])

    def statuses(self, uploads: DataFrame) -> DataFrame:
        """doc_id, status and error of every upload: pending before its batch begins, processing until it is done."""
        begun = self._read("begun", "doc_id long").select("doc_id", F.lit(True).alias("begun")).distinct()
        out = uploads.select("doc_id").join(self.documents().select("doc_id", "status", "error"), "doc_id", "left").join(begun, "doc_id", "left")
        status = F.coalesce("status", F.when(F.col("begun"), PROCESSING), F.lit(PENDING))
        return out.select("doc_id", status.alias("status"), "error")


def ingest(uploads: DataFrame, store: Store, checkpoint: str, embed=None, first_wait: float = 2.0, **trigger) -> StreamingQuery:
    """Starts the stream: uploads is a streaming DataFrame (doc_id, kb, text, chunk_size, chunk_overlap); trigger as for DataStreamWriter.trigger, all there is by default."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        store.add(rows, batch_id, embed, first_wait)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def polled(store: Store, uploads: DataFrame, every: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict[str, int]]:
    """How many uploads have each status, again and again as long as one is pending or processing."""
    while True:
        counts = {r["status"]: r["count"] for r in store.statuses(uploads).groupBy("status").count().collect()}
        yield counts
        if not counts.keys() & {PENDING, PROCESSING}:
            return
        sleep(every)


def stopped(query: StreamingQuery, store: Store) -> DataFrame:
    """Stops the stream, and gives the documents of all batches that were done. Started anew with its checkpoint it goes on with the batch it was in."""
    query.stop()
    return store.documents()
