"""Ingestion by stream: a crash anywhere in a batch neither loses nor doubles; statuses; embedding and retries."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from tessera.operators.chunks import chunk
from tessera.sources.retries import RateLimited, embedded, fetched, with_retries
from tessera.streaming.ingest import COMPLETED, FAILED, PENDING, PROCESSING, Store, _outcomes, ingest, polled, processed, stopped

SCHEMA = "doc_id long, kb string, text string, chunk_size int, chunk_overlap int"


def rows(n=40, seed=1):
    rng = random.Random(seed)
    texts = [" ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "!", "\n\n"]) for _ in range(rng.choice([3, 100, 400]))) for _ in range(n)]
    return [(k, f"kb{k % 3}", x, 200, 20) for k, x in enumerate(texts)] + [(n, "kb0", None, 200, 20), (n + 1, "kb1", " \n ", 200, 20), (n + 2, "kb9", "text", 20, 20)]


@pytest.fixture
def landed(spark, tmp_path):
    """Uploads in five files, one batch each."""
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(str(tmp_path / "uploads"))
    return tmp_path


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "uploads"))


def want(spark):
    """(documents, chunks, counters) by the batch operator."""
    good = [r for r in rows() if r[2] and r[2].strip() and r[3] >= 100]
    got = chunk(spark.createDataFrame(good, SCHEMA), "doc_id", "text", 200, 20).collect()
    chunks = sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in got)
    counts = {r[0]: sum(c[0] == r[0] for c in chunks) for r in good}
    documents = sorted((r[0], COMPLETED if r[0] in counts else FAILED, counts.get(r[0], 0)) for r in rows())
    kbs = sorted((kb, sum(r[1] == kb for r in good), sum(n for d, n in counts.items() if f"kb{d % 3}" == kb)) for kb in {r[1] for r in good})
    return documents, chunks, kbs


def have(store):
    chunks = sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in store.chunks().collect())
    documents = sorted((r["doc_id"], r["status"], r["chunk_count"]) for r in store.documents().collect())
    return documents, chunks, sorted((r["kb"], r["document_count"], r["total_chunks"]) for r in store.counters().collect())


def test_many_documents_are_handed_on_together():
    """2,000 short uploads and one of 4,445 chunks: a few Arrow batches (before: a table for each document)."""
    texts = ["short"] * 2000 + ["0123456789" * 200_000, None]
    b = pa.RecordBatch.from_arrays([pa.array(x) for x in (range(2002), ["kb"] * 2002, texts, [500] * 2002, [50] * 2002)], names=["doc_id", "kb", "text", "chunk_size", "chunk_overlap"])
    got = list(_outcomes(iter([b]), None, 0.0))
    assert sum(x.num_rows for x in got) == 2 * 2000 + 4445 + 1 + 1 and len(got) <= 4
    assert [x for g in got for x in g["status"].to_pylist() if x] == [COMPLETED] * 2001 + [FAILED]


def test_equals_the_batch(spark, landed):
    store = Store(spark, str(landed / "store"))
    assert have(store) == ([], [], [])
    ingest(stream(spark, landed), store, str(landed / "c")).awaitTermination()
    assert have(store) == want(spark)
    # nothing new: nothing happens; a new file: only it
    ingest(stream(spark, landed), store, str(landed / "c")).awaitTermination()
    assert have(store) == want(spark)
    spark.createDataFrame([(900, "kb7", "some text", 200, 20)], SCHEMA).write.mode("append").parquet(str(landed / "uploads"))
    ingest(stream(spark, landed), store, str(landed / "c")).awaitTermination()
    assert [r["chunk_count"] for r in store.documents().where("doc_id = 900").collect()] == [1] and store.documents().count() == len(rows()) + 1


@pytest.mark.parametrize("table", ["begun", "rows", "counters", "done"])
def test_a_crash_neither_loses_nor_doubles(spark, landed, monkeypatch, table):
    """The third batch ends just after one of its four tables is written; its partial output isn't seen, and the restarted stream makes it again."""
    store, write = Store(spark, str(landed / "store")), Store._write

    def lost(self, df, name, batch_id):
        write(self, df, name, batch_id)
        if (name, batch_id) == (table, 2):
            raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_write", lost)
    with pytest.raises(Exception, match="lost"):
        ingest(stream(spark, landed), store, str(landed / "c")).awaitTermination()
    status = {r["status"] for r in store.statuses(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert {COMPLETED, PENDING} <= status and (PROCESSING in status) == (table != "done")
    assert store.counters().agg({"document_count": "sum"}).first()[0] == store.documents().where(f"status = '{COMPLETED}'").count()
    monkeypatch.undo()
    ingest(stream(spark, landed), store, str(landed / "c")).awaitTermination()
    assert have(store) == want(spark)


def test_stop_keeps_what_is_done_and_a_restart_goes_on(spark, landed):
    store, uploads = Store(spark, str(landed / "store")), spark.createDataFrame(rows(), SCHEMA)
    query = ingest(stream(spark, landed), store, str(landed / "c"), processingTime="0 seconds")
    for counts in polled(store, uploads, 0.2):
        if counts.get(COMPLETED, 0) > 5:
            break
    part = stopped(query, store).count()
    documents, chunks, kbs = have(store)
    assert 5 < part == len(documents) and not query.isActive
    assert sum(n for _, n, _ in kbs) == sum(s == COMPLETED for _, s, _ in documents) and sum(c for *_, c in kbs) == len(chunks)
    ingest(stream(spark, landed), store, str(landed / "c")).awaitTermination()
    assert have(store) == want(spark) and list(polled(store, uploads)) == [{COMPLETED: 40, FAILED: 3}]


def flaky(times):
    """An embedder whose first `times` calls are refused."""
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if len(calls) <= times:
            raise RateLimited("slower")
        return [[float(len(x)), 1.0] for x in texts]

    return embed, calls


def test_retries_double_their_waits():
    waits, (embed, calls) = [], flaky(2)
    assert with_retries(lambda: embed(["ab"]), 3, 2.0, waits.append) == [[2.0, 1.0]] and waits == [2.0, 4.0] and calls == [1, 1, 1]
    embed, calls = flaky(9)
    with pytest.raises(RateLimited):
        with_retries(lambda: embed([]), 3, 2.0, waits.append)
    assert len(calls) == 3
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"], 3, 2.0, waits.append)


def test_batches_of_twenty_without_blanks():
    embed, calls = flaky(0)
    texts = [f"text {k}" if k % 4 else " \n" for k in range(60)]
    got = embedded(texts, embed)
    assert calls == [20, 20, 5] and [v is None for v in got] == [k % 4 == 0 for k in range(60)]
    with pytest.raises(ValueError, match="vectors"):
        embedded(["a", "b"], lambda x: [[1.0]])


def test_embeddings_and_their_failures_are_a_document_s_own(spark):
    def embed(texts):
        if any("poison" in x for x in texts):
            raise RateLimited("never")
        return [[float(len(x))] for x in texts]

    uploads = spark.createDataFrame([(1, "k", "good text", 100, 0), (2, "k", "poison " * 40, 100, 0), (3, "k", "more " * 100, 100, 10)], SCHEMA)
    got = processed(uploads, embed, 0.0).collect()
    assert {r["doc_id"]: (r["status"], r["error"]) for r in got if r["status"]} == {1: (COMPLETED, None), 2: (FAILED, "RateLimited: never"), 3: (COMPLETED, None)}
    assert all(list(r["embedding"]) == [len(r["content"])] for r in got if r["chunk_index"] is not None) and not [r for r in got if r["doc_id"] == 2 and r["content"]]


def test_fetches_that_fail_in_the_end_are_rows(spark):
    def fetch(k):
        if k == 3:
            raise RateLimited("always")
        if k == 4:
            raise OSError("gone")
        seen.append(k)
        if seen.count(k) <= k:
            raise RateLimited("not yet")
        return f"body {k}"

    seen: list[int] = []
    asked: DataFrame = spark.createDataFrame([(k,) for k in range(5)], "k long").coalesce(1)
    got = {r["k"]: (r["body"], r["error"]) for r in fetched(asked, "k", fetch, first_wait=0.0).collect()}
    assert got == {0: ("body 0", None), 1: ("body 1", None), 2: ("body 2", None), 3: (None, "RateLimited: always"), 4: (None, "OSError: gone")}
