"""Operator 10: nothing is lost, versions are atomic, files reach their size."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.llm.sharding import ManifestConflict, ShardStore, shard_documents

from .fixtures import SCHEMA, corpus, documents


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nothing_is_lost_or_doubled(spark, tmp_path):
    docs = documents(spark, corpus(3)).selectExpr("*", "'x' as tier", "1 as version", "'here' as arrival")
    store = shard_documents(docs, str(tmp_path / "s"), arrivals=8, fan_in=2)
    assert content(store.read(docs.schema)) == content(docs)
    m = store.manifest()
    assert m["version"] > 8 and len(m["runs"]) == 1
    assert content(store.read(docs.schema, 8)) == content(docs)


def test_appends_compact_by_tier(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), fan_in=3)
    schema = "k long, v string"
    for k in range(7):
        store.append(spark.createDataFrame([(k, "x")], schema).coalesce(1))
    df = spark.createDataFrame([], schema)
    before = store.manifest()
    store.compact(df.schema)
    after = store.manifest()
    assert len(before["runs"]) == 7 and after["version"] == 9 and sorted(r["tier"] for r in after["runs"]) == [0, 1, 1]
    assert all(r["files"] == 1 for r in after["runs"])
    assert [r["k"] for r in store.read(df.schema).orderBy("k").collect()] == list(range(7))
    df.write.parquet(str(tmp_path / "s/data/left-by-a-crash"))
    assert store.vacuum() == 0
    assert store.vacuum(grace_seconds=0) == 7 and store.read(df.schema).count() == 7 and store.versions() == [9]


def test_writers_at_the_same_time(spark, tmp_path):
    """Appends and merges of several writers: none is lost, and a merge of runs that are gone is dropped."""
    stores = [ShardStore(spark, str(tmp_path / "s"), fan_in=2) for _ in range(4)]
    schema = spark.createDataFrame([], "k long").schema
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: stores[k % 4].append(spark.createDataFrame([(k,)], "k long")), range(12)))
        list(pool.map(lambda s: s.compact(schema), stores))
    assert sorted(r["k"] for r in stores[0].read(schema).collect()) == list(range(12))
    gone = [{"folder": str(tmp_path / "s/data/merged-elsewhere"), "files": 1, "bytes": 1, "tier": 0}] * 2
    spark.createDataFrame([(99,)], schema).write.parquet(gone[0]["folder"])
    before = stores[0].manifest()
    stores[1]._merged(gone, schema)
    assert stores[0].manifest() == before


def test_only_one_writer_commits_a_version(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    base = store.manifest()
    store.commit(base, [])
    with pytest.raises(ManifestConflict):
        store.commit(base, [])
    assert store.versions() == [1]


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_documents(empty, str(tmp_path / "s")).read(empty.schema).collect() == []
