"""Every query with SQL against DuckDB over the smallest tables, where these are there; and every query runs over empty tables."""

import os

import pytest

from tessera import plans

FOLDER = os.environ.get("TESSERA_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
    if name in plans.ORACLES:
        rel = duck.sql(plans.ORACLES[name])
        assert sorted(rel.columns) == cols
        want = sorted(tuple(map(shown, r)) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({plans.ORACLES[name]})").fetchall())
        assert got == want
    else:
        assert got


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["vector_search", "conversation_list", "keywords", "chunk_documents", "insert_if_absent", "html_extract", "react_stream", "parse_arxiv", "describe", "ingest_pipeline"])
def test_empty_tables(spark, empty_tables, name):
    plans.QUERIES[name](spark, empty_tables).collect()


MESSAGES = [(1, 0, "user", "a\nb `c` \"d\"\n\nlong " + "word " * 400 + "end"), (1, 1, "assistant", "\n\nfirst\r\n" + "x" * 3000), (1, 2, "user", "short"), (2, 0, "user", "é😀\n" * 50 + "中")]


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("messages"))
    spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return out


def test_parsers_get_whole_messages(spark, messages):
    rows = lambda name, *cols: sorted(tuple(r) for r in plans.QUERIES[name](spark, messages).select(*cols).collect())
    assert rows("sse_frames_whole", "conv_id", "place", "type", "data") == [(c, 2 * k, r, x) for c, k, r, x in MESSAGES]
    assert rows("parse_react_whole", "conv_id", "turn", "thought", "answer") == [(c, k, x.strip(), r) for c, k, r, x in MESSAGES]
    assert rows("code_blocks_whole", "conv_id", "turn", "lang", "n") == [(c, k, "python" if k % 2 else "sql", len(x)) for c, k, _, x in MESSAGES]
    want = [y for c, k, _, x in MESSAGES for y in ((c, 2 * k, "thought", x.strip()), (c, 2 * k + 1, "answer", str(k)))]
    assert rows("react_stream_whole", "conv_id", "place", "type", "text") == want


@pytest.mark.parametrize("name", ["my_students_whole", "safe_ts_sort_whole"])
def test_all_rows_in_order(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    got = [tuple(map(shown, r)) for r in df.collect()]
    want = [tuple(map(shown, r)) for r in duck.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall()]
    table, most = {"my_students_whole": ("customer", 50), "safe_ts_sort_whole": ("events", 200)}[name]
    assert got == want and len(got) == duck.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0] > most


def test_documents_that_begin_alike_stay_apart(spark, tmp_path):
    head = "the same licence line of well over forty characters\n"
    rows = [(2, head + "one"), (3, head + "two"), (6, head + "one"), (10, head + "mine"), (7, head + "mine")]
    spark.createDataFrame([(d, x, "en", "s", len(x)) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in plans.QUERIES["copy_collection_whole"](spark, str(tmp_path)).collect()) == [2, 3]


def test_a_create_whose_key_is_there_takes_no_row_away(spark, tmp_path):
    """1,000,003 is a row of the table, and the key that the row created from 3 gets."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, f"n{k}", f"b{k}", f"t{k}") for k in (1, 2, 3, 4, 1000001, 1000002, 1000003)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in plans.QUERIES["record_changes"](spark, str(tmp_path)).select("id", "name").collect())
    assert got == sorted(con.sql(plans.ORACLES["record_changes"]).fetchall()) and (1000003, "n1000003") in got and (1000003, "t3") in got


def test_vector_literal_multiplies_in_single_precision(spark, tmp_path):
    """0.29 as float is under 0.29, but a hundred times as much is 29 as float."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, [0.29, -0.29, 0.57, 1.13]), (1, []), (2, [k / 100 for k in range(-300, 300)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((tuple(r) for r in plans.QUERIES["vector_literal"](spark, str(tmp_path)).select("vec_id", "literal", "first").collect()), key=str)
    assert got == sorted(con.sql(plans.ORACLES["vector_literal"]).fetchall(), key=str) and got[0][2] == 29
