"""Searches over feeds and landed pages: categories, orders, totals, and that pages which aren't asked for aren't read."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import bibliography as B

HEAD = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/" xmlns:x="http://arxiv.org/schemas/atom">'


def entry(k, title, published, updated, *terms, summary="s"):
    cats = "".join(f'<category term="{c}"/>' for c in terms)
    return f"<entry><id>http://arxiv.org/abs/{k}</id><title>{title}</title><summary>{summary}</summary><published>{published}</published><updated>{updated}</updated><author><name>Ann</name></author>{cats}</entry>"


FEEDS = [
    f"{HEAD}<o:totalResults> 7 </o:totalResults>" + entry("1", "Deep nets", "2020-01-01", "2024-01-01", "cs.AI", "cs.LG") + entry("2", "Deep (deep) DEEP", "2021-01-01", "2022-01-01", "cs.LG") + "</feed>",
    f"{HEAD}<o:totalResults>many</o:totalResults>" + entry("3", "Shallow", "2022-01-01", "2023-01-01", "math.OC", summary="not deep") + "<entry><title>no id</title></entry></feed>",
    f"{HEAD}</feed>", "not xml", "", None,
]


@pytest.fixture
def entries(spark):
    return B.parse_arxiv_feeds(spark.createDataFrame([(f,) for f in FEEDS], "f string"), "f")


def test_feeds_have_dates_and_totals(entries):
    got = {r["external_id"]: (r["published"], r["updated"], r["total_results"], r["fields_of_study"]) for r in entries.collect()}
    assert got == {"1": ("2020-01-01", "2024-01-01", 7, ["cs.AI", "cs.LG"]), "2": ("2021-01-01", "2022-01-01", 7, ["cs.LG"]), "3": ("2022-01-01", "2023-01-01", None, ["math.OC"])}


@pytest.mark.parametrize(
    ("given", "want", "total"),
    [
        ({}, ["2", "1", "3"], 3),
        ({"descending": False}, ["1", "3", "2"], 3),
        ({"sort_by": "submittedDate"}, ["3", "2", "1"], 3),
        ({"sort_by": "lastUpdatedDate"}, ["1", "3", "2"], 3),
        ({"categories": ["cs.AI", "math.OC"]}, ["1", "3"], 2),
        ({"categories": ["cs.LG"], "offset": 1, "limit": 1}, ["1"], 2),
        ({"offset": 5}, [], 0),
    ],
)
def test_arxiv_search(entries, given, want, total):
    got = B.arxiv_search(entries, "deep", **given).collect()
    assert [r["external_id"] for r in got] == want and {r["total"] for r in got} <= {total}


def test_arxiv_searches_all_fields_and_orders_are_known(entries):
    assert B.arxiv_search(entries, "ANN").count() == 3 and B.arxiv_search(entries, "(deep)").count() == 1
    with pytest.raises(ValueError, match="sort_by"):
        B.arxiv_search(entries, "x", sort_by="stars")


def test_only_pages_that_are_asked_for_are_read(spark, tmp_path):
    page = spark.range(40).select(F.lit("openalex").alias("source"), F.col("id").cast("int").alias("page"), F.expr("concat('{\"meta\": {\"count\": 400}, \"results\": [', array_join(transform(sequence(0, 9), k -> concat('{\"id\": \"https://openalex.org/W', id * 10 + k, '\", \"publication_year\": ', 1990 + k, '}')), ','), ']}')").alias("body"))
    root = str(tmp_path / "landed")
    B.land(page.union(page.select(F.lit("crossref"), "page", F.lit("{}"))), root, shelf=4)
    every = B.landed(spark, root, "openalex")
    some = B.landed(spark, root, "openalex", offset=75, limit=30, per_page=10, shelf=4)
    assert every.count() == 40 and sorted(r["page"] for r in some.collect()) == [7, 8, 9, 10]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "PushedFilters: [IsNotNull(page)" in plan
    read = lambda df: len({r["f"] for r in df.select(F.input_file_name().alias("f")).collect()})
    assert read(every) == 10 and read(some) == 2
    got = B.openalex_results(some, 10).where("place >= 75 and place < 105").orderBy("place").collect()
    assert [(r["place"], r["external_id"], r["year"], r["total"]) for r in got] == [(k, f"W{k}", 1990 + k % 10, 400) for k in range(75, 105)]
    assert B.filtered(B.openalex_results(every, 10), years=(1991, 1992)).count() == 80


def test_broken_pages_give_nothing(spark):
    pages = spark.createDataFrame([(0, "no json"), (1, '{"results": null}'), (2, '{"meta": {}, "results": [{"id": "W1"}, 3]}')], "page int, body string")
    assert {(r["place"], r["external_id"]) for r in B.openalex_results(pages, 100).collect()} >= {(200, "W1")}
    feeds = spark.createDataFrame([("<r><IdList><Id>5</Id><Id/><Id>7</Id></IdList></r>",), ("<IdList>",), (None,), ("<r><IdList><Id>5</Id></IdList></r>",)], "f string")
    assert sorted(r["external_id"] for r in B.parse_pubmed_ids(feeds, "f").collect()) == ["5", "7"]
