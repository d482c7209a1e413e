"""Bibliographic records of five services as rows of one schema; JSON natively, XML by a parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTHORS = "array<struct<name:string,authorId:string,affiliations:array<string>>>"
PAPER = f"source string, external_id string, title string, abstract string, authors {AUTHORS}, year int, venue string, citation_count int, reference_count int, url string, pdf_url string, arxiv_id string, doi string, fields_of_study array<string>"

_S2 = f"struct<paperId:string,title:string,abstract:string,authors:{AUTHORS},year:int,venue:string,citationCount:int,referenceCount:int,url:string,openAccessPdf:struct<url:string>,externalIds:struct<ArXiv:string,DOI:string>,fieldsOfStudy:array<string>>"
_OPENALEX = "struct<id:string,title:string,abstract:string,doi:string,publication_year:int,cited_by_count:int,referenced_works:array<string>,authorships:array<struct<author:struct<display_name:string>>>,open_access:struct<is_oa:boolean,oa_url:string>,concepts:array<struct<display_name:string>>,primary_location:struct<source:struct<display_name:string>>>"
_CROSSREF = "struct<DOI:string,title:array<string>,abstract:string,URL:string,author:array<struct<given:string,family:string>>,`container-title`:array<string>,`is-referenced-by-count`:int,`references-count`:int,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>>"


def _rows(df: DataFrame, source: str, *more: str, **columns: Column) -> DataFrame:
    """The columns `more` of df, and columns in the common schema; those not given are null."""
    out = {"source": F.lit(source), **columns}
    kinds = dict(x.strip().split(" ", 1) for x in PAPER.replace("authors " + AUTHORS, "authors AUTHORS").split(","))
    return df.select(*more, *[out.get(c, F.lit(None)).cast(AUTHORS if k == "AUTHORS" else k).alias(c) for c, k in kinds.items()])


def _named(names: Column) -> Column:
    return F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("authorId"), F.lit(None).cast("array<string>").alias("affiliations")))


def _some(c: Column, empty: str) -> Column:
    return F.coalesce(c, F.array().cast(empty))


def parse_s2(df: DataFrame, column: str) -> DataFrame:
    """Semantic Scholar papers; a text that isn't JSON gives a row of nulls and defaults."""
    p = F.from_json(F.col(column), _S2)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _rows(
        df, "semantic_scholar", external_id=F.coalesce(p["paperId"], F.lit("")), title=F.coalesce(p["title"], F.lit("Untitled")), abstract=p["abstract"], authors=_some(p["authors"], AUTHORS), year=p["year"], venue=p["venue"],
        citation_count=zero(p["citationCount"]), reference_count=zero(p["referenceCount"]), url=p["url"], pdf_url=p["openAccessPdf"]["url"], arxiv_id=p["externalIds"]["ArXiv"], doi=p["externalIds"]["DOI"], fields_of_study=_some(p["fieldsOfStudy"], "array<string>"),
    )


def parse_openalex(df: DataFrame, column: str, *more: str) -> DataFrame:
    """OpenAlex works, with the columns `more` of df: of ten authors and five concepts those with a name."""
    w = F.from_json(F.col(column), _OPENALEX)
    named = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
    authors = named(F.transform(F.slice(w["authorships"], 1, 10), lambda a: a["author"]["display_name"]))
    fields = named(F.transform(F.slice(w["concepts"], 1, 5), lambda c: c["display_name"]))
    return _rows(
        df, "openalex", *more, external_id=F.replace(w["id"], F.lit("https://openalex.org/"), F.lit("")), title=F.coalesce(w["title"], F.lit("")), abstract=w["abstract"], authors=_some(_named(authors), AUTHORS), year=w["publication_year"],
        venue=w["primary_location"]["source"]["display_name"], citation_count=F.coalesce(w["cited_by_count"], F.lit(0)), reference_count=F.greatest(F.size(_some(w["referenced_works"], "array<string>")), F.lit(0)), url=w["id"],
        pdf_url=F.when(w["open_access"]["is_oa"], w["open_access"]["oa_url"]), doi=F.nullif(F.replace(w["doi"], F.lit("https://doi.org/"), F.lit("")), F.lit("")), fields_of_study=_some(fields, "array<string>"),
    )


def parse_crossref(df: DataFrame, column: str) -> DataFrame:
    """Crossref items: the year of print, else online, else creation."""
    c = F.from_json(F.col(column), _CROSSREF)
    name = F.transform(F.slice(c["author"], 1, 10), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    date = F.coalesce(c["published-print"], c["published-online"], c["created"])["date-parts"]
    first = lambda a: F.get(a, F.lit(0))
    return _rows(
        df, "crossref", external_id=F.coalesce(c["DOI"], F.lit("")), title=F.coalesce(first(c["title"]), F.lit("")), abstract=c["abstract"], authors=_some(_named(F.filter(name, lambda x: x != "")), AUTHORS), year=first(first(date)), venue=first(c["container-title"]),
        citation_count=F.coalesce(c["is-referenced-by-count"], F.lit(0)), reference_count=F.coalesce(c["references-count"], F.lit(0)), url=c["URL"], doi=F.coalesce(c["DOI"], F.lit("")), fields_of_study=F.array().cast("array<string>"),
    )


def parse_serp(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """Web search results with their place: knowledge graph, answer box, organic ones, and up to two related questions while there is room."""
    kind = "struct<knowledgeGraph:struct<title:string,description:string>,answerBox:struct<answer:string,snippet:string,title:string,link:string>,organic:array<struct<title:string,link:string,snippet:string>>,peopleAlsoAsk:array<struct<question:string,snippet:string>>>"
    s = F.from_json(F.col(column), kind)
    row = lambda t, title, text, url: F.struct(F.lit(t).alias("type"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(url, F.lit("")).alias("url"))
    none, empty = F.lit(""), F.array().cast("array<struct<type:string,title:string,text:string,url:string>>")
    graph = F.when(s["knowledgeGraph"].isNotNull(), F.array(row("knowledge_graph", s["knowledgeGraph"]["title"], s["knowledgeGraph"]["description"], none))).otherwise(empty)
    given = lambda c: F.nullif(c, F.lit(""))
    answer = F.coalesce(given(s["answerBox"]["answer"]), given(s["answerBox"]["snippet"]), given(s["answerBox"]["title"]))
    box = F.when(answer.isNotNull(), F.array(row("answer_box", answer, none, s["answerBox"]["link"]))).otherwise(empty)
    organic = F.coalesce(F.transform(F.slice(s["organic"], 1, most), lambda o: row("organic", o["title"], o["snippet"], o["link"])), empty)
    asked = F.coalesce(F.transform(F.slice(s["peopleAlsoAsk"], 1, 2), lambda q: row("related_question", q["question"], q["snippet"], none)), empty)
    found = F.concat(graph, box, organic)
    every = F.when(F.size(found) < most + 2, F.concat(found, asked)).otherwise(found)
    return df.withColumn("_all", every).select(*df.columns, F.posexplode("_all").alias("place", "_r")).select(*[c for c in df.columns if c != column], "place", "_r.*")


def _text(node, path: str, ns: dict) -> str | None:
    found = node.find(path, ns)
    return None if found is None else found.text


def arxiv_entries(feed: str) -> list[dict]:
    """Papers of an Atom feed; an entry without an id, and a feed that isn't XML, give none."""
    ns = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}
    try:
        root = ElementTree.fromstring(feed)
    except ElementTree.ParseError:
        return []
    out = []
    for e in root.findall("a:entry", ns):
        if not (url := _text(e, "a:id", ns)):
            continue
        paper, flat = url.rpartition("/abs/")[2], lambda s: None if s is None else s.strip().replace("\n", " ")
        terms = [c.get("term") for c in e.findall("a:category", ns) if c.get("term")]
        primary = e.find("x:primary_category", ns)
        year = (_text(e, "a:published", ns) or "")[:4]
        pdf = next((x.get("href") for x in e.findall("a:link", ns) if x.get("title") == "pdf"), None)
        out.append(
            {
                "source": "arxiv", "external_id": paper, "title": flat(_text(e, "a:title", ns)) or "Untitled", "abstract": flat(_text(e, "a:summary", ns)),
                "authors": [{"name": n.text, "authorId": None, "affiliations": []} for n in e.findall("a:author/a:name", ns)], "year": int(year) if year.isdigit() else None,
                "venue": primary.get("term") if primary is not None else next(iter(terms), None), "citation_count": 0, "reference_count": 0, "url": url,
                "pdf_url": pdf or f"https://arxiv.org/pdf/{paper}.pdf", "arxiv_id": paper, "doi": _text(e, "x:doi", ns), "fields_of_study": terms,
            }
        )
    return out


def pubmed_articles(feed: str) -> list[dict]:
    """Papers of an article set; articles that can't be read are passed over."""
    try:
        root = ElementTree.fromstring(feed)
    except ElementTree.ParseError:
        return []
    out = []
    for a in root.findall(".//PubmedArticle"):
        body = a.find(".//Article")
        if body is None:
            continue
        try:
            names = [f"{x.findtext('ForeName', '')} {x.findtext('LastName')}".strip() for x in body.findall(".//Author") if x.findtext("LastName")]
            year, journal, pmid = body.findtext(".//PubDate/Year"), body.find(".//Journal"), a.findtext(".//PMID", "")
            out.append(
                {
                    "source": "pubmed", "external_id": pmid, "title": body.findtext(".//ArticleTitle", ""), "abstract": _text(body, ".//Abstract/AbstractText", {}), "authors": [{"name": n, "authorId": None, "affiliations": []} for n in names],
                    "year": int(year) if year else None, "venue": None if journal is None else journal.findtext(".//Title", ""), "citation_count": 0, "reference_count": 0, "url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/", "pdf_url": None,
                    "arxiv_id": None, "doi": next((x.text for x in a.findall(".//ArticleId") if x.get("IdType") == "doi"), None), "fields_of_study": ["Medicine", "Biology"],
                }
            )
        except ValueError:
            continue
    return out


def parse_feeds(df: DataFrame, column: str, parse) -> DataFrame:
    """Papers of the feeds in a column, by arxiv_entries or pubmed_articles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [p for feed in b["feed"] if feed for p in parse(feed)]
            yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in PAPER.replace(AUTHORS, "a").split(",")]).astype({"year": "Int32"})

    return df.select(F.col(column).alias("feed")).mapInPandas(run, PAPER)


def filtered(papers: DataFrame, years: tuple[int, int] | None = None, fields: list[str] | None = None, open_access: bool = False) -> DataFrame:
    """Papers of a range of years (ends included), of some fields of study, with a PDF: those conditions that are given."""
    if years:
        papers = papers.where(F.col("year").between(*years))
    if fields:
        papers = papers.where(F.arrays_overlap("fields_of_study", F.array(*map(F.lit, fields))))
    return papers.where("pdf_url is not null") if open_access else papers


def paged(papers: DataFrame, order: list[Column], offset: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """A page in the given order; services give no more than `most` rows whatever limit asks for."""
    return papers.orderBy(*order).offset(offset).limit(min(limit, most))


def by_ids(papers: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """The papers with these ids."""
    return papers.where(F.col(column).isin(ids))


def routed(asked: DataFrame, named: str, sources: dict[str, DataFrame], default: str, key: str) -> DataFrame:
    """Each request joined by key to the source that it names, the default where it names none of them; with a column source."""
    known = F.when(F.col(named).isin(*sources), F.col(named)).otherwise(F.lit(default))
    parts = [asked.withColumn("source", known).where(F.col("source") == name).join(rows, key) for name, rows in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- searches over what a service would hold


#: An arXiv entry with its two dates, and what its feed says of the whole search.
ENTRY = f"{PAPER}, published string, updated string, total_results long"


def arxiv_feed(feed: str) -> list[dict]:
    """As arxiv_entries, with published, updated and the feed's totalResults (null where it gives no number)."""
    papers = arxiv_entries(feed)
    if not papers:
        return []
    a = "{http://www.w3.org/2005/Atom}"
    root = ElementTree.fromstring(feed)
    total = root.findtext("{http://a9.com/-/spec/opensearch/1.1/}totalResults", "").strip()
    entries = [e for e in root.findall(f"{a}entry") if e.findtext(f"{a}id")]
    return [p | {"published": e.findtext(f"{a}published"), "updated": e.findtext(f"{a}updated"), "total_results": int(total) if total.isdigit() else None} for p, e in zip(papers, entries, strict=True)]


def parse_arxiv_feeds(df: DataFrame, column: str) -> DataFrame:
    """Papers of Atom feeds in the schema ENTRY."""
    names = [c.strip().split(" ")[0] for c in ENTRY.replace(AUTHORS, "a").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [p for feed in b["feed"] if feed for p in arxiv_feed(feed)]
            yield pd.DataFrame(rows, columns=names).astype({"year": "Int32", "total_results": "Int64"})

    return df.select(F.col(column).alias("feed")).mapInPandas(run, ENTRY)


#: What arXiv sorts by, and the column that holds it; relevance is how often the words stand in title and abstract.
ARXIV_ORDERS = {"relevance": None, "lastUpdatedDate": "updated", "submittedDate": "published"}


def with_total(found: DataFrame, order: list[Column], offset: int, limit: int, most: int = 100) -> DataFrame:
    """A page of what was found, each row with how many there are in all."""
    return paged(found, order, offset, limit, most).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


def arxiv_search(entries: DataFrame, words: str, categories: list[str] | None = None, sort_by: str = "relevance", descending: bool = True, offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of entries that hold the words anywhere, in any of the categories if some are given, and the total."""
    if sort_by not in ARXIV_ORDERS:
        raise ValueError(f"sort_by must be one of {tuple(ARXIV_ORDERS)}")
    text = F.lower(F.concat_ws(" ", "title", "abstract", F.array_join(F.transform("authors", lambda a: a["name"]), " ")))
    found = entries.where(text.contains(words.lower()))
    if categories:
        found = found.where(F.arrays_overlap("fields_of_study", F.array(*map(F.lit, categories))))
    times = F.size(F.split(F.lower(F.concat_ws(" ", "title", "abstract")), F.concat(F.lit("\\Q"), F.lit(words.lower()), F.lit("\\E")))) - 1
    key = F.col(ARXIV_ORDERS[sort_by]) if ARXIV_ORDERS[sort_by] else times
    return with_total(found, [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.asc("external_id")], offset, limit)


def pubmed_ids(feed: str | None) -> list[str]:
    """The ids of a search's answer; none where it can't be read."""
    try:
        return [i.text for i in ElementTree.fromstring(feed or "").findall(".//IdList/Id") if i.text]
    except ElementTree.ParseError:
        return []


def parse_pubmed_ids(df: DataFrame, column: str) -> DataFrame:
    """external_id of each id in the answers of a column, once."""

    @F.pandas_udf("array<string>")
    def ids(feeds: pd.Series) -> pd.Series:
        return feeds.map(pubmed_ids)

    return df.select(F.explode(ids(column)).alias("external_id")).distinct()


# ---- landed pages


def land(pages: DataFrame, root: str, shelf: int = 64) -> None:
    """Writes pages (source, page, body) of services' answers, as they came, in folders by source and by `shelf` pages."""
    rows = pages.withColumn("shelf", F.floor(F.col("page") / shelf).cast("int"))
    rows.repartition("source", "shelf").sortWithinPartitions("source", "shelf", "page").write.partitionBy("source", "shelf").parquet(root)


def landed(spark, root: str, source: str, offset: int | None = None, limit: int = 20, per_page: int = 100, shelf: int = 64) -> DataFrame:
    """page and body of a source's pages, or of those alone that hold results from offset on: other folders aren't opened, and other row groups are skipped."""
    rows = spark.read.schema("page int, body string, source string, shelf int").parquet(root).where(F.col("source") == source)
    if offset is not None:
        first, last = offset // per_page, (offset + max(limit, 1) - 1) // per_page
        rows = rows.where(F.col("shelf").between(first // shelf, last // shelf) & F.col("page").between(first, last))
    return rows.select("page", "body")


def openalex_results(pages: DataFrame, per_page: int = 100) -> DataFrame:
    """Works of pages of OpenAlex answers ({"meta": {"count": n}, "results": [...]}), each with its place in the whole list and the total."""
    body = F.from_json("body", "struct<meta:struct<count:long>,results:array<string>>")
    rows = pages.select("page", body["meta"]["count"].alias("total"), F.posexplode(body["results"]).alias("k", "work"))
    rows = rows.select((F.col("page") * per_page + F.col("k")).cast("long").alias("place"), "total", "work")
    return parse_openalex(rows, "work", "place", "total")


# ---- papers in a library


def search_key(source: Column, external_id: Column, doi: Column, title: Column) -> Column:
    """By what a found paper is looked for among the saved ones: the id of its source where that has one of its own, else DOI, else title; null without an id."""
    own = F.when(source == "semantic_scholar", "s2:").when(source == "arxiv", "arxiv:").when(source == "pubmed", "pubmed:")
    given = F.nullif(doi, F.lit(""))
    key = F.when(own.isNotNull(), F.concat(own, external_id)).when(given.isNotNull(), F.concat(F.lit("doi:"), given)).otherwise(F.concat(F.lit("title:"), title))
    return F.when(F.coalesce(external_id, F.lit("")) != "", key)


def with_saved(found: DataFrame, saved: DataFrame, user: str = "user") -> DataFrame:
    """found (source, external_id, doi, title and the user) with saved_id, the least id of the user's saved papers that it is, or null.

    saved: id, the user, s2_id, arxiv_id, pubmed_id, doi and title, each of which a paper may have. A saved paper is a row for each key that it has.
    """
    tagged = [F.concat(F.lit(tag), F.col(c)) for tag, c in (("s2:", "s2_id"), ("arxiv:", "arxiv_id"), ("pubmed:", "pubmed_id"), ("doi:", "doi"), ("title:", "title"))]
    keys = saved.select("id", F.col(user).alias("_user"), F.explode(F.filter(F.array(*tagged), lambda k: k.isNotNull())).alias("_key"))
    keys = keys.groupBy("_user", "_key").agg(F.min("id").alias("saved_id"))
    asked = found.withColumn("_asked", search_key(F.col("source"), F.col("external_id"), F.col("doi"), F.col("title")))
    return asked.join(keys, (F.col("_asked") == F.col("_key")) & (F.col(user) == F.col("_user")), "left").drop("_asked", "_key", "_user")


#: Labels of a list of papers: authors, venue, citations, abstract, address, PDF, unknown authors, and further authors.
LABELS = {
    "plain": {"authors": "Authors: ", "venue": "Published: ", "cited": "Citations: ", "abstract": "Abstract: ", "url": "Link: ", "pdf": None, "unknown": "unknown", "more": " and others"},
    "rich": {"authors": "By ", "venue": "In ", "cited": "Cited ", "abstract": "", "url": "", "pdf": "PDF: ", "unknown": "", "more": " et al."},
}


def listed(papers: DataFrame, group: str, place: str, head: Column, style: str = "plain") -> DataFrame:
    """group and text: its papers as a numbered list under head, in the order of place. What a paper doesn't have has no line; abstracts are cut at 200 characters."""
    w = LABELS[style]
    line = lambda label, c, given=None: F.coalesce(F.when(given if given is not None else c != "", F.concat(F.lit("\n" + label), c)), F.lit(""))
    names = F.array_join(F.transform(F.slice("authors", 1, 3), lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
    who = F.concat(F.coalesce(F.nullif(names, F.lit("")), F.lit(w["unknown"])), F.when(F.size("authors") > 3, w["more"]).otherwise(""))
    abstract = F.concat(F.left("abstract", F.lit(200)), F.when(F.length("abstract") > 200, "...").otherwise(""))
    body = F.concat(
        F.coalesce("title", F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")), F.lit("\n" + w["authors"]), F.coalesce(who, F.lit(w["unknown"])), line(w["venue"], F.col("venue")),
        line(w["cited"], F.col("citation_count").cast("string"), F.col("citation_count") > 0), line(w["abstract"], abstract, F.col("abstract") != ""), line(w["url"], F.col("url")), line(w["pdf"], F.col("pdf_url")) if w["pdf"] else F.lit(""),
    )
    rows = papers.select(F.col(group).alias("_g"), head.alias("_h"), F.struct(F.col(place).alias("o"), body.alias("b")).alias("_e")).groupBy("_g", "_h").agg(F.array_sort(F.collect_list("_e")).alias("_e"))
    text = F.array_join(F.transform("_e", lambda e, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), e["b"])), "\n")
    return rows.select(F.col("_g").alias(group), F.concat("_h", F.lit("\n"), text).alias("text"))


def as_dicts(papers: DataFrame) -> DataFrame:
    """external_id and paper: all that a caller of a tool sees of it, as JSON with nulls; what the service sent besides is not in it."""
    names = [c.strip().split(" ")[0] for c in PAPER.replace(AUTHORS, "a").split(",")]
    return papers.select("external_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("paper"))
