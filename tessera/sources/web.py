"""HTML and files: text, links and tables by the standard library's parser, and files of several encodings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_type, url_error
from tessera.sources import markup

SKIPPED = {"script", "style", "noscript", "iframe"}
#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


class Page(HTMLParser):
    """Text pieces, links (address, text) and tables (rows of cell texts) of one page."""

    def __init__(self, html: str):
        super().__init__()
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self._skip = 0
        self._link: tuple[str, list[str]] | None = None
        self._cell: list[str] | None = None
        self._open: list[list[list[str]]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self._skip += 1
        elif tag == "a":
            self._link = (dict(attrs).get("href") or "", [])
        elif tag == "table":
            self._open.append([])
            self.tables.append(self._open[-1])
        elif tag == "tr" and self._open:
            self._open[-1].append([])
        elif tag in ("td", "th") and self._open and self._open[-1]:
            self._cell = []

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag == "a" and self._link is not None:
            self.links.append((self._link[0], "".join(self._link[1]).strip()))
            self._link = None
        elif tag in ("td", "th") and self._cell is not None:
            self._open[-1][-1].append("".join(self._cell).strip())
            self._cell = None
        elif tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data):
        if self._skip:
            return
        if data.strip():
            self.text.append(data.strip())
        if self._link is not None:
            self._link[1].append(data)
        if self._cell is not None:
            self._cell.append(data)


#: Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Selected(HTMLParser):
    """Texts of the elements that a simple selector takes: a tag, .class, #id, or a tag with one of these."""

    def __init__(self, html: str, selector: str):
        super().__init__()
        self.texts: list[str] = []
        self._tag, self._class, self._id = selector, "", ""
        if "." in selector:
            self._tag, self._class = selector.split(".", 1)
        elif "#" in selector:
            self._tag, self._id = selector.split("#", 1)
        self._stack: list[tuple[str, list[str] | None]] = []
        self.feed(html)
        self.close()
        while self._stack:
            self._leave(self._stack.pop())

    def _leave(self, element: tuple[str, list[str] | None]) -> None:
        if element[1] is not None:
            self.texts.append("".join(element[1]).strip())

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        takes = self._tag in ("", "*", tag) and (not self._class or self._class in (a.get("class") or "").split()) and (not self._id or self._id == a.get("id"))
        if tag not in VOID:
            self._stack.append((tag, [] if takes else None))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self._stack):
            while self._stack[-1][0] != tag:
                self._leave(self._stack.pop())
            self._leave(self._stack.pop())

    def handle_data(self, data):
        if not any(t in SKIPPED for t, _ in self._stack):
            for _, got in self._stack:
                if got is not None:
                    got.append(data)


class Results(HTMLParser):
    """Links of a page of search results and the notes beside them: anchors by their class, with all that stands in them."""

    def __init__(self, html: str):
        super().__init__()
        self.found: dict[str, list[tuple[str, str]]] = {"result__a": [], "result__snippet": []}
        self._open: tuple[str, str, list[str]] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kind = next((k for k in self.found if k in (a.get("class") or "").split()), None)
        if tag == "a" and kind and (kind != "result__a" or a.get("href")):
            self._open = (kind, a.get("href") or "", [])

    def handle_endtag(self, tag):
        if tag == "a" and self._open:
            self.found[self._open[0]].append((self._open[1], "".join(self._open[2]).strip()))
            self._open = None

    def handle_data(self, data):
        if self._open:
            self._open[2].append(data)


def result_links(pages: DataFrame, key: str, html: str, most: int = 5) -> DataFrame:
    """key, url, title and snippet of a result page's first links that have a title, each with the note in the same place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b["key"], b["html"], strict=True):
                got = Results(x or "").found
                notes = [t for _, t in got["result__snippet"]]
                rows += [(k, u, t, notes[i] if i < len(notes) else "") for i, (u, t) in enumerate(got["result__a"][:most]) if t]
            yield pd.DataFrame(rows, columns=["key", "url", "title", "snippet"])

    schema = f"key {dict(pages.dtypes)[key]}, url string, title string, snippet string"
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, schema).withColumnRenamed("key", key)


#: What scrape may give.
MODES = ("text", "html", "links", "tables", "all")
SCRAPED = "error string, found boolean, text string, html string, links array<struct<url:string,text:string>>, tables array<array<array<string>>>"


def scrape(pages: DataFrame, key: str, url: str, html: str, mode: str = "text", selector: str | None = None, max_length: int = 5000) -> DataFrame:
    """key, and of each page by mode its text, html, links or tables (all: but for html); the others are null.

    Everything is of what the selector takes, if one is given: each element taken out of its place, in their order. found tells whether it
    takes anything; a page where it doesn't has nothing. Texts and html are cut at max_length characters. A page whose address isn't allowed has
    an error (see url_error) and nothing else; it isn't parsed. Each page is parsed once.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    chains = markup.compiled(selector) if selector else None

    def of_one(page: str | None) -> tuple:
        root = markup.parsed(page)
        if chains is not None:
            nodes = markup.selected(root, chains)
            if not nodes:
                return None, False, None, None, None, None
            root = markup.apart(nodes)
        wants = lambda x: mode in (x, "all")
        return (
            None, True, markup.text_of(root, max_length) if wants("text") else None, root.markup()[:max_length] if mode == "html" else None,
            markup.links_of(root) if wants("links") else None, markup.tables_of(root) if wants("tables") else None,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *((error, None, None, None, None, None) if error else of_one(x))) for k, error, x in zip(b["key"], b["error"], b["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "error", "found", "text", "html", "links", "tables"])

    rows = pages.select(F.col(key).alias("key"), url_error(F.col(url)).alias("error"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"key {dict(pages.dtypes)[key]}, {SCRAPED}").withColumnRenamed("key", key)


def select(pages: DataFrame, key: str, html: str, selector: str) -> DataFrame:
    """key and texts of the elements that the selector takes, inner ones before those around them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "texts": [Selected(x or "", selector).texts for x in b["html"]]})

    schema = f"key {dict(pages.dtypes)[key]}, texts array<string>"
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, schema).withColumnRenamed("key", key)


def extract(pages: DataFrame, key: str, html: str, links: int = 50, tables: int = 5) -> DataFrame:
    """key, body (text pieces by line), links (http only, texts cut at 50) and tables (rows that aren't empty) of each page. Null pages give empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [Page(x or "") for x in b["html"]]
            yield pd.DataFrame(
                {
                    "key": b["key"],
                    "body": ["\n".join(p.text) for p in got],
                    "links": [[{"url": u, "text": t[:50]} for u, t in p.links if u.startswith(("http://", "https://"))][:links] for p in got],
                    "tables": [[[r for r in t if r] for t in p.tables[:tables]] for p in got],
                }
            )

    schema = f"key {dict(pages.dtypes)[key]}, body string, links array<struct<url:string,text:string>>, tables array<array<array<string>>>"
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, schema).withColumnRenamed("key", key)


def decoded(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def pdf_text(data: bytes) -> str:
    """Page texts with a blank line between, empty pages left out; needs the optional pypdf."""
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs pypdf") from e
    return "\n\n".join(x for p in PdfReader(io.BytesIO(data)).pages if (x := p.extract_text() or "").strip())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text and error of each file: txt, md, markdown, html, htm, pdf by their extension; others are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, kind, data in zip(b["path"], b["kind"], b["content"], strict=True):
                text = error = None
                try:
                    if kind in ("txt", "md", "markdown"):
                        text = decoded(data)
                    elif kind in ("html", "htm"):
                        text = "\n".join(Page(data.decode("utf-8")).text)
                    elif kind == "pdf":
                        text = pdf_text(data)
                    else:
                        error = f"unsupported: {kind}"
                except ValueError as e:
                    error = str(e)
                rows.append((p, kind, text, error))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", file_type(name).alias("kind"), "content").mapInPandas(run, "path string, kind string, text string, error string")
