"""Trees of markup, selectors, and what scraping takes of them."""

import pytest

from tessera.sources import markup as M
from tessera.sources.web import scrape

PAGE = """<html><body class="top"><style>p {}</style><div id="a" class="x y"><p title="t">one <b>two</b><br>three</p><noscript>no</noscript></div>
<p>four &amp; five<iframe><p>unseen</p></iframe></p><ul><li>i<li>j</ul><a href="https://e.org/1">L<i> k </i></a><a>none</a><a href="/x">rel</a>
<table><tr><td>1<table><tr><th>in</th></tr></table></td><td> 2 </td></tr></table><table></table><input disabled value='q"'></body></html>"""


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("p", ["one\ntwo\nthree", "four & five"]),
        ("div.x.y > p", ["one\ntwo\nthree"]),
        ("div > b", []),
        (".top #a b, ul", ["two", "i\nj"]),
        ("[title]", ["one\ntwo\nthree"]),
        ("p[title=t] b", ["two"]),
        ('p[title="u"]', []),
        ("body > *", ["one\ntwo\nthree", "four & five", "i\nj", "L\nk", "none", "rel", "1\nin\n2", "", ""]),
    ],
)
def test_selectors(selector, texts):
    assert [M.text_of(n) for n in M.selected(M.parsed(PAGE), M.compiled(selector))] == texts


@pytest.mark.parametrize("selector", ["", "p:first-child", "> p", "p >", "p,,b", "a[href^=x]"])
def test_unknown_selectors(selector):
    with pytest.raises(ValueError, match="selector"):
        M.compiled(selector)


def test_parts():
    root = M.parsed(PAGE)
    assert M.links_of(root) == [{"url": "https://e.org/1", "text": "Lk"}] and M.links_of(root, 0) == []
    assert M.tables_of(root) == [[["1in", "in", "2"], ["in"]], [["in"]]] and len(M.tables_of(root, 1)) == 1
    assert M.selected(root, M.compiled("input"))[0].markup() == '<input disabled="" value="q&quot;"/>'
    assert M.parsed("<p>a < b</p>").markup() == "<p>a &lt; b</p>" and M.parsed(None).markup() == "" == M.text_of(M.parsed("<p></b></p></div>"))


def test_inner_elements_are_taken_out():
    root = M.apart(M.selected(M.parsed("<div>a<div>b</div>c</div>"), M.compiled("div")))
    assert root.markup() == "<div><div>ac</div><div>b</div></div>"


def test_deep_pages():
    deep = M.parsed("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert M.text_of(deep) == "x" and len(deep.markup()) == 20_000 * 11 + 1


@pytest.mark.parametrize("mode", ["text", "html", "links", "tables", "all"])
def test_modes(spark, mode):
    pages = spark.createDataFrame([(1, "https://e.org", PAGE), (2, "https://e.org", None), (3, "https://corp.e.org", PAGE), (4, None, PAGE), (5, "https://e.org", "x" * 6000)], "k long, u string, h string")
    got = {r["k"]: r for r in scrape(pages, "k", "u", "h", mode).collect()}
    assert {k: r["error"] for k, r in got.items()} == {1: None, 2: None, 3: "blocked_domain", 4: "invalid_protocol", 5: None}
    have = {c for c in ("text", "html", "links", "tables") if got[1][c] is not None}
    assert have == ({"text", "links", "tables"} if mode == "all" else {mode})
    assert all(got[3][c] is None for c in ("found", "text", "html", "links", "tables"))
    if mode == "text":
        assert len(got[5]["text"]) == 5000 and got[2]["text"] == ""


def test_a_selector_holds_for_all_modes(spark):
    pages = spark.createDataFrame([(1, "https://e.org", PAGE)], "k long, u string, h string")
    one = scrape(pages, "k", "u", "h", "all", "table").first()
    assert (one["text"], one["links"], one["tables"][0]) == ("1\n2\nin", [], [["1", "2"]])
    none = scrape(pages, "k", "u", "h", "all", "h1").first()
    assert (none["found"], none["text"], none["links"], none["tables"]) == (False, None, None, None)
