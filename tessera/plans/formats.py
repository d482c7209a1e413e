"""Queries of parsers, extraction, code checks, token streams and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import calls
from tessera.functions import code as K
from tessera.functions import text as X
from tessera.functions.maths import calculate
from tessera.functions.tools import Tool, Tools
from tessera.session import Tables
from tessera.sources import bibliography as B
from tessera.sources import web
from tessera.streaming import live, tags

from .library import n
from .registry import ORACLES, query


def _json(t: Tables, expr: str) -> DataFrame:
    return t.part.select(F.to_json(F.expr(expr)).alias("j"))


_OUT = ("external_id", "title", "year", "venue", "citation_count", "doi", "first_author")


def _short(df: DataFrame) -> DataFrame:
    return df.withColumn("first_author", F.get("authors", F.lit(0))["name"]).select(*_OUT)


@query("SELECT 'p' || p_partkey AS external_id, coalesce(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END, 'Untitled') AS title, (2000 + p_size)::INT AS year, p_brand AS venue, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS citation_count, '10.1/' || p_partkey AS doi, p_type AS first_author FROM part")
def parse_s2(t: Tables) -> DataFrame:
    e = "struct(concat('p', p_partkey) as paperId, if(p_partkey % 7 = 0, null, p_name) as title, 2000 + p_size as year, p_brand as venue, if(p_partkey % 3 = 0, null, p_size) as citationCount, struct(concat('10.1/', p_partkey) as DOI) as externalIds, array(struct(p_type as name)) as authors)"
    return _short(B.parse_s2(_json(t, e), "j"))


@query("SELECT 'W' || p_partkey AS external_id, p_name AS title, (1990 + p_size)::INT AS year, p_brand AS venue, p_size AS citation_count, CASE WHEN p_partkey % 2 = 0 THEN '10.2/' || p_partkey END AS doi, p_type AS first_author FROM part")
def parse_openalex(t: Tables) -> DataFrame:
    e = "struct(concat('https://openalex.org/W', p_partkey) as id, p_name as title, 1990 + p_size as publication_year, p_size as cited_by_count, if(p_partkey % 2 = 0, concat('https://doi.org/10.2/', p_partkey), null) as doi, struct(struct(p_brand as display_name) as source) as primary_location, array(struct(struct('' as display_name) as author), struct(struct(p_type as display_name) as author)) as authorships)"
    return _short(B.parse_openalex(_json(t, e), "j"))


@query("SELECT '10.3/' || p_partkey AS external_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 1980 ELSE 1970 END AS year, p_brand AS venue, p_size AS citation_count, '10.3/' || p_partkey AS doi, 'A ' || p_type AS first_author FROM part")
def parse_crossref(t: Tables) -> DataFrame:
    e = "named_struct('DOI', concat('10.3/', p_partkey), 'title', array(p_name), 'container-title', array(p_brand, 'x'), 'is-referenced-by-count', p_size, 'author', array(named_struct('given', 'A', 'family', p_type)), 'published-print', if(p_partkey % 2 = 0, named_struct('date-parts', array(array(1980, 2))), null), 'created', named_struct('date-parts', array(array(1970))))"
    return _short(B.parse_crossref(_json(t, e), "j"))


@query("""SELECT p_partkey, 0 AS place, 'knowledge_graph' AS type, p_name AS title FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + i, 'organic', p_brand FROM part, (SELECT unnest([0, 1]) AS i)
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END, 'related_question', p_type FROM part""")
def parse_serp(t: Tables) -> DataFrame:
    o = "named_struct('title', p_brand, 'link', 'http://x')"
    e = f"named_struct('knowledgeGraph', if(p_partkey % 2 = 0, named_struct('title', p_name), null), 'organic', array({o}, {o}), 'peopleAlsoAsk', array(named_struct('question', p_type)))"
    return B.parse_serp(t.part.select("p_partkey", F.to_json(F.expr(e)).alias("j")), "j").select("p_partkey", "place", "type", "title")


@query("SELECT p_partkey || '.5' AS external_id, p_name AS title, (1990 + p_size)::INT AS year, 'cs.' || p_size AS venue, 0 AS citation_count, '10.4/' || p_partkey AS doi, p_brand AS first_author FROM part")
def parse_arxiv(t: Tables) -> DataFrame:
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom">'
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    k, size = F.col("p_partkey"), F.col("p_size")
    feed = c(head, "<entry><id>http://arxiv.org/abs/", k, ".5</id><title> ", F.col("p_name"), "\n</title><published>", 1990 + size, '-01-01</published><author><name>', F.col("p_brand"), '</name></author><category term="cs.', size, '"/><x:doi>10.4/', k, "</x:doi></entry></feed>")
    return _short(B.parse_feeds(t.part.select(feed.alias("f")), "f", B.arxiv_entries))


@query("SELECT p_partkey::VARCHAR AS external_id, p_name AS title, (1990 + p_size)::INT AS year, p_brand AS venue, 0 AS citation_count, '10.5/' || p_partkey AS doi, 'A ' || p_type AS first_author FROM part WHERE p_partkey % 5 <> 0")
def parse_pubmed(t: Tables) -> DataFrame:
    """Articles with a year that is no number can't be read."""
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    k = F.col("p_partkey")
    year = F.when(k % 5 == 0, "bad").otherwise((1990 + F.col("p_size")).cast("string"))
    feed = c("<s><PubmedArticle><PMID>", k, "</PMID><Article><ArticleTitle>", F.col("p_name"), "</ArticleTitle><Journal><Title>", F.col("p_brand"), "</Title><PubDate><Year>", year, "</Year></PubDate></Journal><AuthorList><Author><LastName>", F.col("p_type"), "</LastName><ForeName>A</ForeName></Author></AuthorList></Article><ArticleId IdType=\"doi\">10.5/", k, "</ArticleId></PubmedArticle></s>")
    return _short(B.parse_feeds(t.part.select(feed.alias("f")), "f", B.pubmed_articles))


@query()
def html_extract(t: Tables) -> DataFrame:
    """Text, links and tables of every page."""
    out = web.extract(t.pages, "page_id", "html")
    return out.select("page_id", F.sha2("body", 256).alias("body"), F.size("links").alias("links"), F.size("tables").alias("tables"))


@query("SELECT page_id, 'https://example.org/' || page_id AS url, left(url, 50) AS text FROM pages")
def extract_links(t: Tables) -> DataFrame:
    page = F.concat(F.lit('<p><a href="/near">near</a><a href="https://example.org/'), F.col("page_id").cast("string"), F.lit('">'), F.col("url"), F.lit("</a></p>"))
    out = web.extract(t.pages.withColumn("page", page), "page_id", "page")
    return out.select("page_id", F.inline("links"))


_PAGE = "'<body><script>x < 1</script><div id=\"d\" class=\"a b\"><p>' || page_id || '</p><p class=\"x\">in <b>' || url || '</b></p></div><p>out</p><a href=\"https://e.org/' || page_id || '\">far <i>away</i></a><a href=\"/near\">near</a><table><tr><th>k</th></tr><tr></tr><tr><td>' || page_id || '</td><td> v </td></tr></table></body>'"
_MODES = [("text", None), ("html", "div.a > p.x"), ("links", "body a"), ("tables", "table"), ("all", "#d p, table"), ("text", "ul")]


@query(f"""WITH p AS (SELECT page_id, url, CASE page_id % 5 WHEN 1 THEN 'blocked_domain' WHEN 2 THEN 'private_ip' WHEN 3 THEN 'invalid_protocol' END AS error, {_PAGE} AS page FROM pages),
m AS (SELECT unnest(range(6)) AS m)
SELECT page_id, m::INT AS mode, error, CASE WHEN error IS NULL THEN m < 5 END AS found,
CASE WHEN error IS NULL THEN CASE m WHEN 0 THEN left(page_id || chr(10) || 'in' || chr(10) || trim(url) || chr(10) || 'out' || chr(10) || 'far' || chr(10) || 'away' || chr(10) || 'near' || chr(10) || 'k' || chr(10) || page_id || chr(10) || 'v', 60)
  WHEN 4 THEN left(page_id || chr(10) || 'in' || chr(10) || trim(url) || chr(10) || 'k' || chr(10) || page_id || chr(10) || 'v', 60) END END AS text,
CASE WHEN error IS NULL AND m = 1 THEN left('<div><p class="x">in <b>' || url || '</b></p></div>', 60) END AS html,
CASE WHEN error IS NULL THEN CASE m WHEN 2 THEN 'https://e.org/' || page_id || '=faraway' WHEN 4 THEN '' END END AS links,
CASE WHEN error IS NULL AND m IN (3, 4) THEN 'k;' || page_id || ',v' END AS tables FROM p, m""")
def scrape_modes(t: Tables) -> DataFrame:
    """Every page in all five modes, with and without selectors: one that takes some elements, one that takes none; texts cut at 60."""
    k = F.col("page_id").cast("string")
    page = F.expr(_PAGE)
    at = F.when(k.cast("long") % 5 == 1, "https://my.internal/x").when(k.cast("long") % 5 == 2, "http://10.0.0.1/").when(k.cast("long") % 5 == 3, "ftp://e.org/").otherwise("https://e.org/")
    rows = t.pages.select("page_id", at.alias("at"), page.alias("page"))
    out = None
    for m, (mode, selector) in enumerate(_MODES):
        got = web.scrape(rows, "page_id", "at", "page", mode, selector, 60).withColumn("mode", F.lit(m))
        out = got if out is None else out.union(got)
    links = F.array_join(F.transform("links", lambda x: F.concat(x["url"], F.lit("="), x["text"])), ";")
    tables = F.array_join(F.transform(F.flatten("tables"), lambda r: F.array_join(r, ",")), ";")
    return out.select("page_id", "mode", "error", "found", "text", "html", links.alias("links"), tables.alias("tables"))


@query("SELECT page_id, r AS row, CASE r WHEN 0 THEN 'id|url' ELSE page_id || '|' || url END AS cells FROM pages, (SELECT unnest([0, 1]) AS r)")
def extract_tables(t: Tables) -> DataFrame:
    page = F.concat(F.lit("<table><tr><th>id</th><th> url </th></tr><tr></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), F.col("url"), F.lit("</td></tr></table>"))
    out = web.extract(t.pages.withColumn("page", page), "page_id", "page")
    rows = out.select("page_id", F.posexplode(F.col("tables")[0]).alias("row", "cells"))
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


def _code(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    code = F.concat(F.when(k % 2 == 0, "import os\n").otherwise("import sys\nsys.exit\n"), F.when(k % 3 == 0, "x = [\n").otherwise("x = 1\n"), F.when(k % 5 == 0, "# TODO\n").otherwise(""), F.when(k % 7 == 0, "for i in range(len(x)): pass").otherwise(""))
    return t.part.select("p_partkey", code.alias("code"))


@query("""SELECT p_partkey, NULL::INT AS line, 'syntax_error' AS type, 'error' AS severity FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 1, 'unused_import', 'info' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END, 'todo', 'info' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, NULL, 'range_len', 'warning' FROM part WHERE p_partkey % 7 = 0""")
def code_lint(t: Tables) -> DataFrame:
    return K.lint(_code(t), "p_partkey", "code")


@query("SELECT p_partkey, (p_partkey % 3 = 0)::BIGINT AS errors, (p_partkey % 7 = 0)::BIGINT AS warnings, (p_partkey % 2 = 0)::BIGINT + (p_partkey % 5 = 0)::BIGINT AS info FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def issue_summary(t: Tables) -> DataFrame:
    is_ = lambda s, a: F.count_if(F.col("severity") == s).alias(a)
    return code_lint(t).groupBy("p_partkey").agg(is_("error", "errors"), is_("warning", "warnings"), is_("info", "info"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'os' ELSE 'sys' END AS modules FROM part")
def import_set(t: Tables) -> DataFrame:
    """Each source's imported modules, sorted, up to five."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(?m)^\s*(?:import|from)\s+(\w+)"), F.lit(1))))
    return _code(t).select("p_partkey", F.array_join(F.slice(found, 1, 5), ",").alias("modules"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'undefined:np' WHEN 'error' THEN 'missing:foo' WHEN 'click' THEN 'key' WHEN 'signup' THEN 'conversion' ELSE 'other' END AS kind FROM events")
def error_classify(t: Tables) -> DataFrame:
    m = F.create_map(*map(F.lit, ("view", "NameError: name 'np' is not defined", "error", "ModuleNotFoundError: No module named 'foo'", "click", "KeyError: 3", "signup", "ValueError: could not convert", "purchase", "all fine")))
    return t.events.select("event_id", K.error_kind(m[F.col("event_type")]).alias("kind"))


# an error of each kind, with what is said to it
_SAID = {
    "NameError: name 'np' is not defined": [("undefined", "'np' isn't defined: check its spelling, or define or import it first"), ("import", "import numpy as np")],
    "NameError: name 'total' is not defined": [("undefined", "'total' isn't defined: check its spelling, or define or import it first")],
    "nameerror, of what isn't said": [],
    "TypeError: 'int' object is not subscriptable": [("not_subscriptable", "the object takes no index: check what it is")],
    "TypeError: 'int' object is NOT ITERABLE": [("not_iterable", "the object can't be looped over: a list or a dict can")],
    "TypeError: f() takes 1 positional argument but 2 were given": [("wrong_arguments", "the number of arguments isn't that of the function")],
    "TypeError: bad operand": [],
    "IndexError: list index out of range": [("index", "the index is out of range: check the length"), ("length", "len() gives the length, try and except catch the error")],
    "KeyError: 3": [("key", "the key isn't there: get() gives a default"), ("membership", "`key in d` tells whether it is there")],
    "ModuleNotFoundError: No module named 'foo'": [("install", "the module 'foo' isn't installed: install it with pip")],
    "ImportError: cannot import": [],
    "AttributeError: no attribute 'x'": [("attribute", "the object has no such attribute: check its type and the spelling"), ("inspect", "dir() and type() tell about the object")],
    "ValueError: invalid literal for int()": [("conversion", "the text can't be converted: check its format")],
    "ValueError: out of range": [("value", "the value isn't one that is allowed: check range and format")],
    "FileNotFoundError: x.csv": [("file", "the file isn't there: check the path"), ("exists", "os.path.exists() tells whether it is there")],
    "all fine": [],
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SAID_SQL = ", ".join(f"({k}, {i}, {_quoted(c)}, {_quoted(x)})" for k, said in enumerate(_SAID.values()) for i, (c, x) in enumerate(said))


@query(f"SELECT event_id, place, code, text FROM events JOIN (VALUES {_SAID_SQL}) s(k, place, code, text) ON event_id % {len(_SAID)} = k")
def error_suggestions(t: Tables) -> DataFrame:
    """What is suggested against each error, one row a suggestion."""
    message = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % len(_SAID) + 1).cast("int"))
    return t.events.select("event_id", F.posexplode(K.suggestions(message)).alias("place", "s")).select("event_id", "place", "s.code", "s.text")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 1 END::INT AS line,
CASE WHEN p_partkey % 3 = 0 THEN '''['' was never closed' WHEN p_partkey % 5 = 0 THEN '''return'' outside function' END AS message FROM part""")
def syntax_faults(t: Tables) -> DataFrame:
    """Where a source can't be compiled, and why: an open bracket, and what only compiling finds."""
    k = F.col("p_partkey")
    code = F.concat(F.when(k % 3 == 0, "import os\nx = [\n").when(k % 5 == 0, "return 1\n").otherwise("x = 1\n"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", K.syntax_fault(code).alias("f")).select("p_partkey", "f.line", "f.message")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT * 2 AS place, role AS type, text AS data FROM conversations")
def sse_frames_whole(t: Tables) -> DataFrame:
    """Events framed and read again, over whole messages: JSON escapes their newlines. A line that is no frame stands between."""
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("data"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "\n\n")
    return tags.frames(t.conversations.groupBy("conv_id").agg(text.alias("s")), "conv_id", "s")


query(ORACLES["sse_frames_whole"], "sse_frames")(sse_frames_whole)


@query(r"""SELECT conv_id, (2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1))::INT AS place, 'thought' AS type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations
UNION ALL SELECT conv_id, (2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) + 1)::INT, 'answer', turn::VARCHAR FROM conversations""")
def react_stream_whole(t: Tables) -> DataFrame:
    """Replies with whole messages as thoughts, cut into pieces of seven characters and parsed as a stream."""
    reply = F.concat(F.lit("<think> "), F.col("text"), F.lit("</think><answer>"), F.col("turn").cast("string"), F.lit("</answer>"))
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", reply.alias("r")))), lambda x: x["r"]), "").alias("s"))
    pieces = whole.select("conv_id", F.posexplode(F.regexp_extract_all("s", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "piece"))
    return tags.parse_batch(pieces, "conv_id", "seq", "piece")


query(ORACLES["react_stream_whole"], "react_stream")(react_stream_whole)


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS thought,
CASE WHEN turn % 3 = 0 AND coalesce(text, '') = '' THEN 'tail' ELSE regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') END AS answer FROM conversations""")
def react_two_modes(t: Tables) -> DataFrame:
    """Replies of think and answer tags in pieces of seven characters: with both tags, without an answer tag, without any."""
    text, think = F.coalesce("text", F.lit("")), F.concat(F.lit("<think> "), "role", F.lit("</think>"))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(think, F.lit(" hm <answer>"), text, F.lit("</answer> tail"))).when(F.col("turn") % 3 == 1, F.concat(think, text)).otherwise(text)
    pieces = t.conversations.select("conv_id", "turn", F.posexplode_outer(F.regexp_extract_all(reply, F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "piece"))
    return tags.parse_two_modes(pieces, ["conv_id", "turn"], "seq", "piece")


@query("SELECT p_partkey, ((p_size * 2 + 1) // 3)::VARCHAR AS value FROM part")
def calculator(t: Tables) -> DataFrame:
    """Expressions evaluated by their syntax tree."""
    f = F.pandas_udf(lambda s: s.map(calculate), "string")
    return t.part.select("p_partkey", f(F.concat(F.lit("floor(("), F.col("p_size").cast("string"), F.lit(" * 2 + 1) / 3)"))).alias("value"))


@query("SELECT conv_id, turn, role AS tool, CASE WHEN turn % 2 = 0 THEN 'k' END AS k, 'say ' || role AS left_over FROM conversations")
def bare_calls(t: Tables) -> DataFrame:
    """Calls without tags, and what is left of the reply without them."""
    k = F.when(F.col("turn") % 2 == 0, '"q": "k"').otherwise("")
    x = F.concat(F.lit("say <answer>"), F.col("role"), F.lit('</answer> {"tool": "'), F.col("role"), F.lit('", "input": {'), k, F.lit("}}"))
    rows = t.conversations.withColumn("x", x).select("conv_id", "turn", calls.bare_call(F.col("x")).alias("call"), calls.without_tags_and_calls(F.col("x")).alias("left_over"))
    return rows.select("conv_id", "turn", F.col("call.tool").alias("tool"), F.try_element_at(F.col("call.input"), F.lit("q")).alias("k"), "left_over")


@query("SELECT page_id, url AS title, 'https://e.org/' || page_id AS link, CASE WHEN page_id % 2 = 0 THEN 'a & b' ELSE '' END AS snippet FROM pages")
def result_links(t: Tables) -> DataFrame:
    k = F.col("page_id").cast("string")
    note = F.when(F.col("page_id") % 2 == 0, '<a class="result__snippet">a &amp; <b>b</b></a>').otherwise("")
    page = F.concat(F.lit('<a rel="x" class="result__a" href="https://e.org/'), k, F.lit('"><b>'), F.col("url"), F.lit("</b></a>"), note)
    return web.result_links(t.pages.withColumn("page", page), "page_id", "page").select("page_id", "title", F.col("url").alias("link"), "snippet")


@query("SELECT c_custkey, string_agg(place || '. ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE chr(10) || '   ' || o_orderstatus END, chr(10) ORDER BY place) AS listing FROM (SELECT o_custkey AS c_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) GROUP BY c_custkey")
def result_listing(t: Tables) -> DataFrame:
    """Numbered blocks of each customer's orders."""
    row = F.struct("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("note"))
    rows = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return rows.select("c_custkey", X.numbered(F.col("r"), "o_orderpriority", "note").alias("listing"))


@query("SELECT page_id, url AS text FROM pages")
def css_select(t: Tables) -> DataFrame:
    page = F.concat(F.lit('<div id="a">no</div><p class="x main">'), F.col("url"), F.lit("<br></p><p>no</p>"))
    return web.select(t.pages.withColumn("page", page), "page_id", "page", "p.main").select("page_id", F.explode("texts").alias("text"))


@query("SELECT event_id, event_type IN ('view', 'click') AS success, CASE event_type WHEN 'view' THEN upper(event_type) WHEN 'click' THEN '5' END AS output, CASE WHEN event_type = 'error' THEN 'no output' WHEN event_type NOT IN ('view', 'click') THEN 'unknown tool: ' || event_type END AS error FROM events")
def tool_dispatch(t: Tables) -> DataFrame:
    """Each row's tool called on its argument; unknown and failing tools are errors of their rows."""
    tools = Tools(Tool("view", "upper case", F.upper), Tool("click", "length", lambda a: F.length(a).cast("string")), Tool("error", "nothing", lambda a: F.lit(None).cast("string")))
    return t.events.select("event_id", tools.call(F.col("event_type"), F.col("event_type")).alias("r")).select("event_id", "r.*")


# fixed values: tools and whether they need the user's permission
TOOLS = {"knowledge_search": False, "web_search": False, "calculator": False, "datetime": False, "text_analysis": False, "unit_converter": False, "literature_search": False, "notebook_execute": True, "notebook_variables": True, "notebook_cell": True, "pip_install": True, "web_scrape": False, "code_analysis": False}
# fixed values: providers of models, and whether one needs a key to be available
PROVIDERS = {"deepseek": True, "openai": True, "aliyun": True, "ollama": False}


@query("SELECT unnest([" + ", ".join(f"'{x}'" for x in TOOLS) + "]) AS name, unnest([" + ", ".join(str(x).lower() for x in TOOLS.values()) + "]) AS needs_permission")
def tool_catalog(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(TOOLS.items()), "name string, needs_permission boolean")


def providers(t: Tables, keys: tuple[str, ...] = ()) -> DataFrame:
    """Providers in their order, and which are available with the keys that are set."""
    return t.spark.createDataFrame([(k, p, p in keys or not needs) for k, (p, needs) in enumerate(PROVIDERS.items())], "place int, provider string, available boolean")


@query("SELECT * FROM (VALUES (0, 'deepseek', true), (1, 'openai', false), (2, 'aliyun', false), (3, 'ollama', true)) AS p(place, provider, available)")
def provider_catalog(t: Tables) -> DataFrame:
    return providers(t, ("deepseek",))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(n("n"))


@query()
def live_events(t: Tables) -> DataFrame:
    """All events of messages that come as replies in pieces of seven characters: thoughts and answers, tool calls, no tags, no end."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    call = F.concat(F.lit("<action>"), F.to_json(F.struct(F.lit("search").alias("tool"), F.struct(F.left(text, F.lit(40)).alias("q")).alias("input"))), F.lit("</action>"))
    think = F.concat(F.lit("<think>"), text, F.lit("</think>"))
    reply = F.when(turn % 4 == 0, F.concat(think, F.lit("<answer>"), text, F.lit("</answer>"))).when(turn % 4 == 1, F.concat(think, call)).when(turn % 4 == 2, text).otherwise(F.concat(F.lit("<answer>"), text))
    key = F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    events = live.live_batch(live.pieces_of(t.conversations.select(key.alias("reply"), reply.alias("text")), "reply", "text", 7))
    return events.select(F.col("conv_id").alias("reply"), "place", "type", "data")


@query(r"""WITH r AS (SELECT conv_id || '/' || turn AS reply, coalesce(text, '') AS t, 15 + length(coalesce(text, '')) AS e FROM conversations),
s AS (SELECT *, e + 8 AS a, e + 17 + length(t) AS z FROM r)
SELECT reply, regexp_replace(t, '^\s+|\s+$', '', 'g') AS thought, regexp_replace(t, '^\s+|\s+$', '', 'g') AS answer,
greatest(0, 7 * ((e + 6) // 7 - 1) - 15 - 7)::BIGINT AS thinking_chars, greatest(0, 7 * ((z + 6) // 7 - 1) - 15 - a)::BIGINT AS content_chars FROM s""")
def live_streamed(t: Tables) -> DataFrame:
    """Of replies in pieces of seven characters: the thought, the answer, and how much of each was sent on before its end came."""
    text = F.coalesce("text", F.lit(""))
    reply = F.concat(F.lit("<think>"), text, F.lit("</think><answer>"), text, F.lit("</answer>"))
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    events = live.live_batch(live.pieces_of(t.conversations.select(key.alias("reply"), reply.alias("text")), "reply", "text", 7))
    of = lambda kind: F.max(F.when(F.col("type") == kind, F.col("data")))
    chars = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.length("data"))), F.lit(0)).cast("long")
    out = events.groupBy(F.col("conv_id").alias("reply")).agg(of("thought").alias("thought"), of("answer").alias("answer"), chars("thinking").alias("thinking_chars"), chars("content").alias("content_chars"))
    return out.select("reply", "thought", "answer", "thinking_chars", "content_chars")
