"""Queries of text, vector, number and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import maths as M
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators.chunks import ENDINGS, chunk
from tessera.operators import relational as R
from tessera.operators.relational import page_with_total
from tessera.session import Tables, shared_folder, timed
from tessera.streaming.ingest import Store, ingest

from .library import n
from .registry import ORACLES, query

_ROUND = lambda c: F.round(c, 4)


def search(t: Tables, query_id: int = 0, top_k: int = 20, threshold: float = 0.1) -> DataFrame:
    """The vectors nearest to one by cosine, joined to their knowledge base, from a threshold on: TakeOrdered, no full sort."""
    asked = t.embeddings.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    scored = t.embeddings.crossJoin(F.broadcast(asked)).withColumn("distance", 1 - V.cosine(F.col("embedding"), F.col("q")))
    near = scored.where(F.col("distance") <= 1 - threshold).join(t.nation, F.col("label") == F.col("n_nationkey"))
    return near.orderBy("distance", "vec_id").limit(top_k).select("vec_id", "n_name", _ROUND(1 - F.col("distance")).alias("score"))


@query("""SELECT vec_id, n_name, round(1 - d, 4) AS score FROM (SELECT e.vec_id, e.label, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) JOIN nation ON label = n_nationkey WHERE d <= 0.9 ORDER BY d, vec_id LIMIT 20""")
def vector_search(t: Tables) -> DataFrame:
    return search(t)


def pairs(t: Tables) -> DataFrame:
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.select("vec_id", F.col("embedding").alias("a")).join(other, "vec_id")


_PAIRS = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"SELECT vec_id, round(list_cosine_similarity(a, b), 4) AS score FROM {_PAIRS}")
def cosine_pair(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", _ROUND(V.cosine(F.col("a"), F.col("b"))).alias("score"))


@query(f"SELECT vec_id, round(list_distance(a, b), 4) AS distance FROM {_PAIRS}")
def l2_distance(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", _ROUND(V.l2_distance(F.col("a"), F.col("b"))).alias("distance"))


@query(f"SELECT vec_id, round(list_inner_product(a, b), 4) AS product FROM {_PAIRS}")
def inner_product(t: Tables) -> DataFrame:
    return pairs(t).select("vec_id", _ROUND(V.dot(F.col("a"), F.col("b"))).alias("product"))


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q")
def similarity_batch(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1)
    return t.embeddings.crossJoin(F.broadcast(asked)).select("vec_id", _ROUND(V.cosine(F.col("embedding"), F.col("q"))).alias("score"))


_CLEAN = r"trim(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12))"


@query(f"SELECT doc_id, sha256({_CLEAN}) AS cleaned, length({_CLEAN}) AS n FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("cleaned"), F.length(X.clean_text(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(r"SELECT doc_id, floor(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / 1.5::DOUBLE + (length(text) - len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]'))) / 4.0::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, length(text) AS chars, length(replace(replace(text, ' ', ''), chr(10), '')) AS no_space, len(regexp_extract_all(text, '[a-zA-Z]+')) AS words,
greatest(len(regexp_extract_all(text, '[。！？.!?]+')), 1) AS sentences, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS lines,
len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS chinese,
round(length(replace(replace(text, ' ', ''), chr(10), '')) / greatest(len(regexp_extract_all(text, '[。！？.!?]+')), 1)::DOUBLE, 1) AS mean_sentence FROM documents""")
def text_stats(t: Tables) -> DataFrame:
    sentences = F.greatest(F.regexp_count(F.col("text"), F.lit("[。！？.!?]+")), F.lit(1))
    lines = F.size(F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(X.BLANK)) != ""))
    long = lambda c, a: c.cast("long").alias(a)
    no_space = F.length(F.translate(F.col("text"), " \n", ""))
    return t.documents.select("doc_id", long(F.length(F.col("text")), "chars"), long(no_space, "no_space"), long(F.regexp_count(F.col("text"), F.lit("[a-zA-Z]+")), "words"), long(sentences, "sentences"), long(lines, "lines"), long(F.regexp_count(F.col("text"), F.lit(X.ZH)), "chinese"), F.round(no_space / sentences, 1).alias("mean_sentence"))


_STOP = "('的','是','在','和','了','有','不','这','为','上','the','a','an','is','are','was','were','be','been','to','of','and','in','that','it','for','on','with')"


@query(rf"""WITH w AS (SELECT doc_id, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS p FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\x{{4e00}}-\x{{9fff}}]+|[a-z]+'), lambda y: length(y) > 1 AND y NOT IN {_STOP}) AS x FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS place FROM w GROUP BY doc_id, word) SELECT doc_id, word, n, place FROM c WHERE place <= 10""")
def keywords(t: Tables) -> DataFrame:
    """Each document's ten most frequent words, ties in the order of appearance: counted in Arrow batches, as lambdas over arrays aren't compiled; nothing is shuffled."""
    top = t.documents.select("doc_id", F.posexplode(X.top_words(F.lower("text"), 10)).alias("p", "r"))
    return top.select("doc_id", "r.word", "r.n", (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def truncate_ellipsis(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncated(F.col("text"), 200).alias("preview"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), '|') AS fields FROM part")
def split_fields(t: Tables) -> DataFrame:
    fields = F.transform(F.split(F.replace("p_type", F.lit(" "), F.lit(" , ")), ","), lambda x: F.trim(x))
    return t.part.select("p_partkey", F.array_join(fields, "|").alias("fields"))


def papers(t: Tables) -> DataFrame:
    """Parts with up to four authors."""
    names = F.slice(F.array("p_name", "p_brand", "p_type", F.lit("Z")), F.lit(1), (F.col("p_partkey") % 5).cast("int"))
    return t.part.withColumn("authors", F.transform(names, lambda x: F.struct(x.alias("name"))))


_A = "list_slice([p_name, p_brand, p_type, 'Z'], 1, (p_partkey % 5)::INT)"


@query(f"SELECT p_partkey, array_to_string({_A}[1:3], ', ') || CASE WHEN p_partkey % 5 > 3 THEN ' et al.' ELSE '' END AS shown, coalesce({_A}[1], 'Unknown') AS first FROM part")
def author_display(t: Tables) -> DataFrame:
    first = F.coalesce(F.get("authors", F.lit(0))["name"], F.lit("Unknown"))
    return papers(t).select("p_partkey", X.author_display(F.col("authors")).alias("shown"), first.alias("first"))


@query(f"SELECT p_partkey, coalesce(nullif(array_to_string({_A}, ', '), ''), 'Unknown') || '. \"' || p_name || '\". ' || p_brand || ' (' || p_size || ')' AS citation FROM part")
def citation_string(t: Tables) -> DataFrame:
    return papers(t).select("p_partkey", X.citation(F.col("authors"), F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("citation"))


@query("SELECT p_partkey, p_size || '.' || p_partkey AS arxiv FROM part")
def clean_arxiv_id(t: Tables) -> DataFrame:
    core = F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "arXiv:").otherwise(""), core, F.when(F.col("p_partkey") % 3 == 0, "v12").otherwise(""), F.lit(" "))
    return t.part.select("p_partkey", X.arxiv_id(F.btrim(raw)).alias("arxiv"))


@query("SELECT p_partkey, 'https://arxiv.org/pdf/' || p_partkey || '.pdf' AS pdf, '10.1/' || p_partkey AS doi, 'W' || p_partkey AS work FROM part")
def url_norm(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    page, doi, work = F.concat(F.lit("https://arxiv.org/abs/"), k), F.concat(F.lit("https://doi.org/10.1/"), k), F.concat(F.lit("https://openalex.org/W"), k)
    pdf = F.concat(F.lit("https://arxiv.org/pdf/"), F.element_at(F.split(page, "/abs/"), -1), F.lit(".pdf"))
    return t.part.select("p_partkey", pdf.alias("pdf"), F.replace(doi, F.lit("https://doi.org/"), F.lit("")).alias("doi"), F.substring_index(work, "/", -1).alias("work"))


@query("SELECT page_id, sha256(trim(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), ' ' || chr(9) || chr(10) || chr(13) || chr(12))) AS plain FROM pages")
def strip_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(X.strip_tags(F.col("html")), 256).alias("plain"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12))) AS body FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(X.html_to_text(F.col("html")), 256).alias("body"))


@query(r"""WITH b AS (SELECT page_id, ltrim(list_last(string_split(x, '/')), '.') AS base FROM (SELECT page_id, [url, '.bashrc', 'a/b.c/Report.PDF', url || '/x.tar.gz', 'end.'][(page_id % 5 + 1)::INT] AS x FROM pages))
SELECT page_id, CASE WHEN base NOT LIKE '%.%' OR lower(list_last(string_split(base, '.'))) = '' THEN 'txt' ELSE lower(list_last(string_split(base, '.'))) END AS kind FROM b""")
def file_type(t: Tables) -> DataFrame:
    name = F.element_at(F.array("url", F.lit(".bashrc"), F.lit("a/b.c/Report.PDF"), F.concat(F.col("url"), F.lit("/x.tar.gz")), F.lit("end.")), (F.col("page_id") % 5 + 1).cast("int"))
    return t.pages.select("page_id", X.file_type(name).alias("kind"))


@query(r"SELECT doc_id, trim(regexp_replace(left(text, 50), '[^\p{L}\p{N} \-_]', '', 'g')) AS name FROM documents")
def safe_filename(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.safe_filename(F.col("text")).alias("name"))


_URLS = "[url, 'http://a:b@10.0.0.1/x', 'HTTPS://Example.org/y', 'http://user@my-corp.org', 'https://e.org/?u=localhost', 'ftp://e.org', 'http://172.99.0.1:80/']"


@query(f"""SELECT page_id, regexp_matches(lower(x), '^https?://') AND NOT regexp_matches(h, 'localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|internal|intranet|private|corp') AND NOT regexp_matches(h, '^(10|172|192\\.168)\\.') AS allowed
FROM (SELECT page_id, x, split_part(list_last(string_split(split_part(split_part(split_part(lower(x), '://', 2), '/', 1), '?', 1), '@')), ':', 1) AS h FROM (SELECT page_id, {_URLS}[(page_id % 7 + 1)::INT] AS x FROM pages))""")
def url_guard(t: Tables) -> DataFrame:
    """Hosts without user and port, schemes in either case."""
    urls = ("http://a:b@10.0.0.1/x", "HTTPS://Example.org/y", "http://user@my-corp.org", "https://e.org/?u=localhost", "ftp://e.org", "http://172.99.0.1:80/")
    url = F.element_at(F.array("url", *map(F.lit, urls)), (F.col("page_id") % 7 + 1).cast("int"))
    return t.pages.select("page_id", X.url_allowed(url).alias("allowed"))


# fixed values: packages that may be installed
PACKAGES = """numpy pandas scipy statsmodels matplotlib seaborn plotly bokeh altair pygal scikit-learn sklearn xgboost lightgbm catboost torch torchvision torchaudio
tensorflow keras transformers datasets accelerate nltk spacy gensim jieba snownlp pillow opencv-python opencv-python-headless imageio requests httpx aiohttp urllib3
beautifulsoup4 bs4 lxml html5lib cssselect pyquery parsel openpyxl xlrd xlwt python-docx PyPDF2 pdfplumber python-pptx csvkit sqlalchemy pymysql psycopg2-binary redis pymongo
tqdm loguru rich typer click pydantic python-dotenv python-dateutil pytz sympy networkx igraph faker arrow pendulum humanize tabulate prettytable colorama""".split()

_WANTED = ("NumPy >=1.0", " pandas==2.1 ", "scikit-learn~=1.4", "left-pad", "PyPDF2", "torch!=2.0", "os")


@query(f"SELECT p_partkey, k AS package, k IN ({', '.join(repr(x) for x in PACKAGES)}) AS allowed FROM (SELECT p_partkey, ['numpy', 'pandas', 'scikit-learn', 'left-pad', 'pypdf2', 'torch', 'os'][(p_partkey % 7 + 1)::INT] AS k FROM part)")
def package_allow(t: Tables) -> DataFrame:
    """Names are compared in lower case with the list as it is, so one with capitals in the list is never met."""
    name = X.package_name(F.element_at(F.array(*map(F.lit, _WANTED)), (F.col("p_partkey") % 7 + 1).cast("int")))
    return t.part.select("p_partkey", name.alias("package"), name.isin(*PACKAGES).alias("allowed"))


_TAGGED_WHOLE = "'<think>' || text || '</think><answer>' || role || '</answer>'"


@query(f"SELECT conv_id, turn, trim(regexp_extract(x, '(?s)<think>(.*?)</think>', 1), ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS thought, role AS answer, CASE WHEN turn % 2 = 0 THEN role END AS tool FROM (SELECT *, {_TAGGED_WHOLE} AS x FROM conversations)")
def parse_react_whole(t: Tables) -> DataFrame:
    """Tagged replies with a call: valid JSON, with an apostrophe in it, as it is, else with its single quotes as double ones."""
    action = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<action>{'tool': '"), F.col("role"), F.lit("'}</action>"))).when(F.col("turn") % 2 == 0, F.concat(F.lit('<action>{"tool": "'), F.col("role"), F.lit("\", \"say\": \"it's\"}</action>"))).otherwise("")
    x = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"), action, F.lit("<answer>"), F.col("role"), F.lit("</answer>"))
    action = X.within(F.col("x"), "action")
    read = lambda c: F.from_json(c, "tool string, say string", {"allowSingleQuotes": "false"})["tool"]
    rows = t.conversations.withColumn("x", x)
    tool = F.coalesce(read(action), read(F.replace(action, F.lit("'"), F.lit('"'))))
    return rows.select("conv_id", "turn", X.within(F.col("x"), "think").alias("thought"), X.within(F.col("x"), "answer").alias("answer"), tool.alias("tool"))


query(ORACLES["parse_react_whole"], "parse_react")(parse_react_whole)


_BLOCK = r"(?s)```(\w+)?\n(.*?)\n?```"


@query(rf"""WITH x AS (SELECT conv_id, turn, 'before ```' || CASE WHEN turn % 2 = 0 THEN 'sql' ELSE '' END || chr(10) || text || chr(10) || '``` after' AS x FROM conversations),
b AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '{_BLOCK}', 1)) AS lang, unnest(regexp_extract_all(x, '{_BLOCK}', 2)) AS code FROM x)
SELECT conv_id, turn, CASE WHEN coalesce(lang, '') = '' THEN 'python' ELSE lang END AS lang, length(code) AS n, sha256(code) AS code_sha256 FROM b""")
def code_blocks_whole(t: Tables) -> DataFrame:
    """Whole messages as code; one with a fence in it ends its block there, as in any reply."""
    lang = F.when(F.col("turn") % 2 == 0, "sql").otherwise("")
    rows = t.conversations.withColumn("x", F.concat(F.lit("before ```"), lang, F.lit("\n"), F.col("text"), F.lit("\n``` after")))
    parts = F.arrays_zip(F.regexp_extract_all("x", F.lit(_BLOCK), F.lit(1)).alias("lang"), F.regexp_extract_all("x", F.lit(_BLOCK), F.lit(2)).alias("code"))
    return rows.select("conv_id", "turn", F.inline(parts)).select("conv_id", "turn", F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("python")).alias("lang"), F.length("code").cast("long").alias("n"), F.sha2("code", 256).alias("code_sha256"))


query(ORACLES["code_blocks_whole"], "code_blocks")(code_blocks_whole)


@query("SELECT p_partkey, least(15 + ln(p_size + 1) * 3, 25) AS size, CASE WHEN length(p_name) > 30 THEN left(p_name, 30) || '...' ELSE p_name END AS label FROM part")
def graph_node_size(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.node_size(F.col("p_size")).alias("size"), X.truncated(F.col("p_name"), 30).alias("label"))


@query("""SELECT c_custkey, round(sqrt(abs(c_acctbal)), 4) AS root, round(sin(c_acctbal), 4) AS sine, round(atan(c_acctbal), 4) AS arc, round(log10(abs(c_acctbal) + 1), 4) AS tens, round(log2(abs(c_acctbal) + 1), 4) AS twos,
round(exp(-abs(c_acctbal) / 10000), 4) AS e, floor(c_acctbal)::BIGINT AS low, ceil(c_acctbal)::BIGINT AS high, ((c_custkey % 7 - 3) % 3 + 3) % 3 AS rest, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE round(c_acctbal / (c_custkey % 5), 4) END AS part FROM customer""")
def math_functions(t: Tables) -> DataFrame:
    a = F.col("c_acctbal")
    r = lambda c, x: F.round(c, 4).alias(x)
    return t.customer.select(
        "c_custkey", r(F.sqrt(F.abs(a)), "root"), r(F.sin(a), "sine"), r(F.atan(a), "arc"), r(F.log10(F.abs(a) + 1), "tens"), r(F.log2(F.abs(a) + 1), "twos"), r(F.exp(-F.abs(a) / 10000), "e"),
        F.floor(a).alias("low"), F.ceil(a).alias("high"), F.pmod(F.col("c_custkey") % 7 - 3, F.lit(3)).alias("rest"), r(F.try_divide(a, F.col("c_custkey") % 5), "part"),
    )


@query("""SELECT p_partkey, u AS unit, CASE u WHEN 'km' THEN p_retailprice * 1000 / 1.0 WHEN 'kg' THEN p_retailprice * 1000 / 453.592::DOUBLE WHEN 'MB' THEN p_retailprice * 1048576 / 1073741824 WHEN 'C' THEN p_retailprice * 9 / 5 + 32 WHEN '千米' THEN p_retailprice * 1000
WHEN '华氏度' THEN (p_retailprice - 32) * 5 / 9 END AS converted, CASE WHEN u = 'ft' THEN 'unsupported_unit' WHEN u = '吨' THEN 'category_mismatch' END AS error FROM (SELECT *, ['km', 'kg', 'MB', 'C', 'ft', '千米', '吨', '华氏度'][(p_partkey % 8 + 1)::INT] AS u FROM part)""")
def unit_convert(t: Tables) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = t.part.withColumn("u", pick("km", "kg", "MB", "C", "ft", "千米", "吨", "华氏度")).withColumn("to", pick("m", "lb", "GB", "fahrenheit", "m", "米", "m", "Celsius"))
    return rows.withColumn("r", M.conversion(F.col("p_retailprice"), F.col("u"), F.col("to"))).select("p_partkey", F.col("u").alias("unit"), F.col("r.result").alias("converted"), "r.error")


@query("SELECT event_id, strftime(ts, '%Y年%m月%d日') AS day, (isodow(ts) - 1)::INT AS weekday, floor(epoch(ts))::BIGINT AS seconds, strftime(ts, '%H:%M') AS clock FROM events")
def datetime_format(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_format(ts, "yyyy年MM月dd日").alias("day"), F.weekday(ts).alias("weekday"), F.unix_timestamp(ts).alias("seconds"), F.date_format(ts, "HH:mm").alias("clock"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS week, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS month FROM orders")
def expiry(t: Tables) -> DataFrame:
    day = lambda k, a: F.date_format(F.col("o_orderdate") + F.expr(f"interval {k} days"), "yyyy-MM-dd").alias(a)
    return t.orders.select("o_orderkey", day(7, "week"), day(30, "month"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS pub_year FROM orders")
def pub_year(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "n.d.").otherwise(F.col("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", F.left(text, F.lit(4)).try_cast("int").alias("pub_year"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 50 ELSE 100 END AS progress, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status FROM orders")
def status_progress(t: Tables) -> DataFrame:
    status = F.create_map(*map(F.lit, ("O", "pending", "P", "processing", "F", "completed")))[F.col("o_orderstatus")]
    progress = F.create_map(*map(F.lit, ("pending", 0, "processing", 50, "completed", 100, "failed", 0)))[status]
    return t.orders.select("o_orderkey", progress.alias("progress"), status.alias("status"))


@query("SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 14 THEN 'noon' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS greeting FROM events")
def hour_bucket(t: Tables) -> DataFrame:
    h = F.hour("ts")
    return t.events.select("event_id", F.when(h < 6, "night").when(h < 12, "morning").when(h < 14, "noon").when(h < 18, "afternoon").otherwise("evening").alias("greeting"))


@query("SELECT event_id, coalesce((props::JSON->>'k')::INT, -1) AS k, coalesce(props::JSON->>'absent', 'none') AS absent FROM events")
def json_props(t: Tables) -> DataFrame:
    p = F.from_json("props", "k int, absent string")
    return t.events.select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), F.coalesce(p["absent"], F.lit("none")).alias("absent"))


@query("SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std_pop, stddev_samp(value) AS std_samp, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def describe(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.stddev_samp(v).alias("std_samp"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("""WITH q AS (SELECT event_type, count(*) AS n, count(value) AS given, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS middle, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
w AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT w.event_type, any_value(n) AS n, any_value(given) AS given, round(any_value(q1), 6) AS q1, round(any_value(middle), 6) AS middle, round(any_value(q3), 6) AS q3,
min(value) FILTER (WHERE value >= lo) AS low, max(value) FILTER (WHERE value <= hi) AS high, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers FROM w JOIN events USING (event_type) GROUP BY w.event_type""")
def box(t: Tables) -> DataFrame:
    """What a box plot draws of each kind's values: quartiles, whiskers within one and a half boxes, and how many lie beyond."""
    return R.box(t.events, "event_type", "value")


@query("""WITH r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY value) - 1) / greatest(count(*) OVER (PARTITION BY event_type) - 1, 1) AS below FROM events WHERE value IS NOT NULL)
SELECT event_type, true AS q1, true AS middle, true AS q3 FROM r GROUP BY event_type""")
def quartile_sketch(t: Tables) -> DataFrame:
    """Quartiles by a sketch: each is a value of the column whose rank is within a hundredth of the rows of the one asked for."""
    rows = t.events.where("value is not null").select("event_type", "value")
    sketch = rows.groupBy("event_type").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 1000).alias("s"), F.count(F.lit(1)).alias("n"))
    both = rows.join(sketch, "event_type")
    near = [F.count_if(F.col("value") < F.col("s")[k]) / F.first("n") <= p + 0.01 for k, p in enumerate((0.25, 0.5, 0.75))]
    reach = [F.count_if(F.col("value") <= F.col("s")[k]) / F.first("n") >= p - 0.01 for k, p in enumerate((0.25, 0.5, 0.75))]
    return both.groupBy("event_type").agg(*[(a & b).alias(x) for a, b, x in zip(near, reach, ("q1", "middle", "q3"), strict=True)])


@query("""SELECT 'events' AS name, count(*) AS n_rows, 6 AS n_columns, 'event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string' AS kinds FROM events
UNION ALL SELECT 'part', count(*), 6, 'p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double' FROM part""")
def shapes(t: Tables) -> DataFrame:
    """Rows, columns and types of tables."""
    return R.shape(t.events, "events").union(R.shape(t.part, "part"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS qe, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_tax), 6) AS et FROM lineitem")
def correlation(t: Tables) -> DataFrame:
    c = lambda a, b, x: F.round(F.corr(a, b), 6).alias(x)
    return t.lineitem.agg(c("l_quantity", "l_extendedprice", "qe"), c("l_quantity", "l_discount", "qd"), c("l_extendedprice", "l_tax", "et"))


@query("SELECT least(floor((l_quantity - lo) / nullif(hi - lo, 0) * 30), 29)::BIGINT AS bin, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    ends = F.broadcast(t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")))
    place = F.least(F.floor(F.try_divide(F.col("l_quantity") - F.col("lo"), F.col("hi") - F.col("lo")) * 30), F.lit(29)).cast("long")
    return t.lineitem.crossJoin(ends).groupBy(place.alias("bin")).agg(n("n"))


def _chunk_sql(size: int = 500, overlap: int = 50) -> str:
    """The chunker as a recursive query: ends are looked for in the reversed window; texts without blank spans of a chunk's length."""

    def last(needle: str, at: str) -> str:
        back = needle[::-1].replace("\n", "' || chr(10) || '")
        return f"(CASE WHEN instr(reverse(substr(t, {at} + 1, {size})), '{back}') > 0 THEN {size} + 1 - {len(needle)} - instr(reverse(substr(t, {at} + 1, {size})), '{back}') ELSE -1 END)"

    def end(at: str) -> str:
        half = size // 2
        best = " ".join(f"WHEN {last(x, at)} > {half} THEN {last(x, at)} + {len(x)}" for x in ENDINGS)
        line = f"CASE WHEN {last(chr(10), at)} > {half} THEN {last(chr(10), at)} + 1 ELSE {size} END"
        return f"(CASE WHEN {last(chr(10) * 2, at)} > {half} THEN {last(chr(10) * 2, at)} + 2 WHEN coalesce(CASE {best} END, {size}) = {size} THEN {line} ELSE CASE {best} END END)"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, t, 0 AS i, 0::BIGINT AS s, (CASE WHEN length(t) <= {size} THEN length(t) ELSE {end("0")} END)::BIGINT AS e FROM d
UNION ALL SELECT doc_id, t, i + 1, e - {overlap}, (CASE WHEN e - {overlap} + {size} >= length(t) THEN length(t) ELSE e - {overlap} + {end(f"(e - {overlap})")} END)::BIGINT FROM c WHERE e < length(t))"""


def chunks(t: Tables) -> DataFrame:
    return chunk(t.documents, "doc_id", "text", 500, 50)


@query(_chunk_sql() + " SELECT doc_id, i::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, sha256(substr(t, s + 1, e - s)) AS content_hash FROM c")
def chunk_documents(t: Tables) -> DataFrame:
    return chunks(t).select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("content", 256).alias("content_hash"))


@query(_chunk_sql() + " SELECT doc_id, i::INT AS chunk_index, 50 AS overlap FROM c WHERE i > 0")
def chunk_overlap_check(t: Tables) -> DataFrame:
    """How far each chunk reaches into the one before."""
    before = F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks(t).select("doc_id", "chunk_index", (before - F.col("start_char")).alias("overlap")).where("overlap is not null")


@query(_chunk_sql() + " SELECT doc_id, i::INT AS chunk_index, e::INT AS end_char, (SELECT count(*) FROM c) AS total FROM c ORDER BY doc_id, i LIMIT 50")
def chunk_page(t: Tables) -> DataFrame:
    """Chunks of the first documents, in order, with their number."""
    return page_with_total(chunks(t).select("doc_id", "chunk_index", "end_char"), [F.asc("doc_id"), F.asc("chunk_index")], 0, 50)


@query(_chunk_sql() + """, k AS (SELECT doc_id, count(*) AS n, sum(floor(len(regexp_extract_all(substr(t, s + 1, e - s), '[\\x{4e00}-\\x{9fff}]')) / 1.5::DOUBLE + (e - s - len(regexp_extract_all(substr(t, s + 1, e - s), '[\\x{4e00}-\\x{9fff}]'))) / 4.0::DOUBLE))::BIGINT AS tokens FROM c GROUP BY doc_id),
a AS (SELECT documents.doc_id, source, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(n, 0) AS chunk_count, coalesce(tokens, 0) AS tokens FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id)
SELECT doc_id, status, chunk_count, b.document_count, b.total_chunks, b.total_tokens FROM a JOIN (SELECT source, count(*) FILTER (WHERE status = 'completed') AS document_count, sum(chunk_count)::BIGINT AS total_chunks, sum(tokens)::BIGINT AS total_tokens FROM a GROUP BY source) b USING (source)""")
def ingest_pipeline(t: Tables) -> DataFrame:
    """Each document's status, chunks and tokens, and its knowledge base's counters."""
    by = chunks(t).groupBy("doc_id").agg(n("chunk_count"), F.sum(X.token_estimate(F.col("content"))).alias("token_count"))
    docs = t.documents.select("doc_id", "source").join(by, "doc_id", "left")
    docs = docs.withColumn("status", F.when(F.col("chunk_count").isNull(), "failed").otherwise("completed"))
    kb = docs.groupBy("source").agg(F.count_if(F.col("status") == "completed").alias("document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    return docs.join(kb, "source").select("doc_id", "status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "document_count", "total_chunks", "total_tokens")


@query(ORACLES["ingest_pipeline"])
def ingest_stream(t: Tables) -> DataFrame:
    """As ingest_pipeline, by a stream over the table's files into a store, and what the store shows when all are in."""
    root = shared_folder(t.spark)
    store = Store(t.spark, f"{root}/store")
    uploads = t.stream("documents", ["doc_id", "source", "text"])
    ingest(uploads.select("doc_id", F.col("source").alias("kb"), "text", F.lit(500).alias("chunk_size"), F.lit(50).alias("chunk_overlap")), store, f"{root}/checkpoint").awaitTermination()
    counters = ["document_count", "total_chunks", "total_tokens"]
    docs = store.documents().join(store.counters(), "kb", "left")
    return docs.select("doc_id", "status", F.col("chunk_count").cast("long").alias("chunk_count"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])


@query("SELECT vec_id, true AS timed FROM (SELECT e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY d, vec_id LIMIT 10")
def search_timed(t: Tables) -> DataFrame:
    """The nearest vectors with the time that finding them took."""
    asked = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    near = t.embeddings.crossJoin(asked).select("vec_id", (1 - V.cosine(F.col("embedding"), F.col("q"))).alias("d")).orderBy("d", "vec_id").limit(10)
    return timed(near.select("vec_id")).select("vec_id", (F.col("elapsed_ms") >= 0).alias("timed"))
