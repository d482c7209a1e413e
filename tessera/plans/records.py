"""Queries of record changes, access, sources by id, retrieval with all its joins, and keyed histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import mutations as C
from tessera.operators import relational as R
from tessera.operators.caches import cached
from tessera.session import Tables, kept, shared_folder, written
from tessera.sources import bibliography as B

from .library import n
from .registry import query

# ---- retrieval


def retrieve(t: Tables, query_id: int, kb_ids: list[int] | None = None, top_k: int = 20, threshold: float = 0.1) -> DataFrame:
    """Chunks nearest to one by cosine, with their document and knowledge base, from a threshold on; chunks without a vector are left out.

    embeddings stand for chunks (spread over all documents), documents for documents of the knowledge base doc_id % 25, nation for those.
    """
    asked = t.embeddings.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    chunk = t.embeddings.where("embedding is not null").crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(t.documents.agg(F.max("doc_id").alias("last")))).select("vec_id", (F.col("vec_id") * 7919 % (F.col("last") + 1)).alias("document"), (1 - V.cosine(F.col("embedding"), F.col("q"))).alias("distance"))
    docs = t.documents.select(F.col("doc_id").alias("document"), F.col("lang"), (F.col("doc_id") % 25).alias("kb"))
    if kb_ids is not None:
        docs = docs.where(F.col("kb").isin(kb_ids))
    found = chunk.where(F.col("distance") <= 1 - threshold).join(docs, "document").join(t.nation, F.col("kb") == F.col("n_nationkey"))
    return found.orderBy("distance", "vec_id").limit(top_k).select("vec_id", "document", F.col("n_name").alias("kb_name"), F.round(1 - F.col("distance"), 4).alias("score"))


_RETRIEVE = """SELECT vec_id, document, n_name AS kb_name, round(1 - d, 4) AS score FROM (SELECT e.vec_id, e.vec_id * 7919 % ((SELECT max(doc_id) FROM documents) + 1) AS document, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.embedding IS NOT NULL) c JOIN documents ON doc_id = document JOIN nation ON n_nationkey = doc_id % 25 WHERE d <= 0.9"""


@query(f"{_RETRIEVE} ORDER BY d, vec_id LIMIT 20")
def retrieval(t: Tables) -> DataFrame:
    return retrieve(t, 0)


@query(f"{_RETRIEVE} AND n_nationkey IN (3, 7, 11, 19) ORDER BY d, vec_id LIMIT 20")
def retrieval_in_kbs(t: Tables) -> DataFrame:
    return retrieve(t, 0, [3, 7, 11, 19])


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: floor(x * 100)::INT::VARCHAR), ',') || ']' AS literal, floor(embedding[1] * 100)::DOUBLE AS first FROM embeddings")
def vector_literal(t: Tables) -> DataFrame:
    """A vector as text, and read again. Products are of single precision, as those of the vectors' SQL: in double precision 0.29 as float is just under 29 hundredths."""
    literal = X.vector_text(F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("int")))
    return t.embeddings.select("vec_id", literal.alias("literal"), F.get(X.vector_of(literal), F.lit(0)).cast("double").alias("first"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1) // 20 AS batch FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) <> ''")
def embedding_batches(t: Tables) -> DataFrame:
    """Texts in batches of 20 within their request (a hundred documents each), blanks left out."""
    some = t.documents.where(F.btrim("text", F.lit(X.BLANK)) != "").select(F.floor(F.col("doc_id") / 100).alias("request"), "doc_id")
    place = F.row_number().over(Window.partitionBy("request").orderBy("doc_id")) - 1
    return some.select("doc_id", F.floor(place / 20).cast("long").alias("batch"))


# ---- changes


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, 'mine' AS description, 3 AS documents FROM nation UNION ALL SELECT s_suppkey, s_name, NULL, 0 FROM supplier")
def insert_with_defaults(t: Tables) -> DataFrame:
    """New rows get the defaults of the columns that they don't give."""
    table = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("mine").alias("description"), F.lit(3).alias("documents"))
    return C.insert_with_defaults(table, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), {"documents": 0})


_EDGES = "SELECT DISTINCT l_partkey AS paper, l_suppkey AS collection FROM lineitem WHERE l_linenumber"


@query(f"""WITH old AS ({_EDGES} = 2), asked AS ({_EDGES} = 1) SELECT paper, collection FROM asked WHERE collection IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)
AND NOT EXISTS (SELECT 1 FROM old WHERE old.paper = asked.paper AND old.collection = asked.collection)""")
def edge_insert(t: Tables) -> DataFrame:
    """Edges asked for, into collections of one's own, that aren't there yet."""
    edges = lambda k: t.lineitem.where(F.col("l_linenumber") == k).select(F.col("l_partkey").alias("paper"), F.col("l_suppkey").alias("collection")).distinct()
    own = t.supplier.where("s_nationkey < 10").select(F.col("s_suppkey").alias("collection"))
    return C.new_edges(edges(2), edges(1), own, ["paper", "collection"], "collection").select("paper", "collection")


_USERS = "SELECT c_custkey, c_mktsegment || c_custkey % 400 AS email, c_nationkey || '-' || c_custkey % 30 AS username FROM customer"


@query(f"""WITH RECURSIVE c AS ({_USERS}), n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM c WHERE c_custkey % 3 <> 0),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS c_custkey, NULL::VARCHAR AS outcome, (SELECT list(email) FROM c WHERE c_custkey % 3 = 0) AS emails, (SELECT list(username) FROM c WHERE c_custkey % 3 = 0) AS names
      UNION ALL SELECT i, c_custkey, outcome, CASE outcome WHEN 'ok' THEN list_append(emails, email) ELSE emails END, CASE outcome WHEN 'ok' THEN list_append(names, username) ELSE names END
      FROM (SELECT n.*, emails, names, CASE WHEN list_contains(emails, email) THEN 'email_taken' WHEN list_contains(names, username) THEN 'username_taken' ELSE 'ok' END AS outcome FROM r JOIN n ON n.i = r.i + 1))
SELECT c_custkey, outcome FROM r WHERE i > 0""")
def register_check(t: Tables) -> DataFrame:
    """Users register one after the other: the email is looked at before the user's name, and who was let in before counts."""
    name = F.concat(F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_custkey") % 30).cast("string"))
    users = t.customer.select("c_custkey", F.concat("c_mktsegment", (F.col("c_custkey") % 400).cast("string")).alias("email"), name.alias("username"))
    old, new = users.where("c_custkey % 3 = 0"), users.where("c_custkey % 3 <> 0")
    return C.registered(new, old, "c_custkey", ["email", "username"]).select("c_custkey", "outcome")


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 10 NOT IN (1, 2) UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 10 = 1
UNION ALL SELECT p_partkey + 1000000, p_type FROM part WHERE p_partkey % 10 = 3""")
def record_changes(t: Tables) -> DataFrame:
    """Creates, updates and deletes of records in one pass over the table."""
    table = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    k = F.col("p_partkey") % 10
    kind = F.when(k == 1, "update").when(k == 2, "delete").when(k == 3, "create")
    changes = t.part.where(kind.isNotNull()).select(F.when(k == 3, F.col("p_partkey") + 1000000).otherwise(F.col("p_partkey")).alias("id"), F.when(k == 3, F.col("p_type")).otherwise(F.col("p_brand")).alias("name"), kind.alias("change"))
    return C.with_changes(table, changes, "id")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM (SELECT user_id, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id + 1000000 FROM events WHERE event_type = 'click') GROUP BY user_id")
def search_history_append(t: Tables) -> DataFrame:
    """A history with further searches appended."""
    old = t.events.where("event_type = 'view'").select("user_id", "event_id")
    new = t.events.where("event_type = 'click'").select("user_id", (F.col("event_id") + 1000000).alias("event_id"))
    return old.unionByName(new).groupBy("user_id").agg(n("n"), F.max("event_id").alias("last"))


# ---- access and lists


@query("""SELECT o_orderkey, c_custkey, o_custkey = c_custkey OR (o_orderstatus = 'F' AND o_orderkey % 1500 = c_custkey) OR (o_orderstatus = 'P' AND o_orderkey % 25 = c_nationkey) AS allowed
FROM orders JOIN customer ON c_custkey IN (o_custkey, o_orderkey % 1500)""")
def share_access(t: Tables) -> DataFrame:
    """Whether the owner or a named user may open a share: owner, user or group; expiry plays no part here."""
    share = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.explode(F.array_distinct(F.array("o_custkey", F.col("o_orderkey") % 1500))).alias("c_custkey"))
    user = t.customer.select("c_custkey", "c_nationkey")
    named = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 1500 == F.col("c_custkey"))
    group = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 25 == F.col("c_nationkey"))
    return share.join(user, "c_custkey").select("o_orderkey", "c_custkey", ((F.col("o_custkey") == F.col("c_custkey")) | named | group).alias("allowed"))


_VARS = "SELECT p_partkey, ['x', '_hidden', 'model', 'f', 'T'][(p_partkey % 5 + 1)::INT] || p_partkey AS name, ['int', 'str', 'DataFrame', 'function', 'type'][(p_partkey % 5 + 1)::INT] AS kind FROM part"


@query(f"SELECT p_partkey, name, kind FROM ({_VARS}) WHERE name NOT LIKE '\\_%' ESCAPE '\\' AND kind NOT IN ('function', 'type') AND kind ILIKE '%frame%'")
def variable_filter(t: Tables) -> DataFrame:
    """Variables that are neither private nor callable nor types, of a kind that contains a text in either case."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = t.part.select("p_partkey", F.concat(pick("x", "_hidden", "model", "f", "T"), F.col("p_partkey").cast("string")).alias("name"), pick("int", "str", "DataFrame", "function", "type").alias("kind"))
    return rows.where(~F.col("name").startswith("_") & ~F.col("kind").isin("function", "type") & R.contains_any("frame", "kind"))


@query("""SELECT p_partkey, p_size FROM part WHERE p_size IS NOT NULL AND p_partkey % 2 = 0 AND p_brand >= 'Brand#2' AND (p_type = 'PROMO' OR p_size % 7 = 3)""")
def paper_filter_rest(t: Tables) -> DataFrame:
    """Papers by read mark, source and tag, with a rating. A paper's tags are its type and the rest of its size."""
    tags = F.array("p_type", F.concat(F.lit("size "), (F.col("p_size") % 7).cast("string")))
    given = R.all_given(F.col("p_partkey") % 2 == 0, F.col("p_brand") >= "Brand#2", F.arrays_overlap(tags, F.array(F.lit("PROMO"), F.lit("size 3"))), F.col("p_size").isNotNull())
    return t.part.where(given).select("p_partkey", "p_size")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS place FROM events""")
def severity_order(t: Tables) -> DataFrame:
    """Issues of each source: errors, then warnings, then the rest, as they came."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(rank, "event_id")).cast("long")
    return t.events.select("event_id", "user_id", place.alias("place"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100")
def messages_page(t: Tables) -> DataFrame:
    """Messages of conversations, oldest first."""
    return R.paginate(t.conversations, [F.asc("conv_id"), F.asc("turn")], 0, 100).select("conv_id", "turn", "role")


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 50")
def share_detail(t: Tables) -> DataFrame:
    """The last 50 things of what is shared."""
    return R.paginate(t.documents.where("source = 'src3'"), [F.desc("n_chars"), F.asc("doc_id")], 0, 50).select("doc_id", "lang")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'pinned' ELSE 'normal' END AS part FROM customer")
def pinned_and_normal(t: Tables) -> DataFrame:
    """Announcements in two lists: those pinned, and the others."""
    pinned, normal = R.split(t.customer, F.col("c_acctbal") > 5000)
    return pinned.select("c_custkey", F.lit("pinned").alias("part")).union(normal.select("c_custkey", F.lit("normal").alias("part")))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS code_cells, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS text_cells FROM orders GROUP BY o_custkey")
def client_counts(t: Tables) -> DataFrame:
    code = F.col("o_orderpriority") == "1-URGENT"
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(code).alias("code_cells"), F.count_if(~code).alias("text_cells"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) // 4 END AS tokens FROM conversations WHERE role = 'assistant'")
def reply_tokens(t: Tables) -> DataFrame:
    """A reply's total tokens; a usage of none counts as not given."""
    usage = F.when(F.col("turn") % 3 == 0, F.lit(0).cast("long")).otherwise(F.floor(F.length("text") / 4))
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.nullif(usage, F.lit(0).cast("long")).alias("tokens"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '.250000' END AS iso FROM orders")
def iso_format(t: Tables) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 250 milliseconds"))
    return t.orders.select("o_orderkey", X.iso_time(at).alias("iso"))


@query("SELECT page_id, left(html, 5000) AS part, left(html, 1000) || '...' AS shown FROM pages")
def html_cut(t: Tables) -> DataFrame:
    """A page's markup as data, up to 5000 characters, and what is shown of it: 1000, and dots whatever its length."""
    part = F.left("html", F.lit(5000))
    return t.pages.select("page_id", part.alias("part"), F.concat(F.left(part, F.lit(1000)), F.lit("...")).alias("shown"))


@query("SELECT p_partkey, 'name=' || p_name || ';brand=' || p_brand AS entries FROM part")
def first_map_entries(t: Tables) -> DataFrame:
    """The first two entries of a map, in its order."""
    pairs = X.first_entries(F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("type"), "p_type"), 2)
    return t.part.select("p_partkey", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


@query("SELECT 1 AS ok, 14 AS tables")
def health(t: Tables) -> DataFrame:
    """That the session answers, and how many tables it finds."""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    return t.spark.sql("SELECT 1 AS ok").withColumn("tables", F.lit(len([x for x in names if getattr(t, x).columns])))


@query("SELECT c_custkey, coalesce(n, 0) AS notebooks, coalesce(latest, -1) AS latest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS latest FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def notebooks_cached(t: Tables) -> DataFrame:
    """Two readings of the users' notebooks, their number and the latest, from one scan that is kept for both and let go then."""
    with kept(t.orders.select("o_custkey", "o_orderkey")) as orders:
        counts = written(orders.groupBy("o_custkey").agg(n("n")))
        latest = written(orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest")))
    by = counts.join(latest, "o_custkey")
    return t.customer.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("notebooks"), F.coalesce("latest", F.lit(-1)).alias("latest"))


# ---- sources


def _works(t: Tables) -> DataFrame:
    e = "struct(concat('p', p_partkey) as paperId, p_name as title, 1990 + p_size as year, p_brand as venue, p_size as citationCount, struct(p_partkey || '.1' as ArXiv) as externalIds, array(struct(p_type as name, concat('a', p_partkey % 50) as authorId)) as authors, if(p_partkey % 2 = 0, struct('u' as url), null) as openAccessPdf, array(p_brand) as fieldsOfStudy)"
    return B.parse_s2(t.part.select(F.to_json(F.expr(e)).alias("j")), "j")


@query("SELECT 'p' || p_partkey AS external_id, 1990 + p_size AS year FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#22') AND p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 100")
def s2_search(t: Tables) -> DataFrame:
    """Papers of a range of years, some fields, open access only; no more than 100 at a time."""
    found = B.filtered(_works(t), years=(2000, 2010), fields=["Brand#11", "Brand#22"], open_access=True)
    return B.paged(found.withColumn("k", F.substring("external_id", 2, 20).cast("long")), [F.asc("k")], limit=500, most=100).select("external_id", "year")


@query("SELECT 'p' || p_partkey AS external_id, p_name AS title FROM part WHERE p_partkey = 42 UNION ALL SELECT 'p' || p_partkey, p_name FROM part WHERE p_partkey % 50 = 7")
def s2_by_id(t: Tables) -> DataFrame:
    """A paper by its id, and those of an author by theirs."""
    works = _works(t)
    return B.by_ids(works, "external_id", ["p42"]).union(works.where(F.exists("authors", lambda a: a["authorId"] == "a7"))).select("external_id", "title")


@query("SELECT p_partkey || '.1' AS arxiv_id, p_name AS title FROM part WHERE p_partkey IN (3, 5, 8)")
def arxiv_by_id(t: Tables) -> DataFrame:
    """Papers by arXiv ids as users write them."""
    ids = t.spark.createDataFrame([("arXiv:3.1v2",), ("5.1",), ("ARXIV:8.1",)], "id string").select(X.arxiv_id(F.col("id")).alias("arxiv_id"))
    return _works(t).join(ids, "arxiv_id", "left_semi").select("arxiv_id", "title")


@query("SELECT p_partkey AS pmid, p_name AS title FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' ORDER BY p_size DESC, p_partkey LIMIT 30 OFFSET 10)")
def pubmed_fetch(t: Tables) -> DataFrame:
    """Two steps: a page of ids that a search finds, then the articles with these ids."""
    ids = R.paginate(t.part.where(R.contains_any("a", "p_name")), [F.desc("p_size"), F.asc("p_partkey")], 10, 30).select(F.col("p_partkey").alias("pmid"))
    return t.part.select(F.col("p_partkey").alias("pmid"), F.col("p_name").alias("title")).join(ids, "pmid", "left_semi")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'arxiv' WHEN 'O' THEN 'semantic_scholar' ELSE 'semantic_scholar' END AS source, p_name AS title FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""")
def source_router(t: Tables) -> DataFrame:
    """Each request goes to the source that it names, Semantic Scholar where it names none that is known."""
    size = F.broadcast(t.part.agg(F.count(F.lit(1)).alias("size")))
    asked = t.orders.crossJoin(size).select("o_orderkey", (F.col("o_orderkey") % F.col("size")).alias("p_partkey"), F.when(F.col("o_orderstatus") == "F", "arxiv").when(F.col("o_orderstatus") == "P", "unheard of").alias("named"))
    papers = t.part.select("p_partkey", F.col("p_name").alias("title"))
    return B.routed(asked, "named", {"arxiv": papers, "semantic_scholar": papers}, "semantic_scholar", "p_partkey").select("o_orderkey", "source", "title")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


@query("""WITH f AS (SELECT p_partkey || '.1' AS external_id, p_name AS title, '19' || lpad((50 + p_size)::VARCHAR, 2, '0') || '-01-01' AS published, count(*) OVER () AS total
FROM part WHERE lower(p_name || ' about ' || p_type || ' ' || p_brand) LIKE '%a%' AND (p_size % 5 = 1 OR p_size % 7 = 2))
SELECT external_id, title, published, total FROM f ORDER BY published DESC, external_id LIMIT 40 OFFSET 20""")
def arxiv_search(t: Tables) -> DataFrame:
    """The words in any field, one of two categories, by date of submission: a page, and how many there are."""
    k, size = F.col("p_partkey"), F.col("p_size")
    day = _text("19", F.lpad((50 + size).cast("string"), 2, "0"), "-01-01")
    entry = _text("<entry><id>http://arxiv.org/abs/", k, ".1</id><title>", F.col("p_name"), "</title><summary>about ", F.col("p_type"), "</summary><published>", day, "</published><updated>", day, "</updated><author><name>", F.col("p_brand"), '</name></author><category term="five.', size % 5, '"/><category term="seven.', size % 7, '"/></entry>')
    feeds = t.part.groupBy(F.floor(k / 100)).agg(F.array_join(F.collect_list(entry), "").alias("e"), F.count(F.lit(1)).alias("n"))
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/"><o:totalResults>'
    papers = B.parse_arxiv_feeds(feeds.select(_text(head, F.col("n"), "</o:totalResults>", F.col("e"), "</feed>").alias("f")), "f")
    return B.arxiv_search(papers, "A", ["five.1", "seven.2"], "submittedDate", offset=20, limit=40).select("external_id", "title", "published", "total")


@query("""WITH o AS (SELECT p_partkey, p_name, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS total FROM part)
SELECT place, 'W' || p_partkey AS external_id, p_name AS title, (1990 + p_size)::INT AS year, total FROM o WHERE place >= 130 AND place < 190 AND p_size BETWEEN 5 AND 40""")
def openalex_page(t: Tables) -> DataFrame:
    """Results 130 to 189 of a search whose answers have landed in pages of 25, of some years: three pages are read."""
    work = F.to_json(F.struct(_text("https://openalex.org/W", F.col("p_partkey")).alias("id"), F.col("p_name").alias("title"), (1990 + F.col("p_size")).alias("publication_year")))
    row = t.part.select((F.floor(F.col("p_partkey") / 25)).cast("int").alias("page"), F.struct("p_partkey", work.alias("w")).alias("r"))
    works = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["w"]), ",")
    pages = row.groupBy("page").agg(works.alias("w")).crossJoin(F.broadcast(t.part.agg(F.count(F.lit(1)).alias("n"))))
    root = shared_folder(t.spark)
    B.land(pages.select(F.lit("openalex").alias("source"), "page", _text('{"meta": {"count": ', F.col("n"), '}, "results": [', F.col("w"), "]}").alias("body")), root, shelf=4)
    found = B.openalex_results(B.landed(t.spark, root, "openalex", 130, 60, per_page=25, shelf=4), 25).where("place >= 130 and place < 190")
    return B.filtered(found, years=(1995, 2030)).select("place", "external_id", "title", "year", "total")


@query("""SELECT p_partkey::VARCHAR AS external_id, p_name AS title, (1990 + p_size)::INT AS year FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' AND p_size % 3 = 0)""")
def pubmed_two_steps(t: Tables) -> DataFrame:
    """A search gives ids in XML, a second one the articles with these ids, in XML too."""
    k = F.col("p_partkey")
    ids = t.part.where(R.contains_any("a", "p_name") & (F.col("p_size") % 3 == 0)).groupBy(F.floor(k / 100)).agg(F.array_join(F.collect_list(_text("<Id>", k, "</Id>")), "").alias("i"))
    article = _text("<PubmedArticle><PMID>", k, "</PMID><Article><ArticleTitle>", F.col("p_name"), "</ArticleTitle><Journal><PubDate><Year>", 1990 + F.col("p_size"), "</Year></PubDate></Journal></Article></PubmedArticle>")
    sets = t.part.groupBy(F.floor(k / 50)).agg(_text("<s>", F.array_join(F.collect_list(article), ""), "</s>").alias("a"))
    found = B.parse_pubmed_ids(ids.select(_text("<r><IdList>", F.col("i"), "</IdList></r>").alias("f")), "f")
    return B.parse_feeds(sets, "a", B.pubmed_articles).join(found, "external_id", "left_semi").select("external_id", "title", "year")


# ---- references, invitations, saved papers, lists

_REFS = """r AS (SELECT o_orderkey AS share_id, o_custkey, o_orderstatus, ['knowledge_base', 'paper_collection', 'paper', 'notebook', 'other'][(o_orderkey % 5 + 1)::INT] AS kind, o_orderkey // 5 % 3000 AS id FROM orders),
k AS (SELECT 'knowledge_base' AS kind, n_nationkey AS id, n_name AS name, NULL AS year FROM nation UNION ALL SELECT 'paper_collection', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, NULL FROM supplier
UNION ALL SELECT 'paper', p_partkey, p_name, (1990 + p_size)::VARCHAR FROM part UNION ALL SELECT 'notebook', item_id, text, NULL FROM benchmark)"""


@query(f"""WITH {_REFS} SELECT share_id, r.kind, k.name, year, c_name AS owner, CASE o_orderstatus WHEN 'O' THEN n_name WHEN 'F' THEN 'all students' END AS shared_with
FROM r JOIN k ON k.kind = r.kind AND k.id = r.id JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = share_id % 30 WHERE coalesce(k.name, '') <> ''""")
def shared_resources(t: Tables) -> DataFrame:
    """Shares of four kinds with the names of what is shared, of its owner and of those it is shared with; what is gone or has no name drops out."""
    kind = F.element_at(F.array(*map(F.lit, ("knowledge_base", "paper_collection", "paper", "notebook", "other"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = t.orders.select(F.col("o_orderkey").alias("share_id"), "o_custkey", "o_orderstatus", kind.alias("kind"), (F.floor(F.col("o_orderkey") / 5) % 3000).alias("rid"))
    none = F.lit(None)
    targets = {
        "knowledge_base": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), none.alias("detail")),
        "paper_collection": t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), none.alias("detail")),
        "paper": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.create_map(F.lit("year"), (1990 + F.col("p_size")).cast("string")).alias("detail")),
        "notebook": t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("name"), none.alias("detail")),
    }
    named = R.named_references(rows, "kind", "rid", targets)
    owner = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
    group = t.nation.select(F.col("n_nationkey").cast("long").alias("gid"), F.col("n_name").alias("group"))
    out = named.join(owner, "o_custkey").join(group, F.col("share_id") % 30 == F.col("gid"), "left")
    whom = F.when(F.col("o_orderstatus") == "O", F.col("group")).when(F.col("o_orderstatus") == "F", "all students")
    return out.select("share_id", "kind", "name", F.col("detail")["year"].alias("year"), "owner", whom.alias("shared_with"))


@query("""WITH i AS (SELECT o_orderkey AS id, o_custkey % 50 AS f, o_orderkey % 50 AS t, CASE WHEN o_orderstatus <> 'P' THEN 'pending' ELSE 'accepted' END AS status, CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate END AS e FROM orders),
a AS (SELECT *, ['accept', 'reject', 'cancel', 'frown'][(id % 4 + 1)::INT] AS action, CASE WHEN id % 3 = 0 THEN f ELSE t END AS u FROM i WHERE id % 7 <> 0),
b AS (SELECT i.*, action, coalesce(i.status = 'pending' AND CASE action WHEN 'cancel' THEN u = i.f WHEN 'frown' THEN false ELSE u = i.t END, false) AS ok FROM i LEFT JOIN a ON a.id = i.id)
SELECT id, CASE WHEN NOT ok THEN status WHEN action = 'accept' AND coalesce(e < TIMESTAMP '1998-01-01', false) THEN 'cancelled' ELSE CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'cancelled' END END AS status,
CASE WHEN action IS NULL THEN NULL WHEN NOT ok THEN 'not_found' WHEN action = 'accept' AND coalesce(e < TIMESTAMP '1998-01-01', false) THEN 'expired' ELSE 'done' END AS outcome FROM b""")
def invitation_answers(t: Tables) -> DataFrame:
    """Invitations after answers by their receivers and senders, some of them of the wrong party, too late, or to what is no longer pending."""
    order = F.col("id")
    i = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("from_user"), (F.col("o_orderkey") % 50).alias("to_user"), F.when(F.col("o_orderstatus") != "P", "pending").otherwise("accepted").alias("status"), F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderdate")).alias("expires_at"))
    action = F.element_at(F.array(*map(F.lit, ("accept", "reject", "cancel", "frown"))), (order % 4 + 1).cast("int"))
    answers = i.where(order % 7 != 0).select("id", F.when(order % 3 == 0, F.col("from_user")).otherwise(F.col("to_user")).alias("user"), action.alias("action"))
    return R.answered(i, answers, F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "status", "outcome")


@query("""WITH f AS (SELECT p_partkey AS k, p_partkey % 4 AS usr, ['semantic_scholar', 'arxiv', 'pubmed', 'crossref', 'openalex'][(p_partkey % 5 + 1)::INT] AS source, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_size::VARCHAR END AS eid, CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_size END AS doi, p_name AS title FROM part),
s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS usr, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey::VARCHAR END AS s2, CASE s_suppkey % 3 WHEN 1 THEN s_suppkey::VARCHAR END AS ax, CASE s_suppkey % 3 WHEN 2 THEN s_suppkey::VARCHAR END AS pm, 'd' || s_suppkey AS doi, (SELECT p_name FROM part WHERE p_partkey = s_suppkey) AS title FROM supplier)
SELECT k, (SELECT min(id) FROM s WHERE s.usr = f.usr AND f.eid <> '' AND CASE source WHEN 'semantic_scholar' THEN s2 = eid WHEN 'arxiv' THEN ax = eid WHEN 'pubmed' THEN pm = eid ELSE CASE WHEN f.doi IS NOT NULL THEN s.doi = f.doi ELSE s.title = f.title END END) AS saved_id FROM f""")
def is_saved_by_source(t: Tables) -> DataFrame:
    """Which of a user's saved papers a found one is: by the id of its source, else DOI, else title."""
    k = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, ("semantic_scholar", "arxiv", "pubmed", "crossref", "openalex"))), (k % 5 + 1).cast("int"))
    found = t.part.select(k.alias("k"), (k % 4).alias("user"), source.alias("source"), F.when(k % 11 == 0, "").otherwise(F.col("p_size").cast("string")).alias("external_id"), F.when(k % 2 == 0, _text("d", F.col("p_size"))).alias("doi"), F.col("p_name").alias("title"))
    i = F.col("s_suppkey")
    own = lambda m: F.when(i % 3 == m, i.cast("string"))
    titles = t.part.select(k.alias("s_suppkey"), F.col("p_name").alias("title"))
    saved = t.supplier.join(titles, "s_suppkey", "left").select(i.alias("id"), (i % 4).alias("user"), own(0).alias("s2_id"), own(1).alias("arxiv_id"), own(2).alias("pubmed_id"), _text("d", i).alias("doi"), "title")
    return B.with_saved(found, saved).select("k", "saved_id")


@query("""WITH p AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_partkey, p_name || CASE WHEN p_size % 4 = 0 THEN '' ELSE ' (' || (1990 + p_size) || ')' END || chr(10) || 'Authors: ' || CASE p_size % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'A, ' || p_type ELSE 'A, B, C and others' END
|| chr(10) || 'Published: ' || p_type || CASE WHEN p_size > 25 THEN chr(10) || 'Citations: ' || p_size ELSE '' END || chr(10) || 'Abstract: ' || left(repeat(p_name || ' ', 9), 200) || CASE WHEN length(repeat(p_name || ' ', 9)) > 200 THEN '...' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Link: u' || p_partkey ELSE '' END AS b FROM part)
SELECT p_brand, sha256('Results of ' || p_brand || chr(10) || string_agg(chr(10) || '[' || i || '] ' || b, chr(10) ORDER BY i)) AS text_sha256, count(*) AS n FROM p GROUP BY p_brand""")
def paper_lists(t: Tables) -> DataFrame:
    """Lists of papers as text, one for each brand, with and without years, authors, citations and addresses."""
    size = F.col("p_size")
    author = lambda *names: F.array(*[F.struct((F.lit(x) if isinstance(x, str) and len(x) == 1 else F.col(x)).alias("name")) for x in names])
    authors = F.when(size % 3 == 0, F.array().cast("array<struct<name:string>>")).when(size % 3 == 1, author("A", "p_type")).otherwise(author("A", "B", "C", "D"))
    papers = t.part.select("p_brand", "p_partkey", F.col("p_name").alias("title"), F.when(size % 4 != 0, 1990 + size).alias("year"), authors.alias("authors"), F.col("p_type").alias("venue"), F.when(size > 25, size).otherwise(0).alias("citation_count"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(9)).alias("abstract"), F.when(size % 2 == 0, _text("u", F.col("p_partkey"))).otherwise("").alias("url"), F.lit(None).cast("string").alias("pdf_url"))
    text = B.listed(papers, "p_brand", "p_partkey", F.concat(F.lit("Results of "), "p_brand"))
    return text.join(t.part.groupBy("p_brand").agg(n("n")), "p_brand").select("p_brand", F.sha2("text", 256).alias("text_sha256"), "n")


@query("""SELECT 'p' || p_partkey AS external_id, '{"source":"semantic_scholar","external_id":"p' || p_partkey || '","title":"' || p_name || '","abstract":null,"authors":[{"name":"' || p_type || '","authorId":"a' || p_partkey % 50 || '","affiliations":null}],"year":' || (1990 + p_size) ||
',"venue":"' || p_brand || '","citation_count":' || p_size || ',"reference_count":0,"url":null,"pdf_url":' || CASE WHEN p_partkey % 2 = 0 THEN '"u"' ELSE 'null' END || ',"arxiv_id":"' || p_partkey || '.1","doi":null,"fields_of_study":["' || p_brand || '"]}' AS paper FROM part""")
def paper_dicts(t: Tables) -> DataFrame:
    """What a tool gives of each paper that it has found."""
    return B.as_dicts(_works(t))


@query(f"""WITH {_REFS} SELECT share_id, r.kind, k.name, c_name AS owner FROM r JOIN k ON k.kind = r.kind AND k.id = r.id JOIN customer ON c_custkey = o_custkey
WHERE coalesce(k.name, '') <> '' AND o_custkey <= 30 AND r.kind = 'paper' ORDER BY share_id DESC LIMIT 20 OFFSET 5""")
def my_shares_of_a_kind(t: Tables) -> DataFrame:
    """A page of some users' shares of papers, with names."""
    mine = t.customer.where("c_custkey <= 30").select(F.col("c_name").alias("owner"))
    rows = shared_resources(t).where("kind = 'paper'").join(mine, "owner", "left_semi")
    return R.paginate(rows, [F.desc("share_id")], 5, 20).select("share_id", "kind", "name", "owner")


# ---- keyed state in batches


@query("SELECT conv_id, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE c <= 6 OR r <= 3")
def history_cap(t: Tables) -> DataFrame:
    """Histories of over 6 messages are cut to their last 3 (100 and 50 by default)."""
    return R.capped(t.conversations, "conv_id", F.col("turn"), most=6, keep=3).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, 1000 + turn FROM conversations WHERE turn = 0")
def agent_history(t: Tables) -> DataFrame:
    """Keyed histories: every fourth one cleared, then a message appended to each."""
    mine = t.conversations.select("conv_id", "turn")
    cleared = C.delete_where_in(mine, "conv_id", mine.where("conv_id % 4 = 0").select("conv_id").distinct(), "conv_id")
    return cleared.union(mine.where("turn = 0").select("conv_id", (F.col("turn") + 1000).alias("turn")))


@query("""SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events) WHERE later IS NULL OR later - ts >= INTERVAL 10 MINUTE""")
def debounce(t: Tables) -> DataFrame:
    """The last event of each burst: none follows within ten minutes."""
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.withColumn("later", later)
    return rows.where(F.col("later").isNull() | (F.col("later") - F.col("ts") >= F.expr("interval 10 minutes"))).select("event_id", "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type || event_id % 3 AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS hit, []::STRUCT(ts TIMESTAMP, key VARCHAR)[] AS live FROM events
      UNION ALL SELECT user_id, i, event_id, hit, CASE WHEN hit THEN live ELSE list_append(live, {'ts': ts, 'key': key})[-4:] END
      FROM (SELECT *, len(list_filter(live, lambda x: x.key = key)) > 0 AS hit
            FROM (SELECT e.*, list_filter(live, lambda x: x.ts > e.ts - INTERVAL 3 DAY) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT event_id, user_id, hit FROM r WHERE i > 0""")
def ttl_cache_hits(t: Tables) -> DataFrame:
    """Each user's cache of three days and four entries: whether a request finds its key. A hit renews nothing, the entry stored longest ago makes room."""
    asked = t.events.select("user_id", "event_id", "ts", F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("key"))
    return cached(asked, "user_id", "key", "ts", "event_id", 3 * 86400 * 10**6, most=4).select("event_id", "user_id", "hit")


@query("""SELECT conv_id, count(*) FILTER (WHERE role <> 'system') AS steps, string_agg(CASE role WHEN 'user' THEN 'thought' WHEN 'assistant' THEN 'observation' END, ',' ORDER BY turn) AS kinds,
arg_max(left(text, 500), turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id""")
def fold_steps(t: Tables) -> DataFrame:
    """Events as one message: steps in order, outputs cut to 500 characters, the last answer wins."""
    kind = F.when(F.col("role") == "user", "thought").when(F.col("role") == "assistant", "observation")
    step = F.when(kind.isNotNull(), F.struct("turn", kind.alias("kind"), F.left("text", F.lit(500)).alias("text")))
    by = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    last = F.element_at(F.filter("s", lambda x: x["kind"] == "observation"), -1)
    return by.select("conv_id", F.size("s").cast("long").alias("steps"), F.nullif(F.array_join(F.transform("s", lambda x: x["kind"]), ","), F.lit("")).alias("kinds"), F.when(F.exists("s", lambda x: x["kind"] == "observation"), last["text"]).alias("answer"))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(text) % 5 = 0 AS done FROM conversations),
e AS (SELECT conv_id, max(n) AS m, min(n) FILTER (WHERE done) AS f, min(turn) FILTER (WHERE done) AS p FROM r WHERE n <= 5 GROUP BY conv_id)
SELECT conv_id, coalesce(f, m) AS rounds, f IS NULL AS summary, p AS answered_at FROM e""")
def bounded_rounds(t: Tables) -> DataFrame:
    """Rounds of an agent until one gives an answer, five at most; without one a summary is asked for."""
    out = R.bounded(t.conversations, "conv_id", "turn", F.length("text") % 5 == 0, 5)
    return out.select("conv_id", "rounds", (~F.col("answered")).alias("summary"), F.col("answer_place").alias("answered_at"))

