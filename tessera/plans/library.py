"""Relational queries of a document library over the stand-in tables.

customer stands for users (mentor: the region of their nation, role: market segment), nation for groups, orders for shares
and read marks, lineitem for paper-collection edges and invitations, part for papers, documents for files in knowledge bases
(source), conversations for messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.session import Tables

from .registry import ORACLES, query

NOW = "1998-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def n(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def pk_lookup(t: Tables) -> DataFrame:
    return R.by_key(t.customer, "c_custkey", 42).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey, p_name AS title, coalesce(p_size, 0) AS rating, coalesce(nullif(p_type, ''), 'unknown') AS kind, coalesce(p_retailprice, 0.0) AS citations FROM part")
def project_defaults(t: Tables) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("p_type"), F.lit("")), F.lit("unknown"))
    return t.part.select("p_partkey", F.col("p_name").alias("title"), F.coalesce("p_size", F.lit(0)).alias("rating"), kind.alias("kind"), F.coalesce("p_retailprice", F.lit(0.0)).alias("citations"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_retailprice >= 900 AND p_retailprice <= 1900 AND (p_name ILIKE '%a%' OR p_type ILIKE '%a%')")
def paper_filter(t: Tables) -> DataFrame:
    given = R.all_given(F.col("p_size") >= 10, F.col("p_retailprice") >= 900, F.col("p_retailprice") <= 1900, None, R.contains_any("a", "p_name", "p_type"))
    return t.part.where(given).select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%00_1%' OR c_mktsegment ILIKE '%mach%'")
def ilike_multi(t: Tables) -> DataFrame:
    return t.customer.where(R.contains_any("00_1", "c_name") | R.contains_any("mach", "c_mktsegment")).select("c_custkey", "c_name", "c_mktsegment")


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate > TIMESTAMP '{NOW}'")
def not_expired(t: Tables) -> DataFrame:
    o = t.orders.withColumn("expires_at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return o.where(R.not_expired("expires_at", now())).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS first_tag FROM part WHERE list_contains(string_split(p_type, ' '), string_split((SELECT min(p_type) FROM part), ' ')[1])")
def tag_contains(t: Tables) -> DataFrame:
    part = t.part.withColumn("tags", F.split("p_type", " "))
    wanted = t.part.agg(F.split(F.min("p_type"), " ")[0].alias("tag"))
    return part.join(F.broadcast(wanted), F.expr("array_contains(tags, tag)")).select("p_partkey", F.col("tags")[0].alias("first_tag"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_custkey % 7 = 3 OR c_nationkey IN (1, 2, 3) AS allowed FROM customer")
def resource_access(t: Tables) -> DataFrame:
    """Administrators, the owner, and listed groups."""
    allowed = (F.col("c_mktsegment") == "BUILDING") | (F.col("c_custkey") % 7 == 3) | F.col("c_nationkey").isin(1, 2, 3)
    return t.customer.select("c_custkey", allowed.alias("allowed"))


@query("""SELECT 'all' AS mode, l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem WHERE (l_suppkey = 5 OR l_partkey = 5) AND l_returnflag = 'N'
UNION ALL SELECT 'received', l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem WHERE l_suppkey = 5 UNION ALL SELECT 'sent', l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem WHERE l_partkey = 5""")
def my_invitations(t: Tables) -> DataFrame:
    """One party's: pending ones from or to it, those it received, those it sent."""
    to, by = F.col("l_suppkey") == 5, F.col("l_partkey") == 5
    modes = {"all": R.all_given(to | by, F.col("l_returnflag") == "N"), "received": R.all_given(to, None), "sent": R.all_given(by, None)}
    hit = F.array_compact(F.array(*[F.when(c, m) for m, c in modes.items()]))
    return t.lineitem.where(to | by).select(F.explode(hit).alias("mode"), "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


_LAST = "SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant'"


@query(f"""WITH l AS ({_LAST}), c AS (SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT c.conv_id, left(l.text, 100) AS last_message, n_messages
FROM c LEFT JOIN l ON l.conv_id = c.conv_id AND rn = 1 ORDER BY last_turn DESC, c.conv_id LIMIT 50""")
def conversation_list(t: Tables) -> DataFrame:
    last = R.first_per(t.conversations.where("role = 'assistant'"), ["conv_id"], [F.desc("turn")]).select("conv_id", "text")
    counts = t.conversations.groupBy("conv_id").agg(n("n_messages"), F.max("turn").alias("last_turn"))
    rows = counts.join(last, "conv_id", "left").select("conv_id", F.left("text", F.lit(100)).alias("last_message"), "n_messages", "last_turn")
    return R.paginate(rows, [F.desc("last_turn"), F.asc("conv_id")], 0, 50).drop("last_turn")


@query("""SELECT m.conv_id, m.turn, lower(m.role) AS role,
CASE WHEN greatest(instr(lower(text), 'the') - 1 - 50, 0) > 0 THEN '...' ELSE '' END || substr(text, greatest(instr(lower(text), 'the') - 51, 0) + 1, least(instr(lower(text), 'the') + 2 + 50, length(text)) - greatest(instr(lower(text), 'the') - 51, 0)) || CASE WHEN instr(lower(text), 'the') + 52 < length(text) THEN '...' ELSE '' END AS snippet
FROM conversations m JOIN (SELECT DISTINCT conv_id FROM conversations) c ON m.conv_id = c.conv_id WHERE text ILIKE '%the%'""")
def message_search(t: Tables) -> DataFrame:
    from tessera.functions.text import snippet

    owned = t.conversations.select("conv_id").distinct()
    found = t.conversations.where(R.contains_any("the", "text")).join(owned, "conv_id")
    return found.select("conv_id", "turn", F.lower("role").alias("role"), snippet(F.col("text"), "the").alias("snippet"))


@query("SELECT e.l_orderkey, p.p_partkey, p.p_name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) e JOIN part p ON e.l_partkey = p.p_partkey")
def papers_in_collection(t: Tables) -> DataFrame:
    edges = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    return edges.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_partkey", "p_name")


@query("SELECT n_nationkey, n_name, c_custkey, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey")
def group_members(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", "c_custkey", "c_name")


@query("SELECT DISTINCT c_mktsegment, n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey")
def my_groups(t: Tables) -> DataFrame:
    """Groups with a member of each segment."""
    member = t.customer.select("c_mktsegment", "c_nationkey").distinct()
    return member.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_nationkey", "n_name")


@query("SELECT c_custkey, c_name, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM customer JOIN orders ON o_custkey = c_custkey")
def read_list(t: Tables) -> DataFrame:
    """Who read what, each one's latest first."""
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "o_orderkey", place.alias("place"))


def shares(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "user").when(F.col("o_orderstatus") == "O", "group").otherwise("all_students")
    to = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 150).when(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 25)
    return t.orders.select(F.col("o_orderkey").alias("share_id"), F.col("o_custkey").alias("owner_id"), kind.alias("to_kind"), to.alias("to_id"), F.col("o_orderdate").alias("expires_at"), F.col("o_orderpriority").alias("resource_type"))


_SHARES = """s AS (SELECT o_orderkey AS share_id, o_custkey AS owner_id, CASE o_orderstatus WHEN 'F' THEN 'user' WHEN 'O' THEN 'group' ELSE 'all_students' END AS to_kind,
CASE o_orderstatus WHEN 'F' THEN o_orderkey % 150 WHEN 'O' THEN o_orderkey % 25 END AS to_id, o_orderdate AS expires_at, o_orderpriority AS resource_type FROM orders)"""


def principals(t: Tables, user: int = 7) -> DataFrame:
    """The user; the user's group; and the mentors (users of the group's region with a number under 6) whose students it holds."""
    me = t.customer.where(F.col("c_custkey") == user).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    mentors = t.customer.where("c_custkey < 60").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("m"), F.col("n_regionkey").alias("r"))
    own = me.select(F.lit("user").alias("kind"), F.col("c_custkey").alias("id"))
    groups = me.select(F.lit("group").alias("kind"), F.col("c_nationkey").cast("long").alias("id"))
    above = me.join(mentors, F.col("n_regionkey") == F.col("r")).select(F.lit("all_students").alias("kind"), F.col("m").alias("id"))
    return own.union(groups).union(above)


_PRINCIPALS = """p AS (SELECT 'user' AS kind, c_custkey AS id FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'group', c_nationkey FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'all_students', m.c_custkey FROM customer m JOIN nation mn ON mn.n_nationkey = m.c_nationkey JOIN nation un ON un.n_regionkey = mn.n_regionkey JOIN customer u ON u.c_nationkey = un.n_nationkey WHERE u.c_custkey = 7 AND m.c_custkey < 60)"""
_SEEN = f"""v AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM p WHERE p.kind = s.to_kind AND p.id = CASE WHEN s.to_kind = 'all_students' THEN s.owner_id ELSE s.to_id END)
AND owner_id <> 7 AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'))"""


def seen(t: Tables) -> DataFrame:
    fresh = shares(t).where((F.col("owner_id") != 7) & R.not_expired("expires_at", now()))
    return R.visible_shares(fresh, principals(t))


@query(f"WITH {_SHARES}, {_PRINCIPALS}, {_SEEN} SELECT share_id, owner_id, to_kind, resource_type FROM v")
def shared_with_me(t: Tables) -> DataFrame:
    return seen(t).select("share_id", "owner_id", "to_kind", "resource_type")


@query(f"""WITH {_SHARES}, {_PRINCIPALS}, {_SEEN}, k AS (SELECT DISTINCT o_orderpriority AS resource_type FROM orders)
SELECT k.resource_type, count(v.share_id) AS n FROM k LEFT JOIN v USING (resource_type) GROUP BY k.resource_type UNION ALL SELECT 'total', count(*) FROM v""")
def share_counts(t: Tables) -> DataFrame:
    kinds = t.orders.select(F.col("o_orderpriority").alias("resource_type")).distinct()
    by = seen(t).groupBy("resource_type").agg(n("n"))
    each = kinds.join(by, "resource_type", "left").select("resource_type", F.coalesce("n", F.lit(0)).alias("n"))
    return each.union(by.agg(F.lit("total"), F.coalesce(F.sum("n"), F.lit(0))))


@query(f"""WITH {_SHARES} SELECT share_id, c_name AS owner, n_name AS to_group, u.c_name2 AS to_user FROM s LEFT JOIN customer ON c_custkey = owner_id
LEFT JOIN nation ON to_kind = 'group' AND n_nationkey = to_id LEFT JOIN (SELECT c_custkey AS k2, coalesce(nullif(c_name, ''), c_custkey::VARCHAR) AS c_name2 FROM customer) u ON to_kind = 'user' AND k2 = to_id""")
def share_details(t: Tables) -> DataFrame:
    user = t.customer.select(F.col("c_custkey").alias("k"), F.coalesce(F.nullif(F.col("c_name"), F.lit("")), F.col("c_custkey").cast("string")).alias("to_user"))
    owner = t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner"))
    group = t.nation.select(F.col("n_nationkey").cast("long").alias("g"), F.col("n_name").alias("to_group"))
    s = shares(t).join(owner, "owner_id", "left").join(group, (F.col("to_kind") == "group") & (F.col("g") == F.col("to_id")), "left")
    return s.join(user, (F.col("to_kind") == "user") & (F.col("k") == F.col("to_id")), "left").select("share_id", "owner", "to_group", "to_user")


@query(f"""WITH {_SHARES} SELECT share_id, to_kind, coalesce(c_name, n_name) AS target FROM s LEFT JOIN customer ON to_kind = 'user' AND c_custkey = to_id
LEFT JOIN nation ON to_kind = 'group' AND n_nationkey = to_id WHERE coalesce(c_name, n_name, '') <> ''""")
def polymorphic_ref(t: Tables) -> DataFrame:
    """Each share's target from the table that its kind names; gone targets drop out."""
    user = t.customer.select(F.lit("user").alias("to_kind"), F.col("c_custkey").alias("to_id"), F.col("c_name").alias("u"))
    group = t.nation.select(F.lit("group").alias("to_kind"), F.col("n_nationkey").cast("long").alias("to_id"), F.col("n_name").alias("g"))
    s = shares(t).join(user, ["to_kind", "to_id"], "left").join(group, ["to_kind", "to_id"], "left")
    return s.select("share_id", "to_kind", F.coalesce("u", "g").alias("target")).where("coalesce(target, '') <> ''")


@query("SELECT s.doc_id, m.text IS NOT NULL AS is_saved FROM (SELECT * FROM documents WHERE doc_id % 2 = 1) s LEFT JOIN (SELECT DISTINCT sha256(text) AS text FROM documents WHERE doc_id % 2 = 0) m ON sha256(s.text) = m.text")
def is_saved(t: Tables) -> DataFrame:
    """Whether a found document (odd) is among the saved ones (even), by the hash of its text."""
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    saved = docs.where("doc_id % 2 = 0").select("key").distinct().withColumn("there", F.lit(True))
    return docs.where("doc_id % 2 = 1").join(saved, "key", "left").select("doc_id", F.col("there").isNotNull().alias("is_saved"))


@query("SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def nested_messages(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(n("n"), F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("c")))).alias("m"))
    return rows.select("conv_id", "n", F.expr("array_join(transform(m, x -> concat(x.role, ':', x.c)), ',')").alias("messages"))


@query("""SELECT n_nationkey, n_name, 'mentor' AS my_role FROM nation WHERE n_regionkey = 1
UNION ALL SELECT n_nationkey, n_name, 'member' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey <= 20) AND n_regionkey <> 1""")
def my_groups_for_sharing(t: Tables) -> DataFrame:
    """Groups I lead, and groups I am only a member of."""
    mine = t.nation.where("n_regionkey = 1").select("n_nationkey", "n_name", F.lit("mentor").alias("my_role"))
    of = t.nation.join(t.customer.where("c_custkey <= 20"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_nationkey", "n_name", F.lit("member").alias("my_role"))
    return mine.union(of.join(mine, "n_nationkey", "left_anti"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unread_announcements(t: Tables) -> DataFrame:
    read = t.orders.where("o_orderstatus = 'P'").select("o_custkey")
    return t.customer.join(read, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT a.n_nationkey AS me, b.n_nationkey AS peer, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def peers(t: Tables) -> DataFrame:
    """Those with my mentor, without me."""
    a = t.nation.select(F.col("n_nationkey").alias("me"), "n_regionkey")
    return a.join(t.nation, "n_regionkey").where("me <> n_nationkey").select("me", F.col("n_nationkey").alias("peer"), "n_name")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS citing, l_suppkey AS cited FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT a.citing, a.cited, p.p_name AS citing_title, q.p_name AS cited_title FROM e a JOIN part p ON p.p_partkey = a.citing JOIN part q ON q.p_partkey = a.cited""")
def citation_edges(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited")).where("citing <> cited").distinct()
    p = t.part.select(F.col("p_partkey").alias("citing"), F.col("p_name").alias("citing_title"))
    q = t.part.select(F.col("p_partkey").alias("cited"), F.col("p_name").alias("cited_title"))
    return e.join(p, "citing").join(q, "cited").select("citing", "cited", "citing_title", "cited_title")


@query("""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS admins, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS mentors,
(SELECT count(*) FROM customer WHERE c_mktsegment = 'AUTOMOBILE') AS students, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations,
(SELECT count(DISTINCT source) FROM documents) AS knowledge_bases, (SELECT count(*) FROM part) AS papers, (SELECT count(*) FROM supplier) AS notebooks""")
def system_statistics(t: Tables) -> DataFrame:
    """One row of nine counts: a pass over each table, one-row sides put together."""
    role = lambda r, a: F.count_if(F.col("c_mktsegment") == r).alias(a)
    users = t.customer.agg(n("users"), role("BUILDING", "admins"), role("MACHINERY", "mentors"), role("AUTOMOBILE", "students"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    chats, kbs = t.conversations.agg(F.countDistinct("conv_id").alias("conversations")), t.documents.agg(F.countDistinct("source").alias("knowledge_bases"))
    return users.crossJoin(chats).crossJoin(kbs).crossJoin(t.part.agg(n("papers"))).crossJoin(t.supplier.agg(n("notebooks")))


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
def user_count(t: Tables) -> DataFrame:
    return t.customer.where(R.all_given(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") > 0)).agg(n("n"))


@query("SELECT lang, sha256(text) AS key, count(*) AS n, min(doc_id) AS keep FROM documents GROUP BY lang, sha256(text) HAVING count(*) > 1")
def duplicate_groups(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", F.sha2("text", 256).alias("key")).agg(n("n"), F.min("doc_id").alias("keep")).where("n > 1")


@query("SELECT n_nationkey, n_name, coalesce(c, 0) AS students FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) ON c_nationkey = n_nationkey")
def mentor_student_count(t: Tables) -> DataFrame:
    return R.counts_for(t.nation, "n_nationkey", t.customer.where("c_acctbal > 9000"), "c_nationkey", "students").select("n_nationkey", "n_name", "students")


@query("""SELECT c_custkey, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 100 = c_custkey) AS conversations, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS knowledge_bases,
(SELECT count(*) FROM part WHERE p_partkey % 500 = c_custkey) AS papers, (SELECT count(*) FROM documents WHERE doc_id % 300 = c_custkey) AS notebooks FROM customer""")
def student_progress(t: Tables) -> DataFrame:
    """Four counts of four tables for each user, 0 where there is nothing."""
    chats = t.conversations.select((F.col("conv_id") % 100).alias("owner"), "conv_id").distinct()
    facts = {"conversations": chats, "knowledge_bases": t.orders.select(F.col("o_custkey").alias("owner")), "papers": t.part.select((F.col("p_partkey") % 500).alias("owner")), "notebooks": t.documents.select((F.col("doc_id") % 300).alias("owner"))}
    out = t.customer.select("c_custkey")
    for name, rows in facts.items():
        out = R.counts_for(out, "c_custkey", rows, "owner", name)
    return out


@query(f"""SELECT l_suppkey % 10 AS party, count(*) FILTER (WHERE l_returnflag = 'N' AND l_shipdate > TIMESTAMP '{NOW}') AS received, count(*) FILTER (WHERE l_returnflag = 'A' AND l_shipdate > TIMESTAMP '{NOW}') AS sent,
count(*) FILTER (WHERE l_returnflag IN ('N', 'A') AND l_shipdate > TIMESTAMP '{NOW}') AS total FROM lineitem GROUP BY 1""")
def pending_counts(t: Tables) -> DataFrame:
    fresh = R.not_expired("l_shipdate", now())
    by = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("party"))
    return by.agg(F.count_if((F.col("l_returnflag") == "N") & fresh).alias("received"), F.count_if((F.col("l_returnflag") == "A") & fresh).alias("sent"), F.count_if(F.col("l_returnflag").isin("N", "A") & fresh).alias("total"))


@query("""SELECT n_nationkey, count(*) AS total, count(*) FILTER (WHERE r) AS read_count, count(*) FILTER (WHERE NOT r) AS unread_count, round(count(*) FILTER (WHERE r) * 100.0::DOUBLE / greatest(count(*), 1), 1) AS rate
FROM (SELECT n_nationkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS r FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY n_nationkey""")
def read_rate(t: Tables) -> DataFrame:
    read = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("r", F.lit(True))
    all_ = t.customer.join(read, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey"))
    by = all_.agg(n("total"), F.count_if(F.col("r").isNotNull()).alias("read_count"))
    by = by.withColumn("unread_count", F.col("total") - F.col("read_count"))
    return by.withColumn("rate", F.round(F.col("read_count") * F.lit(100.0) / F.greatest("total", F.lit(1)), 1))


@query("SELECT c_custkey, (SELECT count(*) FROM nation) - coalesce(r, 0) AS unread FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS r FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def unread_count(t: Tables) -> DataFrame:
    """May be negative: reads count even where the announcement is no longer active."""
    reads = R.counts_for(t.customer, "c_custkey", t.orders, "o_custkey", "r")
    return reads.crossJoin(F.broadcast(t.nation.agg(n("a")))).select("c_custkey", (F.col("a") - F.col("r")).alias("unread"))


@query("SELECT source, count(*) AS document_count, sum(n_chars)::BIGINT AS total_chars, sum(ceil(n_chars / 4.0::DOUBLE))::BIGINT AS total_tokens FROM documents GROUP BY source")
def kb_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(n("document_count"), F.sum("n_chars").alias("total_chars"), F.sum(F.ceil(F.col("n_chars") / 4)).alias("total_tokens"))


@query("SELECT count(DISTINCT conv_id) AS notebooks, count(*) AS cells, sum(turn)::BIGINT AS executions FROM conversations")
def notebook_totals(t: Tables) -> DataFrame:
    return t.conversations.agg(F.countDistinct("conv_id").alias("notebooks"), n("cells"), F.sum("turn").alias("executions"))


@query("""SELECT c_custkey, score, CASE WHEN score >= 70 THEN 'active' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM (SELECT o_custkey AS c_custkey,
least(100, count(*) + 5 * count(*) FILTER (WHERE o_orderstatus = 'F') + 3 * count(*) FILTER (WHERE o_orderstatus = 'P') + 4 * count(*) FILTER (WHERE o_orderstatus = 'O')) AS score FROM orders GROUP BY 1)""")
def activity_score(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(n("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    by = by.select("c_custkey", F.least(F.lit(100), F.col("n") + 5 * F.col("f") + 3 * F.col("p") + 4 * F.col("b")).alias("score"))
    return by.withColumn("level", F.when(F.col("score") >= 70, "active").when(F.col("score") >= 40, "medium").otherwise("low"))


@query("SELECT p_partkey, coalesce(ids, '') AS collections, coalesce(k, 0) AS k FROM part LEFT JOIN (SELECT l_partkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS ids, count(*) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1) ON l_partkey = p_partkey")
def paper_collection_ids(t: Tables) -> DataFrame:
    ids = t.lineitem.groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_orderkey")).alias("ids"))
    both = t.part.join(ids, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    return both.select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("collections"), F.size("ids").cast("long").alias("k"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS evicted, count(*) AS entries FROM events GROUP BY user_id HAVING count(*) > 3")
def cache_evict(t: Tables) -> DataFrame:
    """Of caches with over three entries the oldest key."""
    return t.events.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("evicted"), n("entries")).where("entries > 3")


@query("""SELECT c_custkey, n_name, coalesce(k, 0) AS students FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal > 0
LEFT JOIN (SELECT c_nationkey AS g, count(*) AS k FROM customer GROUP BY 1) ON g = n_nationkey""")
def my_mentor(t: Tables) -> DataFrame:
    size = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(n("k"))
    mentor = t.nation.join(size, "n_nationkey", "left")
    return t.customer.join(mentor, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_acctbal") > 0), "left").select("c_custkey", "n_name", F.coalesce("k", F.lit(0)).alias("students"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_n_messages(t: Tables) -> DataFrame:
    return R.first_per(t.conversations, ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginate(t: Tables) -> DataFrame:
    return R.paginate(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def pinned_first(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), "o_orderdate")
    page = R.paginate(rows, [F.desc("pinned"), F.desc("o_orderdate"), F.asc("o_orderkey")], 0, 100)
    return page.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("pinned"), F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("place"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS rating FROM part ORDER BY CASE WHEN p_size > 25 THEN p_size END DESC NULLS FIRST, p_partkey LIMIT 200")
def dynamic_sort(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("rating"))
    return R.sort_by_name(rows, "rating", "desc", ["rating", "p_partkey"], "p_partkey", "p_partkey").limit(200)


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_partkey DESC LIMIT 20 OFFSET 20")
def page_with_total(t: Tables) -> DataFrame:
    return R.page_with_total(t.part.select("p_partkey", "p_name"), [F.desc("p_partkey")], 20, 20)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END, TIMESTAMP '0001-01-01 00:00:00') AS sort_time FROM events ORDER BY sort_time DESC, event_id")
def safe_ts_sort_whole(t: Tables) -> DataFrame:
    """Times from text, what doesn't parse as the earliest: all rows in their order. The time stands for the place, which would need all rows in one task."""
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    when = F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    return t.events.select("event_id", when.alias("sort_time")).orderBy(F.desc("sort_time"), "event_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 20")
def search_history(t: Tables) -> DataFrame:
    return R.paginate(t.events.where("event_type = 'view'").select("event_id", "user_id", "event_type", "ts"), [F.desc("ts"), F.asc("event_id")], 0, 20).drop("ts")


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS joined FROM customer ORDER BY joined DESC NULLS FIRST, c_custkey")
def my_students_whole(t: Tables) -> DataFrame:
    """All of a mentor's students, the last to join first, those without a date before them."""
    joined = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("joined")
    return t.customer.select("c_custkey", "c_name", joined).orderBy(F.col("joined").desc_nulls_first(), "c_custkey")


@query("""SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE doc_id % 25 = 7 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2)) AS total
FROM documents WHERE doc_id % 25 = 7 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2) ORDER BY doc_id DESC LIMIT 20""")
def document_page(t: Tables) -> DataFrame:
    """Documents of a knowledge base (doc_id % 25) that is its asker's (a region's), the newest first, and their number; of another's there are none."""
    own = t.nation.where("n_nationkey = 7 and n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("kb"))
    docs = t.documents.withColumn("kb", F.col("doc_id") % 25).where("kb = 7").join(own, "kb", "left_semi")
    return R.page_with_total(docs.select("doc_id", "lang"), [F.desc("doc_id")], 0, 20)


@query(f"WITH {_SHARES} SELECT share_id, to_kind, resource_type FROM s WHERE owner_id <= 30 ORDER BY expires_at DESC, share_id LIMIT 50")
def my_shares(t: Tables) -> DataFrame:
    mine = shares(t).where("owner_id <= 30")
    return R.paginate(mine, [F.desc("expires_at"), F.asc("share_id")], 0, 50).select("share_id", "to_kind", "resource_type")


@query(f"WITH {_SHARES}, {_PRINCIPALS}, {_SEEN} SELECT owner_id AS kb FROM v UNION SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def accessible_kbs(t: Tables) -> DataFrame:
    own = t.customer.where("c_nationkey = 7").select(F.col("c_custkey").alias("kb"))
    return own.union(seen(t).select(F.col("owner_id").alias("kb"))).distinct()


@query("SELECT 'documents' AS source, doc_id AS id, text AS title, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'pages', page_id, NULL, url FROM pages UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark")
def search_all_whole(t: Tables) -> DataFrame:
    """Several sources in one schema, nothing merged."""
    a = t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("title"))
    b = t.pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), "url")
    c = t.benchmark.select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), F.col("text").alias("title"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SELECT unnest(['en', 'de', 'zh', 'ja']) AS lang EXCEPT SELECT lang FROM documents")
def except_defaults(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(x,) for x in ("en", "de", "zh", "ja")], "lang string")
    return wanted.join(t.documents.select("lang").distinct(), "lang", "left_anti")


@query(f"WITH {_SHARES}, {_PRINCIPALS}, {_SEEN}, a AS (SELECT owner_id AS kb FROM v UNION SELECT c_custkey FROM customer WHERE c_nationkey = 7) SELECT c_custkey AS kb FROM customer WHERE c_acctbal <= 9000 AND c_custkey NOT IN (SELECT kb FROM a)")
def kb_access_check(t: Tables) -> DataFrame:
    """Requested knowledge bases that are neither accessible nor public; none may be left."""
    asked = t.customer.where("c_acctbal <= 9000").select(F.col("c_custkey").alias("kb"))
    return asked.join(accessible_kbs(t), "kb", "left_anti")


query(ORACLES["search_all_whole"], "search_all")(search_all_whole)
query(ORACLES["safe_ts_sort_whole"], "safe_ts_sort")(safe_ts_sort_whole)
query(ORACLES["my_students_whole"], "my_students")(my_students_whole)
