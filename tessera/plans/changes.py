"""Queries of table changes: each gives the table (or its counters) after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import mutations as C
from tessera.session import Tables

from .library import n
from .registry import ORACLES, query


@query("""WITH e AS (SELECT doc_id, sha256(text) AS key FROM documents WHERE doc_id % 2 = 0), w AS (SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT doc_id, key FROM e UNION ALL SELECT doc_id, key FROM w WHERE key NOT IN (SELECT key FROM e)""")
def insert_if_absent(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("key"))
    return C.insert_if_absent(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["key"], [F.asc("doc_id")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def partial_update(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    change = t.customer.select("c_custkey", F.lit(None).cast("string").alias("c_name"), (k % 3 == 0).alias("c_name_set"), F.lit(0.0).alias("c_acctbal"), (k % 2 == 0).alias("c_acctbal_set"))
    return C.partial_update(t.customer.select("c_custkey", "c_name", "c_acctbal"), change, "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT p_partkey, count(DISTINCT l_orderkey) AS paper_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def counter_recompute(t: Tables) -> DataFrame:
    edges = t.lineitem.select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(n("k"))
    return t.part.join(edges, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("k", F.lit(0)).alias("paper_count"))


@query("SELECT p_partkey, greatest(p_size - coalesce(k, 0), 0)::BIGINT AS counter FROM part LEFT JOIN (SELECT l_partkey, count(*) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def counter_floor(t: Tables) -> DataFrame:
    removed = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey").agg(n("k"))
    both = t.part.join(removed, F.col("p_partkey") == F.col("l_partkey"), "left")
    return both.select("p_partkey", C.floored_decrement("p_size", F.coalesce("k", F.lit(0))).alias("counter"))


@query("SELECT 'orders' AS child, o_orderkey AS id FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey % 10 <> 3")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.customer.where("c_custkey % 10 = 3").select("c_custkey")
    parents = C.delete_where_in(t.customer, "c_custkey", gone, "c_custkey").select(F.lit("customer").alias("child"), F.col("c_custkey").alias("id"))
    children = C.delete_where_in(t.orders, "o_custkey", gone, "c_custkey").select(F.lit("orders").alias("child"), F.col("o_orderkey").alias("id"))
    return children.union(parents)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))")
def delete_in_subquery(t: Tables) -> DataFrame:
    of = t.customer.join(t.nation.where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return C.delete_where_in(t.orders, "o_custkey", of, "c_custkey").select("o_orderkey")


@query("SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, sha256(text)")
def dedupe_keep_min(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    return C.keep_least(docs, ["lang", "key"], "doc_id").select("doc_id", "lang")


@query("""WITH p AS (SELECT p_partkey, p_size % 2 = 1 AS was_read, p_partkey % 3 = 0 AS now_read, p_size AS was_rating, CASE WHEN p_partkey % 4 = 0 THEN 50 ELSE p_size END AS now_rating FROM part)
SELECT p_partkey, 'read' AS collection FROM p WHERE now_read UNION ALL SELECT p_partkey, 'unread' FROM p WHERE NOT now_read UNION ALL SELECT p_partkey, 'favorite' FROM p WHERE now_rating = 50 OR was_rating = 50""")
def read_transition(t: Tables) -> DataFrame:
    """Edges to the read, unread and favourite collections after a change of marks; a favourite stays one."""
    p = t.part.select("p_partkey", (F.col("p_size") % 2 == 1).alias("was"), (F.col("p_partkey") % 3 == 0).alias("now"), F.col("p_size").alias("r0"), F.when(F.col("p_partkey") % 4 == 0, F.lit(50)).otherwise(F.col("p_size")).alias("r1"))
    edge = lambda df, name: df.select("p_partkey", F.lit(name).alias("collection"))
    before = edge(p.where("was"), "read").union(edge(p.where("not was"), "unread")).union(edge(p.where("r0 = 50"), "favorite"))
    gone = edge(p.where("now and not was"), "unread").union(edge(p.where("was and not now"), "read"))
    new = edge(p.where("now and not was"), "read").union(edge(p.where("was and not now"), "unread")).union(edge(p.where("r1 = 50 and r0 <> 50"), "favorite"))
    return before.join(gone, ["p_partkey", "collection"], "left_anti").union(new)


@query("""SELECT c_custkey, d.name FROM customer, (SELECT unnest(['all', 'unread', 'read', 'favorite']) AS name) d WHERE NOT (c_custkey % 4 = 0 AND d.name = 'all') AND NOT (c_custkey % 3 = 0 AND d.name = 'read')""")
def seed_defaults(t: Tables) -> DataFrame:
    """Default collections that each user still misses."""
    names = F.array(*map(F.lit, ("all", "unread", "read", "favorite")))
    wanted = t.customer.select("c_custkey", F.explode(names).alias("name"))
    have = t.customer.where("c_custkey % 4 = 0").select("c_custkey", F.lit("all").alias("name")).union(t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("read")))
    return wanted.join(have, ["c_custkey", "name"], "left_anti")


@query("""SELECT o_custkey, count(*) FILTER (WHERE own AND NOT old) AS success, count(*) FILTER (WHERE NOT own OR old) AS skipped FROM (SELECT o_custkey, o_orderstatus <> 'P' AS own, o_orderkey % 5 = 0 AS old FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY o_custkey""")
def batch_share(t: Tables) -> DataFrame:
    """Shares made and passed over (not owned, or shared already); unsupported kinds count in neither."""
    asked = t.orders.where("o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(True).alias("old"))
    made = (F.col("o_orderstatus") != "P") & F.col("old").isNull()
    return asked.join(old, "o_orderkey", "left").groupBy("o_custkey").agg(F.count_if(made).alias("success"), F.count_if(~made).alias("skipped"))


@query("""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 's2:' || doc_id WHEN doc_id % 4 = 1 THEN 'doi:' || n_chars WHEN doc_id % 4 = 2 AND lang = 'de' THEN 'arxiv:' || n_chars % 50 ELSE 'title:' || sha256(text) END AS key FROM documents),
e AS (SELECT key FROM k WHERE doc_id % 5 = 0) SELECT min(doc_id) AS doc_id, key FROM k WHERE doc_id % 5 <> 0 AND key NOT IN (SELECT key FROM e) GROUP BY key""")
def copy_collection_whole(t: Tables) -> DataFrame:
    """Papers that come new into a library: by Semantic Scholar id, else DOI, else arXiv id, else title; the first of those that are the same."""
    d, k = F.col("doc_id"), F.col("doc_id") % 4
    s2, doi = F.when(k == 0, d.cast("string")).otherwise(""), F.when(k == 1, F.col("n_chars").cast("string")).otherwise("")
    arxiv = F.when((k == 2) & (F.col("lang") == "de"), (F.col("n_chars") % 50).cast("string")).otherwise("")
    tagged = lambda tag, c: F.concat(F.lit(tag), F.nullif(c, F.lit("")))
    keyed = t.documents.select("doc_id", F.coalesce(tagged("s2:", s2), tagged("doi:", doi), tagged("arxiv:", arxiv), F.concat(F.lit("title:"), F.sha2("text", 256))).alias("key"))
    mine = keyed.where("doc_id % 5 = 0")
    return C.insert_if_absent(mine, keyed.where("doc_id % 5 <> 0"), ["key"], [F.asc("doc_id")]).where("doc_id % 5 <> 0")


query(ORACLES["copy_collection_whole"], "copy_collection")(copy_collection_whole)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN 'closed' WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'cancelled' WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'rejected' END AS status FROM lineitem""")
def invitation_transition(t: Tables) -> DataFrame:
    """An answer to a pending invitation; one that has expired is cancelled instead."""
    status = F.when(F.col("l_returnflag") != "N", "closed").when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "cancelled")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", status.when(F.col("l_linestatus") == "O", "accepted").otherwise("rejected").alias("status"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn = 1 DESC, turn) - 1 AS position FROM conversations WHERE turn <> 2")
def cell_positions(t: Tables) -> DataFrame:
    """Cells after deleting the third and moving the second to the front."""
    return C.renumbered(t.conversations.where("turn <> 2"), "conv_id", [F.desc(F.col("turn") == 1), F.asc("turn")]).select("conv_id", "turn", F.col("position").cast("long").alias("position"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS archived, NOT (turn % 2 = 0) AS active FROM conversations")
def toggle(t: Tables) -> DataFrame:
    flag = (F.col("turn") % 2).cast("int")
    return t.conversations.select("conv_id", "turn", F.when(flag == 0, 1).otherwise(0).alias("archived"), (~(flag == 0)).alias("active"))


@query("SELECT c_custkey, CASE WHEN n_regionkey = 3 THEN NULL ELSE c_nationkey END AS mentor FROM customer JOIN nation ON c_nationkey = n_nationkey")
def role_change(t: Tables) -> DataFrame:
    """Students of mentors who lose the role have none."""
    lost = t.nation.where("n_regionkey = 3").select("n_nationkey")
    both = t.customer.join(lost, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.select("c_custkey", F.when(F.col("n_nationkey").isNull(), F.col("c_nationkey")).alias("mentor"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS steps, count(*) FILTER (WHERE role = 'assistant') AS answers, arg_max(left(text, 500), turn) AS last_output, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def fold_events(t: Tables) -> DataFrame:
    """Events of a conversation as one message: steps counted, the last output cut to 500 characters."""
    is_ = lambda r, a: F.count_if(F.col("role") == r).alias(a)
    return t.conversations.groupBy("conv_id").agg(is_("user", "steps"), is_("assistant", "answers"), F.max_by(F.left("text", F.lit(500)), "turn").alias("last_output"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT user_id, count(*) AS sessions, max(c) AS longest FROM (SELECT user_id, s, count(*) AS c FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY user_id""")
def idle_sessions(t: Tables) -> DataFrame:
    """Sessions end after two idle hours."""
    s = t.events.withColumn("at", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("at", "2 hours")).agg(n("c"))
    return s.groupBy("user_id").agg(n("sessions"), F.max("c").alias("longest"))


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables) -> DataFrame:
    at = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(n("n")).select(F.unix_timestamp("w.start").alias("begin"), "event_type", "n")


@query("SELECT epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT - 1800 * k AS begin, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def sliding_window(t: Tables) -> DataFrame:
    at = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return at.groupBy(F.window("at", "1 hour", "30 minutes").alias("w")).agg(n("n")).select(F.unix_timestamp("w.start").alias("begin"), "n")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def latest_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("source", "lang").orderBy(F.desc("doc_id"))
    return t.documents.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "lang", "doc_id")
