"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import classify_held_out
from .bpe import bpe_encode
from .common import shared_dir
from .langid import identify_held_out
from .lines import dedup_lines
from .merkle import tampered_documents, verified
from .minhash import near_duplicates
from .mixing import mix
from .negatives import mine_embeddings
from .neighbours import nearest
from .quality import quality
from .sharding import shard_documents
from .substrings import dedup_substrings, dedup_suffixes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document by the trie walk."""
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, weights 1, 2, 3 in turn, none above three times its size."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to each hundredth vector, among all."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that start in an earlier document, removed from every document."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that equal an earlier one, or are one edit from it, removed from every document."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics and the cascade's verdict for every document."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return identify_held_out(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, removed from every document."""
    return dedup_suffixes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in eight arrivals, compacted, committed, and read back through the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shard_documents(docs, f"{shared_dir(spark).rstrip('/')}/tessera/shards-{uuid.uuid4().hex}")
    back = store.read(docs.schema)
    return back.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and each one's proof held against the row as it is after some were tampered with."""
    out = verified(tampered_documents(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hard negatives of each hundredth vector and its positives, among all rows."""
    return mine_embeddings(table(spark, sf_dir, "embeddings"))


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels that are not held out."""
    return classify_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_neighbours": op3_neighbours,
    "op4_substrings": op4_substrings,
    "op5_lines": op5_lines,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_minhash": op8_minhash,
    "op9_suffixes": op9_suffixes,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_negatives": op12_negatives,
    "op13_quality_trees": op13_quality_trees,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op4_substrings": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE doc_id > first),
p AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op8_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = d.doc_id""",
    "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size,
             [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS most,
             (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(most, w * (SELECT level FROM l WHERE level <= most / w ORDER BY most / w, source NULLS LAST LIMIT 1)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) * size
             + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM c""",
    "op5_lines": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM d),
w AS (SELECT * FROM l WHERE length(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0),
c AS (SELECT line, min((doc_id, no)) AS place, length(line) AS n, list_transform(range(1, length(line) + 1), lambda i: substr(line, i, 1)) AS cs FROM w GROUP BY line),
k AS (SELECT line, place, cs, unnest([md5('p' || n || left(line, n // 2)), md5('s' || n || substr(line, n // 2 + 1)),
                           md5('p' || (n - 1) || left(line, (n - 1) // 2)), md5('s' || (n - 1) || substr(line, (n - 1) // 2 + 2))]) AS key FROM c),
two AS (SELECT DISTINCT a.line AS mine, a.line AS x, b.line AS y, a.cs AS xs, b.cs AS ys FROM k a JOIN k b USING (key) WHERE a.place > b.place AND abs(len(a.cs) - len(b.cs)) <= 1),
p AS (SELECT *, coalesce(list_position(list_transform(list_zip(xs, ys), lambda z: z[1] IS DISTINCT FROM z[2]), true), 1 + len(xs)) AS i FROM two),
near AS (SELECT DISTINCT mine AS line FROM p WHERE CASE WHEN len(xs) = len(ys) THEN substr(x, i + 1) = substr(y, i + 1) WHEN len(xs) > len(ys) THEN substr(x, i + 1) = substr(y, i) ELSE substr(x, i) = substr(y, i + 1) END),
g AS (SELECT w.doc_id, w.no FROM w JOIN c USING (line) WHERE (w.doc_id, w.no) <> c.place OR w.line IN (SELECT line FROM near)),
r AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY doc_id),
s AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) AS kept FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op6_quality": rf"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {_SPACES}, '')) > 0) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(d.text, '') AS text, len(w)::BIGINT AS n_words,
             length(translate(coalesce(d.text, ''), {_SPACES}, ''))::BIGINT AS word_chars,
             (length(coalesce(d.text, '')) - length(translate(coalesce(d.text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(coalesce(d.text, ''), '\P{{L}}+', '', 'g')) AS letters,
             length(regexp_replace(coalesce(d.text, ''), '\P{{Lu}}+', '', 'g')) AS capitals
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 2 * letters < word_chars OR 2 * capitals > letters
            OR 3 * len(regexp_extract_all(text, '(?m)(\.\.\.|…)[ \t\r]*$')) > n_lines
            OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[-•*][ \t]')) > 9 * n_lines) AS kept
FROM b""",
    "op10_sharding": "SELECT doc_id, source, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents",
    "op11_merkle": r"""
WITH RECURSIVE f AS (SELECT *, crc % 7 = 0 AND doc_id IS NOT NULL AS touched FROM (
         SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(split(coalesce(doc_id, 0)::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                lambda r, b: list_reduce(list_concat([xor(r, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) AS crc FROM documents)),
v AS (SELECT doc_id, lang, touched, n_chars,
             coalesce(len(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
             coalesce(octet_length(encode(text)) || ':' || text, '-') AS b FROM f),
l AS (SELECT doc_id, lang, sha256(a || coalesce(len(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
             sha256(a || coalesce(len((n_chars::HUGEINT + touched::INT)::VARCHAR) || ':' || (n_chars::HUGEINT + touched::INT), '-') || b) AS found FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS level, i, n, leaf AS d FROM o
      UNION ALL SELECT lang, level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, level, i // 2),
g AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS d FROM g UNION ALL SELECT level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT d AS root FROM u WHERE n = 1),
w AS (SELECT row_number() OVER () AS id, o.*, subroot, g.i AS g_i, g.n AS g_n FROM o JOIN g ON o.lang IS NOT DISTINCT FROM g.lang),
p AS (SELECT id, lang, 0 AS level, false AS up, i, n, g_i, g_n, found AS h, '' AS s FROM w
      UNION ALL
      SELECT id, p.lang, CASE WHEN p.n > 1 THEN p.level + 1 ELSE 0 END, up OR p.n = 1, CASE WHEN p.n > 1 THEN p.i // 2 ELSE g_i END, CASE WHEN p.n > 1 THEN (p.n + 1) // 2 ELSE g_n END, g_i, g_n,
             CASE WHEN p.n = 1 THEN h WHEN x.d IS NULL AND y.d IS NULL THEN sha256(h) WHEN p.i % 2 = 0 THEN sha256(h || coalesce(x.d, y.d)) ELSE sha256(coalesce(x.d, y.d) || h) END,
             CASE WHEN p.n = 1 THEN s ELSE s || coalesce(x.d, y.d, '') END
      FROM p LEFT JOIN t x ON NOT up AND p.n > 1 AND x.lang IS NOT DISTINCT FROM p.lang AND x.level = p.level AND x.i = xor(p.i, 1)
             LEFT JOIN u y ON up AND p.n > 1 AND y.level = p.level AND y.i = xor(p.i, 1)
      WHERE NOT up OR p.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(s) AS proof_sha256, h AS folded_root, h = root AS verified
FROM p JOIN w USING (id) CROSS JOIN root WHERE p.up AND p.n = 1""",
    "op12_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
}
