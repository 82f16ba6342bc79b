"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import retrieval as T
from claimloom.queries import query


def chunks(t):
    return T.chunk_ids(T.chunk_text(t("documents").select("source", F.col("doc_id").alias("ord"), "text"), run="source"), run="source")


_CHUNKS = """(SELECT *, sha256(source || ':document:' || chunk_index || ':' || text_hash) AS chunk_id FROM (SELECT source, chunk_index, text, sha256(text) AS text_hash FROM (
SELECT source, doc_id * 1000 + start // 1600 AS chunk_index, regexp_replace(substr(text, start + 1, 1800), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT source, doc_id, text, unnest(range(0, length(text), 1600)) AS start FROM documents) a) b WHERE text <> '') c)"""


@query("t1_chunk_text", f"SELECT source, chunk_index, md5(text) AS digest FROM {_CHUNKS} c")
def t1(t):
    return chunks(t).select("source", "chunk_index", F.md5("text").alias("digest"))


@query("t2_chunk_ids", f"SELECT chunk_id, text_hash FROM {_CHUNKS} c")
def t2(t):
    return chunks(t).select("chunk_id", "text_hash")


@query("t3_changed_chunks", f"SELECT source, count(*) AS n FROM {_CHUNKS} c WHERE chunk_id NOT IN (SELECT chunk_id FROM {_CHUNKS} d WHERE chunk_index % 3 = 0) GROUP BY source")
def t3(t):
    c = chunks(t)
    return T.changed_chunks(c, c.where("chunk_index % 3 = 0")).groupBy("source").agg(F.count("*").alias("n"))


_BYTE = "CAST('0x' || substr(sha256(w), {0}, 2) AS INTEGER)"


@query(
    "t4_hash_embed",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents), b AS (SELECT doc_id, {_BYTE.format(1)} % 64 AS bucket, sum(CASE WHEN {_BYTE.format(3)} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY doc_id)
SELECT b.doc_id, bucket, round(v / norm, 6) AS value FROM b JOIN n ON n.doc_id = b.doc_id WHERE v <> 0""",
)
def t4(t):
    e = T.hash_embed(t("documents"), id_col="doc_id")
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


_BM25 = """(WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark), d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
len AS (SELECT doc_id, count(*) AS l FROM d GROUP BY doc_id), tf AS (SELECT doc_id, token, count(*) AS tf FROM d WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT (SELECT count(*) FROM documents) AS n, sum(l) / CAST(count(*) AS DOUBLE) AS mean FROM len),
w AS (SELECT tf.doc_id, tf.token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)) AS w FROM tf JOIN df ON df.token = tf.token JOIN len ON len.doc_id = tf.doc_id CROSS JOIN s),
r AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM w JOIN q ON q.token = w.token GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM r) z WHERE place <= 5)"""


@query("t5_text_search", f"SELECT item_id, doc_id, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM {_BM25} b")
def t5(t):
    return T.text_search(t("documents"), t("benchmark"), k=5, doc_id="doc_id", query_id="item_id").withColumn("score", F.round("score", 4))


_VEC = """(SELECT * FROM (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS place FROM (SELECT a.vec_id AS q, b.vec_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS score
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b) x) y WHERE place <= 5)"""


def nearest(t):
    e = t("embeddings")
    return T.vector_search(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q"), k=5, id_col="vec_id", query_id="q")


@query("t6_vector_search", f"SELECT q, vec_id, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM {_VEC} v")
def t6(t):
    return nearest(t).withColumn("score", F.round("score", 4))


@query("t7_hybrid_search", f"SELECT CASE WHEN t.item_id IS NULL THEN 'vector' ELSE 'text' END AS how, q, CASE WHEN t.item_id IS NULL THEN vec_id ELSE doc_id END AS hit FROM (SELECT q, vec_id FROM {_VEC} v WHERE place = 1) v LEFT JOIN (SELECT item_id, doc_id FROM {_BM25} b WHERE place = 1) t ON t.item_id = v.q UNION ALL SELECT 'text', item_id, doc_id FROM {_BM25} b WHERE place = 1 AND item_id NOT IN (SELECT q FROM {_VEC} v)")
def t7(t):
    text = T.text_search(t("documents"), t("benchmark"), k=1, doc_id="doc_id", query_id="item_id").select(F.col("item_id").alias("q"), F.col("doc_id").alias("hit"))
    return T.hybrid_search(text, nearest(t).where("place = 1").select("q", F.col("vec_id").alias("hit")), query_id="q")
