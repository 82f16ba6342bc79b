"""Thin queries over the operators: one ``opN_<name>`` each, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontam, embeddings, lines, minhash, negatives, packing, phrases, pii, secrets, tokens, toxicity, urlgraph, warc
from claimloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.scored(docs, model)
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")), secrets.KINDS[:3])


#: Fixed values of the query.
URL_RULES = [
    urlgraph.Rule("allow", "org", "/"),
    urlgraph.Rule("block", "example.org", "/es/"),
    urlgraph.Rule("block", "example.org", "/en/1"),
    urlgraph.Rule("allow", "com", "/fr/"),
    urlgraph.Rule("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op9_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_texts(table(spark, sf_dir, "documents"), width=5, threshold=0.8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), limit=512)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"), most_words=4, least=30, scale=2_000_000, covered_percent=80, top=2000)
    return found.drop("first_id", "first_at")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, anchors=F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated(table(spark, sf_dir, "documents"), min_documents=10, min_chars=1, keep="none")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_near_vectors": op7_near_vectors,
    "op8_warc": op8_warc,
    "op9_near_texts": op9_near_texts,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op6_decontamination": """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0) t),
sizes AS (SELECT DISTINCT size FROM win),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, sizes WHERE len(w) >= size),
occ AS (SELECT p.doc_id, p.k, p.size, win.item_id FROM places p JOIN win ON win.size = p.size AND win.phrase = array_to_string(p.w[p.k : p.k + p.size - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM occ) t GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) t GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_near_vectors": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding, embedding) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
cnt AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.x = vec_id LEFT JOIN cnt ON cnt.x = vec_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
k AS (SELECT sha, n, max(page_id) AS keeper FROM p GROUP BY sha, n),
d AS (SELECT sha, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
        ((((strpos('0123456789abcdef', substr(sha || '00', CAST((i * 5) // 4 + 1 AS BIGINT), 1)) - 1) * 256
         + (strpos('0123456789abcdef', substr(sha || '00', CAST((i * 5) // 4 + 2 AS BIGINT), 1)) - 1) * 16
         + (strpos('0123456789abcdef', substr(sha || '00', CAST((i * 5) // 4 + 3 AS BIGINT), 1)) - 1)) >> CAST(7 - (i * 5) % 4 AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS digest
      FROM (SELECT DISTINCT sha FROM p) t)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p JOIN k USING (sha, n) JOIN d USING (sha)""",
    "op11_collocations": """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k) t GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM grams WHERE k >= 2 AND f >= 30),
cuts AS (SELECT *, array_to_string(ws[1 : c], ' ') AS head, array_to_string(ws[c + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM cand) t),
scored AS (SELECT cuts.lang, cuts.phrase, a, c, g.f AS l, h.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(g.f AS HUGEINT) + h.f) AS BIGINT) AS score
           FROM cuts JOIN grams g ON g.lang = cuts.lang AND g.phrase = head JOIN grams h ON h.lang = cuts.lang AND h.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
sub AS (SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS longest
        FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand WHERE k > 2) t) t GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, phrase) WHERE longest IS NULL OR CAST(100 AS HUGEINT) * longest < CAST(80 AS HUGEINT) * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) t JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 AND len(a.c) = len(b.c)),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
neg AS (SELECT pos.anchor_id, pos.other AS positive_id, s.other AS negative_id, pos.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY pos.anchor_id, pos.other ORDER BY s.score DESC, s.other) AS rank
        FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT s.same AND 50 * pos.score <= 100 * s.score AND 100 * s.score <= 95 * pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3""",
    "op13_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) t),
gone AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, gone.k IS NOT NULL AS lost FROM l LEFT JOIN gone ON gone.k = l.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
