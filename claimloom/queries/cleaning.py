"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import cleaning as C
from claimloom.queries import query


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_steps(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        column = f"regexp_replace({column}, {sql_text(pattern)}, {sql_text(to.replace('{1}', chr(92) + '1'))}, 'g')"
    return column


def sql_entities(column: str) -> str:
    for name, to in T.ENTITIES:
        column = f"replace({column}, {sql_text(name)}, {sql_text(to)})"
    n = "CAST(CASE WHEN regexp_matches(p, '^&#[0-9]{1,7};$') THEN CAST(substr(p, 3, length(p) - 3) AS BIGINT) WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]{1,7};$') THEN CAST('0x' || substr(p, 4, length(p) - 4) AS BIGINT) ELSE -1 END AS INTEGER)"
    return f"array_to_string(list_transform(regexp_extract_all({column}, {sql_text(T.NUMERIC_ENTITY)}), lambda p: CASE WHEN {n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111 THEN chr({n}) ELSE p END), '')"


def sql_lines(column: str) -> str:
    return f"list_filter(list_transform(string_split(replace({column}, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, {sql_text(T.SPACE + '+')}, ' ', 'g'))), lambda x: x <> '')"


SQL_REASON = f"""CASE WHEN regexp_matches(line, {sql_text(C.SKIP_LINE)}) THEN 'navigation'
 WHEN length(line) <= {C.LEGAL_MOST} AND regexp_matches(line, {sql_text(C.LEGAL_LINE)}) THEN 'privacy_legal'
 WHEN (length(line) <= {C.SOCIAL_MOST} AND {' + '.join(f"CAST(contains(lower(line), '{n}') AS INTEGER)" for n in C.SOCIAL_NAMES)} >= 3) OR (length(line) <= {C.COPYRIGHT_MOST} AND regexp_matches(line, {sql_text(C.COPYRIGHT_LINE)})) THEN 'footer' END"""


# The same blocks without look-ahead: white space is written twice, so that an arrow can take the blank which the next one needs.
_ONCE, _ARROW = "\x01", "\x02"
SQL_BLOCKS = [
    (r"(\s)", rf"\1{_ONCE}\1"), (r"(?m)(?:^|\s)--?>(\s|$)", rf"{_ARROW}\1"), (rf"\s{_ONCE}{_ARROW}", _ARROW), (rf"{_ARROW}(\s?){_ONCE}", rf"{_ARROW}\1"), (rf"(\s){_ONCE}\s", r"\1"), (_ARROW, "\n"),
    C.KNOWN_BLOCKS[1],
    (r"(?i)尊敬的用户[：:][\s\S]{0,300}?《[^》]*个人信息保护政策》[\s\S]{0,600}?[\s\S]{0,600}?(?:确定|同意)(\s*(?:首页|产品|服务|我的|$))", r" \1"),
    *C.KNOWN_BLOCKS[3:],
]


def sql_line_table(columns: str, column: str, table: str) -> str:
    return f"(SELECT {columns}, pos - 1 AS pos, ls[pos] AS line FROM (SELECT {columns}, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT {columns}, {sql_lines(column)} AS ls FROM {table}) a) b)"


@query("c1_html_to_text", f"SELECT page_id, array_to_string({sql_lines('t')}, chr(10)) AS text FROM (SELECT page_id, {sql_entities(sql_steps('html', C.HTML_STEPS))} AS t FROM pages) q")
def c1(t):
    return t("pages").select("page_id", T.normalize_lines(C.html_to_text(F.col("html"))).alias("text"))


@query("c2_markdown_to_text", f"SELECT doc_id, md5({sql_entities(sql_steps('text', C.MARKDOWN_STEPS))}) AS digest FROM documents")
def c2(t):
    return t("documents").select("doc_id", F.md5(C.markdown_to_text(F.col("text"))).alias("digest"))


@query("c3_decode_entities", f"SELECT page_id, md5({sql_entities('html')}) AS digest, length({sql_entities('html')}) AS n FROM pages")
def c3(t):
    c = T.decode_entities(F.col("html"))
    return t("pages").select("page_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query("c4_normalize_lines", f"SELECT doc_id, md5(array_to_string({sql_lines('text')}, chr(10))) AS digest, len({sql_lines('text')}) AS n_lines FROM documents")
def c4(t):
    c = T.lines(F.col("text"))
    return t("documents").select("doc_id", F.md5(F.array_join(c, "\n")).alias("digest"), F.size(c).cast("long").alias("n_lines"))


# known blocks are planted in some pages
NOISE = "Eins --> --> zwei\n--> drei -> vier\n方太隐私声明 a\nb 请勾选方太隐私协议 fünf\n尊敬的用户：您好《某个人信息保护政策》请阅读 同意 首页 sechs\nThis page has been blocked by an extension x ERR_BLOCKED_BY_CLIENT sieben Shop NowShop Now\nOne-time Discount Get up to 20% off + Free Shipping now\nacht\n"
TAILS = ["\nwww.a-b.example # www.a.example is blocked for you", "\n产品搜索 首页 资生堂日本 官方产品介绍网站 a\nb © Shiseido all"]
_NOISY = f"(SELECT page_id, CASE WHEN page_id % 9 = 0 THEN {sql_text(NOISE)} ELSE '' END || {sql_steps('html', C.HTML_STEPS)} || CASE page_id % 9 WHEN 1 THEN {sql_text(TAILS[0])} WHEN 2 THEN {sql_text(TAILS[1])} ELSE '' END AS h FROM pages)"


@query(
    "c5_drop_noise_lines",
    f"""WITH l AS (SELECT *, {SQL_REASON} AS reason FROM {sql_line_table('page_id', sql_steps('h', SQL_BLOCKS), _NOISY)} x)
SELECT p.page_id, coalesce(md5(string_agg(CASE WHEN reason IS NULL THEN line END, chr(10) ORDER BY pos)), md5('')) AS digest, count(reason) AS removed
FROM pages p LEFT JOIN l ON l.page_id = p.page_id GROUP BY p.page_id""",
)
def c5(t):
    n = F.col("page_id") % 9
    text = F.concat(F.when(n == 0, NOISE).otherwise(""), T.replace_all(F.col("html"), C._java(C.HTML_STEPS)), F.when(n == 1, TAILS[0]).when(n == 2, TAILS[1]).otherwise(""))
    return C.drop_noise_lines(t("pages").select("page_id", text.alias("text")), id_col="page_id").select("page_id", F.md5("text").alias("digest"), F.size("removed").cast("long").alias("removed"))


@query(
    "c6_drop_repeated_lines",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) > 1 AND length(line) >= {C.REPEAT_LINE} AS rep FROM {sql_line_table('doc_id', 'text', 'documents')} x)
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN NOT rep THEN line END, chr(10) ORDER BY pos), '')) AS digest, count(*) FILTER (rep) AS dropped FROM l GROUP BY doc_id""",
)
def c6(t):
    return C.drop_repeated_lines(t("documents")).select("doc_id", F.md5("text").alias("digest"), "dropped")


@query("c7_repeated_token_runs")
def c7(t):
    return C.without_repeated_runs(t("documents")).select("doc_id", F.md5("text").alias("digest"), "removed_chars", "removed_runs")


@query(
    "c8_corpus_boilerplate",
    f"""WITH l AS (SELECT * FROM {sql_line_table('doc_id, source', 'text', 'documents')} x),
b AS (SELECT source, line FROM l WHERE length(line) >= {C.REPEAT_LINE} GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, md5(coalesce(string_agg(CASE WHEN b.line IS NULL THEN l.line END, chr(10) ORDER BY pos), '')) AS digest, count(b.line) AS dropped
FROM l LEFT JOIN b ON b.source = l.source AND b.line = l.line GROUP BY doc_id""",
)
def c8(t):
    return C.without_boilerplate(t("documents"), min_docs=3).select("doc_id", F.md5("text").alias("digest"), "dropped")


@query(
    "c9_removed_audit",
    f"""WITH l0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) > 1 AND length(line) >= {C.REPEAT_LINE} AS rep FROM {sql_line_table('doc_id', 'text', 'documents')} x),
l AS (SELECT *, coalesce({SQL_REASON}, CASE WHEN rep THEN 'duplicate_template' END) AS reason FROM l0),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, reason ORDER BY pos) AS k FROM l WHERE reason IS NOT NULL) q WHERE k <= 3),
e AS (SELECT doc_id, count(*) AS segments, string_agg(reason || ':' || CASE WHEN length(line) > 220 THEN substr(line, 1, 217) || '...' ELSE line END, '|' ORDER BY pos) AS excerpts FROM s WHERE n <= 20 GROUP BY doc_id),
a AS (SELECT doc_id, sum(CASE WHEN reason IS NULL THEN length(line) + 1 ELSE 0 END) AS kept, sum(CASE WHEN reason IS NOT NULL THEN length(line) ELSE 0 END) AS removed FROM l GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS source_length, CAST(greatest(0, coalesce(kept - 1, 0)) AS BIGINT) AS cleaned_length, CAST(least(length(d.text), coalesce(removed, 0)) AS BIGINT) AS removed_chars,
 CASE WHEN length(d.text) > 0 THEN least(length(d.text), coalesce(removed, 0)) / CAST(length(d.text) AS DOUBLE) ELSE 0 END AS removed_ratio, coalesce(segments, 0) AS segments, coalesce(excerpts, '') AS excerpts
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
)
def c9(t):
    return C.removed_audit(t("documents"))


def _sql_residual(c: str) -> str:
    parts = {k: f"coalesce(list_sum(list_transform(regexp_extract_all({c}, {sql_text(p)}), lambda x: length(x))), 0)" for k, p in C.RESIDUAL.items()}
    own = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in parts.items())
    return f"SELECT page_id, {own}, CASE WHEN length({c}) > 0 THEN least(1.0, ({' + '.join(parts.values())}) / CAST(length({c}) AS DOUBLE)) ELSE 0 END AS residual_ratio FROM pages"


@query("c10_residual_noise", _sql_residual("html"))
def c10(t):
    return t("pages").select("page_id", *C.residual_noise(F.col("html")))


@query(
    "c11_detect_format",
    r"""SELECT kind, format, count(*) AS n FROM (
SELECT 'page' AS kind, CASE WHEN regexp_matches(html, '(?i)<(!doctype|html|body|article|main|section|div|p|h[1-6]|ul|ol|table)\b') THEN 'html' WHEN regexp_matches(html, '!?\[[^\]]*\]\([^)]+\)') THEN 'markdown' ELSE 'text' END AS format FROM pages
UNION ALL SELECT 'document', CASE WHEN regexp_matches(text, '(?i)<(!doctype|html|body|article|main|section|div|p|h[1-6]|ul|ol|table)\b') THEN 'html' WHEN regexp_matches(text, '!?\[[^\]]*\]\([^)]+\)') THEN 'markdown' ELSE 'text' END FROM documents) q GROUP BY kind, format""",
)
def c11(t):
    both = t("pages").select(F.lit("page").alias("kind"), F.col("html").alias("c")).unionByName(t("documents").select(F.lit("document").alias("kind"), F.col("text").alias("c")))
    return both.groupBy("kind", C.detect_format(F.col("c")).alias("format")).agg(F.count("*").alias("n"))


@query("c12_truncate_text", "SELECT doc_id, length(text) > 12000 AS truncated, substr(text, 1, 160) AS excerpt, md5(substr(text, 1, 12000)) AS digest FROM documents")
def c12(t):
    return C.truncated(t("documents")).select("doc_id", "truncated", "excerpt", F.md5("text").alias("digest"))
