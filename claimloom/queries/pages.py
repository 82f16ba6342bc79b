"""Queries of the marketplace operators: a part's columns make the text of its page."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions.text import SPACE
from claimloom.operators import pages as A
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text
from claimloom.sources.spread import spread

_TEXT = """('https://shop.example/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' and /gp/product/b' || lpad(CAST(p_partkey // 2 AS VARCHAR), 9, '0') || '/' || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN 'Title: Amazon.com: ' || p_name || ' : Home & Kitchen' WHEN p_partkey % 7 < 4 THEN '# ' || p_name || ' ' || p_type || ' for all of us' || chr(10) || '# Unlock the potential savings' ELSE '# ' || p_name || ' ' || p_type END || chr(10)
 || CASE WHEN p_partkey % 3 = 0 THEN '| Brand | ' || p_brand || ' |' WHEN p_partkey % 3 = 1 THEN 'Visit the ' || p_brand || ' Store' ELSE '' END || chr(10) || CASE WHEN p_size > 5 THEN 'Price: $' || CAST(p_size AS VARCHAR) || '.99' ELSE 'captcha' END || chr(10)
 || CASE WHEN p_size % 2 = 0 THEN '4.' || CAST(p_size % 10 AS VARCHAR) || ' out of 5 stars, ' || CAST(p_partkey AS VARCHAR) || ' global ratings' ELSE '' END || chr(10) || '# About this item' || chr(10) || ' - ' || repeat(p_name || ' ', p_size % 5) || 'made of ' || p_type || chr(10) || '- short' || chr(10)
 || '### Top reviews from buyers' || chr(10) || CASE WHEN p_partkey % 5 < 2 THEN repeat('##### **Fine** [' || p_name || '](http://x/y)' || chr(10) || 'Verified Purchase' || chr(10) || repeat('The ' || p_name || ' works well. ', 2 + p_size % 50) || chr(10) || 'It came in a box of ' || p_type || '!' || chr(10), 1 + p_size % 2)
 || '##### Empty' || chr(10) || 'ok' || chr(10) || CASE WHEN p_size % 3 = 0 THEN repeat('| filler' || chr(10), 500) ELSE '' END || '##### Late' || chr(10) || 'This one stands far down the page, it does.' || chr(10) ELSE repeat('I like the ' || p_name || '. ', p_size % 6) END || chr(10) || 'Helpful' || chr(10) || '## Related' || chr(10) || 'This line belongs to no review, it is too late for that.')"""


def page_texts(t):
    text = F.expr(_TEXT.replace("VARCHAR", "STRING").replace("p_partkey // 2", "p_partkey DIV 2"))
    return spread(t("part").select(F.col("p_partkey").alias("page_id"), "p_size", "p_type", text.alias("text")))


_PAGES = f"(SELECT p_partkey AS page_id, p_size, p_type, {_TEXT} AS text FROM part)"
_CLEAN_ID = A.PRODUCT_ID


@query("a1_product_ids", f"SELECT page_id, CAST(min(k) - 1 AS INTEGER) AS pos, product FROM (SELECT page_id, k, upper(ids[k]) AS product FROM (SELECT page_id, ids, unnest(range(1, len(ids) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(text, {sql_text(A.PRODUCT_ID)}, 1) AS ids FROM {_PAGES} p) a) b) c GROUP BY page_id, product")
def a1(t):
    return A.product_ids(page_texts(t))


def _clean(c):
    marks = f"regexp_replace(regexp_replace({c}, '^(?:[-*#>]|{SPACE})+', ''), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    return f"trim(regexp_replace({marks}, '{SPACE}+', ' ', 'g'))"


def _first(c, patterns):
    return _clean("coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {sql_text(p)}, 1), '')" for p in patterns) + ", '')")


def _each(items, keep, of=None):
    return f"list_filter(list_transform({items}, lambda x: {of or _clean('x')}), lambda x: {keep})"


def _unique(items):
    return f"list_transform(list_filter(list_zip({items}, range(1, len({items}) + 1)), lambda z: list_position({items}, z[1]) = z[2]), lambda z: z[1])"


_MAIN = f"split_part(text, '{A.ABOUT}', 1)"
_NAMED = f"""trim(regexp_replace(regexp_replace(regexp_replace({_clean("regexp_extract(text, '(?im)^Title:\\s*(.+)$', 1)")}, '(?i)^Title:\\s*', ''), '(?i)^Amazon\\.com\\s*:\\s*', ''), {sql_text(A.SHOP_SECTION)}, ''))"""
_HEADINGS = _each(f"regexp_extract_all({_MAIN}, '(?m)^#\\s+(.+)$', 1)", f"length(x) >= 20 AND NOT regexp_matches(x, {sql_text(A.NO_MAIN_TITLE)})")
_LINES = _each("string_split(text, chr(10))", f"length(x) BETWEEN 15 AND 240 AND NOT regexp_matches(x, {sql_text(A.NO_HEADING)})")
_TITLE = f"coalesce(nullif({_NAMED}, ''), {_HEADINGS}[-1], {_LINES}[1], '')"
_BULLETS = _each(f"list_filter(string_split(split_part(split_part(text, '{A.ABOUT}', 2), chr(10) || '#', 1), chr(10)), lambda x: regexp_matches(x, '^\\s*-\\s+'))", f"length(x) BETWEEN 35 AND 420 AND NOT regexp_matches(x, {sql_text(A.NO_BULLET)})")
_SECTION = "split_part(split_part(text, '### Top reviews from buyers', 2), chr(10) || '## ', 1)"
_SAYS = f"NOT regexp_matches(x, {sql_text(A.REJECTED)}) AND regexp_matches(x, '[.!?。！？]') AND NOT regexp_matches(x, '^!\\[|^\\|') AND NOT regexp_matches(x, '(?i)https?://')"
_BODY = _unique(_each("string_split(b, chr(10))[2:]", f"length(x) >= 30 AND {_SAYS}"))
_BLOCKS = f"list_filter(list_transform(string_split({_SECTION}, '##### ')[2:], lambda b: CASE WHEN len({_BODY}) > 0 THEN {_clean('string_split(b, chr(10))[1]')} || ': ' || trim(substr(array_to_string({_BODY}, ' '), 1, 1000)) END), lambda y: y IS NOT NULL)"
_PLAIN = _each(f"string_split({_SECTION}, chr(10))", f"length(x) BETWEEN 45 AND 700 AND {_SAYS}")
_SNIPPETS = f"CASE WHEN contains({_SECTION}, '##### ') THEN {_unique(_BLOCKS)} ELSE {_PLAIN} END[1:8]"
_FIELDS = f"""(SELECT *, (CAST(product <> '' AS INTEGER) + CAST(title <> '' AS INTEGER) + CAST(brand <> '' AS INTEGER) + CAST(price <> '' AS INTEGER) + CAST(rating <> '' AS INTEGER) + CAST(reviews <> '' AS INTEGER) + CAST(len(bullets) > 0 AS INTEGER)) / 7.0 AS coverage FROM (
SELECT page_id, p_size, p_type, upper(regexp_extract(text, {sql_text(A.PRODUCT_ID)}, 1)) AS product, {_TITLE} AS title, {_first('text', A.BRAND)} AS brand, {_first(_MAIN, A.PRICE)} AS price,
{_first('text', A.RATING)} AS rating, {_first('text', A.REVIEWS)} AS reviews, {_BULLETS} AS bullets, {_SNIPPETS} AS snippets, regexp_matches(text, {sql_text(A.BLOCKED)}) AS blocked FROM {_PAGES} p) q)"""


@query("a2_page_fields", f"SELECT page_id, product, title, brand, price, rating, reviews, array_to_string(bullets, '|') AS bullets, array_to_string(snippets, '|') AS snippets, blocked, coverage FROM {_FIELDS} f")
def a2(t):
    return A.page_fields(page_texts(t)).withColumns({"bullets": F.array_join("bullets", "|"), "snippets": F.array_join("snippets", "|")})


def fitted(t):
    pages = page_texts(t).withColumn("fit", F.when(F.col("p_size") % 4 > 0, "direct").otherwise("adjacent"))
    return A.page_fields(pages, keep=("p_type", "fit"))


@query(
    "a3_select_pages",
    f"SELECT p_type, page_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN len(snippets) > 0 THEN 0 ELSE 1 END, len(snippets) DESC, coverage DESC, page_id) AS place FROM {_FIELDS} f WHERE NOT blocked AND p_size % 4 > 0 AND coverage >= 0.7) q WHERE place <= 3",
)
def a3(t):
    return A.select_pages(fitted(t), run="p_type", fit="fit").select("p_type", "page_id", "place")


@query("a4_review_stats", f"SELECT p_type, CAST(sum(len(snippets)) AS BIGINT) AS snippets, count(*) FILTER (len(snippets) > 0) AS pages FROM {_FIELDS} f GROUP BY p_type")
def a4(t):
    return A.review_stats(fitted(t), run="p_type")
