"""Queries of the URL operators. Candidates are the pages' URLs with a section from their number put into the path."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators import urls as O
from claimloom.queries import query
from claimloom.queries.cleaning import sql_text

SECTIONS = ["", "/products/p", "/collections/c", "/blog/post", "/news", "/sitemap.xml", "/robots.txt", "/feed/", "/guides/g"]


def with_url(df):
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("page_id") % len(SECTIONS) + 1).cast("int"))
    return df.withColumn("cand", F.concat(F.regexp_extract("url", r"^(https?://[^/]*)", 1), section, F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1)))


def candidates(t):
    c = with_url(t("pages"))
    run = F.regexp_extract("url", r"^https?://[^/]*/([a-z]+)", 1)
    u = F.col("cand")
    return c.select(F.col("page_id").alias("ord"), run.alias("run"), u.alias("url"), U.hostname(u).alias("host"), U.kind(u).alias("kind"), (F.col("page_id") % 5 == 0).alias("preferred"), O.score(u, U.kind(u), u.contains("the")).alias("score"))


def sql_host(u: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(regexp_extract(trim({u}), '{U.AUTHORITY}', 1), '')), '^.*@', ''), ':\\d+$', ''), '^www\\.', '')"


def sql_path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract(trim({u}), '{U.PATH}', 1), ''), '/')"


def sql_canonical(u: str) -> str:
    q = f"list_sort(list_filter(string_split(regexp_extract(trim({u}), '{U.QUERY}', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{U.TRACKING}')))"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim({u}), '{U.AUTHORITY}', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\\.', '')"
    p = f"coalesce(nullif(regexp_replace(regexp_replace({sql_path(u)}, '/{{2,}}', '/', 'g'), '/+$', ''), ''), '/')"
    return f"CASE WHEN lower(regexp_extract(trim({u}), '{U.SCHEME}', 1)) IN ('http', 'https') AND {host} <> '' THEN lower(regexp_extract(trim({u}), '{U.SCHEME}', 1)) || '://' || {host} || {p} || CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END END"


def sql_kind(u: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({sql_path(u)}), '{p}') THEN '{k}'" for k, p in U.KIND_PATHS) + " ELSE 'homepage' END"


def sql_public(u: str) -> str:
    return f"coalesce(lower(regexp_extract(trim({u}), '{U.SCHEME}', 1)) IN ('http', 'https') AND NOT contains(regexp_extract(trim({u}), '{U.AUTHORITY}', 1), '@') AND {sql_host(u)} <> '' AND NOT regexp_matches({sql_host(u)}, '{U.PRIVATE_HOST}'), false)"


def sql_useful(u: str) -> str:
    skipped = " OR ".join(f"contains({sql_host(u)}, '{s}')" for s in U.SKIPPED_HOST_PARTS)
    hosts = ", ".join(f"'{h}'" for h in U.SEARCH_HOSTS)
    return f"({sql_public(u)} AND NOT {sql_host(u)} IN ({hosts}) AND NOT ({skipped}) AND NOT regexp_matches(coalesce({u}, ''), '{U.FILE_ENDING}'))"


def sql_score(u: str, kind: str, topic: str) -> str:
    base = "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {n}" for k, n in O.BASE_SCORES.items()) + " END"
    p = sql_path(u)
    return (
        f"({base} + least(len(list_filter(string_split({p}, '/'), lambda x: x <> '')), 4) * 4 + CASE WHEN {topic} THEN 30 ELSE 0 END - CASE WHEN regexp_matches({p}, '{U.ROOT_PATH}') THEN 60 ELSE 0 END"
        f" - CASE WHEN regexp_matches({p}, '{U.SHELL_PATH}') THEN 45 ELSE 0 END + CASE WHEN regexp_matches({p}, '{O.DEEP_ITEM}') THEN 15 ELSE 0 END)"
    )


_SECTION = "list_extract([" + ", ".join(f"'{s}'" for s in SECTIONS) + f"], CAST(page_id % {len(SECTIONS)} + 1 AS INTEGER))"
SQL_CAND = f"(SELECT page_id, url, html, regexp_extract(url, '^(https?://[^/]*)', 1) || {_SECTION} || regexp_extract(url, '^https?://[^/]*(.*)$', 1) AS cand FROM pages)"
SQL_CANDIDATES = f"(SELECT page_id AS ord, regexp_extract(url, '^https?://[^/]*/([a-z]+)', 1) AS run, cand AS url, {sql_host('cand')} AS host, {sql_kind('cand')} AS kind, page_id % 5 = 0 AS preferred, {sql_score('cand', '(' + sql_kind('cand') + ')', "contains(cand, 'the')")} AS score FROM {SQL_CAND} q)"


@query("u1_canonical_url", f"SELECT page_id, {sql_canonical('url')} AS canonical FROM pages")
def u1(t):
    return t("pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("u2_hostname", f"SELECT host, count(*) AS n FROM (SELECT {sql_host('url')} AS host FROM pages) q GROUP BY host")
def u2(t):
    return t("pages").groupBy(U.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("u3_is_public_url", f"SELECT page_id, {sql_public('url')} AS public, {sql_public('replace(url, ' + sql_text('://') + ', ' + sql_text('://10.0.0.1/') + ')')} AS private_variant FROM pages")
def u3(t):
    return t("pages").select("page_id", U.is_public(F.col("url")).alias("public"), U.is_public(F.replace("url", F.lit("://"), F.lit("://10.0.0.1/"))).alias("private_variant"))


@query("u4_classify_url", f"SELECT page_id, {sql_kind('cand')} AS kind, regexp_matches({sql_path('cand')}, '{U.ROOT_PATH}') AS is_root, regexp_matches({sql_path('cand')}, '{U.SHELL_PATH}') AS is_shell FROM {SQL_CAND} q")
def u4(t):
    u = F.col("cand")
    return with_url(t("pages")).select("page_id", U.kind(u).alias("kind"), U.path(u).rlike(U.ROOT_PATH).alias("is_root"), U.path(u).rlike(U.SHELL_PATH).alias("is_shell"))


_ABS = "CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN h LIKE '//%' THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || ':' || h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') OR h = '' OR h LIKE '#%' THEN NULL WHEN h LIKE '/%' THEN o || h WHEN h LIKE '?%' THEN o || p || h ELSE o || regexp_replace(p, '[^/]*$', '') || h END"


@query(
    "u5_extract_links",
    f"""SELECT DISTINCT page_id, link FROM (SELECT page_id, {sql_canonical('a')} AS link FROM (SELECT page_id, {_ABS} AS a FROM (SELECT page_id, url, trim(h) AS h,
lower(regexp_extract(url, '{U.SCHEME}', 1)) || '://' || regexp_extract(url, '{U.AUTHORITY}', 1) AS o, {sql_path('url')} AS p
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {sql_text(O.ANCHOR)}, 1)) AS h FROM pages UNION ALL SELECT page_id, url, unnest(regexp_extract_all(html, {sql_text(O.ALTERNATE)}, 1)) FROM pages) x) y) z) w
WHERE link IS NOT NULL AND {sql_useful('link')}""",
)
def u5(t):
    return O.extract_links(t("pages"))


@query("u6_useful_url_filter", f"SELECT page_id, cand AS url FROM {SQL_CAND} q WHERE {sql_useful('cand')}")
def u6(t):
    return with_url(t("pages")).where(U.useful(F.col("cand"))).select("page_id", F.col("cand").alias("url"))


def mapped(df):
    """Every page's map lists itself, an account page of its site and a page of another host."""
    part = F.element_at(F.array(*map(F.lit, MAPPED_PARTS)), (F.col("page_id") % len(MAPPED_PARTS) + 1).cast("int"))
    return df.withColumn("link", F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("https://other.example"), F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1))).otherwise(F.concat(F.col("url"), part)))


MAPPED_PARTS = ["", "/cart", "/account/x", "/login.php", "/cartoon", "/Terms-of-use", "/search"]
_MAPPED = f"(SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN 'https://other.example' || regexp_extract(url, '^https?://[^/]*(.*)$', 1) ELSE url || list_extract([{', '.join(map(sql_text, MAPPED_PARTS))}], CAST(page_id % {len(MAPPED_PARTS)} + 1 AS INTEGER)) END AS link FROM pages)"


@query("u6_mapped_url_filter", f"SELECT page_id, link FROM {_MAPPED} q WHERE {sql_useful('link')} AND {sql_host('link')} = {sql_host('url')} AND NOT regexp_matches({sql_path('link')}, {sql_text(U.MAPPED_PATH)})")
def u6b(t):
    return mapped(t("pages")).where(U.useful_mapped(F.col("link"), F.col("url"))).select("page_id", "link")


def _bodies(t, line):
    own = F.array_sort(F.collect_list(F.struct("page_id", line.alias("line"))))
    return t("pages").groupBy(U.hostname(F.col("url")).alias("host")).agg(F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("body"))


@query(
    "u7_sitemap_urls",
    f"""WITH l AS (SELECT {sql_host('url')} AS host, row_number() OVER (PARTITION BY {sql_host('url')} ORDER BY page_id) - 1 AS pos, url FROM pages)
SELECT host, CAST(pos AS INTEGER) AS pos, {sql_canonical('url')} AS url FROM l WHERE pos < 80""",
)
def u7(t):
    bodies = _bodies(t, F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>")))
    return O.sitemap_urls(bodies, key="host")


@query("u7_robots_sitemaps", f"SELECT {sql_host('url')} AS host, url AS sitemap FROM pages")
def u7b(t):
    return O.robots_sitemaps(_bodies(t, F.concat(F.lit("Sitemap: "), F.col("url"))), key="host")


@query(
    "u8_feed_items",
    f"""WITH l AS (SELECT {sql_host('url')} AS host, row_number() OVER (PARTITION BY {sql_host('url')} ORDER BY page_id) - 1 AS pos, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)
SELECT host, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title, url AS link, 'see ' || url AS description FROM l WHERE pos < 20""",
)
def u8(t):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return O.feed_items(_bodies(t, F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), F.col("url"), F.lit("</link><description><b>see</b>"), F.col("url"), F.lit("</description></item>"))), key="host")


@query(
    "u9_robots_filter",
    f"""WITH r AS (SELECT DISTINCT {sql_host('url')} AS host, '/' || regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) || '/' || regexp_extract(url, '/([0-9])', 1) AS prefix FROM pages WHERE page_id % 7 = 0)
SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.host = {sql_host('p.url')} AND starts_with({sql_path('p.url')}, r.prefix) AND length(prefix) > 1)""",
)
def u9(t):
    rule = F.concat(F.lit("User-agent: x\nDisallow: /"), F.regexp_extract("url", r"^https?://[^/]*/([a-z]+)/", 1), F.lit("/"), F.regexp_extract("url", r"/([0-9])", 1), F.lit("*?q"))
    # some hosts state rules
    some = lambda name: t(name).where("page_id % 7 = 0")
    rules = O.robots_rules(_bodies(some, rule), key="host")
    pages = t("pages").withColumn("host", U.hostname(F.col("url")))
    return O.robots_filter(pages, rules, key="host").select("page_id", "url")


@query("u10_dedupe_urls", f"SELECT min(page_id) AS ord, c AS canonical FROM (SELECT page_id, {sql_canonical('url')} AS c FROM pages) q WHERE c IS NOT NULL GROUP BY c")
def u10(t):
    return O.dedupe_urls(t("pages").select(F.col("page_id").alias("ord"), "url")).select("ord", "canonical")


@query("u11_score_candidates", f"SELECT ord, kind, score FROM {SQL_CANDIDATES} q")
def u11(t):
    return candidates(t).select("ord", "kind", "score")


_CAPS = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {n}" for k, n in O.KIND_CAPS.items()) + " ELSE 30 END"
_GROUP = "CASE " + " ".join(f"WHEN kind = '{k}' AND f = 1 THEN {i}" for i, k in enumerate(O.EVIDENCE_KINDS)) + " WHEN preferred THEN 10 ELSE 20 END"


@query(
    "u12_select_with_caps",
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY ord) AS f FROM {SQL_CANDIDATES} q), b AS (SELECT *, {_GROUP} AS g FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY g, ord) AS k FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY g, ord) AS place FROM c WHERE k <= {_CAPS})
SELECT run, CAST(place AS INTEGER) AS place, ord, kind FROM d WHERE place <= 30""",
)
def u12(t):
    return O.select_with_caps(candidates(t), run="run", total=30).select("run", "place", "ord", "kind")


@query("u13_select_evidence_first")
def u13(t):
    return O.select_evidence_first(candidates(t), run="run", total=12)


@query("u14_kind_mix", f"SELECT run, {', '.join(f'count(*) FILTER (kind = {sql_text(k)}) AS {k}' for k in U.KINDS)} FROM {SQL_CANDIDATES} q GROUP BY run")
def u14(t):
    return O.kind_mix(candidates(t), run="run")


@query(
    "u15_registry_match",
    """WITH reg AS (SELECT n_name AS name, 'https://' || lower(replace(n_name, ' ', '')) || '.example' AS url, list_extract(['default', 'env', 'fixed'], CAST(n_regionkey % 3 + 1 AS INTEGER)) AS origin, lower(substr(p_type, 1, 3)) AS term
FROM nation JOIN (SELECT DISTINCT p_type, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT p_type FROM part) a) b ON k = n_nationkey + 1)
SELECT p_partkey, name, url, origin FROM part JOIN reg ON contains(lower(replace(p_type, ' ', '')) || chr(10) || lower(replace(p_brand, ' ', '')), term)""",
)
def u15(t):
    from pyspark.sql import Window

    kinds = t("part").select("p_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("p_type")))
    origin = F.element_at(F.array(F.lit("default"), F.lit("env"), F.lit("fixed")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    registry = t("nation").join(kinds, F.col("k") == F.col("n_nationkey") + 1).select(F.col("n_name").alias("name"), F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".example")).alias("url"), origin.alias("origin"), F.array(F.substring("p_type", 1, 3)).alias("terms"))
    return O.registry_match(t("part").select("p_partkey", F.array("p_type", "p_brand").alias("terms")), registry, id_col="p_partkey")


_TABLES = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{x}' AS target_table" for k, v in O.KIND_TABLES.items() for x in v)


@query("u16_target_tables", f"SELECT ord, target_table FROM {SQL_CANDIDATES} c JOIN ({_TABLES}) m ON m.kind = c.kind")
def u16(t):
    return O.target_tables(candidates(t)).select("ord", "target_table")


@query(
    "u16_targets_to_sources",
    f"""WITH s AS (SELECT page_id AS source_id, page_id % 4 AS candidate_id, {sql_host('url')} AS value FROM pages WHERE page_id % 3 > 0), g AS (SELECT page_id AS target_id, page_id % 5 AS candidate_id, {sql_host('url')} AS value FROM pages)
SELECT target_id, coalesce((SELECT min(source_id) FROM s WHERE s.candidate_id = g.candidate_id AND s.value = g.value), (SELECT min(source_id) FROM s WHERE s.value = g.value)) AS source_id FROM g""",
)
def u16b(t):
    p = t("pages").withColumn("value", U.hostname(F.col("url")))
    # some pages are no source
    sources = p.where("page_id % 3 > 0").select(F.col("page_id").alias("source_id"), (F.col("page_id") % 4).alias("candidate_id"), "value")
    return O.targets_to_sources(p.select(F.col("page_id").alias("target_id"), (F.col("page_id") % 5).alias("candidate_id"), "value"), sources)


@query(
    "u17_role_for_host",
    f"""WITH r AS (SELECT host AS suffix, 'host_' || min(page_id) AS role FROM (SELECT page_id, {sql_host('url')} AS host FROM pages WHERE page_id % 9 = 0) a GROUP BY host UNION ALL SELECT 'example.org', 'organisation' UNION ALL SELECT 'example.com', 'company'),
m AS (SELECT page_id, role, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS k FROM pages JOIN r ON {sql_host('url')} = suffix OR ends_with({sql_host('url')}, '.' || suffix))
SELECT p.page_id, m.role FROM pages p LEFT JOIN m ON m.page_id = p.page_id AND k = 1""",
)
def u17(t):
    p = t("pages").select("page_id", U.hostname(F.col("url")).alias("host"))
    # some hosts have a rule
    rules = p.where("page_id % 9 = 0").groupBy(F.col("host").alias("suffix")).agg(F.concat(F.lit("host_"), F.min("page_id")).alias("role"))
    rules = rules.unionByName(p.select(F.regexp_extract("host", r"(example\.(org|com))$", 1).alias("suffix")).where("suffix <> ''").distinct().withColumn("role", F.when(F.col("suffix") == "example.org", "organisation").otherwise("company")))
    return O.role_for_host(p, rules, id_col="page_id")
