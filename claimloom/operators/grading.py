"""Source grading: type, relevance, confidence, acceptance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.functions.text import SPACE

# Fixed values.
TYPE_OF_KIND = {"homepage": "official_site", "product": "product_page", "collection": "collection_page", "blog": "blog", "sitemap": "sitemap", "robots": "robots", "search_results": "search_candidate", "review_csv": "csv", "rss": "rss"}
TYPES = ["official_site", "product_page", "collection_page", "blog", "sitemap", "robots", "search_candidate", "csv", "rss", "unknown"]
LEVELS = ["high", "medium", "low"]
PAGE_KINDS = ["homepage", "product", "collection", "blog"]
WEAK_HOST_PARTS = [
    "wabei.", "qcc.", "tianyancha.", "itjuzi.", "36kr.", "huxiu.", "iresearch.", "sohu.", "sina.", "163.com", "qq.com", "baidu.", "zhihu.", "bilibili.", "douyin.", "toutiao.", "ifeng.",
    "jd.com", "taobao.", "tmall.", "1688.", "pinduoduo.", "alibaba.", "aliexpress.", "cosmopolitan.", "trustpilot.",
]
WEAK_TITLE_TERMS = ["新闻", "资讯", "快讯", "财经", "证券", "股票", "信披", "企业信息", "百科", "问答", "社区", "论坛", "门户", "头条", "时尚潮流", "星座运势", "cosmopolitan"]
COMMERCE_WORDS = ["shop", "product", "products", "collection", "collections", "best sellers", "reviews", "bundle", "subscription", "购买", "商品", "品牌", "官网"]
NOT_CONFIRMING = ["robots", "sitemap", "search_candidate", "unknown"]
SHORT_LINE, SHELL_CHARS, SHELL_LINES, SHELL_RATIO = 24, 500, 20, 0.45
SENTENCE_MARK = r"[.!?。！？；;，,]"


def any_of(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(c).contains(t.lower()) for t in terms), F.lit(False))


def topic_terms(*columns: str) -> Column:
    """The columns and their words of two characters or more, and the 3- to 6-grams of long terms in Han script; distinct."""
    whole = F.transform(F.array(*columns), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    split = F.flatten(F.transform(whole, lambda x: F.split(x, r"\s+|/|,|，")))
    terms = F.filter(F.concat(whole, F.transform(split, lambda x: F.trim(x))), lambda x: F.length(x) >= 2)

    def grams(x: Column) -> Column:
        c = F.regexp_replace(x, r"\s+", "")
        n = F.length(c)
        of_size = lambda s: F.when(n >= s, F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.substring(c, i, s)))
        every = F.concat(*(F.coalesce(of_size(s), F.array().cast("array<string>")) for s in (3, 4, 5, 6)))
        return F.when(c.rlike(r"[\x{3400}-\x{9fff}]") & (n >= 5), every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(terms, F.flatten(F.transform(terms, grams))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def has_term(text: Column, terms: Column) -> Column:
    return let(F.lower(text), lambda low: F.exists(terms, lambda x: low.contains(F.lower(x))))


def source_type(kind: Column, host: Column, title: Column, terms: Column) -> Column:
    """What a page is, from its kind; aggregator hosts and news-like titles off topic are unknown."""
    weak_host = reduce(lambda a, b: a | b, (host.contains(p) for p in WEAK_HOST_PARTS))
    weak = kind.isin(*PAGE_KINDS) & (weak_host | (any_of(title, WEAK_TITLE_TERMS) & ~has_term(title, terms)))
    named = F.coalesce(*(F.when(kind == k, v) for k, v in TYPE_OF_KIND.items()), F.lit("unknown"))
    return F.when(weak, "unknown").otherwise(named)


def seeded(url: Column, seed: Column) -> Column:
    """Same origin as the user's URL, and under its path."""
    origin = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
    base = F.regexp_replace(U.path(seed), r"/+$", "")
    return F.coalesce((F.lower(F.regexp_extract(url, origin, 1)) == F.lower(F.regexp_extract(seed, origin, 1))) & (seed != "") & U.path(url).startswith(base), F.lit(False))


def relevance(kind: Column, text: Column, terms: Column, is_seed: Column, commerce: list[str] = COMMERCE_WORDS) -> Column:
    def graded(low: Column) -> Column:
        topic, trade = F.exists(terms, lambda x: low.contains(F.lower(x))), reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in commerce), F.lit(False))
        return F.when(topic & trade, "high").when(topic, "medium").when(is_seed & (trade | (F.length(low) >= 800)), "medium").otherwise("low")

    return F.when(kind.isin("robots", "sitemap"), "medium").otherwise(let(F.lower(text), graded))


def shell_ratio(text: Column) -> Column:
    """(lines, ratio): the share of characters in short lines without sentence marks and digits."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")

    def counted(own: Column) -> Column:
        short = F.filter(own, lambda x: (F.length(x) <= SHORT_LINE) & ~x.rlike(SENTENCE_MARK) & ~x.rlike(r"\d"))
        chars = F.aggregate(short, F.lit(0), lambda a, x: a + F.length(x) + 1)
        return F.struct(F.size(own).alias("lines"), F.when(F.size(own) == 0, 1.0).otherwise(chars / F.greatest(F.lit(1), F.length(text))).alias("ratio"))

    return let(lines, counted)


def navigation_shell(url: Column, text: Column) -> Column:
    def judged(r: Column) -> Column:
        return ((F.length(text) >= SHELL_CHARS) & (r["lines"] >= SHELL_LINES) & (r["ratio"] >= SHELL_RATIO)) | (U.path(url).rlike(U.SHELL_PATH) & ((F.length(text) < 1200) | (r["ratio"] >= 0.25)))

    return let(shell_ratio(text), judged)


def confidence(kind: Column, kind_type: Column, shell: Column, url: Column, text: Column) -> Column:
    n = F.length(text)
    return (
        F.when(shell | (kind_type == "unknown") | (kind == "robots"), "low")
        .when(kind == "sitemap", F.when(n >= 80, "medium").otherwise("low"))
        .when((kind == "homepage") & url.startswith("https://"), F.when(n >= 400, "high").otherwise("medium"))
        .when(kind.isin("product", "collection", "blog", "rss") & (n >= 300), "high")
        .otherwise(F.when(n >= 160, "medium").otherwise("low"))
    )


def grade_sources(df: DataFrame, *, commerce: list[str] = COMMERCE_WORDS) -> DataFrame:
    """``df`` (kind, url, host, title, text, terms, is_seed) with source_type, relevance, confidence, accepted and review_reason."""
    c = F.col
    typed = df.withColumn("source_type", source_type(c("kind"), c("host"), c("title"), c("terms"))).withColumn("relevance", relevance(c("kind"), F.concat_ws("\n", "title", "url", "text"), c("terms"), c("is_seed"), commerce))
    graded = typed.withColumn("shell", navigation_shell(c("url"), c("text"))).withColumn("confidence", confidence(c("kind"), c("source_type"), c("shell"), c("url"), c("text")))
    reason = (
        F.when(c("shell"), "navigation_shell").when(c("source_type").isin("robots", "sitemap", "search_candidate"), F.concat(c("source_type"), F.lit("_only")))
        .when(c("source_type") == "unknown", "aggregator").when(c("relevance") == "low", "off_topic").when(c("confidence") == "low", "weak").when((c("relevance") == "medium") | (c("confidence") == "medium"), "candidate").otherwise("spot_check")
    )
    return graded.withColumns({"accepted": usable_type() & (c("relevance") != "low") & (c("confidence") != "low"), "review_reason": reason})


def usable_type() -> Column:
    return ~F.col("source_type").isin(*NOT_CONFIRMING)


def usable_source() -> Column:
    """The stricter gate for confirming a claim."""
    return F.col("accepted") & (F.col("relevance") != "low") & (F.col("confidence") != "low") & usable_type()


def quality_summary(df: DataFrame, *, run: str) -> DataFrame:
    """(run, dimension, value, n): accepted and rejected documents and counts by type, relevance and confidence; zeros where none."""
    spark = df.sparkSession
    domain = [("accepted", "true"), ("accepted", "false"), *(("source_type", x) for x in TYPES), *((d, x) for d in ("relevance", "confidence") for x in LEVELS)]
    long = F.expr("stack(4, 'accepted', cast(accepted as string), 'source_type', source_type, 'relevance', relevance, 'confidence', confidence) as (dimension, value)")
    counted = df.select(run, long).groupBy(run, "dimension", "value").agg(F.count("*").alias("n"))
    every = df.select(run).distinct().crossJoin(F.broadcast(spark.createDataFrame(domain, "dimension string, value string")))
    return every.join(counted, [run, "dimension", "value"], "left").select(run, "dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))
