"""Marketplace pages: product ids, fields, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import SPACE

# The first pattern that matches gives the field.
PRODUCT_ID = r"/(?:dp|gp/product)/([A-Za-z0-9]{10})(?:[/?\s\")]|$)"
BRAND = [r"(?im)^\|\s*Brand\s*\|\s*([^|\n]+)\|", r"(?i)(?:Brand|品牌)\s*[:|]\s*([^\n|]{2,100})", r"(?i)Visit the\s+([^\n]{2,100}?)\s+Store"]
PRICE = [r"(?i)One-Time Price:\s*((?:US)?\$\s?\d[\d,]*(?:\.\d{2})?)", r'(?i)"displayPrice":"((?:US)?\$\d[\d,]*(?:\.\d{2})?)"', r"(?i)(?:Price|价格)\s*[:|]?\s*((?:US)?\$\s?\d[\d,]*(?:\.\d{2})?)", r"(?i)((?:US)?\$\s?\d[\d,]*(?:\.\d{2})?)"]
RATING = [r"(?i)\|\s*Customer Reviews\s*\|\s*(\d(?:\.\d)?)\s*_[^\n]*averageCustomerReviewsAnchor", r"(?i)(\d(?:\.\d)?)\s+out of 5 stars", r"(\d(?:\.\d)?)\s*/\s*5"]
REVIEWS = [r"(?i)\|\s*Customer Reviews\s*\|[^\n]*?\[\((\d[\d,]*)\)\]\([^\n]*averageCustomerReviewsAnchor", r"(?i)([\d,]+)\s+(?:global\s+)?ratings?", r"(?i)([\d,]+)\s+(?:customer\s+)?reviews?"]
BLOCKED = r"(?i)(robot check|enter the characters|sorry! something went wrong|service unavailable|api error|captcha)"
ABOUT = "# About this item"
TOP_REVIEWS = r"(?is)### Top reviews[^\n]*(.{0,40000})"
REJECTED = r"(?i)^(?:helpful|report|read more|verified purchase|reviewed in|size:|style:|color:|sort reviews|filter by|loading|there was a problem|see more reviews|customer image|brief content|full content|beginning of dialog|images in this review|amazon customer|sorry|thank you|thanks|sending feedback|sponsored|video|video player|current time|duration|loaded:|remaining time|stream type|chapters|descriptions|captions|english|default|\d+x$|\d+ people? found this helpful|\d(?:\.\d)? out of 5 stars)"
NO_BULLET = r"(?i)^(?:image|video|click|see more|report an issue)"
NO_MAIN_TITLE = r"(?i)product summary presents|unlock|choose how often|skip or cancel|potential savings|pricing|added to cart"
NO_HEADING = r"(?i)amazon|skip to|deliver to|search"
SHOP_SECTION = r"(?i)\s*:\s*(?:Pet Supplies|Health & Household|Beauty & Personal Care|Home & Kitchen)\s*$"


def product_ids(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(id, pos, product): ids in links, each once, in the order in which they come."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(PRODUCT_ID), F.lit(1)), lambda x: F.upper(x)))
    return pages.select(id_col, F.posexplode(found).alias("pos", "product"))


def clean_line(c: Column) -> Column:
    """A line without marks in front, links as their texts, white space squeezed."""
    c = F.regexp_replace(F.regexp_replace(c, rf"^(?:[-*#>]|{SPACE})+", ""), r"\[([^\]]+)]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\\([|_*])", "$1"), SPACE + "+", " "))


def first_match(c: Column, patterns: list[str]) -> Column:
    return clean_line(F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns), F.lit("")))


def product_title(c: Column) -> Column:
    """The first there is: the title line, the last long heading before the product's description, the first line of
    15 to 240 characters."""
    named = clean_line(F.regexp_extract(c, r"(?im)^Title:\s*(.+)$", 1))
    named = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(named, r"(?i)^Title:\s*", ""), r"(?i)^Amazon\.com\s*:\s*", ""), SHOP_SECTION, ""))
    region = F.when(c.contains(ABOUT), F.substring_index(c, ABOUT, 1)).otherwise(F.substring(c, 1, 10_000))
    headings = F.filter(F.transform(F.regexp_extract_all(region, F.lit(r"(?m)^#\s+(.+)$"), F.lit(1)), clean_line), lambda x: (F.length(x) >= 20) & ~x.rlike(NO_MAIN_TITLE))
    lines = F.filter(F.transform(F.split(c, r"\n+"), clean_line), lambda x: F.length(x).between(15, 240) & ~x.rlike(NO_HEADING))
    return F.coalesce(F.nullif(named, F.lit("")), F.try_element_at(headings, F.lit(-1)), F.try_element_at(lines, F.lit(1)), F.lit(""))


def bullets(c: Column) -> Column:
    """Up to six points of the description, which ends at a heading or after 4,000 characters."""
    section = F.substring(c, F.instr(c, ABOUT) + len(ABOUT), 4_000 - len(ABOUT))
    lines = F.split(F.split(section, r"\n#{1,4}\s+")[0], r"\n+")
    found = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*-\s+")), clean_line), lambda x: F.length(x).between(35, 420) & ~x.rlike(NO_BULLET))
    return F.when(c.contains(ABOUT), F.slice(F.array_distinct(found), 1, 6)).otherwise(F.array().cast("array<string>"))


def snippets(c: Column) -> Column:
    """Up to eight reviews of the section of top reviews, which ends at a heading or after 40,000 characters: a title and
    the sentences of its block where reviews have headings, else single lines."""
    found = F.split(F.regexp_extract(c, TOP_REVIEWS, 1), r"\n#{2,3}\s+")[0]
    says = lambda x: ~x.rlike(REJECTED) & x.rlike(r"[.!?。！？]") & ~x.rlike(r"^!\[|^\|") & ~x.rlike(r"(?i)https?://")
    lines = lambda x: F.transform(F.split(x, r"\n{2,}|\r?\n"), clean_line)

    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - worked out once, not at each use

    def review(block: Column) -> Column:
        title = clean_line(F.regexp_extract(block, r"(?m)^#####\s+(.+)$", 1))
        body = lambda t: F.trim(F.substring(F.array_join(F.array_distinct(F.filter(lines(block), lambda x: (F.length(x) >= 30) & (x != t) & says(x))), " "), 1, 1_000))
        return bound(title, lambda t: bound(body(t), lambda b: F.when(b != "", F.concat(t, F.lit(": "), b))))

    blocks = lambda section: F.filter(F.split(section, r"(?m)(?=^#####\s+.)"), lambda x: x.rlike(r"^#####\s+."))
    plain = lambda section: F.filter(lines(section), lambda x: F.length(x).between(45, 700) & says(x))
    chosen = bound(found, lambda section: bound(blocks(section), lambda b: F.when(F.size(b) > 0, F.array_compact(F.transform(b, review))).otherwise(plain(section))))
    return F.slice(F.array_distinct(chosen), 1, 8)


def page_fields(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to ``keep``, product, title, brand, price, rating, reviews, bullets, snippets, blocked, coverage): one projection; coverage is the share of seven fields that are there."""
    c = F.col(text_col)
    main = F.when(F.instr(c, ABOUT) > 1, F.substring_index(c, ABOUT, 1)).otherwise(F.substring(c, 1, 8_000))
    fields = pages.select(
        id_col, *keep, F.upper(F.regexp_extract(c, PRODUCT_ID, 1)).alias("product"), product_title(c).alias("title"), first_match(c, BRAND).alias("brand"), first_match(main, PRICE).alias("price"),
        first_match(c, RATING).alias("rating"), first_match(c, REVIEWS).alias("reviews"), bullets(c).alias("bullets"), snippets(c).alias("snippets"), c.rlike(BLOCKED).alias("blocked"),
    )
    filled = sum(((F.col(k) != "").cast("int") for k in ("product", "title", "brand", "price", "rating", "reviews")), (F.size("bullets") > 0).cast("int"))
    return fields.withColumn("coverage", filled / 7)


def select_pages(fields: DataFrame, *, run: str, fit: str, k: int = 3, id_col: str = "page_id", least: float = 0.7) -> DataFrame:
    """Per run the ``k`` best pages that are not blocked, fit directly and have enough fields."""
    order = [(F.size("snippets") > 0).desc(), F.size("snippets").desc(), F.desc("coverage"), F.asc(id_col)]
    ok = fields.where(~F.col("blocked") & (F.col(fit) == "direct") & (F.col("coverage") >= least))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where(F.col("place") <= k)


def review_stats(fields: DataFrame, *, run: str) -> DataFrame:
    return fields.groupBy(run).agg(F.sum(F.size("snippets")).alias("snippets"), F.count_if(F.size("snippets") > 0).alias("pages"))
