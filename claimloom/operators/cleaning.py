"""Corpus cleaning: markup, entities, noise lines, repeats and boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.sources.scratch import cut, hinted

# What is markup or noise.
MARKUP_TAGS = ["script", "style", "noscript", "template", "svg"]
NAVIGATION_TAGS = ["nav", "header", "aside", "form", "dialog"]
CONSENT_WORDS = "cookie|privacy|consent|gdpr|legal"
BLOCK_TAGS = "article|blockquote|br|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|li|main|ol|p|section|table|tbody|td|tfoot|th|thead|tr|ul"
LEGAL_LINE = r"(?i)(privacy policy|cookie settings|terms of service|do not sell|隐私政策|隐私协议|cookie|法律声明)"
COPYRIGHT_LINE = r"(?i)(©|all rights reserved|ICP备)"
SKIP_LINE = r"(?i)^skip to (?:content|main)"
SOCIAL_NAMES = ["facebook", "instagram", "youtube", "linkedin"]
LEGAL_MOST, SOCIAL_MOST, COPYRIGHT_MOST = 240, 180, 240
KNOWN_BLOCKS = [
    (r"(?m)(?:^|\s)--?>(?=\s|$)", "\n"),
    (r"(?i)方太隐私声明[\s\S]*?请勾选方太隐私协议", " "),
    (r"(?i)尊敬的用户[：:][\s\S]{0,300}?《[^》]*个人信息保护政策》[\s\S]{0,1200}?(?:确定|同意)(?=\s*(?:首页|产品|服务|我的|$))", " "),
    (r"(?i)(?:www\.[\w.-]+\s*#\s*)?www\.[\w.-]+\s+is blocked[\s\S]*$", " "),
    (r"(?i)This page has been blocked by an extension[\s\S]*?(?:ERR[_\\]BLOCKED[_\\]BY[_\\]CLIENT|Reload)(?:\s|$)", " "),
    (r"(?i)(?:One-time Discount\s+)?Get up to \d+% off \+ Free Shipping[^\n]*(?:\n|$)", " "),
    (r"(?i)产品搜索\s+首页\s+资生堂日本\s+官方产品介绍网站[\s\S]*?©\s*Shiseido[\s\S]*$", " "),
    (r"(?i)\bShop NowShop Now\b", "Shop Now"),
]
RESIDUAL = {
    "privacy_legal": r"(?i)(privacy policy|cookie settings|terms of service|个人信息保护政策|隐私声明|隐私协议)",
    "crawler_error": r"(?i)(ERR[_\\]BLOCKED[_\\]BY[_\\]CLIENT|blocked by an extension|verifying connection)",
    "image_target": r"!\[[^\]]*\]\([^)]+\)",
    "markup": r"<[^>]+>|--?>|&nbsp;",
    "navigation": r"(?i)skip to (content|main)",
}
REPEAT_LINE, REPEAT_TOKENS, REPEAT_CHARS, REPEAT_PASSES = 24, 10, 30, 8

#: (pattern, replacement with {1} for the group) of HTML, in order.
HTML_STEPS = [
    (r"(?s)<!--.*?-->", " "),
    *((rf"(?is)<{t}\b[^>]*>.*?</{t}>", " ") for t in [*MARKUP_TAGS, *NAVIGATION_TAGS, "footer"]),
    *((rf"""(?is)<{t}\b[^>]*(?:class|id)=["'][^"']*(?:{CONSENT_WORDS})[^"']*["'][^>]*>.*?</{t}>""", " ") for t in ("div", "section")),
    (r"""(?i)<img\b[^>]*alt=["']\s*["'][^>]*>""", " "),
    (r"""(?i)<img\b[^>]*alt=["']\s*([^"']*?)\s*["'][^>]*>""", "{1}"),
    (r"(?i)<img\b[^>]*>", " "),
    (rf"(?i)</?(?:{BLOCK_TAGS})[^>]*>", "\n"),
    (r"<[^>]+>", " "),
]
MARKDOWN_STEPS = [
    (r"(?s)<!--.*?-->", " "),
    (r"\[!\[\s*([^\]]*?)\s*\]\([^)]+\)\]\([^)]+\)", "{1}"),
    (r"!\[\s*([^\]]*?)\s*\]\([^)]+\)", "{1}"),
    (r"\[\s*([^\]]+?)\s*\]\([^)]+\)", "{1}"),
    (r"(?m)^\s{0,3}#{1,6}\s+", "\n"),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"[*_~`]+", ""),
    (r"\s+#{1,6}\s+", "\n"),
    (r"\s+--?>\s+", "\n"),
]


def _java(steps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(p, to.replace("{1}", "$1")) for p, to in steps]


def html_to_text(c: Column) -> Column:
    return T.decode_entities(T.replace_all(c, _java(HTML_STEPS)))


def markdown_to_text(c: Column) -> Column:
    return T.decode_entities(T.replace_all(c, _java(MARKDOWN_STEPS)))


def detect_format(c: Column) -> Column:
    """html if a block tag is there, markdown if link or image syntax is, else text."""
    return F.when(c.rlike(r"(?i)<(!doctype|html|body|article|main|section|div|p|h[1-6]|ul|ol|table)\b"), "html").when(c.rlike(r"!?\[[^\]]*\]\([^)]+\)"), "markdown").otherwise("text")


def noise_reason(line: Column) -> Column:
    """Why a line is noise, or null."""
    low = F.lower(line)
    social = sum((low.contains(n).cast("int") for n in SOCIAL_NAMES), F.lit(0))
    return (
        F.when(line.rlike(SKIP_LINE), "navigation")
        .when((F.length(line) <= LEGAL_MOST) & line.rlike(LEGAL_LINE), "privacy_legal")
        .when(((F.length(line) <= SOCIAL_MOST) & (social >= 3)) | ((F.length(line) <= COPYRIGHT_MOST) & line.rlike(COPYRIGHT_LINE)), "footer")
    )


def drop_noise_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, removed array<struct<pos, line, reason>>): noise lines out, in one projection."""
    every = T.lines(T.replace_all(F.coalesce(text_col, F.lit("")), KNOWN_BLOCKS))
    marked = F.transform(every, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), noise_reason(x).alias("reason")))
    out = df.select(id_col, marked.alias("m"))
    return out.select(id_col, F.array_join(F.transform(F.filter("m", lambda x: x["reason"].isNull()), lambda x: x["line"]), "\n").alias("text"), F.filter("m", lambda x: x["reason"].isNotNull()).alias("removed"))


def line_table(df: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """One row per line: the columns ``keep``, pos, line."""
    return df.select(*keep, F.posexplode(T.lines(F.coalesce(text_col, F.lit("")))).alias("pos", "line"))


def joined_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, text): kept lines in their order."""
    own = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("text"))


def marked_lines(text: Column, least: int = REPEAT_LINE) -> Column:
    """array<struct<pos, line, repeat>>: ``repeat`` is true for second and later equal lines (ignoring case, ``least`` characters or more).

    The lines are sorted by (lower case, place) inside their row, so that an equal line comes right before, and sorted back.
    """
    keyed = F.array_sort(F.transform(T.lines(F.coalesce(text, F.lit(""))), lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("pos"), x.alias("line"))))

    def flagged(of: Column) -> Column:  # the sorted array is bound once, not made again for each line
        again = lambda x, i: (i > 0) & (F.get(of, i - 1)["key"] == x["key"]) & (F.length(x["line"]) >= least)
        return F.transform(of, lambda x, i: F.struct(x["pos"].alias("pos"), x["line"].alias("line"), F.coalesce(again(x, i), F.lit(False)).alias("repeat")))

    return F.array_sort(F.transform(F.array(keyed), flagged)[0])


def drop_repeated_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = REPEAT_LINE) -> DataFrame:
    """(id, text, dropped): second and later equal lines of a document out, in one projection; no line leaves its row."""
    own = df.select(id_col, marked_lines(F.col(text_col), least).alias("m"))
    kept = F.transform(F.filter("m", lambda x: ~x["repeat"]), lambda x: x["line"])
    return own.select(id_col, F.array_join(kept, "\n").alias("text"), F.size(F.filter("m", lambda x: x["repeat"])).cast("long").alias("dropped"))


def repeated_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = REPEAT_LINE) -> DataFrame:
    """The line table with ``repeat`` of ``marked_lines``."""
    return df.select(id_col, F.inline(marked_lines(F.col(text_col), least)))


def corpus_boilerplate(df: DataFrame, *, min_docs: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", least: int = REPEAT_LINE) -> DataFrame:
    """(source, line, docs): lines that at least ``min_docs`` documents of a source have."""
    lines = line_table(df, id_col, source_col, text_col=text_col).where(F.length("line") >= least)
    return lines.groupBy(source_col, "line").agg(F.countDistinct(id_col).alias("docs")).where(F.col("docs") >= min_docs)


def without_boilerplate(df: DataFrame, *, min_docs: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, text, dropped): documents without their source's boilerplate lines."""
    lines = line_table(df, id_col, source_col, text_col=text_col)
    known = corpus_boilerplate(df, min_docs=min_docs, id_col=id_col, source_col=source_col, text_col=text_col).select(source_col, "line", F.lit(True).alias("known"))
    marked = lines.join(hinted(cut(known, "boilerplate")), [source_col, "line"], "left")
    own = F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("pos", "line"))))
    return marked.groupBy(id_col).agg(F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("text"), F.count("known").alias("dropped"))


def removed_audit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_reason: int = 3, total: int = 20, excerpt: int = 220) -> DataFrame:
    """(id, source_length, cleaned_length, removed_chars, removed_ratio, segments): what the line rules and repeats take out."""
    source = df.select(id_col, F.coalesce(text_col, F.lit("")).alias("text"))
    lines = repeated_lines(source, id_col=id_col).withColumn("reason", F.coalesce(noise_reason(F.col("line")), F.when(F.col("repeat"), "duplicate_template")))
    gone = lines.where("reason is not null")
    in_reason = F.row_number().over(Window.partitionBy(id_col, "reason").orderBy("pos"))
    first = gone.withColumn("k", in_reason).where(F.col("k") <= per_reason).withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("n") <= total)
    short = F.when(F.length("line") > excerpt, F.concat(F.substring("line", 1, excerpt - 3), F.lit("..."))).otherwise(F.col("line"))
    segments = first.groupBy(id_col).agg(F.count("*").alias("segments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reason", short.alias("excerpt")))), lambda x: F.concat(x["reason"], F.lit(":"), x["excerpt"])), "|").alias("excerpts"))
    sums = lines.groupBy(id_col).agg(F.sum(F.when(F.col("reason").isNull(), F.length("line") + 1).otherwise(0)).alias("kept"), F.sum(F.when(F.col("reason").isNotNull(), F.length("line")).otherwise(0)).alias("removed"))
    out = source.select(id_col, F.length("text").alias("source_length")).join(sums.hint("merge"), id_col, "left").join(segments.hint("merge"), id_col, "left")
    removed = F.least(F.col("source_length").cast("long"), F.coalesce("removed", F.lit(0)))
    return out.select(
        id_col, F.col("source_length").cast("long").alias("source_length"), F.greatest(F.lit(0), F.coalesce(F.col("kept") - 1, F.lit(0))).alias("cleaned_length"), removed.alias("removed_chars"),
        F.when(F.col("source_length") > 0, removed / F.col("source_length")).otherwise(0.0).alias("removed_ratio"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("excerpts", F.lit("")).alias("excerpts"),
    )


def residual_noise(c: Column) -> list[Column]:
    """Characters of each family of noise that is still there, and their share of the text, at most 1."""
    count = {k: F.aggregate(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.length), F.lit(0), lambda a, x: a + x).cast("long") for k, p in RESIDUAL.items()}
    total = sum(count.values(), F.lit(0))
    return [*(v.alias(k) for k, v in count.items()), F.when(F.length(c) > 0, F.least(F.lit(1.0), total / F.length(c))).otherwise(0.0).alias("residual_ratio")]


def truncated(df: DataFrame, *, most: int = 12_000, excerpt: int = 160, text_col: str = "text") -> DataFrame:
    """``df`` with the text cut to ``most`` characters, whether it was cut, and an excerpt."""
    return df.withColumns({"truncated": F.length(text_col) > most, "excerpt": F.substring(text_col, 1, excerpt), text_col: F.substring(text_col, 1, most)})


def longest_repeat(tokens: list[str], starts: list[int], ends: list[int], n: int, least: int) -> tuple[int, int] | None:
    """(start, end) of the longest later copy of an earlier run of ``n`` tokens or more that it does not overlap.

    Two copies at one distance share where they end, which is kept by distance, so that long repeats are walked once.
    """
    first: dict[tuple[str, ...], int] = {}
    reach: dict[int, int] = {}
    best = None
    for i in range(len(tokens) - n + 1):
        at = first.setdefault(tuple(tokens[i : i + n]), i)
        if at == i or at + n > i:
            continue
        end = reach.get(i - at, 0)
        if end <= i:
            end = i + n
            while end < len(tokens) and tokens[end] == tokens[end - i + at]:
                end += 1
            reach[i - at] = end
        span = (starts[i], ends[end - 1])
        if span[1] - span[0] >= least and (best is None or span[1] - span[0] > best[1] - best[0]):
            best = span
    return best


def without_repeated_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = REPEAT_TOKENS, least: int = REPEAT_CHARS, passes: int = REPEAT_PASSES) -> DataFrame:
    """(id, text, removed_chars, removed_runs): the longest repeated token run out, up to ``passes`` times.

    Each pass depends on what the one before removed, so a document is one call of a small function; documents are
    independent and nothing is shuffled.
    """
    import re

    def clean(text: str) -> tuple[str, int, int]:
        gone = runs = 0
        for _ in range(passes):
            found = list(re.finditer(r"\S+", text))
            best = longest_repeat([m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found], n, least)
            if best is None:
                break
            gone, runs = gone + best[1] - best[0], runs + 1
            text = text[: best[0]] + " " + text[best[1] :]
        return text, gone, runs

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [clean(t or "") for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "text": [d[0] for d in done], "removed_chars": [d[1] for d in done], "removed_runs": [d[2] for d in done]})

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, text string, removed_chars long, removed_runs long").withColumnRenamed("id", id_col)
