"""Entity consolidation: batching, merging, linking and the database tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import hinted


def plan_batches(docs: DataFrame, *, run: str, max_docs: int = 12, max_chars: int = 36_000, doc_cap: int = 4_000, most: int = 36) -> DataFrame:
    """(run, doc, batch) from (run, ord, doc, chars): the first ``most`` documents in order; a new batch where one more
    document would exceed ``max_docs`` or ``max_chars``. The running sum starts anew where it overflows, which no window
    can say; only the at most ``most`` rows of a run reach its group."""

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord")
        batch, n, size, out = 0, 0, 0, []
        for chars in part["chars"].clip(upper=doc_cap):
            if n and (n >= max_docs or size + chars > max_chars):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + chars
            out.append(batch)
        return pd.DataFrame({"run": part["run"], "doc": part["doc"], "batch": out})

    first = docs.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy("ord"))).where(F.col("_k") <= most)
    source = first.select(F.col(run).cast("string").alias("run"), "ord", F.col("doc").cast("long"), F.col("chars").cast("long"))
    return source.groupBy("run").applyInPandas(assign, "run string, doc long, batch int")


def ordered_union(values: Column, order: Column) -> Column:
    """Distinct items of all lists, in the order in which they come first."""
    own = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.array_distinct(F.flatten(F.transform(own, lambda x: x["v"])))


def merge_entities(df: DataFrame, *, keys: list[str], order: str = "ord", text: str = "text", items: str = "items", rank: str = "rank") -> DataFrame:
    """One row per key: the first spelling, the longest text (the first of equals), all items once, the highest rank."""
    return df.groupBy(*keys).agg(
        F.min_by("name", order).alias("name"), F.max_by(text, F.struct(F.length(text), -F.col(order))).alias("text"), ordered_union(F.col(items), F.col(order)).alias("items"), F.max(rank).alias("rank"), F.count("*").alias("merged"),
    )


def union_references(df: DataFrame, *, keys: list[str], order: str = "ord") -> DataFrame:
    """Distinct references: of rows with equal keys the last one's values, at the first one's place."""
    w = Window.partitionBy(*keys)
    last = df.withColumns({"place": F.min(order).over(w), "_k": F.row_number().over(w.orderBy(F.desc(order)))})
    return last.where("_k = 1").drop("_k")


def keyword_table(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(keyword, intent, spelling, evidence): keywords of several tables (keyword, ord, evidence_id), each with an intent.

    The first table and row give the spelling and the intent; evidence is united.
    """
    rows = None
    for place, (df, intent) in enumerate(parts):
        part = df.select("keyword", "ord", "evidence_id", F.lit(intent).alias("intent"), F.lit(place).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("key", F.lower(F.trim("keyword"))).where("key <> ''")
    first = F.struct("place", "ord")
    return rows.groupBy("key").agg(F.min_by("intent", first).alias("intent"), F.min_by("keyword", first).alias("spelling"), F.array_sort(F.collect_set("evidence_id")).alias("evidence"))


def opportunity_scores(df: DataFrame, *, scores: list[str], defaults: list[int], evidence: str, confirmed: str) -> DataFrame:
    """``df`` with the scores clamped to 0-100 (defaults for missing ones; evidence 25 where none is confirmed) and their mean, halves up."""
    own = {c: F.coalesce(F.floor(F.greatest(F.lit(0), F.least(F.lit(100), F.col(c))) + 0.5), F.lit(d)).cast("int") for c, d in zip(scores, defaults)}
    own[evidence] = F.when(F.col(confirmed), own[evidence]).otherwise(25)
    out = df.withColumns(own)
    return out.withColumn("total", F.floor(sum((F.col(c) for c in scores), F.lit(0)) / len(scores) + 0.5).cast("int"))


def bind_single_host(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """(entity, host, docs): entities whose bound documents (entity, host) all have one host."""
    g = entities.join(documents, "doc").groupBy("entity").agg(F.countDistinct("host").alias("hosts"), F.min("host").alias("host"), F.count("*").alias("docs"))
    return g.where("hosts = 1 and host <> ''").drop("hosts")


def link_products(products: DataFrame, competitors: DataFrame, *, run: str) -> DataFrame:
    """(product, competitor): by name; a blank name means the run's only competitor; else the product is dropped."""
    c = competitors.withColumns({"_n": F.count("*").over(Window.partitionBy(run)), "_key": F.lower(F.trim("name"))})
    p = products.withColumn("_key", F.lower(F.trim(F.coalesce("competitor_name", F.lit("")))))
    named = p.where("_key <> ''").join(c.select(run, "_key", "competitor"), [run, "_key"])
    only = p.where("_key = ''").join(c.where("_n = 1").select(run, "competitor"), run)
    return named.select(run, "product", "competitor").unionByName(only.select(run, "product", "competitor"))


def replace_if_any(old: DataFrame, new: DataFrame, *, run: str) -> DataFrame:
    """Per run: the new rows if there are any, else the old ones."""
    return new.unionByName(old.join(new.select(run).distinct(), run, "left_anti"))


def source_table(sources: DataFrame, candidates: DataFrame, *, on: str) -> DataFrame:
    """Sources with their candidate's method and priority, or defaults; feeds and crawlers come weekly, the rest on demand."""
    j = sources.join(hinted(candidates), on, "left")
    return j.withColumns({"method": F.coalesce("method", F.lit("manual")), "priority": F.coalesce("priority", F.lit("medium")), "cadence": F.when(F.col("type").isin("rss", "crawler"), "weekly").otherwise("on_demand")})


def database_counts(tables: dict[str, DataFrame], *, run: str, order: str = "ord", label: str = "label") -> DataFrame:
    """(run, table, n, sample): rows of each table of a run, and its first three labels."""
    out = None
    for name, df in tables.items():
        ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy(order)))
        first = F.array_sort(F.collect_list(F.when(F.col("_k") <= 3, F.struct("_k", F.col(label).alias("label")))))
        part = ranked.groupBy(run).agg(F.count("*").alias("n"), F.array_join(F.transform(first, lambda x: x["label"]), ", ").alias("sample")).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def weekly_seed(parts: list[tuple[DataFrame, str, int]], *, run: str, order: str = "ord") -> DataFrame:
    """(run, list, place, label): the first rows of each table (df, list, how many)."""
    out = None
    for df, name, n in parts:
        part = df.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(order))).where(F.col("place") <= n).select(run, F.lit(name).alias("list"), "place", "label")
        out = part if out is None else out.unionByName(part)
    return out


def documents_union(crawled: DataFrame, given: DataFrame) -> DataFrame:
    """Crawled documents and those given as CSV or by hand; columns that one lacks are null."""
    return crawled.unionByName(given, allowMissingColumns=True)
