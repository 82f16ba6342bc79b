"""The database tables of a run, from its extracted entities, their evidence and the documents that it is bound to."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.operators.entities import replace_if_any, weekly_seed
from claimloom.sources.scratch import cut

# Fixed values.
NO_PRICE = "公开资料未提供价格，需人工复核。"
SIGNAL = "信号"
WEEKLY_TITLE = "公开资料结构化周报种子"
WEEKLY_SUMMARY = "基于 public_web raw documents 的 OpenAI-compatible provider 结构化抽取结果。"
KEYWORD_SOURCE = "openai_compatible_structured_extraction"
NEW_SIGNALS, NEW_TOPICS, WATCHED, OPENINGS, WEEKLY_EVIDENCE = 3, 2, 3, 3, 5
#: Websites and signals of a source that meet at once, and about how many rows of the result a task makes.
SITES, SIGNALS, TASK_ROWS = 1024, 8192, 1 << 24
#: Sources of an entity up to which each carries those before it, and shared sources up to which their counts are broadcast.
LISTED, FEW_SOURCES = 32, 100_000
MARGIN = r"^[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$"


def numbered(df: DataFrame, *, run: str, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with places from 1 in each run. A run may fill many tasks: places count on from one range of rows to the next."""
    keys = [run, *order]
    dealt = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(run, "_part").agg(F.count("*").alias("_n"))
    before = sizes.select(run, "_part", (F.sum("_n").over(Window.partitionBy(run).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(run, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(before.hint("merge"), [run, "_part"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def references(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(run, id, place, evidence, source, document) for the evidence of each entity that exists, in the entity's order."""
    named = entities.select("run", "id", F.posexplode("evidence_ids").alias("place", "evidence"))
    return named.join(evidence.select("run", "evidence", "source", "document").hint("merge"), ["run", "evidence"])


def source_lists(refs: DataFrame) -> DataFrame:
    """(run, id, source_ids): an entity's sources, each once, in order; as long as its own list of evidence at most."""
    first = refs.where("source is not null").groupBy("run", "id", "source").agg(F.min("place").alias("place"))
    own = F.array_sort(F.collect_list(F.struct("place", "source")))
    return first.groupBy("run", "id").agg(F.transform(own, lambda x: x["source"]).alias("source_ids"))


def with_sources(entities: DataFrame, refs: DataFrame) -> DataFrame:
    return entities.join(source_lists(refs).hint("merge"), ["run", "id"], "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))


def website_structure(competitors: DataFrame, refs: DataFrame, documents: DataFrame) -> DataFrame:
    """(run, id, competitor, url, sections, commerce, source_ids): competitors with a source whose bound documents all have one host.

    The URL is that of the first of them; one that is no URL is its own host. None where no document is bound, or that URL is empty.
    """
    bound = refs.where("document is not null").join(documents.select("run", "document", "url").hint("merge"), ["run", "document"])
    host = F.coalesce(F.nullif(U.full_host(F.col("url")), F.lit("")), F.col("url"), F.lit(""))
    sites = bound.groupBy("run", "id").agg(F.min(host).alias("low"), F.max(host).alias("high"), F.min_by("url", "place").alias("url")).where("low = high and url <> ''")
    j = with_sources(competitors, refs).where(F.size("source_ids") > 0).join(sites.select("run", "id", "url").hint("merge"), ["run", "id"])
    return j.select("run", F.concat(F.lit("website-structure-db-"), "id").alias("id"), F.col("id").alias("competitor"), "url", "sections", "commerce", "source_ids")


def source_sets(refs: DataFrame) -> DataFrame:
    """(run, id, long, sources): an entity's sources, each once and with those before it, which only entities of up to LISTED sources carry.

    What stands before the first is null, not an empty list. A row is as long as the entity's own list of evidence, or LISTED times LISTED, at most.
    """
    own = refs.where("source is not null").groupBy("run", "id").agg(F.array_sort(F.collect_set("source")).alias("_own")).withColumn("long", F.size("_own") > LISTED)
    each = F.transform("_own", lambda x, i: F.struct(x.alias("source"), F.when((i > 0) & ~F.col("long"), F.slice("_own", 1, i)).alias("before")))
    return own.select("run", "id", "long", each.alias("sources"))


def website_topics(websites: DataFrame, competitor_refs: DataFrame, contents: DataFrame, content_refs: DataFrame) -> DataFrame:
    """(run, content, competitor, ord, topic): the content signals of a website, being those that share a source with it.

    Rows and not lists, since a source may have any number of signals; in order they are a website's topics. They grow with the product of
    both, so they are not shuffled: the websites and signals of a source meet in blocks of about SITES and SIGNALS, dealt to as many tasks
    as the rows ask for, and of several shared sources only the first makes the row. Where a website or a signal has more than LISTED
    sources, all shared ones make it, and the rows of these are shuffled to be made one.
    """
    mine = competitor_refs.join(websites.select("run", F.col("competitor").alias("id")).hint("merge"), ["run", "id"], "left_semi")
    site_sets, signal_sets = source_sets(mine), source_sets(content_refs)
    sites = site_sets.select("run", F.col("id").alias("competitor"), F.col("long").alias("_long"), F.inline("sources").alias("source", "_before"))
    signals = contents.select("run", "id", "ord", "topic").join(signal_sets.hint("merge"), ["run", "id"])
    signals = signals.select("run", F.col("id").alias("content"), "ord", "topic", "long", F.inline("sources"))
    key = ["run", "source"]
    of_source = lambda sets, n, long: sets.select("run", "long", F.inline("sources")).groupBy(*key).agg(F.count("*").alias(n), F.max("long").alias(long))
    shared = of_source(site_sets, "_sites", "_long").join(of_source(signal_sets, "_signals", "_long_signals").hint("merge"), key)
    counted = shared.agg(F.count("*"), F.coalesce(F.sum(F.col("_sites") * F.col("_signals")), F.lit(0)), F.coalesce(F.max(F.col("_long") | F.col("_long_signals")), F.lit(False))).first()
    tasks = max(int(websites.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted[1] // TASK_ROWS))
    blocks = shared.select(*key, F.ceil(F.col("_sites") / SITES).cast("int").alias("_blocks"), F.ceil(F.col("_signals") / SIGNALS).cast("int").alias("_slices"))
    blocks = F.broadcast(blocks) if counted[0] <= FEW_SOURCES else blocks.hint("merge")
    one = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sites = sites.join(blocks, key).withColumn("_block", one("competitor", "_blocks")).withColumn("_slice", every("_slices")).drop("_blocks", "_slices")
    signals = signals.join(blocks, key).withColumn("_slice", one("content", "_slices")).withColumn("_block", every("_blocks")).drop("_blocks", "_slices")
    unit = [*key, "_block", "_slice"]

    def met(signals: DataFrame, sites: DataFrame) -> DataFrame:
        # null, where nothing stands before the source on one side: it is the first that they share
        first = F.coalesce(~F.arrays_overlap("before", "_before"), F.lit(True))
        return signals.repartition(tasks, *unit).join(sites.repartition(tasks, *unit).hint("merge"), unit).where(first).select("run", "content", "competitor", "ord", "topic")

    if not counted[2]:
        return met(signals, sites)
    gathered = met(signals.where("long"), sites).unionAll(met(signals.where("not long"), sites.where("_long"))).distinct()
    return met(signals.where("not long"), sites.where("not _long")).unionAll(gathered)


def keyword_rows(products: DataFrame, pains: DataFrame, contents: DataFrame) -> DataFrame:
    """(run, key, keyword, intent, at, evidence_ids): tags of products, themes of pains, topics of contents, as keyword seeds."""
    seed = lambda place, df, intent, word, tag: df.select("run", word.alias("keyword"), F.lit(intent).alias("intent"), F.struct(F.lit(place).alias("table"), "ord", F.col("id").cast("string").alias("id"), tag.alias("tag")).alias("at"), "evidence_ids")
    tags = products.select("run", "ord", "id", "evidence_ids", F.posexplode("tags").alias("tag", "keyword"))
    parts = [seed(0, tags, "purchase", F.col("keyword"), F.col("tag")), seed(1, pains, "pain_point", F.col("theme"), F.lit(0)), seed(2, contents, "research", F.col("topic"), F.lit(0))]
    rows = reduce(DataFrame.unionByName, parts).where("keyword is not null")
    return rows.withColumn("key", F.regexp_replace(F.lower("keyword"), MARGIN, ""))


def keyword_tables(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, id, key, keyword, intent, source) and (run, key, evidence): a keyword as first written, with its first intent; all evidence, each once."""
    one = seeds.groupBy("run", "key").agg(F.min("at").alias("at"), F.min_by(F.struct("keyword", "intent"), "at").alias("_s")).select("run", "key", "at", "_s.*")
    placed = numbered(one, run="run", order=["at"])
    words = placed.select("run", F.concat(F.lit("keyword-db-deepseek-"), "number").alias("id"), "key", "keyword", "intent", F.lit(KEYWORD_SOURCE).alias("source"))
    return words, seeds.select("run", "key", F.explode("evidence_ids").alias("evidence")).distinct()


def weekly_reports(projects: DataFrame, products: DataFrame, contents: DataFrame, competitors: DataFrame, opportunities: DataFrame, evidence: DataFrame, *, week: str) -> DataFrame:
    """One report a run: its first signals and topics, competitors and opportunities to watch, first new evidence; lists have at most six items."""
    label = lambda df, c: df.select("run", F.struct("ord", F.col(c).cast("string").alias("tie")).alias("ord"), F.col(c).cast("string").alias("label"))
    parts = [(label(products, "signal"), "0", NEW_SIGNALS), (label(contents, "topic"), "1", NEW_TOPICS), (label(competitors, "name"), "2", WATCHED), (label(opportunities, "title"), "3", OPENINGS), (label(evidence.where("new"), "evidence"), "4", WEEKLY_EVIDENCE)]
    rows = weekly_seed(parts, run="run").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("list", "place", "label"))).alias("items"))
    j = projects.join(rows.hint("merge"), "run", "left")
    of = lambda *lists: F.coalesce(F.transform(F.filter("items", lambda x: x["list"].isin(*lists)), lambda x: x["label"]), F.array().cast("array<string>"))
    return j.select("run", F.lit("weekly-intel-deepseek-1").alias("id"), F.lit(week).alias("week_of"), F.concat_ws(" ", "category", F.lit(WEEKLY_TITLE)).alias("title"), F.lit(WEEKLY_SUMMARY).alias("summary"), of("0", "1").alias("new_signals"), of("2", "3").alias("watch_list"), of("4").alias("evidence_ids"))


def build_databases(projects: DataFrame, competitors: DataFrame, products: DataFrame, pains: DataFrame, contents: DataFrame, opportunities: DataFrame, evidence: DataFrame, documents: DataFrame, *, week: str, only: list[str] | None = None) -> dict[str, DataFrame]:
    """The database tables of all runs by name, from their entities; with ``only`` those named, and no work is done for others.

    Entities have (run, ord, id, evidence_ids) and columns of their own: ``competitors`` name, channel, positioning, sections, commerce;
    ``products`` competitor, category, signal, tags; ``pains`` theme, need, frequency; ``contents`` platform, topic, content_type, why;
    ``opportunities`` title, summary, total, review. ``projects``: (run, category, market); ``evidence``: (run, evidence, ord, source,
    document, new); ``documents``: (run, document, url). Ids are unique in a run. Evidence that does not exist gives no source and
    no document; null lists are empty. What the lists of a run may have without bound is given as rows: ``website_topics`` and
    ``keyword_evidence``. An empty table of entities gives an empty table.
    """
    listed = lambda df: df.withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast(dict(df.dtypes)["evidence_ids"])))
    competitors, products, pains, contents, opportunities = map(listed, (competitors, products, pains, contents, opportunities))
    # written once, when a table asks for them
    own = cache(lambda: cut(references(competitors, evidence), "refs"))
    about = cache(lambda: cut(references(contents, evidence), "refs"))
    named = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id")
    websites = cache(lambda: cut(website_structure(competitors, own(), documents), "websites"))
    keywords = cache(lambda: keyword_tables(cut(keyword_rows(products, pains, contents), "keywords")))
    market = projects.select("run", "market", "category")
    product = lambda: numbered(products, run="run", order=["ord", "id"]).join(market.select("run", F.col("category").alias("_category")).hint("merge"), "run")
    tables = {
        "competitor_database": lambda: with_sources(competitors, own()).join(market.select("run", "market").hint("merge"), "run").select("run", named("competitor-db-"), F.col("id").alias("competitor"), "name", "market", "channel", "positioning", "source_ids", "evidence_ids"),
        "website_structure_database": websites,
        "website_topics": lambda: website_topics(websites(), own(), contents, about()),
        "product_database": lambda: product().select("run", named("product-db-"), "competitor", F.concat_ws(" ", "_category", F.lit(SIGNAL), "number").alias("name"), "category", F.lit(NO_PRICE).alias("price_signal"), "tags", "evidence_ids"),
        "keyword_database": lambda: keywords()[0],
        "keyword_evidence": lambda: keywords()[1],
        "pain_point_database": lambda: with_sources(pains, references(pains, evidence)).select("run", named("pain-point-db-"), "theme", "need", "frequency", "source_ids", "evidence_ids"),
        "content_database": lambda: contents.select("run", named("content-db-"), "platform", "topic", "content_type", "why", "evidence_ids"),
        "opportunity_database": lambda: opportunities.select("run", named("opportunity-db-"), F.col("id").alias("opportunity"), "title", "summary", "total", "review", "evidence_ids"),
        "weekly_intelligence_reports": lambda: weekly_reports(projects, products, contents, competitors, opportunities, evidence, week=week),
    }
    return {name: tables[name]() for name in (tables if only is None else only)}


def replace_databases(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each table with the new rows of those runs that have any, and the old ones of the others; a table that only one side has is that."""
    return {name: replace_if_any(old[name], df, run="run") if name in old else df for name, df in new.items()} | {name: df for name, df in old.items() if name not in new}
