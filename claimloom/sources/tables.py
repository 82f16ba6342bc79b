"""Scans, payload parsers, sinks and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimloom.sources.scratch import cut

# Fixed values.
SEARCH_SCHEMA = "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,channelTitle:string,publishedAt:string>>>"
LISTING_SCHEMA = "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,permalink:string,score:int>>>>"
RESULT_SCHEMA = "results array<struct<url:string>>, organic array<struct<link:string>>, web struct<results:array<struct<url:string>>>, data struct<webPages:struct<value:array<struct<url:string>>>>"
CONTENT_TABLES = ["content_database", "pain_point_database", "keyword_database"]
WEBHOOK_STATUSES = ["queued", "running", "succeeded", "failed"]
EXTRACTION_LISTS = ["competitors", "product_signals", "pain_points", "content_signals", "opportunities"]
SEED_SCHEMA = "name string, url string, category string, note string"


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str], *, file_format: str = "parquet") -> dict[str, DataFrame]:
    """The saved tables of runs with declared schemas (names to DDL), and the file of each row as ``run_key``; nothing is inferred."""
    reader = {"parquet": ".parquet", "json": ".json", "csv": ".csv"}[file_format]
    return {n: spark.read.schema(s).format(file_format).load(f"{folder}/{n}{reader}").withColumn("run_key", F.input_file_name()) for n, s in schemas.items()}


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED_SCHEMA).option("header", True).csv(path)


def parse_seed_lines(df: DataFrame, *, line_col: str = "line") -> DataFrame:
    """Seed rows from CSV lines in a column; lines without a name are dropped."""
    return df.withColumn("s", F.from_csv(line_col, SEED_SCHEMA)).select(*[c for c in df.columns if c != line_col], "s.*").where("name <> ''")


def seeds_to_documents(seeds: DataFrame, *, key: str) -> DataFrame:
    """Seed rows as documents next to crawled ones."""
    return seeds.select(key, F.lit("csv").alias("kind"), "url", F.col("name").alias("title"), F.concat_ws("\n", "name", "category", "note").alias("text"))


def parse_search_payload(df: DataFrame, *, key: str, payload: str = "payload") -> DataFrame:
    """(key, video, title, url, text) of video-search answers; items without an id or a title are dropped."""
    i = df.select(key, F.explode(F.from_json(payload, SEARCH_SCHEMA)["items"]).alias("i")).select(key, F.col("i.id.videoId").alias("video"), "i.snippet.*")
    return i.where("video <> '' and title <> ''").select(key, "video", "title", F.concat(F.lit("https://www.youtube.com/watch?v="), "video").alias("url"), F.concat_ws("\n", "title", "channelTitle", "description").alias("text"))


def parse_listing_payload(df: DataFrame, *, key: str, payload: str = "payload", most: int = 2000) -> DataFrame:
    """(key, post, title, url, text) of forum listings; self-texts cut to ``most`` characters."""
    d = df.select(key, F.explode(F.from_json(payload, LISTING_SCHEMA)["data"]["children"]).alias("c")).select(key, "c.data.*")
    return d.where("id <> '' and title <> ''").select(key, F.col("id").alias("post"), "title", F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", F.lit(""))).alias("url"), F.concat_ws("\n", "title", F.substring("selftext", 1, most)).alias("text"))


def content_to_documents(items: DataFrame, *, key: list[str], text_col: str = "text", most: int = 4000, excerpt: int = 160) -> DataFrame:
    """A document for each item and one extraction job for each table that content feeds."""
    cut = F.substring(F.trim(text_col), 1, most)
    return items.where(F.trim(text_col) != "").select(*key, cut.alias("text"), F.substring(cut, 1, excerpt).alias("excerpt"), F.explode(F.array(*map(F.lit, CONTENT_TABLES))).alias("job"))


def parse_result_urls(df: DataFrame, *, key: str, payload: str = "payload") -> DataFrame:
    """(key, pos, url) of search answers in any of four shapes."""
    r = F.from_json(payload, RESULT_SCHEMA)
    lists = [F.transform(r["results"], lambda x: x["url"]), F.transform(r["organic"], lambda x: x["link"]), F.transform(r["web"]["results"], lambda x: x["url"]), F.transform(r["data"]["webPages"]["value"], lambda x: x["url"])]
    urls = F.filter(F.coalesce(*lists), lambda x: x.isNotNull() & x.rlike("^https?://"))
    return df.select(key, F.posexplode(urls).alias("pos", "url"))


def coerce_extraction(df: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """(key, list, pos, name, status, score) from a model's answer, which is not trusted: code fences off, cut from the first
    brace to the last, parsed leniently; items without a name are dropped, an unknown status is needs_review, scores are
    clamped to 0-100."""
    body = F.regexp_extract(F.regexp_replace(text_col, r"```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    item = "array<struct<name:string,status:string,score:double>>"
    parsed = df.select(key, F.from_json(body, ", ".join(f"{n} {item}" for n in EXTRACTION_LISTS)).alias("j"))
    every = [parsed.select(key, F.lit(n).alias("list"), F.posexplode(F.col(f"j.{n}")).alias("pos", "x")) for n in EXTRACTION_LISTS]
    rows = reduce(DataFrame.unionByName, every).where("x.name <> ''")
    status = F.when(F.col("x.status").isin("approved", "rejected", "needs_review"), F.col("x.status")).otherwise("needs_review")
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("x.score", F.lit(0.0)))) + 0.5).cast("int")
    return rows.select(key, "list", "pos", F.col("x.name").alias("name"), status.alias("status"), score.alias("score"))


def upsert_by_key(target: DataFrame, updates: DataFrame, *, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; of equal versions the update. ``upsert_table`` does this to a written table."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))).where("_k = 1").drop("_k", "_new")


def _with_bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_keyed(df: DataFrame, path: str, *, keys: list[str], buckets: int = 64) -> None:
    """A new table that ``upsert_table`` can change: a folder for each bucket of keys."""
    _with_bucket(df, keys, buckets).repartition("_bucket").write.partitionBy("_bucket").parquet(path)


def upsert_table(path: str, updates: DataFrame, *, keys: list[str], version: str, buckets: int = 64) -> None:
    """``upsert_by_key`` of the table at ``path``: only buckets that an update falls into are read and replaced.

    ``buckets`` is the number that the table was written with. The new buckets are written aside first, then each folder is swapped whole by a
    dynamic overwrite; others keep their files. To run it again with the same updates, after a failure too, gives the same table.
    """
    spark = updates.sparkSession
    new = cut(_with_bucket(updates, keys, buckets), "updates")
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    old = spark.read.schema(new.schema).parquet(path).where(F.col("_bucket").isin(touched))
    merged = cut(upsert_by_key(old, new, keys=["_bucket", *keys], version=version), "upserted")
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def split_events(events: DataFrame, *, run: str, status: str, payload: str, most_bytes: int = 65_536) -> DataFrame:
    """``events`` with ``problem``: null for those to append (orphans too), else why not. Works on streams."""
    why = F.when(F.coalesce(F.trim(F.col(run).cast("string")), F.lit("")) == "", "run_missing").when(~F.coalesce(F.col(status).isin(*WEBHOOK_STATUSES), F.lit(False)), "status_unknown").when(F.octet_length(payload) > most_bytes, "payload_too_large")
    return events.withColumn("problem", why)


def append_events(events: DataFrame, path: str, *, source: str = "batch", batch_id: int | None = None) -> None:
    """Append the valid events to the Parquet table at ``path``.

    With ``batch_id`` a batch has a folder of its own (source, batch_id), which a repeated write replaces: it adds nothing twice.
    """
    valid = events.where("problem is null").drop("problem")
    if batch_id is None:
        valid.write.mode("append").parquet(path)
    else:
        valid.write.mode("overwrite").parquet(f"{path}/source={source}/batch_id={batch_id}")


def append_stream(events: DataFrame, path: str, *, source: str, checkpoint: str) -> DataStreamWriter:
    """A sink for a stream of events: each micro-batch is appended by its number, so one that runs again after a lost driver, as
    Spark does where a batch was not committed, replaces what it had written. ``source`` names the stream; start the writer returned."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_events(batch, path, source=source, batch_id=batch_id)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def artifact_rows(df: DataFrame, files: dict[str, tuple[Column, str]], *, key: str) -> DataFrame:
    """(key, file, content_type, bytes): a row for each file of a package (name to content and type) that is there."""
    parts = F.array(*(F.struct(F.lit(n).alias("file"), F.lit(kind).alias("content_type"), F.octet_length(c).cast("long").alias("bytes")) for n, (c, kind) in files.items()))
    return df.select(key, F.inline(parts)).where("bytes is not null")


def backfill_plan(local: DataFrame, existing: DataFrame, *, key: str, version: str) -> DataFrame:
    """(status, n): runs that would be inserted, updated or skipped."""
    j = local.select(key, F.col(version).alias("_l")).join(existing.select(key, F.col(version).alias("_e"), F.lit(True).alias("_there")), key, "left")
    status = F.when(F.col("_there").isNull(), "insert").when(F.col("_l") > F.col("_e"), "update").otherwise("skip")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


#: Rows that a task holds where rows are dealt out by keys that are nearly all different.
PART_ROWS = 500_000


def _tasks(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def check_constraints(df: DataFrame, *, key: list[str], required: list[str] = (), checks: dict[str, Column] | None = None, parent: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """(key..., violation): nulls in required columns, failed checks, repeated keys, and rows without their parent (table, column, its column).

    Keys are nearly all different, so they are not grouped where they are read, in a map as large as a file's part: rows are counted and then dealt
    out by key to tasks of about PART_ROWS each. A task holds its parents, each once, and streams their rows, so a parent may have many.
    """
    own = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in required), *(F.when(~c, F.lit(f"check:{n}")) for n, c in (checks or {}).items())))
    rows = df.count()
    keys = df.select(*key).repartition(_tasks(rows), *key)
    out = [df.select(*key, F.explode(own).alias("violation")), keys.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key, F.lit("primary_key").alias("violation"))]
    if parent:
        table, column, theirs = parent
        children, known = df.where(F.col(column).isNotNull()).select(*dict.fromkeys([*key, column])), table.select(F.col(theirs).alias(column))
        tasks = _tasks(rows + known.count())
        known = known.repartition(tasks, column).distinct()
        orphans = children.repartition(tasks, column).join(known.hint("shuffle_hash"), column, "left_anti")
        out.append(orphans.select(*key, F.lit(f"foreign_key:{column}").alias("violation")))
    return reduce(DataFrame.unionByName, out)
