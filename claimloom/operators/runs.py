"""Run comparison and run catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import SPACE

#: What a failure text contains and what it means; the first that fits.
FAILURES = [("timeout", ["timeout", "timed out", "abort"]), ("blocked", ["403", "blocked", "forbidden", "captcha"]), ("not_found", ["404", "not found"]), ("rate_limited", ["429", "rate limit"]), ("network", ["network", "fetch failed", "dns", "error"])]
FAILURE_NAMES = [*(n for n, _ in FAILURES), "other"]


def norm_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, SPACE + "+", ""))


def stable_keys(df: DataFrame, dimensions: list[str], *, run: str, json_col: str = "payload") -> DataFrame:
    """(run, dimension, key): trimmed, distinct, non-empty strings of the lists in a JSON object; what is no list of strings is ignored."""
    schema = T.StructType([T.StructField(d, T.ArrayType(T.StringType())) for d in dimensions])
    parsed = df.select(run, F.from_json(json_col, schema).alias("j"))
    every = [parsed.select(run, F.lit(d).alias("dimension"), F.explode(F.col(f"j.{d}")).alias("key")) for d in dimensions]
    rows = reduce(DataFrame.unionByName, every)
    return rows.select(run, "dimension", F.trim("key").alias("key")).where("key <> ''").distinct()


def set_diff(previous: DataFrame, current: DataFrame, *, on: list[str]) -> DataFrame:
    """(on..., key, change): keys added and removed, ignoring case and white space, by one full outer join."""
    p, c = (df.withColumn("_k", norm_key(F.col("key"))).groupBy(*on, "_k").agg(F.min("key").alias(name)) for df, name in ((previous, "_p"), (current, "_c")))
    j = c.join(p, [*on, "_k"], "full").where("_p is null or _c is null")
    return j.select(*on, F.coalesce("_c", "_p").alias("key"), F.when(F.col("_p").isNull(), "added").otherwise("removed").alias("change"))


def score_changes(previous: DataFrame, current: DataFrame, *, on: list[str]) -> DataFrame:
    """(on..., title, before, after): titles that are new (before null) or whose score changed; of equal titles the last one before counts."""
    p = previous.groupBy(*on, "title").agg(F.max_by("score", "ord").alias("before"))
    c = current.groupBy(*on, "title").agg(F.max_by("score", "ord").alias("after"))
    return c.join(p, [*on, "title"], "left").where(F.col("before").isNull() | (F.col("before") != F.col("after")))


def consecutive(runs: DataFrame, *, project: str, run: str, at: str) -> DataFrame:
    """(project, run, previous): each run of a project and the one before it, null for the first."""
    return runs.select(project, run, F.lag(run).over(Window.partitionBy(project).orderBy(at, run)).alias("previous"))


def run_diff_all(pairs: DataFrame, keys: DataFrame, *, run: str) -> DataFrame:
    """(run, dimension, key, change) for every pair of consecutive runs: all comparisons in one join."""
    having = pairs.where("previous is not null").select(run, "previous")
    current = having.select(run).join(keys, run)
    before = having.join(keys.withColumnRenamed(run, "previous"), "previous").drop("previous")
    return set_diff(before, current, on=[run, "dimension"])


def previous_run(runs: DataFrame, inputs: DataFrame, *, keys: list[str], at: str, run: str, started: str, slices: int = 32) -> DataFrame:
    """``inputs`` with the latest run of equal keys (ignoring case and outer blanks) that finished before it started, or null.

    An as-of join: both sides are put together and each input takes the last run before it, in order of time. A key is cut into
    ``slices`` of time (quantiles of all runs), so that one with very many runs is several tasks; what a slice lacks comes from the
    last run of the slices before, of which a key has at most that many. Null keys and runs without a time match nothing.
    """
    low = {f"_{k}": F.lower(F.trim(F.col(k))) if dict(runs.dtypes)[k] == "string" else F.col(k) for k in keys}
    kind = dict(runs.dtypes)[at]
    r = runs.withColumns(low).select(*low, F.col(at).alias("_at"), F.col(run).alias("_run"), F.lit(True).alias("_ran")).dropna(subset=[*low, "_at"])
    edges = []
    if kind != "string":
        edges = r.agg(F.percentile_approx("_at", [k / slices for k in range(1, slices)], 1000)).first()[0] or []
    number = sum(((F.col("_at") >= F.lit(e)).cast("int") for e in sorted(set(edges))), F.lit(0))
    own = inputs.withColumns(low).select(*low, F.col(started).cast(kind).alias("_at"), F.struct(*inputs.columns).alias("_input"), F.lit(False).alias("_ran"))
    both = own.unionByName(r, allowMissingColumns=True).withColumn("_slice", F.coalesce(number, F.lit(0)))
    key = [*low, "_slice"]
    # at the same time an input comes before runs, which have not finished before it
    so_far = Window.partitionBy(*key).orderBy("_at", "_ran", "_run").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last(F.when(F.col("_ran"), F.struct("_run")), ignorenulls=True).over(so_far)).where("not _ran")
    ends = both.groupBy(*key).agg(F.max_by(F.when(F.col("_ran"), F.struct("_run")), F.when(F.col("_ran"), F.struct("_at", "_run"))).alias("_end"))
    before = Window.partitionBy(*low).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    met = found.join(carried.hint("merge"), key, "left")
    previous = F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_carried"))
    return met.select("_input.*", previous["_run"].alias("previous_run"))


def weekly_report(diff: DataFrame, pairs: DataFrame, *, run: str, most: int = 6) -> DataFrame:
    """(run, label, lines): the first keys of each label; a run without a previous one has one baseline row."""
    ranked = diff.withColumn("label", F.concat_ws(":", "dimension", "change")).withColumn("_k", F.row_number().over(Window.partitionBy(run, "label").orderBy("key"))).where(F.col("_k") <= most)
    lines = ranked.groupBy(run, "label").agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("lines"))
    baseline = pairs.where("previous is null").select(run, F.lit("baseline").alias("label"), F.lit("").alias("lines"))
    return lines.unionByName(baseline)


def history_context(keys: DataFrame, caps: dict[str, int], *, run: str) -> DataFrame:
    """(run, dimension, keys): the first keys of each dimension, as many as its cap says."""
    cap = F.coalesce(*(F.when(F.col("dimension") == d, F.lit(n)) for d, n in caps.items()), F.lit(0))
    ranked = keys.withColumn("_k", F.row_number().over(Window.partitionBy(run, "dimension").orderBy("ord", "key"))).where(F.col("_k") <= cap)
    return ranked.groupBy(run, "dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "key"))), lambda x: x["key"]), ", ").alias("keys"))


def list_runs(runs: DataFrame, *, at: str, tie: str, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc()).limit(limit)


def run_manifest(events: DataFrame, *, run: str) -> DataFrame:
    """(run, documents, failures, status) from (run, kind) events."""
    g = events.groupBy(run).agg(F.count_if(F.col("kind") == "document").alias("documents"), F.count_if(F.col("kind") == "failure").alias("failures"))
    return g.withColumn("status", F.when(F.col("documents") == 0, "no_documents").when(F.col("failures") > 0, "crawl_failures").otherwise("ready"))


def failure_reason(c: Column) -> Column:
    out = F.lit("other")
    for name, parts in reversed(FAILURES):
        out = F.when(reduce(lambda a, b: a | b, (F.lower(c).contains(p) for p in parts)), name).otherwise(out)
    return out


def failure_breakdown(failures: DataFrame, *, run: str, text_col: str, id_col: str) -> DataFrame:
    """(run, reason, n, jobs): failures by reason, zeros where none, with the ids of the jobs."""
    counted = failures.withColumn("reason", failure_reason(F.col(text_col))).groupBy(run, "reason").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(id_col)).alias("jobs"))
    every = failures.select(run).distinct().withColumn("reason", F.explode(F.array(*map(F.lit, FAILURE_NAMES))))
    return every.join(counted, [run, "reason"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "jobs": F.coalesce("jobs", F.array())})


def run_log(events: DataFrame, statuses: list[str], *, run: str, at: str, status_col: str) -> DataFrame:
    """(run, seconds, events, a column for each status)."""
    g = events.groupBy(run).agg(F.greatest(F.lit(0), F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("seconds"), F.count("*").alias("events"))
    return g.join(events.groupBy(run).pivot(status_col, statuses).count().na.fill(0), run)


def public_summary(reports: DataFrame, titles: DataFrame, entities: DataFrame, *, run: str) -> DataFrame:
    """(run, state, confirmed, top): confirmed is the smaller of what is reported and how many titles there are; top three by
    score among confirmed titles. ``reports``: (run, documents, failures, reported); ``titles``: (run, title);
    ``entities``: (run, name, score)."""
    t = titles.select(run, F.lower("title").alias("_t")).distinct()
    n = t.groupBy(run).agg(F.count("*").alias("titles"))
    chosen = entities.withColumn("_t", F.lower("name")).join(t, [run, "_t"], "left_semi")
    ranked = chosen.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("score"), "name"))).where("_k <= 3")
    top = ranked.groupBy(run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda x: x["name"]), ", ").alias("top"))
    j = reports.join(n, run, "left").join(top, run, "left").withColumn("confirmed", F.least("reported", F.coalesce("titles", F.lit(0))))
    state = F.when((F.col("documents") == 0) & (F.col("failures") > 0), "technical_blocked").when(F.col("confirmed") > 0, "usable").otherwise("insufficient")
    return j.select(run, state.alias("state"), "confirmed", F.coalesce("top", F.lit("")).alias("top"))
