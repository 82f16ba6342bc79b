"""Benchmark scoring: metrics, hard gates, scores, early stop, cost and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import hinted

# Fixed values.
MIN_DOCUMENTS, MIN_HOSTS, MIN_DEEP, MIN_VERIFIABLE = 3, 2, 1, 0.7
MAX_MEDIAN_NOISE, MAX_NOISE, MAX_MS, MAX_PUBLIC, MAX_MODEL, MAX_CREDITS = 0.25, 0.5, 300_000, 32, 3, 50
PASS_SCORE, MIN_PASSING = 70, 3


def category_metrics(docs: DataFrame, *, category: str) -> DataFrame:
    """(category, docs, hosts, deep, verifiable, noise_median, noise_max) from (category, accepted, host, deep, noise, verified):
    noise is 1 where nothing is accepted."""
    ok = F.col("accepted")
    return docs.groupBy(category).agg(
        F.count_if(ok).alias("docs"), F.countDistinct(F.when(ok, F.col("host"))).alias("hosts"), F.count_if(ok & F.col("deep")).alias("deep"), F.coalesce(F.avg(F.when(ok, F.col("verified").cast("int"))), F.lit(0.0)).alias("verifiable"),
        F.coalesce(F.percentile(F.when(ok, F.col("noise")), 0.5), F.lit(1.0)).alias("noise_median"), F.coalesce(F.max(F.when(ok, F.col("noise"))), F.lit(1.0)).alias("noise_max"),
    )


def _share(c: Column, least: float, weight: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / least)) * weight


def score_category(m: DataFrame) -> DataFrame:
    """``m`` with score (of 100), failures and passed: at least 70 points and no hard gate failed."""
    c = F.col
    gates = {
        "run_not_completed": c("status") != "completed", "source_coverage": (c("docs") < MIN_DOCUMENTS) | (c("hosts") < MIN_HOSTS) | (c("deep") < MIN_DEEP), "verifiable_ratio": c("verifiable") < MIN_VERIFIABLE,
        "residual_noise": (c("noise_median") > MAX_MEDIAN_NOISE) | (c("noise_max") > MAX_NOISE), "no_actionable_finding": c("actionable") < 1, "duration": c("duration_ms") > MAX_MS,
        "cost_or_requests": (c("public_requests") > MAX_PUBLIC) | (c("model_requests") > MAX_MODEL) | (c("credits") > MAX_CREDITS) | c("cost").isNull() | (c("cost") > c("cost_cap")),
    }
    failures = F.array_compact(F.array(*(F.when(g, F.lit(n)) for n, g in gates.items())))
    noise = F.when(c("noise_median") <= MAX_MEDIAN_NOISE, 8.0).otherwise(8.0 * F.greatest(F.lit(0.0), 1 - (c("noise_median") - MAX_MEDIAN_NOISE) / (1 - MAX_MEDIAN_NOISE)))
    worst = F.when(c("noise_max") <= MAX_NOISE, 7.0).otherwise(7.0 * F.greatest(F.lit(0.0), 1 - (c("noise_max") - MAX_NOISE) / (1 - MAX_NOISE)))
    points = (
        _share(c("docs"), MIN_DOCUMENTS, 12) + _share(c("hosts"), MIN_HOSTS, 8) + _share(c("deep"), MIN_DEEP, 10) + _share(c("verifiable"), MIN_VERIFIABLE, 30) + noise + worst
        + F.when(c("actionable") >= 1, 10.0).otherwise(0.0) + F.when((c("status") == "completed") & (c("duration_ms") <= MAX_MS), 10.0).otherwise(0.0) + F.when(gates["cost_or_requests"], 0.0).otherwise(5.0)
    )
    out = m.withColumns({"score": F.round(points, 2), "failures": failures})
    return out.withColumn("passed", (F.col("score") >= PASS_SCORE) & (F.size("failures") == 0))


def early_stop(scores: DataFrame, *, benchmark: str, seq: str = "seq", least: int = MIN_PASSING) -> DataFrame:
    """``scores`` with ``counted`` and ``verdict``: in order, a benchmark stops at the first row after which the passes and what remains can no longer reach ``least``."""
    w = Window.partitionBy(benchmark)
    passes = F.sum(F.col("passed").cast("int")).over(w.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    left = F.count("*").over(w) - F.row_number().over(w.orderBy(seq))
    marked = scores.withColumn("_hopeless", passes + left < least).withColumn("_stop", F.min(F.when(F.col("_hopeless"), F.col(seq))).over(w))
    out = marked.withColumn("counted", F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop")))
    total = F.sum((F.col("passed") & F.col("counted")).cast("int")).over(w)
    return out.withColumn("verdict", F.when(total >= least, "passed").when(F.col("_stop").isNotNull(), "stopped").otherwise("failed")).drop("_hopeless", "_stop")


def model_cost(usage: DataFrame, prices: DataFrame, *, run: str) -> DataFrame:
    """(run, cost decimal(18,6)): tokens at a price per million by model, plus search credits at theirs; prices are a small table."""
    j = usage.join(hinted(prices), "model")
    d = lambda x: x.cast("decimal(18,6)")
    cost = F.col("input_tokens") * d(F.col("input_price")) / 1_000_000 + F.col("output_tokens") * d(F.col("output_price")) / 1_000_000 + F.col("searches") * d(F.col("search_price"))
    return j.groupBy(run).agg(F.round(F.sum(cost), 6).cast("decimal(18,6)").alias("cost"))


def budget_violations(usage: DataFrame, caps: dict[str, float], *, run: str) -> DataFrame:
    """(run, violation): the counters of a run that exceed their caps."""
    names = F.array(*(F.when(F.col(k) > v, F.lit(f"{k}_cap_exceeded")) for k, v in caps.items()))
    return usage.select(run, F.explode(F.array_compact(names)).alias("violation"))


def support_status(findings: DataFrame, *, finding: str) -> DataFrame:
    """(finding, support): full if all of its quotes are bound, partial if some are, else unsupported; from (finding, bound)."""
    g = findings.groupBy(finding).agg(F.count("*").alias("n"), F.count_if("bound").alias("ok"))
    return g.select(finding, F.when(F.col("ok") == F.col("n"), "full").when(F.col("ok") > 0, "partial").otherwise("unsupported").alias("support"))


def replay_score(m: DataFrame) -> DataFrame:
    """``m`` with the replay score and passed: sources 10 + 10 + 10, findings 30, cleanliness 15, decisions 10, stability 10, cost 5."""
    c = F.col
    one = lambda x, n: F.least(x / n, F.lit(1.0)) * 10
    stability = F.when(c("duration_ms") <= 180_000, 10).when(c("duration_ms") <= 240_000, 7).when(c("duration_ms") <= 300_000, 3).otherwise(0)
    score = one(c("docs"), 3) + one(c("hosts"), 2) + one(c("deep"), 2) + c("verifiable") * 30 + (1 - c("noise_median")) * 15 + F.when((c("competitors") >= 2) & (c("opportunities") >= 2), 10).otherwise(0) + stability + 5
    gates = (c("docs") >= MIN_DOCUMENTS) & (c("hosts") >= MIN_HOSTS) & (c("deep") >= MIN_DEEP) & (c("verifiable") >= MIN_VERIFIABLE) & (c("noise_median") <= MAX_MEDIAN_NOISE) & (c("noise_max") <= MAX_NOISE) & (c("crossings") == 0) & (c("duration_ms") <= MAX_MS)
    out = m.withColumn("score", F.round(score, 4))
    return out.withColumn("passed", gates & (F.col("score") >= PASS_SCORE))


def entity_crossing(websites: DataFrame, competitors: DataFrame, *, run: str) -> DataFrame:
    """(run, crossings): bound sites with a source that their competitor does not have."""
    j = websites.join(competitors, [run, "competitor"], "left")
    crossing = F.size(F.array_except("sources", F.coalesce("known", F.array().cast("array<bigint>")))) > 0
    return j.groupBy(run).agg(F.count_if(crossing).alias("crossings"))
