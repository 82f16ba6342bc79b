"""Verification of a wave of collected documents against the tasks that asked for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.functions.text import SPACE
from claimloom.sources.scratch import cut, hinted

# What an official record of a standard shows, and whose records count although their source was not accepted.
# Bounds of the number are those of ASCII words (Java's \b would count Han characters to the word).
STANDARD_NUMBER = rf"(?i)(?<![0-9A-Za-z_])GB(?:/T)?{SPACE}*\d{{3,6}}(?:\.\d+)?-\d{{4}}(?![0-9A-Za-z_])"
RECORD_TERMS = ["发布单位", "发布日期", "实施日期"]
AUTHORITIES = ["standards_body", "regulator"]
RELEVANT = "raw_candidate_relevant_not_evidence"
MET = "raw_candidate_target_met_not_evidence"


def squeezed(c: Column) -> Column:
    """Lower case, all white space out."""
    return F.regexp_replace(F.lower(c), SPACE, "")


def squeeze(terms: list[str]) -> list[str]:
    out = ["".join(x.lower().replace("\ufeff", "").split()) for x in terms]
    if not all(out):
        raise ValueError("terms must not be blank")
    return out


def occurrences(c: Column, terms: list[str]) -> Column:
    """How often the terms occur in ``c``, added up; occurrences of one term do not overlap."""
    each = (F.floor((F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) / len(x)) for x in terms)
    return reduce(lambda a, b: a + b, each)


def verify_wave(docs: DataFrame, routes: DataFrame, *, terms: list[str], conflicts: list[str] = (), least: int = 2, url_col: str = "url", title_col: str = "title", text_col: str = "text", accepted_col: str = "accepted") -> DataFrame:
    """``docs`` with route_id, task_id, role, hits, conflicting, binary, override and status.

    ``routes``: (ord, reference, route_id, task_id, role); a document's route is the last one whose reference has its
    canonical URL. hits counts ``terms`` in title and text, conflicting lists ``conflicts`` in title and URL, both with
    case and white space set aside. Status, the first that holds: route_missing; source_quality_rejected (a PDF payload,
    or a source not accepted, unless it is an official record of an authority); category_relevance_mismatch (fewer hits than ``least``,
    or a conflict); else relevant. Nulls count as empty or not accepted. A copy of a document gets the same status.
    """
    if not terms:
        raise ValueError("terms of the category are required")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = routes.withColumn("_c", U.canonical(F.col("reference"))).where("_c is not null").groupBy("_c").agg(F.max_by(F.struct("route_id", "task_id", "role"), "ord").alias("_r"))
    j = docs.withColumn("_k", U.canonical(blank(url_col))).join(hinted(cut(own, "routes")), F.col("_k") == F.col("_c"), "left")
    both = F.concat(blank(title_col), F.lit("\n"), blank(text_col))
    j = j.withColumn("hits", occurrences(squeezed(both), squeeze(terms)))
    named = squeezed(F.concat(blank(title_col), F.lit("\n"), blank(url_col)))
    found = F.array_compact(F.array(*(F.when(named.contains(s), F.lit(x)) for x, s in zip(conflicts, squeeze(list(conflicts)))))) if conflicts else F.array().cast("array<string>")
    shown = reduce(lambda a, b: a + b, (both.contains(x).cast("int") for x in RECORD_TERMS))
    record = F.coalesce(F.col("_r")["role"].isin(*AUTHORITIES), F.lit(False)) & (F.col("hits") >= 2) & both.rlike(STANDARD_NUMBER) & (shown >= 2)
    j = j.withColumns({"route_id": F.col("_r")["route_id"], "task_id": F.col("_r")["task_id"], "role": F.col("_r")["role"], "conflicting": found, "binary": blank(text_col).rlike(rf"\A{SPACE}*%PDF-"), "override": record})
    taken = F.coalesce(F.col(accepted_col), F.lit(False)) | F.col("override")
    status = (
        F.when(F.col("_r").isNull(), "route_missing").when(F.col("binary") | ~taken, "source_quality_rejected")
        .when((F.col("hits") < least) | (F.size("conflicting") > 0), "category_relevance_mismatch").otherwise(RELEVANT)
    )
    return j.withColumn("status", status).drop("_k", "_c", "_r")


def wave_coverage(audit: DataFrame, tasks: DataFrame, *, url_col: str = "url") -> DataFrame:
    """(task_id, docs, hosts, roles, gaps, status): each task's relevant documents, their distinct hosts and roles, against its minima.

    ``tasks``: (task_id, min_sources, min_roles, min_samples). A wave brings no representative samples, so a task that
    needs some keeps that gap.
    """
    host = F.nullif(U.hostname(F.col(url_col)), F.lit(""))
    g = audit.where(F.col("status") == RELEVANT).groupBy("task_id").agg(F.count("*").alias("docs"), F.countDistinct(host).alias("hosts"), F.countDistinct("role").alias("roles"))
    j = tasks.join(hinted(cut(g, "tasks")), "task_id", "left").na.fill(0, ["docs", "hosts", "roles"])
    short = [(F.col("hosts") < F.col("min_sources"), "independent_source_coverage_missing"), (F.col("roles") < F.col("min_roles"), "source_role_coverage_missing"), (F.col("min_samples") > 0, "representative_sample_coverage_missing")]
    gaps = F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in short)))
    return j.select("task_id", "docs", "hosts", "roles", gaps.alias("gaps"), F.when(F.size(gaps) == 0, MET).otherwise("raw_candidate_gap").alias("status"))


def wave_decision(audit: DataFrame, coverage: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: documents by status, tasks met and with gaps, and what comes next; critical tasks decide. ``tasks``: (task_id, priority)."""
    status = F.col("status")
    d = audit.agg(
        F.count("*").alias("documents"), F.count_if(status == RELEVANT).alias("relevant"), F.count_if(status == "category_relevance_mismatch").alias("mismatches"), F.count_if(status == "source_quality_rejected").alias("rejected"),
        F.count_if(status == "route_missing").alias("unrouted"), F.count_if("binary").alias("binaries"), F.count_if("override").alias("overrides"),
    )
    met, critical = status == MET, F.col("priority") == "critical"
    c = coverage.join(tasks.select("task_id", "priority"), "task_id", "left").agg(F.count_if(met).alias("met"), F.count_if(~met).alias("gaps"), F.count_if(met & critical).alias("critical_met"), F.count_if(~met & critical).alias("critical_gaps"))
    one = d.join(F.broadcast(c))  # a row each
    return one.withColumn("next_action", F.when(F.col("critical_gaps") == 0, "begin_m3_claim_extraction").otherwise("continue_m2_4_targeted_waves")).withColumn("reason", F.when(F.col("critical_gaps") == 0, "critical_raw_candidate_coverage_met").otherwise("critical_raw_candidate_coverage_gaps_remain"))
