"""Targets of the next wave: candidates for tasks that the wave before left short of sources or roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.plans.waves import RELEVANT
from claimloom.sources.scratch import cut

# Fixed values.
MARKET_ROLES = ["government_statistics", "industry_association", "credible_research_institution", "financial_report"]
#: Last picks, in order: priority and role of the task, roles of the candidate.
LAST_PICKS = [("critical", "regulator", ["regulator", "standards_body"]), ("high", "trusted_retail_channel", ["trusted_retail_channel"])]


def _first(df: DataFrame, keys: list[str], by: list[str], k: int, name: str = "_k") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(name) <= k)


def one_per_url(candidates: DataFrame) -> DataFrame:
    """(run, ord, candidate, host, role): a canonical URL once in a run, in its first place, with what its last row says."""
    key = F.coalesce(U.canonical(F.col("url")), F.col("url"), F.lit(""))
    g = candidates.groupBy("run", key.alias("_key")).agg(F.max_by(F.struct("candidate", "url", "role"), F.struct("ord", "candidate")).alias("_c"), F.min("ord").alias("ord"))
    return g.select("run", "ord", "_c.candidate", F.coalesce(U.hostname(F.col("_c.url")), F.lit("")).alias("host"), "_c.role")


def short_tasks(tasks: DataFrame, seen: DataFrame) -> DataFrame:
    """Critical tasks open to a market role whose relevant documents (``seen``: run, task, host, role) have too few hosts or roles."""
    critical = tasks.where((F.col("priority") == "critical") & F.arrays_overlap("roles", F.array(*map(F.lit, MARKET_ROLES))))
    have = seen.groupBy("run", "task").agg(F.countDistinct("host").alias("hosts"), F.countDistinct("role").alias("kinds"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("role").isin(MARKET_ROLES), F.col("role")))), ",").alias("known"))
    j = critical.select("run", "task", F.col("ord").alias("t_ord"), F.coalesce("min_sources", F.lit(0)).alias("min_sources"), F.coalesce("min_roles", F.lit(0)).alias("min_roles")).join(have.hint("merge"), ["run", "task"], "left")
    j = j.na.fill(0, ["hosts", "kinds"]).na.fill("", ["known"])
    return j.where("hosts < min_sources or kinds < min_roles")


def possible_pairs(short: DataFrame, market: DataFrame, seen: DataFrame, *, cap: int) -> DataFrame:
    """``short`` with the candidates that each could still get: by role the first (cap + 1)^2 of hosts that it hasn't seen.

    At most ``cap`` candidates are taken. One is passed over because it is taken, its host is one of those at most ``cap`` that the
    task took, or the task has seen its host. So of a host and role cap + 1 rows matter, and of a role as many more of
    these as the task has seen hosts. Places are joined by blocks, so the pairs follow the tasks and what they have seen.
    """
    block = (cap + 1) ** 2
    most = short.agg(F.max("hosts")).first()[0]
    if most is None:
        most = 0
    own = _first(market, ["run", "role", "host"], ["ord", "candidate"], cap + 1).drop("_k")
    placed = _first(own, ["run", "role"], ["ord", "candidate"], block + (cap + 1) * most, "pos").withColumn("block", F.floor((F.col("pos") - 1) / block))
    limit = F.col("hosts") * (cap + 1) + block
    wanted = short.withColumns({"limit": limit, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((limit - 1) / block)))})
    pairs = wanted.join(placed.hint("merge"), ["run", "block"]).where("pos <= limit").join(seen.select("run", "task", "host").distinct().hint("merge"), ["run", "task", "host"], "left_anti")
    return _first(pairs, ["run", "task", "role"], ["ord", "candidate"], block).drop("_k", "pos", "limit", "block")


def last_picks(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(run, pick, task, candidate): each run's first task of a kind of LAST_PICKS with the first candidate of its roles."""
    out = None
    for pick, (priority, role, roles) in enumerate(LAST_PICKS):
        task = tasks.where((F.col("priority") == priority) & F.array_contains("roles", role)).groupBy("run").agg(F.min_by("task", F.struct("ord", "task")).alias("task"))
        own = candidates.where(F.col("role").isin(roles)).groupBy("run").agg(F.min_by("candidate", F.struct("ord", "candidate")).alias("candidate"))
        part = task.join(own.hint("merge"), "run").select("run", F.lit(pick).alias("pick"), "task", "candidate")
        out = part if out is None else out.unionByName(part)
    return out


def targeted_wave(tasks: DataFrame, candidates: DataFrame, audit: DataFrame, *, cap: int = 8) -> DataFrame:
    """(run, place, candidate, task): whom the next wave asks for which task, at most ``cap`` a run.

    Critical tasks that allow a market role start from the hosts and roles of their documents that ``audit`` (run, task, url, role,
    status) calls relevant. In order each takes unused candidates of a market role with a host new to it, first of a role
    new to it, until it has its least numbers of hosts and roles or none is left. Then the first critical task of a regulator
    gets the first regulator or standards body, and the first high task of a trusted retail channel the first such channel.
    ``tasks``: (run, task, ord, priority, roles, min_sources, min_roles); ``candidates``: (run, candidate, ord, url, role), ids
    unique in a run. Equal places are told apart by id. Null minima are 0, null URLs have the empty host, null roles are of no use
    and count as no role that was seen. Empty tables give none.

    Each taking changes the next, so a run is one group, of at most 4 (cap + 1)^2 rows for each of its tasks that are short.
    """
    candidates = cut(one_per_url(candidates), "candidates")
    seen = cut(audit.where(F.col("status") == RELEVANT).select("run", "task", F.coalesce(U.hostname(F.col("url")), F.lit("")).alias("host"), "role").distinct(), "seen")
    short = cut(short_tasks(tasks, seen), "short")
    pairs = possible_pairs(short, candidates.where(F.col("role").isin(MARKET_ROLES)), seen, cap=cap)
    last = last_picks(tasks, candidates)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], set()
        for (_, task), own in part[part["pick"] < 0].groupby(["t_ord", "task"]):
            hosts, roles = set(), set(filter(None, own["known"].iloc[0].split(",")))
            seen_hosts, seen_kinds, more = int(own["hosts"].iloc[0]), int(own["kinds"].iloc[0]), len(roles)
            sources, kinds = int(own["min_sources"].iloc[0]), int(own["min_roles"].iloc[0])
            rows = list(own.sort_values(["ord", "candidate"])[["candidate", "host", "role"]].itertuples(index=False, name=None))
            while len(out) < cap and (seen_hosts + len(hosts) < sources or seen_kinds + len(roles) - more < kinds):
                free = [c for c in rows if c[0] not in taken and c[1] not in hosts]
                pick = next((c for c in free if c[2] not in roles), free[0] if free else None)
                if pick is None:
                    break
                taken.add(pick[0])
                hosts.add(pick[1])
                roles.add(pick[2])
                out.append((pick[0], task))
        ends = part[part["pick"] >= 0].sort_values("pick")
        out = (out + list(zip(ends["candidate"], ends["task"])))[:cap]
        return pd.DataFrame([(part["run"].iloc[0], k, c, t) for k, (c, t) in enumerate(out, 1)], columns=["run", "place", "candidate", "task"])

    rows = pairs.withColumn("pick", F.lit(-1)).unionByName(last, allowMissingColumns=True)
    types = dict(candidates.dtypes) | {"task": dict(tasks.dtypes)["task"]}
    return rows.groupBy("run").applyInPandas(choose, f"run {types['run']}, place int, candidate {types['candidate']}, task {types['task']}")
