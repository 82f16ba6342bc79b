"""Coverage plans: matrices, tasks, candidates, samples and gates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import urls as U
from claimloom.sources.scratch import cut, hinted

# Fixed values.
AXIS_WEIGHTS = {"taxonomy": 5, "price_tier": 4, "channel": 3, "model": 3, "population": 2}
ACCESS = ["login", "cookie", "api_key", "credits", "paywall", "captcha", "private"]
ROUTES = {"homepage": "html_crawler", "product": "html_crawler", "collection": "html_crawler", "blog": "html_crawler", "rss": "feed_reader", "sitemap": "url_discovery", "robots": "url_discovery", "search_results": "search_api", "review_csv": "csv_import"}
DISCOVERY = ["url_discovery", "search_api"]


def _reasons(pairs: list[tuple[Column, str | Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n) if isinstance(n, str) else n) for c, n in pairs)))


def coverage_matrix(plans: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Each plan's coverage rows with their axis items and minima. ``rows`` (row_id, module, axis, min_sources, min_roles) and
    ``items`` (axis, item) are small dimensions; a row needs as many samples as it has items, three at most."""
    listed = items.groupBy("axis").agg(F.array_sort(F.collect_set("item")).alias("axis_items"))
    own = rows.join(listed, "axis", "left").withColumn("axis_items", F.coalesce("axis_items", F.array().cast(dict(listed.dtypes)["axis_items"])))
    own = own.withColumn("min_samples", F.least(F.lit(3), F.size("axis_items")))
    return plans.crossJoin(F.broadcast(own))


def acquisition_tasks(matrix: DataFrame, current: DataFrame, *, keys: list[str], critical: list) -> DataFrame:
    """(keys..., module, gaps, priority): one task a row; what is missing against the minima, and how urgent it is."""
    j = matrix.join(current, keys, "left").na.fill(0, ["sources", "roles", "samples"])
    gap = lambda what: (F.col(what) < F.col(f"min_{what}"), F.concat(F.lit(f"{what}:"), F.col(what), F.lit("/"), F.col(f"min_{what}")))
    gaps = _reasons([gap("sources"), gap("roles"), gap("samples")])
    priority = F.when(F.size(gaps) == 0, "none").when(F.col("module").isin(*critical), "critical").when(F.size(gaps) > 1, "high").otherwise("medium")
    return j.select(*keys, "module", gaps.alias("gaps"), priority.alias("priority"))


def module_task_groups(tasks: DataFrame, modules: DataFrame, *, roles: str) -> DataFrame:
    """(module, tasks, rows, roles): every module, also those without tasks (0 of each)."""
    g = tasks.groupBy("module").agg(F.count("*").alias("tasks"), F.countDistinct("row_id").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(roles)))).alias("roles"))
    return modules.select("module").distinct().join(g, "module", "left").na.fill(0, ["tasks", "rows"])


def route_targets(targets: DataFrame) -> DataFrame:
    """``targets`` (url, kind, task_id) with adapter, disposition and blocking reasons."""
    adapter = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in ROUTES.items()), F.lit("none"))
    reasons = _reasons([(~U.is_public(F.col("url")), "url_not_public"), (adapter == "none", "no_adapter"), (F.col("task_id").isNull(), "task_missing")])
    out = targets.withColumns({"adapter": adapter, "reasons": reasons})
    return out.withColumn("disposition", F.when(F.size("reasons") > 0, "blocked").when(F.col("adapter").isin(*DISCOVERY), "discover_only").otherwise("collect"))


def candidate_priority(rank: Column) -> Column:
    return F.when(rank <= 2, "high").when(rank <= 5, "medium").otherwise("low")


def assess_candidates(inputs: DataFrame, roles: DataFrame, *, plan: str) -> DataFrame:
    """``inputs`` (plan, ord, url, role and the access flags) with canonical URL, duplicate_of, reasons and status, and what its
    role allows (``roles``: role, modules)."""
    c = inputs.withColumn("canonical", U.canonical(F.col("url")))
    first = F.first("ord").over(Window.partitionBy(plan, "canonical").orderBy("ord"))
    c = c.withColumn("duplicate_of", F.when(F.col("canonical").isNotNull() & (first != F.col("ord")), first))
    j = c.join(hinted(roles), "role", "left")
    reasons = F.concat(
        _reasons([(F.col("canonical").isNull() | ~U.is_public(F.col("url")), "url_not_public"), (F.col("duplicate_of").isNotNull(), "duplicate"), (F.col("modules").isNull(), "role_unknown")]),
        _reasons([(F.col(a), f"{a}_required") for a in ACCESS if a in inputs.columns]),
    )
    out = j.withColumn("reasons", reasons)
    return out.withColumn("status", F.when(F.size("reasons") == 0, "eligible").otherwise("blocked"))


def allocate_budget(candidates: DataFrame, *, plan: str, max_eligible: int, max_requests: int, per_role: int, per_host: int, brand_share: float) -> DataFrame:
    """(plan, candidate, reasons) from (plan, candidate, url, host, role, rank, requests, brand): by rank and URL, other sources first;
    brand-controlled ones up to their share of what is chosen.

    The caps interact, so the choice of a plan is made in one group. No cap ever frees room again: a candidate is refused
    once another of its host, role, requests and brand was, and passed over for its host only if that is among the chosen.
    So only a number of candidates bounded by the caps, the roles and the sizes of requests reaches the group. What speaks
    against each candidate then follows from the chosen ones before it, of which a plan has ``max_eligible`` at most.
    """
    limit = brand_share / (1 - brand_share)
    order = ["brand", "rank", "url", "candidate"]
    each = max(1, min(per_role, per_host, max_eligible))
    source = candidates.select(F.col(plan).cast("string").alias("plan"), F.col("candidate").cast("long"), "url", "host", F.col("role").cast("string"), F.col("rank").cast("int"), F.col("requests").cast("int"), "brand")
    near = source
    for keys, k in ((["plan", "brand", "role", "requests", "host"], each), (["plan", "brand", "role", "requests"], each * (max_eligible + 1))):
        near = near.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        roles: dict = {}
        hosts: dict = {}
        out: list = []
        spent = brands = 0
        others = None
        for r in part.sort_values(order).itertuples(index=False):
            if r.brand and others is None:
                others = len(out)
            if r.brand and brands >= min(max_eligible - others, int(others * limit)):
                continue
            if len(out) < max_eligible and roles.get(r.role, 0) < per_role and hosts.get(r.host, 0) < per_host and spent + r.requests <= max_requests:
                spent, brands = spent + r.requests, brands + bool(r.brand)
                roles[r.role], hosts[r.host] = roles.get(r.role, 0) + 1, hosts.get(r.host, 0) + 1
                out.append(r)
        return pd.DataFrame(out, columns=part.columns)

    chosen = near.groupBy("plan").applyInPandas(choose, near.schema)
    lists = chosen.groupBy("plan").agg(F.collect_list(F.struct(*order, "role", "host", "requests")).alias("_chosen"))
    mine = F.struct(*order)
    before = F.filter("_chosen", lambda x: F.struct(*(x[c] for c in order)) < mine)
    j = source.join(hinted(cut(lists, "chosen")), "plan", "left").withColumn("_before", F.coalesce(before, F.array().cast(dict(lists.dtypes)["_chosen"])))
    count = lambda test, of="_before": F.size(F.filter(of, test))
    others = F.coalesce(count(lambda x: ~x["brand"], "_chosen"), F.lit(0))
    full = F.col("brand") & (count(lambda x: x["brand"]) >= F.least(F.lit(max_eligible) - others, F.floor(others * limit)))
    spent = F.aggregate("_before", F.lit(0), lambda a, x: a + x["requests"])
    reasons = _reasons([
        (F.size("_before") >= max_eligible, "eligible_budget"), (count(lambda x: x["role"] == F.col("role")) >= per_role, "role_quota"),
        (count(lambda x: x["host"] == F.col("host")) >= per_host, "host_quota"), (spent + F.col("requests") > max_requests, "request_budget"),
    ])
    return j.select("plan", "candidate", F.when(full, "brand_share").otherwise(F.array_join(reasons, ",")).alias("reasons"))


def candidate_coverage(matrix: DataFrame, candidates: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys..., eligible, roles, met): candidates (with row_id) for each coverage row, and whether its minima are met."""
    g = candidates.groupBy(*keys).agg(F.count("*").alias("eligible"), F.countDistinct("role").alias("roles_found"))
    j = matrix.join(g, keys, "left").na.fill(0, ["eligible", "roles_found"])
    return j.select(*keys, "eligible", "roles_found", ((F.col("eligible") >= F.col("min_sources")) & (F.col("roles_found") >= F.col("min_roles"))).alias("met"))


def validate_samples(samples: DataFrame, bindings: DataFrame, sources: DataFrame, axes: DataFrame, allowed: DataFrame, *, sample: str) -> DataFrame:
    """(sample, errors): what speaks against each sample.

    ``samples``: (sample, status, basis, sample_type, relationship, populations, taxonomy); ``bindings``: (sample, source);
    ``sources``: (source, eligible, role); ``axes``: known items (item); ``allowed``: (relationship, role).
    """
    c = F.col
    own = _reasons([
        (c("status") != "validated", F.concat(F.lit("not_validated:"), c("status"))), (F.size("basis") == 0, "basis_missing"),
        ((c("relationship") == "analogy") != (c("sample_type") == "analogy"), "analogy_mismatch"), ((c("relationship") == "competitor") & (F.size("taxonomy") == 0), "taxonomy_missing"), ((c("relationship") == "competitor") & (F.size("populations") == 0), "population_missing"),
    ])
    base = samples.select(sample, F.explode(own).alias("error"))
    unknown = samples.select(sample, F.explode("taxonomy").alias("item")).join(hinted(axes), "item", "left_anti").select(sample, F.concat(F.lit("unknown_axis_item:"), "item").alias("error"))
    b = samples.select(sample, "relationship").join(bindings.hint("merge"), sample, "left").join(sources.hint("merge"), "source", "left").join(hinted(allowed.withColumn("fits", F.lit(True))), ["relationship", "role"], "left")
    g = b.groupBy(sample).agg(F.count("source").alias("n"), F.count_if(c("source").isNotNull() & c("eligible").isNull()).alias("lost"), F.count_if(~c("eligible")).alias("bad"), F.count("fits").alias("fits"))
    bound = g.select(sample, F.explode(_reasons([(c("n") == 0, "source_required"), (c("lost") > 0, "source_missing"), (c("bad") > 0, "source_not_eligible"), (c("fits") == 0, "role_not_allowed")])).alias("error"))
    errors = base.unionByName(unknown).unionByName(bound).groupBy(sample).agg(F.array_sort(F.collect_set("error")).alias("errors"))
    return samples.select(sample).join(errors.hint("merge"), sample, "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def coverage_keys(samples: DataFrame, axes: list[str], *, sample: str) -> DataFrame:
    """(sample, key): distinct ``axis:item`` keys of the axis columns, which hold lists."""
    keys = F.array_distinct(F.flatten(F.array(*map(_prefixed, axes))))
    return samples.select(sample, F.explode(keys).alias("key"))


def _prefixed(axis: str) -> Column:
    return F.transform(F.coalesce(F.col(axis), F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{axis}:"), x))


def key_weight(key: Column) -> Column:
    return F.coalesce(*(F.when(key.startswith(f"{a}:"), F.lit(n)) for a, n in AXIS_WEIGHTS.items()), F.lit(1))


def greedy_cover(keys: DataFrame, *, plan: str, sample: str) -> DataFrame:
    """(plan, place, sample, gain): in turn the sample whose uncovered keys weigh most, ties by id, until none gains.

    Each choice changes what the others gain, so a plan's keys are one group: for many plans of some hundred samples each.
    ``greedy_cover_large`` is for a plan without such a bound.
    """

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        left = {s: set(zip(own["key"], own["weight"])) for s, own in part.groupby("sample")}
        out, covered = [], set()
        while left:
            gain, s = min((-sum(w for _, w in own), s) for s, own in left.items())
            if gain == 0:
                break
            out.append((part["plan"].iloc[0], len(out) + 1, s, -gain))
            covered = left.pop(s)
            left = {k: own - covered for k, own in left.items()}
        return pd.DataFrame(out, columns=["plan", "place", "sample", "gain"])

    source = keys.select(F.col(plan).cast("string").alias("plan"), F.col(sample).cast("long").alias("sample"), "key", key_weight(F.col("key")).alias("weight")).distinct()
    return source.groupBy("plan").applyInPandas(choose, "plan string, place int, sample long, gain long")


def greedy_cover_large(keys: DataFrame, *, sample: str, rounds: int, cut, batch: int = 512, log: list | None = None) -> DataFrame:
    """The same for one plan too large for a group, up to ``rounds`` picks; ``cut`` writes a table and reads it back.

    Lazy: what a sample gained when it was last looked at bounds what it gains now, since covered keys only grow. A turn takes
    the ``batch`` samples of the highest bounds, works out their gains, and picks from them as long as the best one beats (or ties by id) the
    highest bound outside; only then are covered keys taken out of the table and bounds lowered. A turn ends without a pick
    only if it has lowered the highest bounds. The batch's uncovered keys are one group; at most ``batch`` + 1 rows reach the
    driver. ``log`` gets the number of picks of each turn.
    """
    left = cut(keys.select(F.col(sample).alias("sample"), "key", key_weight(F.col("key")).alias("weight")).distinct())
    bounds = cut(left.groupBy("sample").agg(F.sum("weight").cast("long").alias("bound")))
    chosen: list[tuple[int, int, int]] = []
    while len(chosen) < rounds:
        head = bounds.orderBy(F.desc("bound"), "sample").limit(batch + 1).collect()
        if not head:
            break
        inside, limit = [r["sample"] for r in head[:batch]], (-head[batch]["bound"], head[batch]["sample"]) if len(head) > batch else None
        most = rounds - len(chosen)

        def choose(part: pd.DataFrame) -> pd.DataFrame:
            own = {s: dict(zip(rows["key"], rows["weight"])) for s, rows in part.groupby("sample")}
            gain = {s: sum(k.values()) for s, k in own.items()}
            having: dict[str, list] = {}
            for s, k in own.items():
                for key in k:
                    having.setdefault(key, []).append(s)
            out, open_ = [], set(own)
            while open_ and len(out) < most:
                best = min((-gain[s], s) for s in open_)
                if limit is not None and best > limit or best[0] == 0:
                    break
                open_.discard(best[1])
                out.append((best[1], gain[best[1]], len(out) + 1))
                for key in own[best[1]]:
                    for s in having.pop(key, ()):
                        gain[s] -= own[s][key] if s != best[1] else 0
            return pd.DataFrame([*out, *((s, gain[s], 0) for s in sorted(open_))], columns=["sample", "gain", "place"])

        asked = keys.sparkSession.createDataFrame([(s,) for s in inside], f"sample {dict(left.dtypes)['sample']}")
        done = left.join(F.broadcast(asked), "sample").groupBy(F.lit(0).alias("one")).applyInPandas(choose, f"sample {dict(left.dtypes)['sample']}, gain long, place int").collect()
        picks = sorted((r for r in done if r["place"]), key=lambda r: r["place"])
        chosen += [(len(chosen) + n, r["sample"], r["gain"]) for n, r in enumerate(picks, 1)]
        if log is not None:
            log.append(len(picks))
        gone = {r["sample"] for r in picks} | {s for s in inside if s not in {r["sample"] for r in done}}
        now = [(r["sample"], r["gain"]) for r in done if not r["place"] and r["gain"]]
        if picks:
            own = keys.sparkSession.createDataFrame([(r["sample"],) for r in picks], asked.schema)
            covered = left.join(F.broadcast(own), "sample").select("key").distinct()
            left = cut(left.join(covered.hint("merge"), "key", "left_anti"))
        new = keys.sparkSession.createDataFrame(now, f"sample {dict(left.dtypes)['sample']}, bound long")
        others = bounds.join(F.broadcast(asked), "sample", "left_anti")
        bounds = cut(others.select("sample", "bound").unionByName(new))
        if not picks and not now and not gone:
            break
    return keys.sparkSession.createDataFrame(chosen, "place int, sample long, gain long")


def relationship_backfill(selected: DataFrame, redundant: DataFrame, minimums: DataFrame, *, sample: str) -> DataFrame:
    """Redundant samples, by id, that each relationship still needs to reach its minimum."""
    have = selected.groupBy("relationship").agg(F.count("*").alias("have"))
    need = minimums.join(have, "relationship", "left").select("relationship", (F.col("least") - F.coalesce("have", F.lit(0))).alias("need"))
    ranked = redundant.withColumn("_k", F.row_number().over(Window.partitionBy("relationship").orderBy(sample)))
    return ranked.join(hinted(need), "relationship").where(F.col("_k") <= F.col("need")).drop("_k", "need")


def axis_coverage(axes: DataFrame, keys: DataFrame) -> DataFrame:
    """(axis, covered, uncovered) from the known (axis, item) and the selected samples' (axis, item)."""
    j = axes.join(keys.distinct().withColumn("hit", F.lit(True)).hint("merge"), ["axis", "item"], "left")
    return j.groupBy("axis").agg(F.count("hit").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("item")))).alias("uncovered"))


# Relationships of samples and axes in the order in which gaps are told, and the gates' statuses.
RELATIONSHIPS = ["direct_competitor", "supply_chain_actor", "channel_actor", "content_actor", "business_model_analogy"]
GAP_AXES = ["taxonomy", "value_chain", "price_tier", "channel", "consumer_need", "business_model"]
GATED_AXES = ["price_tier", "channel", "business_model"]
BLOCKED = "blocked_insufficient_coverage"
GATE_PASSED = "抽样覆盖门已通过，但所有样本仍需在 module_research 采集 evidence。"
GATE_BLOCKED = "代表性覆盖不足，禁止进入 module_research 和综合判断。"


def coverage_gate(samples: DataFrame, assignments: DataFrame, axes: DataFrame, minimums: DataFrame, *, least_each: int) -> DataFrame:
    """(requirement, found, least, status) of the selected samples.

    ``samples``: (sample, relationship); ``assignments``: (sample, axis, item), populations as axis ``population``; ``axes``: (axis, item),
    the plan's items; ``minimums``: (requirement, least). Requirement ``taxonomy`` counts the taxonomy's items that
    ``least_each`` samples have, and asks for all; an axis counts its known items that a sample has, ``population`` all that samples
    name, a relationship its samples. What has no minimum is asked for 0.
    """
    mine = assignments.join(samples.select("sample").distinct().hint("merge"), "sample", "left_semi").distinct()
    each = mine.groupBy("axis", "item").agg(F.count("*").alias("n"))
    known = axes.distinct().join(each.hint("merge"), ["axis", "item"], "left").na.fill(0, ["n"])
    enough = F.col("n") >= F.when(F.col("axis") == "taxonomy", least_each).otherwise(1)
    per = known.where(F.col("axis").isin("taxonomy", *GATED_AXES)).groupBy(F.col("axis").alias("requirement")).agg(F.count_if(enough).alias("found"), F.count("*").alias("of"))
    people = each.where("axis = 'population'").select(F.lit("population").alias("requirement"), F.lit(1).alias("one")).groupBy("requirement").agg(F.count("*").alias("found"), F.count("*").alias("of"))
    kinds = samples.dropDuplicates(["sample"]).groupBy(F.col("relationship").alias("requirement")).agg(F.count("*").alias("found"), F.count("*").alias("of"))
    asked = samples.sparkSession.createDataFrame([(n, r) for n, r in enumerate(["taxonomy", *GATED_AXES, "population", *RELATIONSHIPS])], "place int, requirement string")
    j = asked.join(per.unionByName(people).unionByName(kinds).hint("merge"), "requirement", "left").join(minimums, "requirement", "left").na.fill(0, ["found", "of", "least"])
    least = F.when(F.col("requirement") == "taxonomy", F.col("of")).otherwise(F.col("least").cast("long"))
    return j.select("place", "requirement", "found", least.alias("least")).withColumn("status", F.when(F.col("found") >= F.col("least"), "pass").otherwise(BLOCKED))


def gate_gaps(gate: DataFrame, samples: DataFrame, assignments: DataFrame, axes: DataFrame) -> DataFrame:
    """(phase, place, item, gap): one line if all of ``gate`` passes; else a line that says so, the plan's items that no sample has, and relationships below their minimum."""
    verdict = gate.agg(F.bool_and(F.col("status") == "pass").alias("_ok"))
    head = verdict.select(F.lit(0).alias("phase"), F.lit(0).alias("place"), F.lit("").alias("item"), F.when(F.col("_ok"), GATE_PASSED).otherwise(GATE_BLOCKED).alias("gap"), "_ok")
    mine = assignments.join(samples.select("sample").distinct().hint("merge"), "sample", "left_semi").select("axis", "item").distinct()
    left = axes.distinct().where(F.col("axis").isin(*GAP_AXES)).join(mine.hint("merge"), ["axis", "item"], "left_anti")
    at = F.array_position(F.array(*map(F.lit, GAP_AXES)), F.col("axis")).cast("int")
    left = left.select(F.lit(1).alias("phase"), at.alias("place"), F.col("item").cast("string").alias("item"), F.concat(F.lit("uncovered_axis_item:"), F.col("item").cast("string")).alias("gap"))
    short = gate.where(F.col("requirement").isin(*RELATIONSHIPS) & (F.col("status") != "pass"))
    short = short.select(F.lit(2).alias("phase"), "place", F.lit("").alias("item"), F.concat(F.lit("relationship_minimum:"), "requirement", F.lit(":"), F.col("found").cast("string"), F.lit("/"), F.col("least").cast("string")).alias("gap"))
    rest = left.unionByName(short).join(F.broadcast(verdict), ~F.col("_ok"))  # one row
    return head.unionByName(rest).drop("_ok")


def next_roles(tasks: DataFrame, collected: DataFrame, *, most: int = 8) -> DataFrame:
    """The first roles, by task order, that nothing has been collected for. ``tasks``: (ord, roles); ``collected``: (role)."""
    first = tasks.select("ord", F.posexplode("roles").alias("pos", "role")).groupBy("role").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.join(collected.select("role").distinct().hint("merge"), "role", "left_anti").orderBy("at", "role").limit(most).select("role")


def final_coverage(rows: DataFrame, samples: DataFrame, *, plan: str) -> DataFrame:
    """``rows`` (plan, row_id, module, axis_items, min_samples, other_gaps) with the samples whose items meet theirs, and the gaps left."""
    hit = rows.select(plan, "row_id", F.explode("axis_items").alias("item")).join(samples.hint("merge"), [plan, "item"]).groupBy(plan, "row_id").agg(F.countDistinct("sample").alias("samples"))
    j = rows.join(hit.hint("merge"), [plan, "row_id"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    gaps = F.col("other_gaps") + (F.col("samples") < F.col("min_samples")).cast("int")
    return j.select(plan, "row_id", "module", "samples", gaps.alias("gaps"))


def usage_totals(waves: DataFrame, columns: list[str], *, plan: str) -> DataFrame:
    return waves.groupBy(plan).agg(*(F.sum(F.col(c).cast("decimal(18,6)")).alias(c) for c in columns))


def report_coverage(rows: DataFrame, *, plan: str) -> DataFrame:
    """(plan, total, passed, gap, critical, critical_passed) from (plan, status, priority)."""
    ok, critical = F.col("status") == "pass", F.col("priority") == "critical"
    return rows.groupBy(plan).agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("gap"), F.count_if(critical).alias("critical"), F.count_if(critical & ok).alias("critical_passed"))


def fill_targets(rows: DataFrame, *, cap: int = 8) -> DataFrame:
    """(run, place, candidate, task) from a run's tasks and candidates in one table (run, what, ord, id, host, role, min_sources, min_roles).

    For each critical task in order candidates with a new host, of a new role first, until its minima are met; at most ``cap``
    a run. Each taking changes the next, so a run is one group, but only of what its first ``cap`` takings can reach: a
    candidate is passed over only if it is taken, or its host or role is among at most ``cap`` of those taken.
    """

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ord", "id"])
        unused = list(part[part["what"] == "candidate"][["id", "host", "role"]].itertuples(index=False, name=None))
        out = []
        for task, sources, roles_needed in part[part["what"] == "task"][["id", "min_sources", "min_roles"]].itertuples(index=False, name=None):
            hosts, roles = set(), set()
            while len(hosts) < sources or len(roles) < roles_needed:
                free = [c for c in unused if c[1] not in hosts]
                pick = next((c for c in free if c[2] not in roles), free[0] if free else None)
                if pick is None:
                    break
                unused.remove(pick)
                hosts.add(pick[1])
                roles.add(pick[2])
                out.append((part["run"].iloc[0], len(out) + 1, pick[0], task))
        return pd.DataFrame(out[:cap], columns=["run", "place", "candidate", "task"])

    def first(part: DataFrame, keys: list[str], k: int) -> DataFrame:
        return part.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "id"))).where(F.col("_k") <= k).drop("_k")

    tasks = first(rows.where("what = 'task' and (min_sources > 0 or min_roles > 0)"), ["run"], cap)
    candidates = first(rows.where("what = 'candidate'"), ["run", "host", "role"], cap + 1)
    a_role = first(candidates, ["run", "role"], (cap + 1) ** 2)
    kept = first(a_role, ["run"], (cap + 1) ** 3).unionByName(first(first(candidates, ["run", "host"], cap + 1), ["run"], (cap + 1) ** 2)).distinct()
    return tasks.unionByName(kept).groupBy("run").applyInPandas(choose, "run string, place int, candidate long, task long")


def fresh_candidates(candidates: DataFrame, known: DataFrame, *, run: str = "run", url_col: str = "url", order: str = "ord") -> DataFrame:
    """``candidates`` of each run without those whose canonical URL another one before has, or a document of the run before (``known``: run, url).

    A URL without a canonical form counts as itself among candidates; it is known if the run before has any such URL.
    Equal places are told apart by URL. Rows of a URL are combined before the shuffle, so a URL may have any number of them.
    """
    canonical = U.canonical(F.col(url_col))
    columns = candidates.columns
    first = candidates.withColumn("_key", F.coalesce(canonical, F.col(url_col))).groupBy(run, "_key").agg(F.min_by(F.struct(*columns), F.struct(order, url_col)).alias("_c"))
    one = first.select("_c.*").withColumn("_key", F.coalesce(canonical, F.lit("")))
    seen = known.select(run, F.coalesce(U.canonical(F.col("url")), F.lit("")).alias("_key")).distinct()
    return one.join(seen.hint("merge"), [run, "_key"], "left_anti").select(*columns)


def balance_tasks(rows: DataFrame, *, cap: int = 24) -> DataFrame:
    """(run, candidate, task) from (run, ord, candidate, task, priority, load): each candidate goes to its least loaded compatible task
    (then priority, id), candidates in order, at most ``cap`` a run. ``load`` is what the task has from before. A run is one group, of its
    first ``cap`` candidates and for each of the ``cap`` tasks that were least loaded before: fewer than that get a load meanwhile."""

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        load = dict(part[["task", "load"]].itertuples(index=False, name=None))
        out = []
        for (_, candidate), own in part.sort_values(["ord", "candidate"]).groupby(["ord", "candidate"], sort=True):
            task = min((load[t], p, t) for t, p in own[["task", "priority"]].itertuples(index=False, name=None))[2]
            load[task] += 1
            out.append((part["run"].iloc[0], candidate, task))
        return pd.DataFrame(out[:cap], columns=["run", "candidate", "task"])

    order = Window.partitionBy("run").orderBy("ord", "candidate")
    kept = rows.withColumn("_k", F.dense_rank().over(order)).where(F.col("_k") <= cap).drop("_k")
    tasks = Window.partitionBy("run", "ord", "candidate").orderBy("load", "priority", "task")
    kept = kept.withColumn("_k", F.row_number().over(tasks)).where(F.col("_k") <= cap).drop("_k")
    return kept.groupBy("run").applyInPandas(assign, "run string, candidate long, task long")
