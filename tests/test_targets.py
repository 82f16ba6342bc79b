"""Targets of the next wave against a plain model that looks at every candidate."""

import random

from claimloom.plans import targets as T
from claimloom.plans.waves import RELEVANT

TASK = "run string, task long, ord long, priority string, roles array<string>, min_sources int, min_roles int"
CANDIDATE = "run string, candidate long, ord long, url string, role string"
AUDIT = "run string, task long, url string, role string, status string"
ROLES = [*T.MARKET_ROLES, "regulator", "standards_body", "trusted_retail_channel", "media"]


def plain(tasks, candidates, audit, cap):
    """One run; URLs are ``https://host/path``, candidates come in order of place and id."""
    host = lambda u: u.split("/")[2]
    by_url = {}
    for c in sorted(candidates, key=lambda c: (c[1], c[0])):
        by_url[c[2]] = (by_url[c[2]][0] if c[2] in by_url else c[1], c)
    unused = [c for _, c in sorted(by_url.values(), key=lambda x: (x[0], x[1][0]))]
    out, tasks = [], sorted(tasks, key=lambda t: (t[1], t[0]))

    def take(fits):
        for c in unused:
            if fits(c):
                unused.remove(c)
                return c
        return None

    for task, _, priority, roles, sources, kinds in tasks:
        if priority != "critical" or not set(roles) & set(T.MARKET_ROLES):
            continue
        old = [a for a in audit if a[0] == task and a[3] == RELEVANT]
        hosts, used = {host(a[1]) for a in old}, {a[2] for a in old if a[2]}
        while len(hosts) < (sources or 0) or len(used) < (kinds or 0):
            fresh = lambda c: c[3] in T.MARKET_ROLES and host(c[2]) not in hosts  # noqa: B023, E731
            c = take(lambda c: fresh(c) and c[3] not in used) or take(fresh)  # noqa: B023
            if c is None:
                break
            hosts.add(host(c[2]))
            used.add(c[3])
            out.append((c[0], task))
    for priority, role, roles in T.LAST_PICKS:
        task = next((t[0] for t in tasks if t[2] == priority and role in t[3]), None)
        c = take(lambda c: c[3] in roles) if task is not None else None  # noqa: B023
        if c:
            out.append((c[0], task))
    return out[:cap]


def test_against_plain_model(spark):
    r = random.Random(24)
    tasks, candidates, audit, want = [], [], [], {}
    for run in range(30):
        n = r.choice([2, 6, 40])
        ts = [(k, r.randrange(4), r.choice(["critical", "critical", "high"]), r.sample(ROLES, 3), r.choice([None, 0, 2, 5]), r.randrange(3)) for k in range(r.choice([1, 4, 9]))]
        cs = [(k, r.randrange(60), f"https://h{r.randrange(n)}.example.org/{r.randrange(6)}", r.choice([*ROLES, None])) for k in range(r.choice([0, 8, 60, 200]))]
        au = [(r.randrange(9), f"https://h{r.randrange(n)}.example.org/{k}", r.choice([*ROLES, None]), r.choice([RELEVANT, "route_missing"])) for k in range(r.choice([0, 10, 60]))]
        tasks += [(str(run), *t) for t in ts]
        candidates += [(str(run), *c) for c in cs]
        audit += [(str(run), *a) for a in au + au[:3]]
        want[str(run)] = plain(ts, cs, au, 3)
    got = {}
    made = spark.createDataFrame(tasks, TASK), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(audit, AUDIT)
    for x in T.targeted_wave(*made, cap=3).orderBy("run", "place").collect():
        got.setdefault(x.run, []).append((x.candidate, x.task))
    assert got == {k: v for k, v in want.items() if v}


def test_task_that_has_seen_most_hosts_and_one_hot_host(spark):
    market = T.MARKET_ROLES[0]
    tasks = spark.createDataFrame([("r", 1, 0, "critical", [market], 500, 1), ("r", 2, 1, "critical", [market], 1, 0)], TASK)
    candidates = spark.createDataFrame([("r", k, k, f"https://{'hot' if k < 2000 else f'h{k}'}.example.org/{k}", market) for k in range(2400)], CANDIDATE)
    audit = spark.createDataFrame([("r", 1, f"https://h{k}.example.org/x", market, RELEVANT) for k in range(2000, 2390)], AUDIT)
    got = [(x.candidate, x.task) for x in T.targeted_wave(tasks, candidates, audit).orderBy("place").collect()]
    assert got == [(0, 1), *((2390 + k, 1) for k in range(7))]
    short = T.short_tasks(tasks, audit.selectExpr("run", "task", "split(url, '/')[2] host", "role"))
    assert short.where("task = 1").first().hosts == 390


def test_empty_tables(spark):
    made = [spark.createDataFrame([], s) for s in (TASK, CANDIDATE, AUDIT)]
    assert T.targeted_wave(*made).collect() == []
