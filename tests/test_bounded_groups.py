"""Choices whose groups are cut to what can still be chosen, against plain loops over whole groups."""

import random

import pytest

from claimloom.operators import urls as O
from claimloom.plans import coverage as P


def plain_pages(rows, total):
    rows = sorted(set(rows), key=lambda r: (-r[3], len(r[0]), r[0]))
    hosts = list(dict.fromkeys(r[1] for r in rows))
    deep, most = (total, total) if len(hosts) <= 1 else (2, 3)
    budget = max(1, min(6, total - (3 if total >= 7 else 2 if total >= 3 else 0)))
    taken, used = [], {}

    def take(r, cap):
        if len(taken) < total and r not in taken and used.get(r[1], 0) < cap:
            taken.append(r)
            used[r[1]] = used.get(r[1], 0) + 1

    good = [r for r in rows if r[2] in O.EVIDENCE_KINDS]
    for kind in O.EVIDENCE_KINDS:
        if len(taken) < budget and all(r[2] != kind for r in taken):
            for r in [r for r in good if r[2] == kind][:1]:
                take(r, total)
    for host in hosts:
        if len(taken) < budget and host not in used:
            for r in [r for r in good if r[1] == host][:1]:
                take(r, deep)
    for r in good:
        if len(taken) < budget:
            take(r, deep)
    for r in sorted((r for r in rows if r[4] and r[2] == "homepage"), key=lambda r: r[0]):
        take(r, total)
    for kind in ("robots", "sitemap"):
        for r in [r for r in rows if r[2] == kind][:1]:
            take(r, total)
    for r in rows:
        take(r, most)
    return [r[0] for r in taken]


def test_pages(spark):
    r = random.Random(3)
    kinds = ["product", "collection", "blog", "rss", "homepage", "robots", "sitemap", "other"]
    data, total = [], 4
    for run in range(30):
        hosts = 1 if run < 3 else r.choice([2, 5, 40])
        share = r.choice([0.05, 0.3, 1.0])
        for k in range(r.choice([3, 60, 250])):
            host = f"h{r.randrange(hosts)}"
            kind = r.choice(kinds[:4]) if r.random() < share * (host != "h0") else r.choice(kinds[4:])
            data.append((run, f"u{k}/{'x' * r.randrange(3)}", host, kind, r.randrange(6), r.random() < 0.3))
    df = spark.createDataFrame(data, "run long, url string, host string, kind string, score long, preferred boolean")
    got = {}
    for x in O.select_evidence_first(df, run="run", total=total).orderBy("run", "place").collect():
        got.setdefault(int(x.run), []).append(x.url)
    kept = O._choosable(df.selectExpr("cast(run as string) run", "url", "host", "kind", "score", "preferred"), total).groupBy("run").count().agg({"count": "max"}).first()[0]
    assert kept < 80  # of up to 250
    for run in range(30):
        assert got[run] == plain_pages([x[1:] for x in data if x[0] == run], total), run


def plain_budget(rows, eligible, requests, per_role, per_host, share):
    limit, out = share / (1 - share), {}
    roles, hosts, chosen, spent, brands, others = {}, {}, 0, 0, 0, None
    for c, url, host, role, rank, need, brand in sorted(rows, key=lambda x: (x[6], x[4], x[1], x[0])):
        others = chosen if brand and others is None else others
        if brand and brands >= min(eligible - others, int(others * limit)):
            out[c] = "brand_share"
            continue
        tests = [(chosen >= eligible, "eligible_budget"), (roles.get(role, 0) >= per_role, "role_quota"), (hosts.get(host, 0) >= per_host, "host_quota"), (spent + need > requests, "request_budget")]
        out[c] = ",".join(name for bad, name in tests if bad)
        if not out[c]:
            chosen, spent, brands = chosen + 1, spent + need, brands + brand
            roles[role], hosts[host] = roles.get(role, 0) + 1, hosts.get(host, 0) + 1
    return out


@pytest.mark.parametrize("caps", [(10, 24, 3, 2, 0.3), (6, 9, 2, 1, 0.5), (40, 500, 30, 30, 0.2)])
def test_budget(spark, caps):
    r = random.Random(sum(map(int, caps)))
    data = [(p, k + 1000 * p, f"u{r.randrange(90)}", f"h{r.randrange(r.choice([2, 30]))}", f"r{r.randrange(4)}", r.randrange(4), r.randint(1, 4), r.random() < 0.4) for p in range(6) for k in range(r.choice([1, 20, 200]))]
    df = spark.createDataFrame(data, "plan long, candidate long, url string, host string, role string, rank int, requests int, brand boolean")
    got = {x.candidate: x.reasons for x in P.allocate_budget(df, plan="plan", max_eligible=caps[0], max_requests=caps[1], per_role=caps[2], per_host=caps[3], brand_share=caps[4]).collect()}
    assert len(got) == len(data)
    for p in range(6):
        want = plain_budget([x[1:] for x in data if x[0] == p], *caps)
        assert {k: got[k] for k in want} == want


def plain_targets(tasks, candidates, cap):
    unused, out = sorted(candidates), []
    for _, task, sources, needed in sorted(tasks):
        hosts, roles = set(), set()
        while len(hosts) < sources or len(roles) < needed:
            free = [c for c in unused if c[2] not in hosts]
            pick = next((c for c in free if c[3] not in roles), free[0] if free else None)
            if pick is None:
                break
            unused.remove(pick)
            hosts.add(pick[2])
            roles.add(pick[3])
            out.append((len(out) + 1, pick[1], task))
    return out[:cap]


def test_targets_and_balance(spark):
    r = random.Random(12)
    rows, loads, want, want_load = [], [], {}, {}
    for run in range(25):
        hosts, kinds = r.choice([2, 30]), r.choice([1, 3, 12])
        candidates = [(r.randrange(50), 1000 * run + k, f"h{r.randrange(hosts)}", f"r{r.randrange(kinds)}") for k in range(r.choice([2, 30, 150]))]
        tasks = [(k, k, r.randrange(4), r.randrange(3)) for k in range(r.choice([1, 6, 12]))]
        rows += [(str(run), "candidate", *c, 0, 0) for c in candidates] + [(str(run), "task", o, i, "", "", s, n) for o, i, s, n in tasks]
        want[str(run)] = plain_targets(tasks, candidates, 3)
        load = {k: r.randrange(3) for k in range(r.choice([2, 9, 40]))}
        now, out = dict(load), []
        for o, c in sorted((o, c) for o, c, _, _ in candidates):
            fit = r.sample(sorted(load), r.randint(1, len(load)))
            loads += [(str(run), o, c, k, "p" + str(k % 2), load[k]) for k in fit]
            pick = min(fit, key=lambda k: (now[k], "p" + str(k % 2), k))
            now[pick] += 1
            out.append((c, pick))
        want_load[str(run)] = sorted(out[:5])
    got = {}
    for x in P.fill_targets(spark.createDataFrame(rows, "run string, what string, ord long, id long, host string, role string, min_sources int, min_roles int"), cap=3).orderBy("run", "place").collect():
        got.setdefault(x.run, []).append((x.place, x.candidate, x.task))
    assert got == {k: v for k, v in want.items() if v}
    dealt = {}
    for x in P.balance_tasks(spark.createDataFrame(loads, "run string, ord long, candidate long, task long, priority string, load long"), cap=5).collect():
        dealt.setdefault(x.run, []).append((x.candidate, x.task))
    assert {k: sorted(v) for k, v in dealt.items()} == want_load
