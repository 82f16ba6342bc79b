"""Rules on literal rows: order-dependent choices against plain models, streams against batches, and what the tables lack."""

import random
import uuid

from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import cleaning as C
from claimloom.operators import entities as M
from claimloom.operators import evidence as E
from claimloom.operators import grading as G
from claimloom.operators import runs as R
from claimloom.operators import urls as O
from claimloom.plans import coverage as P
from claimloom.plans import graph
from claimloom.sources import tables as S
from claimloom.streaming import events as W


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c")).alias("x")).first().x


def cutter(tmp_path):
    def cut(df):
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return cut


def test_entities_and_lines(spark):
    assert one(spark, "&#26412;&#x672c;&amp;&#38;&#1114112;&#xD800;<![CDATA[x]]>", T.decode_entities) == "本本&&&#1114112;&#xD800;x"
    assert one(spark, " a 　b \r\n\n\t\nc", T.normalize_lines) == "a b\nc"


def test_html_and_markdown(spark):
    html = '<nav>x</nav><p>One<br>two <img alt=" pic " src=a><img src=b></p><div class="cookie-bar">no</div><script>1</script><footer>f</footer><b>end</b>'
    assert one(spark, html, lambda c: T.normalize_lines(C.html_to_text(c))) == "One\ntwo pic\nend"
    assert one(spark, "# Title\n- [a link](http://x) and **bold**\n![img](y)", lambda c: T.normalize_lines(C.markdown_to_text(c))) == "Title\na link and bold\nimg"


def test_noise_lines(spark):
    text = "Skip to content\nReal text stays.\nRead our Privacy Policy\nFacebook Instagram YouTube\n© 2024 X"
    r = C.drop_noise_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.text == "Real text stays." and [x.reason for x in r.removed] == ["navigation", "privacy_legal", "footer", "footer"]


def plain_longest(tokens, starts, ends, n, least):
    best, first = None, {}
    for i in range(len(tokens) - n + 1):
        key = tuple(tokens[i : i + n])
        if key not in first:
            first[key] = i
            continue
        at = first[key]
        if at + n > i:
            continue
        k = n
        while i + k < len(tokens) and tokens[at + k] == tokens[i + k]:
            k += 1
        span = (starts[i], ends[i + k - 1])
        if span[1] - span[0] >= least and (best is None or span[1] - span[0] > best[1] - best[0]):
            best = span
    return best


def test_repeated_runs(spark):
    r = random.Random(1)
    for _ in range(300):
        tokens = [r.choice("abc") for _ in range(r.randint(0, 40))]
        starts = list(range(0, 2 * len(tokens), 2))
        ends = [s + 1 for s in starts]
        assert C.longest_repeat(tokens, starts, ends, 3, 4) == plain_longest(tokens, starts, ends, 3, 4)
    run = " ".join(f"word{k}" for k in range(12))
    got = C.without_repeated_runs(spark.createDataFrame([(1, f"{run} middle {run} end"), (2, None), (3, "in " * 20000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].text == f"{run} middle   end" and got[0].removed_runs == 1 and got[1].text == "" and got[2].removed_runs > 0


def test_urls(spark):
    rows = [("HTTP://WWW.Shop.com:80//a//b/?utm_source=x&b=2&a=1#f", "http://shop.com/a/b?a=1&b=2", True), ("ftp://x/y", None, False), ("http://u:p@x.com/", "http://x.com/", False), ("http://10.1.2.3/", "http://10.1.2.3/", False), ("https://[fe80::1]/", "https://[fe80::1]/", False), (None, None, False), ("x", None, False)]
    got = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, u string").select("k", U.canonical(F.col("u")).alias("c"), U.is_public(F.col("u")).alias("p")).orderBy("k").collect()
    assert [(r.c, r.p) for r in got] == [(r[1], r[2]) for r in rows]
    base = "https://a.com/x/y?q"
    for link, want in [("z", "https://a.com/x/z"), ("/z", "https://a.com/z"), ("//b.com/", "https://b.com/"), ("?k=1", "https://a.com/x/y?k=1"), ("#t", None), ("mailto:a@b", None), ("http://c", "http://c")]:
        assert one(spark, link, lambda c: U.absolute(c, F.lit(base))) == want
    kinds = {"https://a/products/x": "product", "https://a/product-list/": "product", "https://a/catalog/x": "collection", "https://a/feed/": "rss", "https://a/robots.txt": "robots", "https://a/sitemap_1.xml": "sitemap", "https://a/news": "blog", "https://a/newsletter": "homepage"}
    for u, k in kinds.items():
        assert one(spark, u, U.kind) == k


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nDisallow: /*.gif\nDisallow:\nDisallow: /a*b\nSitemap: https://h/s.xml"
    rules = O.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), key="host")
    assert {r.prefix for r in rules.collect()} == {"/private", "/a"}
    urls = spark.createDataFrame([("h", "https://h/private/1"), ("h", "https://h/b"), ("h", "https://h/abc"), ("i", "https://i/private")], "host string, url string")
    assert {r.url for r in O.robots_filter(urls, rules, key="host").collect()} == {"https://h/b", "https://i/private"}


def test_evidence_first_covers_hosts_and_kinds(spark):
    rows = [("r", f"https://h{h}/{k}{n}", f"h{h}", k, 100 - n - h, False) for h in range(4) for k in ("product", "blog") for n in range(4)] + [("r", "https://h0/", "h0", "homepage", 1, True), ("r", "https://h1/robots.txt", "h1", "robots", 0, False)]
    df = spark.createDataFrame(rows, "run string, url string, host string, kind string, score int, preferred boolean")
    a = [(r.place, r.url) for r in O.select_evidence_first(df, run="run", total=9).orderBy("place").collect()]
    b = [(r.place, r.url) for r in O.select_evidence_first(df.orderBy(F.rand(3)), run="run", total=9).orderBy("place").collect()]
    urls = [u for _, u in a]
    assert a == b and len(a) == 9 and urls[0] == "https://h0/product0" and urls[1] == "https://h0/blog0"
    assert {u.split("/")[2] for u in urls} == {"h0", "h1", "h2", "h3"} and "https://h0/" in urls and "https://h1/robots.txt" in urls


def test_topic_terms_in_han_script(spark):
    terms = spark.createDataFrame([("宠物益生菌", "pet care")], "a string, b string").select(G.topic_terms("a", "b").alias("t")).first().t
    assert {"宠物益生菌", "宠物益", "物益生", "益生菌", "宠物益生", "物益生菌", "pet care", "pet", "care"} == set(terms)


def test_match_quotes_inside_words(spark):
    docs = spark.createDataFrame([(1, "xxalpha beta gamma delta epsilon zeta eta thetayy"), (2, "alpha  BETA gamma\ndelta epsilon zeta eta theta"), (3, "short one")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "ort o"), (3, "abc"), (4, "beta gamma delta nothing zeta eta theta more")], "q long, text string")
    got = {(r.q, r.doc_id) for r in E.match_quotes(quotes, docs, quote_id="q", doc_id="doc_id").collect()}
    assert got == {(1, 1), (1, 2), (2, 3)}


def test_claims(spark):
    assert one(spark, "Top 10 brand with 35% market share", E.high_risk) and not one(spark, "A quiet market", E.high_risk)
    claim = spark.createDataFrame([(1, "Sales of 120 users, top 5")], "c long, text string")
    quotes = spark.createDataFrame([(1, "we have 120 users"), (1, "120 users made it top 5 in sales")], "c long, quote string")
    assert E.high_risk_supported(claim, quotes, claim_id="c").first().supported
    assert not E.high_risk_supported(claim, quotes.limit(1), claim_id="c").first().supported
    assert spark.createDataFrame([("益生菌市场",)], "t string").select(E.claim_terms(F.col("t")).alias("x")).first().x == ["益生", "生菌", "菌市", "市场"]


def test_role_gate(spark):
    policy = spark.createDataFrame([("official", "product"), ("retail", "price")], "source_role string, claim_role string")
    rows = [(1, None, None, None), (2, None, None, "product"), (3, "official", "retail", "product"), (4, "official", None, None), (5, "lab", None, "product"), (6, "official", "official", "price"), (7, "official", None, "product")]
    got = {r.k: r.role_failure for r in E.role_gate(spark.createDataFrame(rows, "k int, a string, b string, claim string"), policy, roles=["a", "b"], claim_role="claim").collect()}
    assert got == {1: None, 2: "source_role_missing", 3: "source_role_conflict", 4: "claim_role_missing", 5: "source_role_policy_missing", 6: "source_role_not_authorized:official:price", 7: None}


def test_batches(spark):
    r = random.Random(2)
    rows = [("a", k, k, r.choice([100, 3000, 9000])) for k in range(40)]
    got = {x.doc: x.batch for x in M.plan_batches(spark.createDataFrame(rows, "run string, ord long, doc long, chars long"), run="run", max_docs=4, max_chars=9000).collect()}
    batch, n, size, want = 0, 0, 0, {}
    for _, _, d, c in rows[:36]:
        c = min(c, 4000)
        if n and (n >= 4 or size + c > 9000):
            batch, n, size = batch + 1, 0, 0
        n, size = n + 1, size + c
        want[d] = batch
    assert got == want


def test_budget_allocation(spark):
    r = random.Random(5)
    rows = [("p", k, f"u{k:02}", f"h{r.randrange(6)}", f"r{r.randrange(4)}", r.randrange(3), r.randrange(1, 4), r.random() < 0.4) for k in range(40)]
    df = spark.createDataFrame(rows, "plan string, candidate long, url string, host string, role string, rank int, requests int, brand boolean")
    caps = dict(max_eligible=12, max_requests=25, per_role=4, per_host=3, brand_share=0.25)
    got = {x.candidate: x.reasons for x in P.allocate_budget(df, plan="plan", **caps).collect()}
    chosen = [x for x in rows if got[x[1]] == ""]
    assert len(chosen) <= 12 and sum(x[6] for x in chosen) <= 25 and all(sum(y[4] == x[4] for y in chosen) <= 4 and sum(y[3] == x[3] for y in chosen) <= 3 for x in chosen)
    assert sum(x[7] for x in chosen) <= 0.25 * len(chosen) + 1e-9
    again = {x.candidate: x.reasons for x in P.allocate_budget(df.orderBy(F.rand(9)), plan="plan", **caps).collect()}
    assert got == again


def test_greedy_cover_forms_agree(spark, tmp_path):
    r = random.Random(7)
    rows = [("p", s, f"{r.choice(['taxonomy', 'channel', 'need'])}:{r.randrange(9)}") for s in range(30) for _ in range(r.randrange(1, 6))]
    keys = spark.createDataFrame(rows, "plan string, sample long, key string")
    small = [(x.place, x.sample, x.gain) for x in P.greedy_cover(keys, plan="plan", sample="sample").orderBy("place").collect()]
    large = [(x.place, x.sample, x.gain) for x in P.greedy_cover_large(keys, sample="sample", rounds=30, cut=cutter(tmp_path)).orderBy("place").collect()]
    weight = {"taxonomy": 5, "channel": 3, "need": 1}
    left, want = {s: {k for _, t, k in rows if t == s} for s in range(30)}, []
    while True:
        gain, s = min((-sum(weight[k.split(":")[0]] for k in own), s) for s, own in left.items())
        if gain == 0:
            break
        want.append((len(want) + 1, s, -gain))
        covered = left.pop(s)
        left = {t: own - covered for t, own in left.items()}
    assert small == want == large


def test_fill_and_balance(spark):
    rows = [("r", "task", 0, 1, "", "", 2, 2), ("r", "task", 1, 2, "", "", 1, 1)] + [("r", "candidate", k, 10 + k, h, role, 0, 0) for k, (h, role) in enumerate([("h1", "a"), ("h2", "a"), ("h3", "b"), ("h1", "c")])]
    got = P.fill_targets(spark.createDataFrame(rows, "run string, what string, ord long, id long, host string, role string, min_sources int, min_roles int")).orderBy("place").collect()
    assert [(x.candidate, x.task) for x in got] == [(10, 1), (12, 1), (11, 2)]
    rows = [("r", k, k, t, p, load) for k in range(4) for t, p, load in ((1, "high", 1), (2, "critical", 0), (3, "critical", 0))]
    got = P.balance_tasks(spark.createDataFrame(rows, "run string, ord long, candidate long, task long, priority string, load long")).orderBy("candidate").collect()
    assert [x.task for x in got] == [2, 3, 2, 3]


def test_run_diff_and_malformed_keys(spark):
    payload = spark.createDataFrame([(1, '{"a": ["x ", "X", null, ""], "b": 5}'), (2, "not json")], "run int, payload string")
    assert {(r.run, r.dimension, r.key) for r in R.stable_keys(payload, ["a", "b"], run="run").collect()} == {(1, "a", "x"), (1, "a", "X")}
    p, c = (spark.createDataFrame([("d", k) for k in ks], "dimension string, key string") for ks in (["A b", "c"], ["ab", "D"]))
    assert {(r.key, r.change) for r in R.set_diff(p, c, on=["dimension"]).collect()} == {("D", "added"), ("c", "removed")}


def test_lineage_to_any_depth(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "a int, b int")
    got = graph.trace_all(edges, spark.createDataFrame([(1,)], "node int"), depth=10, cut=cutter(tmp_path)).collect()
    assert {(r.node, r.hops) for r in got} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_sinks(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('name,url,category,note\n"A, B",http://x,c,"say ""hi"""\n')
    assert S.read_seed_csv(spark, str(tmp_path / "seed.csv")).first().name == "A, B"
    events = S.split_events(spark.createDataFrame([("r", "failed", "x"), (None, "failed", "x"), ("r", "odd", "x"), ("r", "failed", "x" * 70000)], "run string, status string, payload string"), run="run", status="status", payload="payload")
    S.append_events(events, str(tmp_path / "t"))
    S.append_events(events, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    news = spark.createDataFrame([(1, 1, "c"), (3, 0, "d")], "k int, v int, x string")
    merged = S.upsert_by_key(rows, news, keys=["k"], version="v")
    assert {(r.k, r.x) for r in merged.collect()} == {(1, "c"), (2, "b"), (3, "d")} == {(r.k, r.x) for r in S.upsert_by_key(merged, news, keys=["k"], version="v").collect()}


def stream(spark, df, tmp_path, n):
    """``df`` as a stream of ``n`` files in order of its first column."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = df.toPandas().sort_values(df.columns[0])
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows.iloc[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(spark, df, tmp_path, mode):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_budget_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("user_id") % 7).alias("run"), F.from_json("props", "k bigint")["k"].cast("double").alias("credits"), F.col("value").alias("cost"))
    caps = {"credits": 3000.0, "cost": 1500.0}
    want = {(r.event_id, r.accepted) for r in W.budget_tracker(e, caps, run="run", order="event_id").collect()}
    got = {(r.event_id, r.accepted) for r in drained(spark, W.budget_stream(stream(spark, e, tmp_path, 3), caps, run="run", order="event_id"), tmp_path, "append")}
    assert got == want and {a for _, a in want} == {True, False}


def test_rate_limit_stream_equals_batch_and_plain(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("user_id") % 3).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    start, n, want = {}, {}, set()
    for r in e.orderBy("ts", "event_id").collect():
        at = r.ts.timestamp()
        if r.client not in start or at - start[r.client] >= 3600:
            start[r.client], n[r.client] = at, 0
        n[r.client] += 1
        want.add((r.event_id, n[r.client] <= 2))
    assert {(r.event_id, r.allowed) for r in W.rate_limit(e, client="client", at="ts", key="event_id", limit=2).collect()} == want
    got = drained(spark, W.rate_limit_stream(stream(spark, e, tmp_path, 3), client="client", at="ts", key="event_id", limit=2), tmp_path, "append")
    assert {(r.event_id, r.allowed) for r in got} == want


def test_state_and_rollup_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id")
    src = stream(spark, e, tmp_path, 2)
    rows = drained(spark, W.latest_status(src, run="user_id", status="event_type", at="ts"), tmp_path, "complete")
    assert {(r.user_id, r.event_type) for r in rows} == {(r.user_id, r.event_type) for r in W.latest_status(e, run="user_id", status="event_type", at="ts").collect()}
    rows = drained(spark, W.weekly_rollup(src).withColumn("value", F.round("value", 3)), tmp_path, "complete")
    assert {tuple(r) for r in rows} == {tuple(r) for r in W.weekly_rollup(e).withColumn("value", F.round("value", 3)).collect()}
    assert all(r.week_start.weekday() == 0 and r.week_start.hour == 9 for r in rows)
    caps = src.select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("content_hash"), F.col("ts").alias("captured_at"))
    assert len(drained(spark, W.stream_snapshots(caps, late="3650 days"), tmp_path, "append")) == e.select("user_id", "event_type").distinct().count()


def test_tokens(spark):
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    issued = spark.createDataFrame([("t",), ("u",)], "token string").withColumn("issued_at", ts(1000))
    used = spark.createDataFrame([("t", 1, 1100), ("t", 2, 1200), ("u", 3, 9000), ("v", 4, 1100)], "token string, use_id int, s long").withColumn("used_at", F.timestamp_seconds("s")).drop("s")
    assert {(r.use_id, r.valid) for r in W.expire_tokens(issued, used).collect()} == {(1, True), (2, False), (3, False), (4, False)}


def test_phases(spark):
    e = spark.createDataFrame([(1, "crawl", "start"), (2, "crawl", "end")], "k int, phase string, edge string")
    assert [(r.k, r.step, r.state) for r in W.expand_phases(e).collect()] == [(1, "fetch", "started"), (2, "fetch", "done"), (2, "clean", "done"), (2, "grade", "done")]
