"""URL filters: rules by host and path, and trust and distrust spread over the link graph (operator 3). DataFrame functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import cut, lookup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or # (or the end), A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(df: DataFrame, rules: list[Rule], *, inline: int = 100) -> DataFrame:
    """``df`` (with host and path) and its rule (``host + path`` of it, or null) and rule_verdict.

    A rule fits its host and all subdomains if the path starts with its path; the longest wins, of equally long ones that
    with the longer host. Up to ``inline`` rules become one expression. More are joined by the suffixes of the distinct
    hosts, so that a frequent host is looked up once.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    if len(ordered) <= inline:
        name = verdict = F.lit(None).cast("string")
        for r in reversed(ordered):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
        return df.withColumns({"rule": name, "rule_verdict": verdict})
    table = df.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(ordered)], "rule_verdict string, rule_host string, rule_path string, place int")
    labels = F.split("host", r"\.")
    suffixes = df.select("host", "path").distinct().withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    fitting = suffixes.join(F.broadcast(table) if len(ordered) <= 200_000 else table.hint("merge"), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fitting.groupBy("host", "path").agg(F.min(F.struct("place", F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
    return df.join(best.hint("merge"), ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("best")


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute links in the pages."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    ends = links.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[A-Za-z][A-Za-z0-9+.-]*:", ""))).alias("dst"))
    return ends.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 1000, every: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) after personalised PageRank from ``seeds`` (host, trust, distrust).

    Trust flows along links in proportion to their number, distrust against them: who links to a blocked host is
    distrusted. Both flows are rows of one table of arcs, so a round is one join and one aggregation over hosts. The state
    is written to the shared folder every few rounds. Ends when no value of any host has changed by more than ``tolerance``
    of itself, so that small shares settle like large ones and no host is newly reached; raises where that takes more than
    ``rounds``, and never returns values that are still on the move.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all_out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all_in"))
    forth = edges.join(out.hint("merge"), "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("n") / F.col("all_out")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into.hint("merge"), "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all_in")).alias("d"))
    arcs = cut(forth.unionByName(back), "arcs")
    known = seeds.select("host", "trust", "distrust").unionByName(arcs.select(F.col("from").alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")).distinct())
    start = cut(known.groupBy("host").agg(F.sum("trust").alias("trust0"), F.sum("distrust").alias("distrust0")), "seeds")
    state = start.select("host", ((1 - damping) * F.col("trust0")).alias("trust"), ((1 - damping) * F.col("distrust0")).alias("distrust"))
    if arcs.isEmpty():
        return state
    for _ in range(0, rounds, every):
        before = state
        for _ in range(every):
            flow = arcs.join(state.withColumnRenamed("host", "from").hint("merge"), "from").groupBy(F.col("to").alias("host"))
            got = flow.agg(F.sum(F.col("t") * F.col("trust")).alias("in_t"), F.sum(F.col("d") * F.col("distrust")).alias("in_d"))
            joined = start.join(got.hint("merge"), "host", "left")
            state = joined.select("host", *(((1 - damping) * F.col(f"{x}0") + damping * F.coalesce(y, F.lit(0.0))).alias(x) for x, y in (("trust", "in_t"), ("distrust", "in_d"))))
        state = cut(state, "trust")
        old = before.select("host", F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"))
        moved = [F.abs(F.col(x) - F.col(y)) > tolerance * F.col(x) for x, y in (("trust", "old_t"), ("distrust", "old_d"))]
        if state.join(old.hint("merge"), "host").where(moved[0] | moved[1]).isEmpty():
            return state
    raise RuntimeError(f"trust did not settle within {rounds} rounds")


def judged(pages: DataFrame, rules: list[Rule], *, share: float = 0.5, damping: float = 0.85, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every row: the longest fitting rule's verdict, else the host's.

    A host is a trusted seed to the share of its pages that rules allow and a blocked one to the share that they block.
    It is blocked where its distrust exceeds ``share`` of its trust and distrust together. Null urls and those without ://
    have an empty host and path and are allowed; repeated rows give repeated rows.
    """
    source = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = with_rules(source, rules)
    shares = [F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0)).alias(n) for v, n in (("allow", "trust"), ("block", "distrust"))]
    seeds = ruled.where("host <> ''").groupBy("host").agg(*shares)
    hosts = spread(seeds, host_edges(pages, url_col=url_col, html_col=html_col), damping=damping)
    blocked = cut(hosts.where(F.col("distrust") > share * (F.col("trust") + F.col("distrust"))).select("host", F.lit(True).alias("bad")), "blocked")
    out = lookup(ruled, blocked, "host")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
