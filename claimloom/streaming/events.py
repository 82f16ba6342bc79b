"""Event streams: the same functions work on batches and on streams unless they say otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimloom.sources.scratch import cut, hinted

#: Phases and their steps, in order.
PHASES = {"discover": ["plan", "probe", "select"], "crawl": ["fetch", "clean", "grade"], "extract": ["batch", "bind", "merge"], "report": ["diff", "write"]}
HOUR = 3600


def run_state(events: DataFrame, *, run: str = "run_id", order: str = "seq") -> DataFrame:
    """(run, events, steps_done, last_step, progress, found, finished, failed): a run's state folded from its events.

    An aggregation only, so it runs on a stream in update mode as well.
    """
    at = F.col(order)
    kind = F.col("type")
    return events.groupBy(run).agg(
        F.count("*").alias("events"), F.count_if(kind == "step.done").alias("steps_done"), F.max_by("step_id", F.when(kind.startswith("step."), at)).alias("last_step"),
        F.max_by("value", F.when(kind == "crawl.progress", at)).alias("progress"), F.count_if(kind == "source.found").alias("found"),
        F.max(F.when(kind == "step.done", at)).alias("finished"), F.bool_or(kind == "run.error").alias("failed"),
    )


def last_log_lines(events: DataFrame, *, run: str = "run_id", order: str = "seq", most: int = 9) -> DataFrame:
    """(run, place, message): the newest messages of each run. Batch only."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(order)))).where(F.col("place") <= most).select(run, "place", "message")


def expand_phases(events: DataFrame, phases: dict[str, list[str]] = PHASES) -> DataFrame:
    """Phase events as step events: a phase's start starts its first step, its end ends all of them. Stateless."""
    steps = F.coalesce(*(F.when(F.col("phase") == p, F.array(*map(F.lit, s))) for p, s in phases.items()))
    own = F.when(F.col("edge") == "start", F.slice(steps, 1, 1)).otherwise(steps)
    return events.withColumn("step", F.explode(own)).withColumn("state", F.when(F.col("edge") == "start", "started").otherwise("done"))


def budget_tracker(requests: DataFrame, caps: dict[str, float], *, run: str, order: str) -> DataFrame:
    """``requests`` with ``accepted``: in order, the first request whose reserve would exceed a cap and all after it are rejected. Batch form."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = F.lit(False)
    for c, cap in caps.items():
        over = over | (F.sum(c).over(w) > cap)
    marked = requests.withColumn("_over", over)
    first = F.min(F.when(F.col("_over"), F.col(order))).over(Window.partitionBy(run))
    return marked.withColumn("accepted", first.isNull() | (F.col(order) < first)).drop("_over")


def budget_stream(requests: DataFrame, caps: dict[str, float], *, run: str, order: str) -> DataFrame:
    """(run, order, accepted) on a stream: the sums so far and whether the run is closed are its state. Requests of a run must come in order between micro-batches."""
    names = list(caps)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *sums, closed = state.get if state.exists else (*[0.0] * len(names), False)
        part = pd.concat(list(parts)).sort_values(order)
        accepted = []
        for row in part[names].itertuples(index=False, name=None):
            more = [a + b for a, b in zip(sums, row)]
            closed = closed or any(m > caps[n] for m, n in zip(more, names))
            sums = sums if closed else more
            accepted.append(not closed)
        state.update((*sums, closed))
        yield pd.DataFrame({run: key[0], order: part[order], "accepted": accepted})

    fields = dict(requests.dtypes)
    return requests.groupBy(run).applyInPandasWithState(step, f"{run} {fields[run]}, {order} {fields[order]}, accepted boolean", ", ".join(f"{n} double" for n in names) + ", closed boolean", "append", GroupStateTimeout.NoTimeout)


def request_usage(requests: DataFrame, *, run: str, kinds: list[str]) -> DataFrame:
    """(run, a count for each kind, reserved, reported): works on streams in update mode."""
    return requests.groupBy(run).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.sum("reserved").alias("reserved"), F.sum(F.coalesce("reported", F.lit(0))).alias("reported"))


def _windows(times: list[float], start: float | None, n: int, limit: int) -> tuple[list[bool], float | None, int]:
    """Whether each request is within the limit; a window of an hour begins with the first request after the last one's end."""
    out = []
    for at in times:
        if start is None or at - start >= HOUR:
            start, n = at, 0
        n += 1
        out.append(n <= limit)
    return out, start, n


def window_starts(times: DataFrame) -> DataFrame:
    """(c, at): where the windows of an hour of each client begin, from the different ``times`` (c, at in microseconds, cell its hour).

    A window begins with the first time, and then with the first one an hour or more after the last beginning. Every time knows its successor, the
    first one an hour or more later; windows begin at what the first time leads to. Successors are found within hours, so a client
    is as many groups as it has hours; then they are followed by doubling: each round joins the table of leaps with itself and
    marks as many beginnings again as there are, so 2^n windows take n rounds of joins of written tables.
    """
    cells = times.groupBy("c", "cell").agg(F.min("at").alias("first"))
    ahead = Window.partitionBy("c").orderBy("cell")
    following = F.when(F.lead("cell").over(ahead) == F.col("cell") + 1, F.lead("first", 2).over(ahead)).otherwise(F.lead("first").over(ahead))
    cells = cut(cells.withColumn("later", following), "hours")
    points = times.select("c", (F.col("cell") + 1).alias("cell"), (F.col("at") + HOUR * 1_000_000).alias("at"), F.col("at").alias("own"))
    both = times.select("c", "cell", "at", F.lit(None).cast("long").alias("own")).unionAll(points)
    down = Window.partitionBy("c", "cell").orderBy(F.desc("at"), F.asc_nulls_first("own")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.min(F.when(F.col("own").isNull(), F.col("at"))).over(down)).where("own is not null")
    near = near.select("c", (F.col("cell") - 1).alias("cell"), F.col("own").alias("at"), "near")
    leaps = near.join(cells.select("c", "cell", "later").hint("merge"), ["c", "cell"]).select("c", "at", F.coalesce("near", "later").alias("to"))
    leaps = cut(leaps.where("to is not null"), "leaps")
    starts = cut(cells.groupBy("c").agg(F.min("first").alias("at")), "starts")
    while True:
        more = cut(starts.join(leaps.hint("merge"), ["c", "at"]).select("c", F.col("to").alias("at")), "starts")
        if more.isEmpty():
            return starts
        starts = starts.unionAll(more)
        second = leaps.select("c", F.col("at").alias("to"), F.col("to").alias("end"))
        leaps = cut(leaps.join(second.hint("merge"), ["c", "to"]).select("c", "at", F.col("end").alias("to")), "leaps")


def rate_limit(requests: DataFrame, *, client: str, at: str, key: str, limit: int) -> DataFrame:
    """(client, key, allowed): whether a request is among the first ``limit`` of its window, in order of time and key. A window of an hour
    begins with a client's first request after the last one's end (``window_starts``). Batch form.

    A client's requests are spread over tasks by hour, also those of a single window: only its first ``limit`` are ranked, and
    the last of them decides on the others. Keys are unique; a request without a time is not allowed.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    hour = HOUR * 1_000_000
    rows = cut(requests.select(F.struct(F.col(client).alias("v")).alias("c"), F.col(key).alias("key"), us.alias("at"), F.floor(us / hour).alias("cell")), "requests")
    starts = window_starts(rows.where("at is not null").select("c", "at", "cell").distinct())
    # two beginnings are an hour apart: an hour of the clock has one at most, and a request's is in its own or the one before
    own = starts.select("c", F.floor(F.col("at") / hour).alias("cell"), F.col("at").alias("s0"))
    last = own.select("c", (F.col("cell") + 1).alias("cell"), F.col("s0").alias("s1"))
    placed = rows.join(hinted(own), ["c", "cell"], "left").join(hinted(last), ["c", "cell"], "left")
    placed = cut(placed.select("c", "key", "at", F.when(F.col("s0") <= F.col("at"), F.col("s0")).otherwise(F.col("s1")).alias("start")), "windows")
    rank = F.row_number().over(Window.partitionBy("c", "start").orderBy("at", "key"))
    firsts = placed.where("start is not null").withColumn("n", rank).where(F.col("n") <= limit)
    ends = cut(firsts.groupBy("c", "start").agg(F.max(F.struct("at", "key")).alias("end")), "ends")
    allowed = F.coalesce(F.struct("at", "key") <= F.col("end"), F.lit(False))
    return placed.join(hinted(ends), ["c", "start"], "left").select(F.col("c.v").alias(client), F.col("key").alias(key), allowed.alias("allowed"))


def rate_limit_stream(requests: DataFrame, *, client: str, at: str, key: str, limit: int) -> DataFrame:
    """The same on a stream: a client's state is its window's start and count, and is dropped an hour after its last request."""

    def step(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        part = pd.concat(list(parts)).sort_values(["_at", key])
        allowed, start, n = _windows(part["_at"].tolist(), start, n, limit)
        state.update((start, n))
        state.setTimeoutDuration(HOUR * 1000)
        yield pd.DataFrame({client: who[0], key: part[key], "allowed": allowed})

    kinds = dict(requests.dtypes)
    source = requests.select(client, key, F.col(at).cast("timestamp").cast("double").alias("_at"))
    return source.groupBy(client).applyInPandasWithState(step, f"{client} {kinds[client]}, {key} {kinds[key]}, allowed boolean", "start double, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def token_uses(issued: DataFrame, used: DataFrame, *, ttl: str = "30 minutes") -> DataFrame:
    """(token, used_at, use_id, issued_at) for every use of a token within its time: an interval join, on streams with watermarks on both sides."""
    i = issued.select(F.col("token").alias("_t"), "issued_at")
    return used.join(i, (F.col("token") == F.col("_t")) & (F.col("used_at") >= F.col("issued_at")) & (F.col("used_at") < F.col("issued_at") + F.expr(f"interval {ttl}"))).drop("_t")


def expire_tokens(issued: DataFrame, used: DataFrame, *, ttl: str = "30 minutes") -> DataFrame:
    """(use_id, valid): the first use within the time is valid; later uses and those outside it are not. Batch form; ``first_use_stream`` is the other."""
    first = token_uses(issued, used, ttl=ttl).groupBy("token").agg(F.min_by("use_id", F.struct("used_at", "use_id")).alias("first"))
    return used.join(first, "token", "left").select("use_id", F.coalesce(F.col("use_id") == F.col("first"), F.lit(False)).alias("valid"))


def first_use_stream(issued: DataFrame, used: DataFrame, *, ttl_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(use_id, valid) of ``expire_tokens`` on streams: only a token's first use within its time is valid, in whatever order uses arrive.

    A use is decided when the watermark has passed it, since an earlier one may come until then. A token's state is when it was
    issued, whether it is used up, and the uses that wait; it goes when its time is over and none waits. Rows later than ``late``
    are dropped. A token is issued once; append mode.
    """
    kinds = dict(used.dtypes)
    number = kinds["use_id"] != "string"  # ids are whole numbers or strings; in the state they are strings
    own_id = int if number else str
    none = F.lit(None).cast("string")
    rows = issued.select("token", F.col("issued_at").alias("at"), F.lit(True).alias("issue"), none.alias("use_id"))
    rows = rows.unionByName(used.select("token", F.col("used_at").alias("at"), F.lit(False).alias("issue"), F.col("use_id").cast("string").alias("use_id")))
    rows = rows.withColumn("s", F.unix_micros("at")).withWatermark("at", late)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, done, times, ids = (list(x) if isinstance(x, (list, np.ndarray)) else x for x in (state.get if state.exists else ([], False, [], [])))
        for part in () if state.hasTimedOut else parts:
            starts += [int(x) for x in part.loc[part["issue"], "s"]]
            own = part[~part["issue"]]
            times += [int(x) for x in own["s"]]
            ids += list(own["use_id"])
        mark, ttl = state.getCurrentWatermarkMs() * 1000, ttl_seconds * 1_000_000
        waiting, out = sorted(zip(times, ids), key=lambda x: (x[0], own_id(x[1]))), []
        while waiting and waiting[0][0] < mark:
            at, use = waiting.pop(0)
            valid = not done and any(s <= at < s + ttl for s in starts)
            done = done or valid
            out.append((own_id(use), valid))
        live = [s + ttl for s in starts if s + ttl > mark]
        if waiting or live:
            state.update((starts, done, [w[0] for w in waiting], [w[1] for w in waiting]))
            state.setTimeoutTimestamp(max(min([w[0] for w in waiting] + live) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["use_id", "valid"])

    return rows.groupBy("token").applyInPandasWithState(step, f"use_id {kinds['use_id']}, valid boolean", "starts array<long>, done boolean, times array<long>, ids array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_snapshots(captures: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Captures without repeats of a URL and content, within the watermark; ``captured_at`` is their time. On batches all repeats go."""
    if captures.isStreaming:
        return captures.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["url", "content_hash"])
    return captures.withColumn("_k", F.row_number().over(Window.partitionBy("url", "content_hash").orderBy("captured_at"))).where("_k = 1").drop("_k")


def weekly_rollup(events: DataFrame, *, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(week_start, type, n, value) by weeks from Monday 09:00; on a stream rows later than ``late`` are dropped."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    week: Column = F.window(at, "7 days", "7 days", "4 days 9 hours")
    return source.groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("week.start").alias("week_start"), "event_type", "n", "value")


def latest_status(events: DataFrame, *, run: str, status: str, at: str) -> DataFrame:
    """(run, status, at): the newest event of each run; works on streams in update mode."""
    return events.groupBy(run).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))
