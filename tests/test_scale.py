"""Operators whose form is chosen for large inputs: results as the plain forms, and what they move, write or look at."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import cleaning as C
from claimloom.operators import runs as R
from claimloom.plans import coverage as P
from claimloom.sources import tables as S
from claimloom.sources.scratch import cut
from claimloom.streaming import events as W
from tests.test_operators import drained


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).replace(tzinfo=None)


# --- W5


def plain_limit(rows, limit):
    start, n, out = {}, {}, set()
    for c, key, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[2], r[1])):
        if c not in start or t - start[c] >= 3600:
            start[c], n[c] = t, 0
        n[c] += 1
        out.add((key, n[c] <= limit))
    return out | {(key, False) for _, key, t in rows if t is None}


@pytest.mark.parametrize("gap", [20, 900, 3600, 9000])
def test_rate_limit_with_a_client_that_has_most_requests(spark, gap):
    r = random.Random(gap)
    t, rows = 1_000_000, []
    for k in range(600):
        t += r.choice([0, gap, gap // 2, gap * 3])
        rows.append((r.choice(["hot", "hot", "hot", "cold", None, f"c{k % 7}"]), k, t))
    rows.append(("cold", 9999, None))
    df = spark.createDataFrame([(c, k, None if t is None else float(t)) for c, k, t in rows], "client string, key long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = {(x.key, x.allowed) for x in W.rate_limit(df, client="client", at="ts", key="key", limit=2).collect()}
    assert got == plain_limit(rows, 2)


def test_rate_limit_of_nothing(spark):
    df = spark.createDataFrame([], "client string, key long, ts timestamp")
    assert W.rate_limit(df, client="client", at="ts", key="key", limit=2).collect() == []


# --- W6


def test_first_use_stream_equals_batch_when_uses_come_out_of_order(spark, tmp_path):
    r = random.Random(7)
    issued = [(f"t{k}", 10_000 + 100 * k) for k in range(40)]
    used = []
    for k in range(160):
        token = r.choice(issued)
        used.append((token[0] if k % 9 else "unknown", k, token[1] + r.choice([-50, 0, 10, 500, 1799, 1800, 4000])))
    used += [("t3", 500, 10_400), ("t3", 501, 10_400)]
    i = spark.createDataFrame(issued, "token string, s long").select("token", F.timestamp_seconds("s").alias("issued_at"))
    u = spark.createDataFrame(used, "token string, use_id long, s long").select("token", "use_id", F.timestamp_seconds("s").alias("used_at"))
    want = {(x.use_id, x.valid) for x in W.expire_tokens(i, u).collect()}
    assert {v for _, v in want} == {True, False}
    ins, uses = str(tmp_path / "issued"), str(tmp_path / "used")
    order = list(used)
    r.shuffle(order)
    end = [("zz-end", 900_000)]
    for k in range(4):
        spark.createDataFrame(issued[k::4], "token string, s long").select("token", F.timestamp_seconds("s").alias("issued_at")).coalesce(1).write.mode("append").parquet(ins)
        spark.createDataFrame(order[k::4], "token string, use_id long, s long").select("token", "use_id", F.timestamp_seconds("s").alias("used_at")).coalesce(1).write.mode("append").parquet(uses)
    for k in range(2):  # time goes on
        spark.createDataFrame([(t, s + k) for t, s in end], "token string, s long").select("token", F.timestamp_seconds("s").alias("issued_at")).coalesce(1).write.mode("append").parquet(ins)
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream = W.first_use_stream(read(ins, i.schema), read(uses, u.schema), late="4 hours")
    rows = drained(spark, stream, tmp_path, "append")
    assert len(rows) == len(want) and {(x.use_id, x.valid) for x in rows} == want


# --- S9, S8


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    events = [(k, f"r{k}", "succeeded" if k % 3 else "odd", "x") for k in range(30)]
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(events[10 * k : 10 * k + 10], "id long, run string, status string, payload string").coalesce(1).write.mode("append").parquet(source)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema("id long, run string, status string, payload string").option("maxFilesPerTrigger", 1).parquet(source)
        split = S.split_events(stream, run="run", status="status", payload="payload")
        S.append_stream(split, out, source="hook", checkpoint=checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    want = [k for k, _, status, _ in events if status != "odd"]
    assert run() == want
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")  # as if the driver had died before it could commit
    if os.path.exists(f"{checkpoint}/commits/.{last}.crc"):
        os.remove(f"{checkpoint}/commits/.{last}.crc")
    assert run() == want


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "keyed")
    old = spark.createDataFrame([(k, 1, f"old{k}") for k in range(500)] + [(None, 1, "null")], "k long, v int, x string")
    new = spark.createDataFrame([(3, 2, "new"), (4, 0, "older"), (5, 1, "same"), (900, 1, "added")], "k long, v int, x string")
    S.write_keyed(old, path, keys=["k"], buckets=16)
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    before = files()
    want = sorted(map(tuple, S.upsert_by_key(old, new, keys=["k"], version="v").collect()), key=repr)
    for _ in range(2):  # again, as after a failure
        S.upsert_table(path, new, keys=["k"], version="v", buckets=16)
        assert sorted(((r.k, r.v, r.x) for r in S.read_keyed(spark, path).collect()), key=repr) == want
    kept = {f for f, t in files().items() if before.get(f) == t}
    assert len({os.path.dirname(f) for f in kept}) >= 12 and len({os.path.dirname(f) for f in files()}) == 16
    S.upsert_table(path, new.limit(0), keys=["k"], version="v", buckets=16)
    assert S.read_keyed(spark, path).count() == len(want)


# --- R5


def test_previous_run_of_a_key_with_most_runs(spark):
    r = random.Random(3)
    runs = [(k, r.choice([" Hot ", "hot", "hot", "cold", None]), r.choice([1, 1, 2]), None if k % 50 == 0 else r.randrange(0, 400)) for k in range(600)]
    inputs = [(k, r.choice(["HOT", "cold ", "none", None]), r.choice([1, 2, None]), None if k % 40 == 0 else r.randrange(-5, 410)) for k in range(200)]
    a = spark.createDataFrame(runs, "run long, name string, kind int, at long")
    b = spark.createDataFrame(inputs, "id long, name string, kind int, started long")

    def plain(name, kind, started):
        if name is None or kind is None or started is None:
            return None
        fits = [(t, k) for k, n, c, t in runs if n is not None and t is not None and n.strip().lower() == name.strip().lower() and c == kind and t < started]
        return max(fits)[1] if fits else None

    for slices in (1, 8, 32):
        got = R.previous_run(a, b, keys=["name", "kind"], at="at", run="run", started="started", slices=slices)
        assert {(x.id, x.previous_run) for x in got.collect()} == {(k, plain(n, c, s)) for k, n, c, s in inputs}
    assert got.columns == ["id", "name", "kind", "started", "previous_run"]
    # the only join is that with what slices carry over, a row for each key and slice
    assert plan_of(got).count("Join") == plan_of(got).count("SortMergeJoin") and "NestedLoop" not in plan_of(got)
    assert R.previous_run(a.limit(0), b, keys=["name", "kind"], at="at", run="run", started="started").where("previous_run is not null").count() == 0


# --- C6


def test_repeated_lines_stay_in_their_row(spark):
    long = "a line that is long enough to count as repeated"
    docs = [(1, f"{long}\nshort\nshort\n{long.upper()}\nx\n{long}"), (2, None), (3, ""), (4, long), (4, long)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = C.drop_repeated_lines(df)
    assert "Exchange" not in plan_of(got)
    rows = sorted((r.doc_id, r.text, r.dropped) for r in got.collect())
    assert rows[0] == (1, f"{long}\nshort\nshort\nx", 2) and rows[-2:] == [(4, long, 0)] * 2


# --- P11


def plain_cover(sets):
    left, out = {s: dict(k) for s, k in sets.items()}, []
    while left:
        gain, s = min((-sum(k.values()), s) for s, k in left.items())
        if not gain:
            return out
        out.append((len(out) + 1, s, -gain))
        gone = left.pop(s)
        left = {x: {k: w for k, w in own.items() if k not in gone} for x, own in left.items()}
    return out


@pytest.mark.parametrize("batch", [3, 20, 500])
def test_lazy_cover_picks_as_the_plain_one(spark, batch):
    r = random.Random(batch)
    sets = {s: {f"brand:{r.randrange(300)}": 1 for _ in range(r.randrange(1, 14))} for s in range(120)}
    df = spark.createDataFrame([(s, k) for s, own in sets.items() for k in own], "sample long, key string")
    weight = {x.key: x.w for x in df.select("key", P.key_weight(F.col("key")).alias("w")).distinct().collect()}
    want = plain_cover({s: {k: weight[k] for k in own} for s, own in sets.items()})
    log = []
    most = 1000 if batch > 3 else 12
    got = [tuple(x) for x in P.greedy_cover_large(df, sample="sample", rounds=most, cut=cut, batch=batch, log=log).orderBy("place").collect()]
    assert got == want[:most]
    if batch > 3:
        assert len(want) > 40 and len(log) < len(want) / 2
