"""Streams with state across triggers: repeats, failures, order and lateness."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import latedays, numbered, ratelimit, workqueue

ITEM = "k string, body string, extra int"


@pytest.fixture
def queue(spark, tmp_path):
    """A queue whose items yield the numbers of their body; `x` fails, and `later` yields from the second offer on."""
    offers = []

    def work(items):
        offers.append(sorted(r["k"] for r in items.select("k").collect()))
        if len(offers) == 3:
            raise RuntimeError("the driver is lost")
        late = F.when((F.col("body") == "later") & F.lit(len(offers) > 1), F.lit("7")).otherwise(F.col("body"))
        rows = items.select("k", F.when(F.col("body") == "x", F.array(F.lit(None).cast("string"))).otherwise(F.regexp_extract_all(late, F.lit("([0-9]+)"), F.lit(1))).alias("found"))
        return rows.select("k", F.explode("found").alias("number")).withColumn("error", F.when(F.col("number").isNull(), "bad body"))

    schema = spark.createDataFrame([], ITEM).schema
    out = workqueue.WorkQueue(spark, f"{tmp_path}/queue", "k", schema, "number string", work)
    out.offers, out.state, out.root = offers, f"{tmp_path}/state", f"{tmp_path}/in"
    return out


def test_queue_marks_what_yields(spark, queue):
    parts = [[("a", "1 2", 0), ("b", "none", 0), ("c", "later", 0), ("d", "x", 0), (None, "5", 0), ("e", None, 0)], [("a", "1 2", 1), ("f", "3", 1), ("f", "3", 2), ("d", "x", 1)], [("c", "later", 2), ("g", "4", 2)]]
    frames = [spark.createDataFrame(p, ITEM) for p in parts]
    run = lambda stream: numbered.run_once(stream, queue.step, queue.state)
    with pytest.raises(Exception, match="the driver is lost"):
        numbered.in_arrivals(frames, queue.root, run)
    # two whole batches; the third failed after its first write and starts over
    assert queue.offers == [["a", "b", "c", "d", "e"], ["b", "c", "e", "f"], ["b", "e", "g"]] and queue.last() == 1
    run(numbered.folder_stream(spark, queue.root, frames[0].schema))
    assert queue.offers[3] == ["b", "e", "g"]

    def state():
        return sorted(map(tuple, queue.results().collect())), sorted(map(tuple, queue.marked().collect())), sorted(r["k"] for r in queue.waiting().collect()), sorted(map(tuple, queue.log.all().drop("batch").collect()))

    want = ([("a", "1"), ("a", "2"), ("c", "7"), ("f", "3"), ("g", "4")], [("a", False), ("c", False), ("d", True), ("f", False), ("g", False)], ["b", "e"], [(0, 5, 2, 1, 3), (1, 4, 2, 0, 2), (2, 3, 1, 0, 2)])
    assert state() == want
    # a repeated batch changes nothing; a trigger without arrivals neither
    numbered.uncommit(spark, queue.state, 2)
    run(numbered.folder_stream(spark, queue.root, frames[0].schema))
    assert queue.offers[4] == ["b", "e", "g"] and state() == want
    run(numbered.folder_stream(spark, queue.root, frames[0].schema))
    assert state() == want


@pytest.mark.parametrize("count_refused", [False, True])
def test_window_equals_all_requests(count_refused):
    rng = random.Random(4)
    for most in (0, 1, 2, 5):
        window, past = ratelimit.Window((), 60_000_000, count_refused), []
        at = 0
        for _ in range(400):
            at += rng.choice([0, 1, 5_000_000, 20_000_000, 60_000_000])
            recent = [x for x in past if x >= at - 60_000_000]
            allowed, left, wait = window.ask(at, most)
            assert allowed == (len(recent) < most) and len(window.times) <= max(1, most)
            if allowed:
                assert left == most - len(recent) - 1 and wait is None
            elif most:
                free = recent[-most] + 60_000_000  # the last time that still counts here
                assert left == 0 and at + (wait - 1) * 1_000_000 <= free < at + wait * 1_000_000
            if allowed or count_refused:
                past.append(at)


def test_limits_across_triggers(spark, tmp_path):
    rng, start = random.Random(2), dt.datetime(2024, 5, 1)
    rows = sorted((start + dt.timedelta(seconds=rng.randrange(3000)), i, rng.choice(["hot", "hot", "u1", "u2", None]), rng.choice(["free", "pro"])) for i in range(500))
    tier = {"hot": "pro", "u1": "free", "u2": "unknown"}
    rows = [(k, i, t, tier.get(k, x)) for t, i, k, x in rows] + [("u1", None, start, "free"), ("u1", 900, None, "free")]
    parts = [spark.createDataFrame(rows[a:b], "k string, id long, ts timestamp, tier string") for a, b in ((0, 150), (150, 320), (320, 502))]
    said = numbered.Numbered(spark, f"{tmp_path}/said", "k string, id long, ts timestamp, most long, allowed boolean, remaining long, retry_after long")
    tiers = {"free": 2, "pro": 6}
    limited = lambda stream: ratelimit.decisions(stream, "k", "id", "ts", "tier", tiers, 60, delay="30 seconds")
    numbered.in_arrivals(parts, f"{tmp_path}/in", lambda stream: numbered.run_once(limited(stream), said.write, f"{tmp_path}/state"))
    windows, want = {}, []
    for k, i, t, x in rows:
        if None not in (k, i, t):
            most = tiers.get(x, 2)
            at = round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
            want.append((k, i, most, *windows.setdefault(k, ratelimit.Window((), 60_000_000, False)).ask(at, most)))
    got = [(r["k"], r["id"], r["most"], r["allowed"], r["remaining"], r["retry_after"]) for r in said.all().collect()]
    assert sorted(got) == sorted(want) and 0 < sum(not r[3] for r in got) < len(got)


def test_late_rows_mend_closed_days(spark, tmp_path):
    day = lambda d, h=1: dt.datetime(2024, 5, d, h)
    kind = "id long, ts timestamp, kind string, value double"
    parts = [[(1, day(1), "a", 1.0), (2, day(2), "a", 2.0), (2, day(2), "a", 2.0), (None, day(1), "a", 9.0), (3, None, "a", 9.0)], [(4, day(1), "a", 10.0), (5, day(5), "b", None), (1, day(1), "a", 1.0)], [(6, day(2), None, 5.0), (7, day(4, 23), "b", 3.0), (8, day(1), "a", 100.0), (9, day(3), "a", 1.0)]]
    days = latedays.DailyTotals(spark, f"{tmp_path}/days", "id", "long", "ts", "kind", "value", "1 day")
    run = lambda stream: numbered.run_once(stream, days.step, f"{tmp_path}/state")
    numbered.in_arrivals([spark.createDataFrame(p, kind) for p in parts], f"{tmp_path}/in", run)
    want = [(1, "a", 3, 111.0, 1), (2, "a", 1, 2.0, 0), (2, None, 1, 5.0, 1), (3, "a", 1, 1.0, 1), (4, "b", 1, 3.0, 0), (5, "b", 1, None, 0)]
    got = lambda: sorted(((r["day"].day, r["kind"], r["n"], r["total"], r["n_late"]) for r in days.totals().collect()), key=str)
    assert got() == sorted(want, key=str)
    numbered.uncommit(spark, f"{tmp_path}/state", 2)
    run(numbered.folder_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], kind).schema))
    assert got() == sorted(want, key=str)
