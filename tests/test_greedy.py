"""Greedy near-duplicates in rounds against going through each group row by row."""

from __future__ import annotations

import random

import pytest

from plumbline.functions.similarity import similarity
from plumbline.operators import ledger
from plumbline.plans.registry import queries

SF = "/root/testdata/sf0.001"


def plain(rows, least):
    """rows of (group, order, id, text)."""
    kept, out = {}, []
    for g, _, i, x in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        own = kept.setdefault(g, [])
        hit = next(((k, s) for k, y in own if (s := similarity(y, x or "")) >= least), None)
        if hit:
            out.append((i, *hit))
        else:
            own.append((i, x or ""))
    return sorted(out)


@pytest.mark.parametrize(("lead", "per_task"), [(512, 4096), (16, 20)])
def test_rounds_equal_row_by_row(spark, lead, per_task):
    rng = random.Random(6)
    words = ["win", "lose", "trade", "draft", "the", "Bears", "Lions", "by", "seven", "points", "this", "year"]
    rows = []
    for i in range(260):
        x = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) if i % 4 else rng.choice(["", None, "win by seven points", "the Bears win this year", "the Bears win this yeah"])
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(40), (1 << 60) + i, x))
    df = spark.createDataFrame(rows, "g string, o int, id long, x string")
    got = sorted(tuple(r) for r in ledger.void_near_duplicates(df, ["g"], ["o", "id"], "id", "x", 0.65, lead, per_task).collect())
    want = plain(rows, 0.65)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert ledger.void_near_duplicates(df.limit(0), ["g"], ["o"], "id", "x").count() == 0


def test_of_the_feed(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    rows = [(f"{r['user_id']}/{r['event_type'].strip().lower()}", r["ts"], r["event_id"], f"{r['event_type']} {r['props']}") for r in events]
    got = sorted(tuple(r) for r in queries()["ded_cross_article"](spark, SF).collect())
    assert [r[:2] for r in got] == [r[:2] for r in plain(rows, 0.65)]
