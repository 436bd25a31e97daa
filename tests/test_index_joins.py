"""Joins by an index against all pairs."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from plumbline.functions.similarity import ratio, similarity
from plumbline.operators import fuzzy
from plumbline.operators.joins import events_after


def made_names(rng, n):
    syllables = ["an", "bo", "cra", "del", "e", "fin", "gor", "hu", "jay", "kes", "lo", "mi", "né", "o'", "pat"]
    out = []
    for _ in range(n):
        name = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice(["", "x", name[k : k + 2]]) + name[k + 1 :] or "q"
        out.append(name)
    return out + ["", "a", "ab", "ba", "abc", "aaaaaa", "aaaaab", "a" * 30]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_fuzzy_pairs_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    base = made_names(rng, 45)
    left = [(i, i % 2, x) for i, x in enumerate([*base, *made_names(rng, 30), None])]
    right = [(i % 2, x) for i, x in enumerate([*made_names(rng, 30), *(b[1:] + "s" for b in base), *base[:20], base[0], None])]
    a, b = spark.createDataFrame(left, "id long, g int, x string"), spark.createDataFrame(right, "g int, y string")
    want = {(g, x, y): similarity(x, y) for _, g, x in left for h, y in right if g == h and x is not None and y is not None}
    want = {k: s for k, s in want.items() if s >= least}
    got = fuzzy.near_names(a, b, ["g"], "x", "y", ratio, least).collect()
    assert len(got) == len(want) and {(r["g"], r["a"], r["b"]): r["score"] for r in got} == pytest.approx(want)
    best = defaultdict(list)
    for (g, x, y), s in want.items():
        best[g, x].append((-s, y))
    matched = {r["id"]: (r["y"], r["score"]) for r in fuzzy.best_match(a, b, ["g"], "x", "y", ratio, least).collect()}
    assert matched == {i: (min(best[g, x])[1], pytest.approx(-min(best[g, x])[0])) for i, g, x in left if (g, x) in best}


def test_index_leaves_few_candidates(spark):
    """Long names that have nothing in common are not compared: candidates grow with the near pairs, not with all."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(14, 24))) for _ in range(400)]
    names += [x[:5] + "q" + x[6:] for x in names[:50]]
    df = spark.createDataFrame([(x,) for x in names], "name string")
    n = fuzzy.candidates(df, df, [], 0.75).count()
    assert 100 <= n <= 600 < len(names) ** 2 / 300
    assert fuzzy.candidates(df.limit(0), df, [], 0.75).count() == 0


def test_first_events_after(spark):
    rng, start = random.Random(8), dt.datetime(2024, 3, 1)
    events = [(i, rng.choice(["hot", "hot", "a", "b", None]), start + dt.timedelta(seconds=rng.randrange(0, 4000, 7)), "v%d" % i) for i in range(1500)]
    events += [(2000, "a", None, "x"), (2001, "b", start, "y"), (2002, "b", start, "z")]
    anchors = [(k, t, i) for i, k, t, _ in rng.sample(events, 150)] + [("b", start, 1), ("b", start, 1), ("none", start, 2), ("a", None, 3), ("hot", start - dt.timedelta(days=1), 4)]
    e, a = spark.createDataFrame(events, "id long, k string, ts timestamp, v string"), spark.createDataFrame(anchors, "k string, ts timestamp, n long")
    for seconds, most in ((60, 3), (900, 10), (5000, 4)):
        got = sorted((r["k"], r["anchor_ts"], r["anchor_n"], r["event_ts"], r["event_id"], r["event_v"], r["rank"]) for r in events_after(a, e, "k", "ts", "ts", "id", seconds, most).collect())
        want = []
        for k, t, n in anchors:
            if k is not None and t is not None:
                near = sorted((ts, i, v) for i, x, ts, v in events if x == k and ts is not None and t < ts <= t + dt.timedelta(seconds=seconds))
                want += [(k, t, n, *x, r + 1) for r, x in enumerate(near[:most])]
        assert got == sorted(want)
