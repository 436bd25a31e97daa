"""Best partners by bounds against all pairs, and how few pairs get an exact ratio."""

from __future__ import annotations

import difflib
import random

import pytest

from plumbline.functions.similarity import ratio, similarity
from plumbline.operators import bestratio, fuzzy


def plain(others, names, least):
    out = {}
    for i, x in enumerate(others):
        scored = [(-(1.0 if x == n else similarity(x, n)), n) for n in names]
        scored = [t for t in scored if -t[0] >= least]
        if scored:
            out[i] = (min(scored)[1], -min(scored)[0])
    return out


@pytest.mark.parametrize(("first", "at_a_time", "classes", "wide"), [(64, 2048, 128, 128), (2, 3, 4, 9), (1, 1, 3, 5)])
def test_partners_equal_all_pairs(monkeypatch, first, at_a_time, classes, wide):
    for k, v in {"FIRST": first, "AT_A_TIME": at_a_time, "CLASSES": classes, "WIDE": wide}.items():
        monkeypatch.setattr(bestratio, k, v)
    rng = random.Random(first)
    for _ in range(40):
        signs = rng.choice(["ab", "abc ", "0123456789", "abcdefghijklmnop é", "ab€😀"])
        made = lambda: "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, rng.randint(0, 12), rng.randint(0, 20), rng.randint(50, 70), rng.randint(190, 230)])))  # noqa: B023, E731
        others = [made() for _ in range(20)]
        names = list({made() for _ in range(rng.randint(0, 40))} | set(others[:4]))
        least = rng.choice([0.0, 0.3, 0.6, 0.75, 0.95])
        assert {i: (n, s) for i, n, s in bestratio.Partners(names, least).best(others)} == plain(others, names, least)


def test_few_exact_ratios(monkeypatch):
    """Names that nearly all signs are common to: of 300,000 pairs under the threshold's bound, a few hundred are compared."""
    asked = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(bestratio, "SequenceMatcher", Counted)
    rng = random.Random(2)
    others, names = [f"Supplier#{rng.randrange(6000):09d}" for _ in range(100)], list({f"Customer#{rng.randrange(90_000):09d}" for _ in range(3000)})
    got = bestratio.Partners(names, 0.6).best(others)
    assert len(got) == 100 and len(asked) < 1000
    assert {i: (n, s) for i, n, s in got[:5]} == {i: plain([others[i]], names, 0.6)[0] for i, _, _ in got[:5]}


@pytest.mark.parametrize("block", [["g"], []])
def test_tiles(spark, monkeypatch, block):
    monkeypatch.setattr(fuzzy, "TILE", (3, 5))
    rng = random.Random(9)
    made = lambda n: [(rng.choice([0, 0, 1, 2, None]), "".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) if i % 9 else None) for i in range(n)]
    left, right = [(i, *x) for i, x in enumerate(made(60))], made(50)
    a, b = spark.createDataFrame(left, "id long, g int, x string"), spark.createDataFrame(right, "g int, y string")
    got = {r["id"]: (r["y"], r["score"]) for r in fuzzy.best_match(a, b.drop(*({"g"} - set(block))), block, "x", "y", ratio, 0.5).collect()}
    want = {}
    for i, g, x in left:
        if x is not None and (g is not None or not block):
            found = plain([x], [y for h, y in right if y is not None and (h == g or not block)], 0.5)
            want |= {i: found[0]} if found else {}
    assert got == want and len(want) > 20
    assert fuzzy.best_match(a, b.limit(0).drop(*({"g"} - set(block))), block, "x", "y", ratio, 0.5).count() == 0
