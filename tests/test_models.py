"""Ranks and quantiles of whole tables, and the models, against plain computations."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import backtest, forest, lasso, ranks
from plumbline.plans import features
from plumbline.plans.base import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of three keys (null one of them) in which one value fills a third."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), rng.choice([0.0, 0.0, rng.gauss(0, 1), None, round(rng.gauss(0, 1), 1)])) for i in range(900)]
    return spark.createDataFrame(rows, "id long, k string, v double"), rows


def test_quantiles_equal_interpolation(spark, skewed):
    df, rows = skewed
    shares = {"q0": 0.0, "q1": 0.1, "mid": 0.5, "q9": 0.95, "top": 1.0}
    for keys, of in ((["k"], lambda r: r[1]), ([], lambda r: None)):
        groups = defaultdict(list)
        for r in rows:
            if r[2] is not None:
                groups[of(r)].append(r[2])
        got = {(r["k"] if keys else None): r for r in ranks.quantiles(df, keys, "v", shares).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert [got[k][c] for c in shares] == pytest.approx([np.percentile(v, 100 * q) for q in shares.values()], abs=1e-12)
    assert ranks.quantiles(df.limit(0), ["k"], "v", shares).count() == 0 and ranks.quantiles(df.limit(0), [], "v", shares).first()["mid"] is None


def test_ranks_and_running_totals(spark, skewed):
    df, rows = skewed
    got = {r["id"]: r for r in ranks.with_ranks(df, ["k"], "v", first=ranks.percent_rank(), mean=ranks.mean_rank_share()).collect()}
    assert len(got) == len(rows)
    for i, k, v in rows:
        own = [y for _, x, y in rows if x == k and y is not None]
        if v is None:
            assert got[i]["first"] is None and got[i]["mean"] is None
            continue
        below, same = sum(y < v for y in own), sum(y == v for y in own)
        assert got[i]["first"] == pytest.approx(below / (len(own) - 1)) and got[i]["mean"] == pytest.approx((below + (same + 1) / 2) / len(own))
    placed = {r["id"]: r for r in ranks.running_totals(df, ["k"], [F.desc("v"), "id"], {"n": F.lit(1), "v": F.col("v")}).collect()}
    order = lambda r: (r[2] is None, -(r[2] or 0), r[0])
    for k in ("a", "b", None):
        total, n = 0.0, 0
        mine = sorted((r for r in rows if r[1] == k), key=order)
        for r in mine:
            assert placed[r[0]]["n_before"] == n and placed[r[0]]["v_before"] == pytest.approx(total, abs=1e-9) and placed[r[0]]["n_total"] == len(mine)
            n, total = n + 1, total + (r[2] or 0)


def test_two_samples(spark, skewed):
    df, rows = skewed
    got = {r["k"]: r for r in ranks.two_samples(df, ["k"], "v", F.col("id") % 3 == 0).collect()}
    for k in ("a", "b", None):
        a, b = (sorted(v for i, x, v in rows if x == k and v is not None and (i % 3 == 0) == side) for side in (True, False))
        d = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
        z = d * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
        p = 1.0 if z < 0.2 else min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101)))
        assert (got[k]["statistic"], got[k]["p_value"], got[k]["n1"], got[k]["n2"]) == pytest.approx((d, p, len(a), len(b)))
    one = ranks.two_samples(df, [], "v", F.lit(True)).first()
    assert one["statistic"] is None and one["p_value"] is None and ranks.two_samples(df.limit(0), ["k"], "v", F.lit(True)).count() == 0


# isolation forest -----------------------------------------------------------------------------------


def test_forest_path_lengths(spark):
    rng = np.random.RandomState(3)
    rows = [(i, *map(float, rng.randn(2)), 4.0, "x") for i in range(700)] + [(1000 + i, 9.0 + i, -8.0, 4.0, "x") for i in range(5)] + [(2000, None, float("nan"), 4.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, score string")
    names = ["a", "b", "c"]
    f = forest.fit(df, "id", names, trees=20, sample=64, seed=5)
    assert len(f.root) == 20 and f.rows == 64

    def depth(tree, x):
        node, steps = tree, 0
        while f.feature[node] >= 0:
            node, steps = (f.left if x[f.feature[node]] < f.split[node] else f.right)[node], steps + 1
        return steps + f.leaf[node]

    fill = lambda v: 0.0 if v is None or v != v else v
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    want = {r[0]: 2 ** (-sum(depth(t, [fill(v) for v in r[1:4]]) for t in f.root) / 20 / c(64)) for r in rows}
    got = {r["id"]: r for r in forest.anomalies(df, "id", names, 0.05, trees=20, sample=64, seed=5).collect()}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(want)
    cut = np.percentile(list(want.values()), 95)
    assert {i for i, r in got.items() if r["flagged"]} == {i for i, s in want.items() if s > cut + 1e-12}
    assert all(r["decision"] == pytest.approx(cut - r["score"], abs=1e-9) for r in got.values()) and all(got[1000 + i]["flagged"] for i in range(5))
    # the same forest for other partitions, other trees for another seed, no column of equal values in a split
    again = forest.fit(df.repartition(7), "id", names, trees=20, sample=64, seed=5)
    assert np.array_equal(again.split, f.split) and np.array_equal(again.leaf, f.leaf) and 2 not in f.feature
    assert not np.array_equal(forest.fit(df, "id", names, trees=20, sample=64, seed=6).split[:5], f.split[:5])


def test_forest_samples(spark):
    """Each tree's sample has the wished size, without repetition; small and odd tables work."""
    df = spark.range(30_000).select("id", F.rand(1).alias("a"))
    per_tree = [r["n"] for r in forest.tree_samples(forest.matrix(df, ["a"], "id"), "id", 10, 64, 1).groupBy("tree").agg(F.count("*").alias("n")).collect()]
    assert len(per_tree) == 10 and all(64 <= n <= 140 for n in per_tree)
    assert forest.anomalies(df.limit(0), "id", ["a"]).count() == 0
    one = forest.anomalies(spark.createDataFrame([(1, 2.0)], "id long, a double"), "id", ["a"], trees=3).collect()
    assert [(r["id"], r["flagged"]) for r in one] == [(1, False)]
    same = forest.anomalies(spark.range(40).select((F.col("id") % 4).alias("id"), F.lit(1.0).alias("a")), "id", ["a"], trees=3)
    assert same.count() == 40 and same.where("flagged").count() == 0


# regularisation path --------------------------------------------------------------------------------


def dense_lasso(x, y, penalty):
    """Coordinate descent on the rows themselves."""
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            if (xc[:, j] ** 2).sum() > 0:
                r = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j])
                w[j] = np.sign(r) * max(abs(r) - len(y) * penalty, 0) / (xc[:, j] ** 2).sum()
    return w, y.mean() - x.mean(0) @ w


def test_path_equals_dense_solutions(spark):
    rng = np.random.RandomState(7)
    x = rng.randn(160, 5) * [1, 50, 1, 0.01, 0] + [0, 1000, 0, 0, 3]
    x[:, 2] = x[:, 0] + 0.3 * rng.randn(160)
    y = 3 * x[:, 0] + 0.02 * x[:, 1] + rng.randn(160) + 500
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], ", ".join(["id long", *(f"{n} double" for n in names), "y double"]))
    fold = {r["id"]: r["f"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("f")).collect()}
    folds = np.array([fold[i] for i in range(160)])
    g = lasso.grams(lasso.standardised(df, names, "y", F.pmod(F.xxhash64("id"), F.lit(5))), 7, 5)
    found = lasso.path(g, steps=12)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    top = np.abs((z - z.mean(0)).T @ (y - y.mean())).max() / 160
    assert found.penalties == pytest.approx(np.geomspace(top, top * 1e-3, 12))
    for k in (0, 5, 11):
        errors = []
        for f in range(5):
            w, b = dense_lasso(z[folds != f], y[folds != f], found.penalties[k])
            errors.append(((y[folds == f] - z[folds == f] @ w - b) ** 2).mean())
        assert found.errors[k] == pytest.approx(np.mean(errors), rel=1e-6)
    w, _ = dense_lasso(z, y, found.penalty)
    assert found.weights == pytest.approx(w, abs=1e-6) and found.penalty == found.penalties[np.argmin(found.errors)]
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert lasso.components(g) == pytest.approx(values / values.sum())
    out = lasso.select_features(df, names, "y", F.col("id")).collect()
    assert [r["feature"] for r in out] == names and not out[4]["selected"] and out[0]["selected"] and out[1]["selected"]


def test_path_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0)], "id long, a double, y double")
    assert lasso.select_features(df.limit(0), ["a"], "y", F.col("id")).count() == 0
    assert [(r["coefficient"], r["selected"]) for r in lasso.select_features(df, ["a"], "y", F.col("id")).collect()] == [(0.0, False)]


# walk-forward ---------------------------------------------------------------------------------------


def f1_of(pairs):
    tp, fp, fn = (sum(a == x and p == y for a, p in pairs) for x, y in ((1, 1), (0, 1), (1, 0)))
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


@pytest.mark.parametrize("classify", [False, True])
def test_folds_and_metrics(spark, classify):
    t = Tables(spark, SF)
    rows = features.weekly(t)
    if classify:
        rows = rows.withColumn("target", (F.col("target") >= 21).cast("double"))
    told = backtest.predictions(rows, ["player"], "year", "week", ["week", "ytd", "cap_ytd", "perf"], "target", [1995, 1997, 1998, 2030], least=100, classify=classify, maxIter=3, maxDepth=3)
    metrics = {r["year"]: r for r in backtest.fold_metrics(told, ["player"], "year", "week", threshold=21.0, classify=classify).collect()}
    plain = [(r["player"], r["year"], r["week"], r["target"]) for r in rows.collect()]
    per_year = Counter(r[1] for r in plain)
    said = defaultdict(list)
    for r in told.collect():
        said[r["year"]].append((r["player"], r["week"], r["actual"], r["predicted"], r["n_train"]))
    assert said.keys() == metrics.keys() == {1997, 1998}  # 1995 has nothing before it, 2030 no rows
    for y, own in said.items():
        n_train = sum(n for k, n in per_year.items() if k < y)
        assert {x[4] for x in own} == {n_train} and sorted((x[0], x[1], x[2]) for x in own) == sorted((p, w, v) for p, k, w, v in plain if k == y)
        last = {}
        for p, w, a, g, _ in sorted(own, key=lambda x: x[1]):
            last[p] = (a, g)
        a, g = (np.array(v) for v in zip(*last.values(), strict=True))
        m = metrics[y]
        assert (m["n_train"], m["n_test"], m["n_terminal"]) == (n_train, len(own), len(last))
        if classify:
            assert m["accuracy"] == pytest.approx((a == g).mean()) and m["f1"] == pytest.approx(f1_of(list(zip(a, g, strict=True))))
        else:
            assert m["rmse"] == pytest.approx(math.sqrt(((a - g) ** 2).mean())) and m["r2"] == pytest.approx(1 - ((a - g) ** 2).sum() / ((a - a.mean()) ** 2).sum())
            assert m["f1"] == pytest.approx(f1_of(list(zip((a >= 21).astype(int), (g >= 21).astype(int), strict=True))))
            assert len(set(g)) > 1
