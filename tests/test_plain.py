"""Queries that SQL does not express, against plain Python over the smallest tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.functions.chunks import chunks
from plumbline.functions.similarity import similarity
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def rows(spark):
    return lambda table: spark.read.parquet(f"{SF}/{table}.parquet").collect()


def test_top_factors(run, rows):
    want = Counter()
    for r in rows("lineitem"):
        f = {"qty": r["l_quantity"], "disc": -r["l_discount"] * 100, "tax": r["l_tax"] * 100, "line": float(r["l_linenumber"])}
        top = sorted(f.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:3]
        want[r["l_orderkey"], r["l_linenumber"], tuple(f"{k}: {v:.2f}" for k, v in top)] += 1
    assert Counter((r["l_orderkey"], r["l_linenumber"], tuple(r["factors"])) for r in run("agg_topfactor")) == want


def test_similarities(run, rows):
    brands = defaultdict(list)
    for r in sorted(rows("part"), key=lambda r: r["p_partkey"]):
        brands[r["p_brand"]].append(r)
    want = {a["p_partkey"]: similarity(a["p_name"], b["p_name"]) if b else None for own in brands.values() for a, b in zip(own, [*own[1:], None], strict=True)}
    assert {r["p_partkey"]: r["ratio"] for r in run("str_similarity_ratio")} == {k: None if v is None else pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert {r["p_partkey"]: r["percent"] for r in run("str_fuzz_ratio")} == {r["p_partkey"]: math.floor(similarity(r["p_name"], r["p_name"][::-1]) * 100 + 0.5) for r in rows("part")}


def test_best_names(run, rows):
    near = defaultdict(list)
    for c in rows("customer"):
        near[c["c_nationkey"]].append(c["c_name"])
    want = {}
    for s in rows("supplier"):
        scored = [(-x, n) for n in near[s["s_nationkey"]] if (x := similarity(s["s_name"], n)) >= 0.6]
        if scored:
            want[s["s_suppkey"]] = (min(scored)[1], pytest.approx(-min(scored)[0], abs=1e-4))
    assert {r["s_suppkey"]: (r["c_name"], r["score"]) for r in run("jn_fuzzy_best")} == want
    brands = defaultdict(set)
    parts = [(p["p_partkey"], p["p_brand"], p["p_name"].lower()) for p in rows("part")]
    for _, b, n in parts:
        brands[b].add(n)
    best = {}
    for k, b, n in parts:
        scored = [(-x, m) for m in brands[b] if m != n and (x := similarity(n, m)) >= 0.75]
        if scored:
            best[k] = (min(scored)[1], pytest.approx(-min(scored)[0], abs=1e-4))
    assert {r["p_partkey"]: (r["match"], r["score"]) for r in run("jn_fuzzy_names")} == best


def test_chunks(run, rows):
    want = sorted((r["doc_id"], i, c) for r in rows("documents") for i, c in enumerate(chunks(r["text"], 1000)))
    got = sorted(tuple(r) for r in run("str_chunk_sentences"))
    assert got == want and all(0 < len(c) <= 1000 for _, _, c in got)
    # nothing but white space at the cuts is lost
    whole = defaultdict(str)
    for d, _, c in got:
        whole[d] += c
    squeeze = lambda x: "".join((x or "").split())
    assert all(squeeze(whole[r["doc_id"]]) == squeeze(r["text"]) for r in rows("documents"))


def test_claims_of_an_article(run, rows):
    turns, want = defaultdict(list), []
    for r in rows("conversations"):
        turns[r["conv_id"]].append((r["turn"], r["text"] or ""))
    for conv, own in turns.items():
        kept: list[str] = []
        for _, x in sorted(own):
            hit = next((k for k, y in enumerate(kept) if similarity(y, x) >= 0.75), None)
            if hit is None:
                kept.append(x)
            elif len(x) > len(kept[hit]):
                kept[hit] = x
        want += [(conv, k, x) for k, x in enumerate(kept)]
    assert sorted(tuple(r) for r in run("ded_claims")) == sorted(want)


def test_checksum_and_sample(run, rows, spark):
    n = len(rows("customer"))
    first = run("hash_frame_checksum")
    shuffled = spark.read.parquet(f"{SF}/customer.parquet").repartition(5)
    from plumbline.plans.base import Tables

    class Other(Tables):
        customer = shuffled

    from plumbline.plans import scalars

    assert first == scalars.hash_frame_checksum(Other(spark, SF)).collect() and first[0]["n"] == n  # whatever the order of rows
    sample = [r["c_custkey"] for r in run("srt_random_sample")]
    assert len(set(sample)) == 5 and set(sample) <= {r["c_custkey"] for r in rows("customer")}


def test_linear_folds(run, rows):
    facts = defaultdict(lambda: [0.0, 0])
    for o in rows("orders"):
        f = facts[o["o_custkey"], o["o_orderdate"].year]
        f[0], f[1] = f[0] + o["o_totalprice"], f[1] + 1
    data, last = [], {}
    for (k, y), (cap, games) in sorted(facts.items()):
        data.append((y, games, last.get(k, 0.0), round(cap, 2)))
        last[k] = round(cap, 2)
    data = np.array(data)
    got = {r["year"]: r for r in run("ml_walk_forward")}
    for y in range(1996, 2002):
        train, test = data[data[:, 0] < y], data[data[:, 0] == y]
        if len(train) < 100 or not len(test):
            assert y not in got
            continue
        x, scale = train[:, 1:3], train[:, 1:3].std(0, ddof=1)
        scale[scale == 0] = 1  # no row of the first year has one before it
        z, t = (x - x.mean(0)) / scale, train[:, 3] - train[:, 3].mean()
        w = np.linalg.solve(z.T @ z / len(z) + 1e-3 / train[:, 3].std(ddof=1) * np.eye(2), z.T @ t / len(z))
        told = (test[:, 1:3] - x.mean(0)) / scale @ w + train[:, 3].mean()
        rmse = math.sqrt(((told - test[:, 3]) ** 2).mean())
        assert (got[y]["n_train"], got[y]["n_test"]) == (len(train), len(test)) and got[y]["rmse"] == pytest.approx(rmse, rel=2e-3)
        assert got[y]["r2"] == pytest.approx(1 - rmse**2 / test[:, 3].var(), abs=5e-3)


def test_lasso_and_components(run, rows):
    lines = np.array([[r["l_quantity"], r["l_discount"], r["l_tax"], r["l_extendedprice"]] for r in rows("lineitem")], float)
    z = (lines[:, :3] - lines[:, :3].mean(0)) / lines[:, :3].std(0, ddof=1)
    got = {r["name"]: r["value"] for r in run("ml_lasso_pca")}
    slope = z[:, 0] @ (lines[:, 3] - lines[:, 3].mean()) / (z[:, 0] ** 2).sum()
    assert got["l_quantity"] == pytest.approx(slope, rel=0.01)
    shares = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert [got["pc1"], got["pc2"]] == pytest.approx(list(shares[:2] / shares.sum()), abs=0.006)


def test_tree_search(run, rows):
    """A report on the largest gains: the chosen trade is one of them, the same each time."""
    s = rows("supplier")
    pairs = sorted(((-a["s_acctbal"], b["s_suppkey"], a["s_suppkey"]) for a in s for b in s if a["s_nationkey"] == b["s_nationkey"] and a["s_suppkey"] != b["s_suppkey"]))[:20]
    got = run("ml_mcts")
    assert got == run("ml_mcts") and all((r["buyer"], r["seller"]) in {(b, a) for _, b, a in pairs} and r["visits"] > 0 for r in got) and len(got) == bool(pairs)
