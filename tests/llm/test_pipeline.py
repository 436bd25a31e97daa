"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

import pathlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from plumbline.llm import line_dedup, queries
from plumbline.llm.common import CLEANUP, checkpoint_folder, read

from . import brute
from .test_operators import plain_budgets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in out.collect()} if k < 4 else {}
        if k < 4:
            assert out.columns == columns
        if name == "quality":
            bad = {r["doc_id"] for r in read(spark, SF, "labels").where("quality = 0").collect()}
            good = {r["doc_id"] for r in read(spark, SF, "labels").where("quality = 1").collect()}
            gone = {d for d, _ in before} - set(after)
            assert len(good & gone) <= 0.03 * len(good) and len(bad & gone) >= 0.6 * len(bad)
        elif name == "line_dedup":
            gone = brute.dropped_lines(before, line_dedup.JOB_STEPS, line_dedup.JOB_CHARS)
            assert after == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone.get(d, ()))) for d, t in before}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, c in brute.near_duplicates(before) if d == c}
        elif name == "decontamination":
            items = [(r[0], r[1]) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
            assert set(after) == {x[0] for x in brute.contamination(before, items) if not x[5]}
        else:
            tokens = {d: len(re.findall(r"[^ \t\n\x0B\f\r]+", t or "")) for d, t in before}
            leaf = {r["doc_id"]: (r["d"], r["lang"], r["source"]) for r in docs.withColumn("d", queries.domain()).collect()}
            sizes, read_ = Counter(), defaultdict(set)
            for d, n in tokens.items():
                if n:  # a leaf without tokens is no leaf
                    sizes[leaf[d]] += n
            for r in out.collect():
                assert r["n_tokens"] == tokens[r["doc_id"]]
                read_[leaf[r["doc_id"]], r["epoch"]].add(r["doc_id"])
            budgets = plain_budgets(dict(sizes), queries.WEIGHTS, sum(sizes.values()) * 0.9, 4)
            for place, n in sizes.items():
                whole = min(4, int((budgets[place] + 1e-6) // n))
                members = {d for d, n_ in tokens.items() if leaf[d] == place and n_}
                assert all(read_[place, e] == members for e in range(whole))
                part = read_[place, whole]
                assert part <= members and sum(tokens[d] for d in part) <= budgets[place] - whole * n + 1e-5
        docs = out


def test_empty_table(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_run_keeps_its_result_alone(spark):
    """What stages write on the way is deleted; their shuffle files too, so that the setting is as before."""
    folder = pathlib.Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*")) | set(folder.glob("pipeline-*"))
    assert corpus_pipeline.run(spark, SF).count() > 0
    (left,) = (set(folder.glob("cut-*")) | set(folder.glob("pipeline-*"))) - before
    assert [p.name for p in left.iterdir() if not p.name.startswith(".")] == ["4-mixing"]
    assert spark.conf.get(CLEANUP) in ("false", False)
