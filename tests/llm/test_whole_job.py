"""The registered jobs do the whole job: cases that narrower versions left out."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import common, jaccard, line_dedup, mixing, queries

from . import brute

DOCS = "doc_id long, text string"


@pytest.fixture
def line_jobs(spark, tmp_path):
    """A function that gives the dropped line numbers by op3 and the texts left by the pipeline stage."""

    def run(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        gone = {r["doc_id"]: r["dropped_lines"] for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
        left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()}
        return gone, left

    return run


def test_short_lines(line_jobs):
    """Lines of 10 to 59 code points, exact and near copies."""
    licence, hot, ten = "Licensed under the Apache License, Version 2.0.", "The and attion to thanedble the, anea. Eriner thanea.", "Ten points"
    near = "Rights of this text reserved"
    texts = [f"{licence}\n{hot}\n{ten}\n}}\n{near}", f"}}\n{ten}\nown line here\n{licence}\n{near}!", f"{hot}\n{hot}\nanother line, not the same"]
    gone, left = line_jobs(texts)
    assert gone == {0: "", 1: "1,3,4", 2: "0,1"}
    assert left == {0: texts[0], 1: "}\nown line here", 2: "another line, not the same"}


def test_near_lines_of_two_edits(line_jobs):
    """Two edits from 20 code points, one below; white space inside a line does not count."""
    base = "the quick brown fox jumps over the lazy dog once more before noon today"
    texts = [f"{base}\nshort lines 1", base.replace("quick", "quack").replace("noon", "noun"), "xx" + base, base.replace(" ", " \t ") + "\r", "short lynes 2\n" + base.replace("quick", "slower")]
    gone, _ = line_jobs(texts)
    assert gone == {0: "", 1: "0", 2: "0", 3: "0", 4: ""}


def test_steps_equal_brute_force(spark):
    """Clusters of near lines of 10 to 40 code points against all pairs."""
    rng = random.Random(5)
    lines = []
    for n in [*range(12, 32, 2), 40, 40]:
        base = [rng.choice("abc ") for _ in range(n)]
        for _ in range(9):
            y = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(y))
                how = rng.randrange(3)
                y[k : k + (how != 1)] = [rng.choice("abc")] * (how != 0)
            lines.append("".join(y))
    rng.shuffle(lines)
    plain = [" ".join(x.split()) for x in lines]
    up = list(range(len(lines)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        short = min(len(plain[i]), len(plain[j]))
        if short >= 10 and brute.edit_distance(plain[i], plain[j]) <= (1 if short < 20 else 2):
            up[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    out = line_dedup.dedup_lines(df, line_dedup.JOB_STEPS, line_dedup.JOB_CHARS, dropped="gone", collapse=True).where(F.size("gone") > 0)
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(len(lines)) if root(i) != i}


def test_copies_not_near_one_another(spark, monkeypatch):
    """400 near copies of one text, each beyond the threshold from it and from one another, and five that have a near copy of their own: no table grows with the square of their number, and the five are found."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(len(words)), 13):
            words[at] = f"x{k}y{at}"
        texts.append(words)
    for k in range(5):
        words = list(texts[80 * k])
        words[150] = f"z{k}"
        texts.append(words)
    docs = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(texts)], DOCS)
    written, write = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: written.append(write(df)) or written[-1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()}
    assert got == {k: 80 * (k - 400) if k >= 400 else k for k in range(405)}
    assert max(df.count() for df in written if "sig" not in df.columns) < 20 * len(texts)


@pytest.mark.parametrize(("few", "most"), [(1_000_000, 0), (0, 1)])
def test_sets_are_shuffled_once_at_most(spark, monkeypatch, few, most):
    """Sets of tokens do not move to be chosen where their ids are few, and once where they are many; repeated rows give one set."""
    rng = random.Random(11)
    docs = []
    for k in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        docs += [(10 * k + j, " ".join(base[:59] + [f"x{k}{j}"])) for j in range(4)]
    docs += docs[:7]
    plans, write = [], jaccard.cut

    def seen(df):
        if "tokens" in df.columns and "sketch" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(jaccard, "cut", seen)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.joined(spark.createDataFrame(docs, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, i // 10 * 10) for i, _ in docs)
    # the first table of sets, and how often its big columns are dealt anew
    moved = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) <= 2 * most, plans[0]


def test_states_of_lines_with_exchanged_words(spark, monkeypatch):
    """600 lines of one template, each with two words of its own, and 20 copies with two edits: few states and pairs a line, all links found."""
    rng = random.Random(6)
    base = ["".join(rng.choice("adehinorst") for _ in range(6)) for _ in range(60)]
    lines = []
    for _ in range(600):
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = "".join(rng.choice("adehinorst") for _ in range(6))
        lines.append(" ".join(words))
    copies = [line[:50] + "#" + line[51:200] + "#" + line[201:] for line in lines[::30]]
    states, split, pairs, each = [], line_dedup._split, [], line_dedup._each_pair
    monkeypatch.setattr(line_dedup, "_split", lambda *a: states.append(split(*a).count()) or split(*a))
    monkeypatch.setattr(line_dedup, "_each_pair", lambda *a: pairs.append(each(*a).count()) or each(*a))
    df = spark.createDataFrame(list(enumerate(lines + copies)), DOCS)
    out = line_dedup.dedup_lines(df, line_dedup.JOB_STEPS, line_dedup.JOB_CHARS, dropped="gone", collapse=True).where(F.size("gone") > 0)
    assert {r["doc_id"] for r in out.collect()} == set(range(600, 620))
    assert sum(states) < 60 * len(lines)
    assert sum(pairs) < 60 * len(lines)


def test_driver_garbage_is_collected(spark, monkeypatch):
    """Jobs of many written tables collect the driver's garbage on the way."""
    calls = []
    monkeypatch.setattr(common, "released", lambda s: calls.append(s))
    for _ in range(2 * common.TABLES_A_GC):
        common.cut(spark.range(1))
    assert len(calls) == 2


def test_driver_heap_is_given_back(spark):
    """A collection leaves no more of the driver's heap free than set, and the JVM's own setting stays."""
    ratio = lambda: spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")).getVMOption("MaxHeapFreeRatio").getValue()
    before, heap = ratio(), spark._jvm.Runtime.getRuntime()
    spark._jvm.System.gc()
    loose = heap.totalMemory()
    common.released(spark)
    assert ratio() == before
    assert heap.totalMemory() < 0.75 * loose


def test_mixing_plans_the_tree_once(spark):
    """The budgets of the leaves are a table when the rows are chosen: the last plan does not hold the tree again for each use."""
    rows = [(i, "a b c", "en", f"s{i % 3}") for i in range(30)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), queries.domain(), queries.weights_table(spark, queries.WEIGHTS), share=0.9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 20
    assert plan.count("Window") <= 4
    assert plan.count("SortMergeJoin") == 2  # the slices, which grow with the leaves, are not broadcast
