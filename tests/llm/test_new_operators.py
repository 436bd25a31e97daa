"""Likelihood rules, vector codes and periodic runs against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import likelihood_rules, queries, runs, vector_codes
from plumbline.llm.common import CHUNK_BYTES, WordHasher, read

from .test_operators import empty, odd, pairs  # noqa: F401

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11 likelihood rules --------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def counted(df):
    return sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df.collect()), key=str)


def test_rule_counts_equal_brute_force(spark, odd, empty):  # noqa: F811
    rule = likelihood_rules.Rule(None, None)
    extra = [(900, "a b c a b c\na b c\n\n  \na b c\r\na b c \n# é|é <x>"), (901, "a a a a"), (902, "\n".join(["same line here"] * 60)), (903, "x " * (CHUNK_BYTES // 2 + 50)), (904, "a b\x0bc\x0cd\x1ce\x85f g")]
    for docs in ([*pairs(odd), *extra], [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]):
        got = likelihood_rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), rule)
        assert counted(got) == sorted(((d, *plain_counts(t)) for d, t in docs), key=str)
        assert got.where("kept = base_failed").count() == 0
    assert likelihood_rules.judge(empty, likelihood_rules.fit_rule(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_rule_of_plain_multinomials(spark):
    """Counts, ratios, threshold and verdicts from one more, plain computation over the same buckets."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rule = likelihood_rules.fit_rule(docs, labels)
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    hasher, texts = WordHasher(), {r["doc_id"]: r["text"] for r in docs.collect()}
    grams = {}
    for d, t in texts.items():
        w = WORD.findall(t or "")
        names = [*((x,) for x in w), *zip(w, w[1:], strict=False)]
        bucket = likelihood_rules.analysed(pa.array([t]), hasher).bucket.tolist()
        assert len(names) == len(bucket)
        same = {}
        assert all(same.setdefault(k, b) == b for k, b in zip(names, bucket, strict=True))  # equal n-grams share a bucket
        grams[d] = bucket
    raw, target = Counter(), Counter()
    for d, bs in grams.items():
        raw.update(bs)
        if mark.get(d) == 1 and fold(d) in (1, 2, 3):
            target.update(bs)
    share = sum(target.values()) / sum(raw.values())
    score = {d: sum(math.log((target[b] + 4) / (raw[b] * share + 4)) for b in bs) / max(1, len(bs)) for d, bs in grams.items()}
    tried = [(score[d], mark[d]) for d in texts if d in mark and fold(d) == 4 and not plain_counts(texts[d])[5]]
    good, bad = [s for s, y in tried if y], [s for s, y in tried if not y]
    gain = lambda c: sum(s < c for s in bad) / len(bad) - 10 * sum(s < c for s in good) / len(good)
    edges = [k / 1024 for k in range(-12 * 1024, 12 * 1024 + 2)]
    assert gain(rule.threshold) == pytest.approx(max(map(gain, edges)), abs=1e-9)
    out = likelihood_rules.judge(docs, rule).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= rule.threshold)


def test_rule_on_unseen_labels(spark):
    sf = "/root/testdata/sf0.1"
    mark = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    got = [(mark[r["doc_id"]], r["kept"]) for r in queries.op11_likelihood_rules(spark, sf).collect() if mark.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["n_words"] >= 50]
    good, bad = [k for y, k in got if y == 1], [k for y, k in got if y == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1


def test_rule_from_every_label(spark):
    """A hundred thousand trusted ids: all of the counting folds count."""
    n = 150_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one two").otherwise("one three").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 0).alias("quality")).union(docs.selectExpr("doc_id", "1").where("doc_id % 3 = 2"))
    ids = np.arange(n)
    trusted = (ids % 3 != 1) & np.isin([zlib.crc32(str(d).encode()) % 5 for d in range(n)], (1, 2, 3))
    grams = [np.bincount(likelihood_rules.analysed(pa.array([t]), WordHasher()).bucket, minlength=likelihood_rules.BUCKETS) for t in ("one two", "one three")]
    raw, target = (sum(np.count_nonzero(which & ((ids % 3 == 0) == (k == 0))) * g for k, g in enumerate(grams)) for which in (ids >= 0, trusted))
    assert np.array_equal(likelihood_rules.fit_rule(docs, labels).ratios, likelihood_rules.likelihood_ratios(raw, target))


def test_rule_defined_cases(spark, odd):  # noqa: F811
    kinds = "doc_id long, quality int, text string, good boolean"
    for marks in ([], [(0, 1, "x", True)], [(0, 0, "x", True), (1, 0, "x", None)], [(None, 1, None, None), (0, None, None, None), (7, 1, "", False), (7, 0, "", False)]):
        rule = likelihood_rules.fit_rule(odd, spark.createDataFrame(marks, kinds))
        out = likelihood_rules.judge(odd, rule)
        assert out.count() == odd.count() and out.where("kept and base_failed").count() == 0
    assert likelihood_rules.best_cut(np.array([5, 9]), np.array([0, 3]), np.array([2, 0]), 10) == 8 / 1024  # the middle of 6 to 9
    assert likelihood_rules.best_cut(np.array([5]), np.array([4]), np.array([4]), 10) * 1024 <= 5  # ties of both kinds: the good ones stay


# 12 vector codes ------------------------------------------------------------------------------------


def plain_codes(rows, parts=8):
    out = []
    kept = [(i, [math.floor(4096 * Fraction(x)) for x in v], x_) for i, v, x_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sums = Counter()
    for d in {len(v) for _, v, _ in kept}:
        ours = [k for k in kept if len(k[1]) == d]
        if d % parts:
            out += [(i, None, None, x_, None) for i, _, x_ in ours]
            continue
        m, start = d // parts, {}
        for i, v, _ in sorted((k for k in ours if k[0] is not None), key=lambda k: (k[0], k[1])):
            start.setdefault(i, v)
        books = [[v[p * m : p * m + m] for v in list(start.values())[:16]] for p in range(parts)]

        def near(p, v, books=books, m=m):
            far = [sum((a - b) ** 2 for a, b in zip(v[p * m : p * m + m], e, strict=True)) for e in books[p]]
            return far.index(min(far)), min(far)

        for _ in range(6):
            for p in range(parts):
                groups = {}
                for _, v, _ in ours:
                    groups.setdefault(near(p, v)[0], []).append(v[p * m : p * m + m])
                for e, xs in groups.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, x_ in ours:
            found = [near(p, v) for p in range(parts)]
            error = sum(f[1] for f in found)
            sums[x_] += error
            out.append((i, "".join(f"{f[0]:02x}" for f in found), error, x_, sha))
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(sums[x_]) if c else None, s) for i, c, e, x_, s in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, d int, __label int"


def coded(spark, rows):
    df = spark.createDataFrame([(*r, "c", "e", 3, 4) for r in rows], VECTORS)
    return sorted((tuple(r) for r in vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("size", [1, 3e4, 1e9, 1e20])
def test_codes_equal_brute_force(spark, size, monkeypatch):
    rng = np.random.RandomState(6)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i * 3 % 401, f32(rng.randn(16) * (size if i % 9 == 0 or i < 3 else 1)), [0, 1, None, 7][i % 4]) for i in range(220)]
    rows += [rows[1], (6, f32(rng.randn(16)), 1), (None, f32(rng.randn(16)), None)] + [(700 + i, rows[5][1], 1) for i in range(30)]
    rows += [(800, None, 1), (801, [], 1), (802, [1.0] * 15 + [None], 1), (803, [1.0] * 15 + [float("nan")], 1), (804, [float("-inf")] * 16, None), (805, [1.0] * 5, 1), (806, [0.5] * 24, None), (807, [0.25] * 24, None)]
    want = plain_codes(rows)
    assert coded(spark, rows) == want
    if size == 1:
        monkeypatch.setattr(vector_codes, "MOST_LABELS", 1)  # salted join
        assert coded(spark, rows) == want


def test_codes_of_few_vectors(spark):
    rows = [(i, [float(i)] * 8, None) for i in range(3)]
    assert coded(spark, rows) == plain_codes(rows) and coded(spark, []) == []


def test_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    got = sorted((tuple(r) for r in queries.op12_vector_codes(spark, "/root/testdata/sf0.001").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == plain_codes(rows)


def test_bounds_filter_entries():
    """Entries apart in mean or in norm never reach the exact distance."""
    rng = np.random.RandomState(2)
    near = np.floor(rng.randn(400, 8) * 20)
    book = vector_codes.Codebook(np.stack([np.full(8, k * 5000) for k in range(16)]))
    index, least, exact = vector_codes.nearest(near, book)
    assert (index == 0).all() and (exact == 1).all() and (least == (near**2).sum(1)).all()


# 13 periodic runs -----------------------------------------------------------------------------------


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(doc, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def ran(df):
    return sorted((tuple(r) for r in runs.periodic_runs(df).collect()), key=str)


def test_runs_of_periodic_texts(spark):
    rng, docs = random.Random(1), []
    for i in range(1500):
        letters, n, t = "abcdé"[: rng.choice([1, 2, 2, 3, 5])], rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), []
        while len(t) < n:
            base = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            t += (base * rng.randint(2, 9))[: rng.randint(1, 40)] if rng.random() < 0.4 else base[:1]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
    fib = ["a", "a b"]
    while len(fib[-1]) < 900:
        fib.append(f"{fib[-1]} {fib[-2]}")
    docs += [(5000, fib[-1]), (5001, "x " * 700), (5002, "a b c " * 300 + "a b"), (5003, ("a b " * 5 + "c ") * 6)]
    assert ran(spark.createDataFrame(docs, "doc_id long, text string")) == sorted((plain_row(*d) for d in docs), key=str)


def test_runs_of_the_corpus(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == sorted((plain_row(*d) for d in docs), key=str) and sum(r[1] > 0 for r in got) > len(docs) / 20


def test_runs_defined_cases(spark, odd, empty):  # noqa: F811
    plain = [(d, t) for d, t in pairs(odd) if len(t or "") < 5000 or " " not in t]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    assert ran(df) == sorted((plain_row(*d) for d in plain), key=str)
    assert runs.periodic_runs(odd).count() == odd.count() and runs.periodic_runs(empty).count() == 0


def test_runs_of_a_very_long_text(spark):
    """Above the size of a chunk: one word over and over, and two words without a pattern around a run."""
    rng = random.Random(3)
    noise = lambda n: " ".join("%x" % rng.getrandbits(40) for _ in range(n))
    words = CHUNK_BYTES // 10
    text = f"{noise(words)} {' '.join(['p q r'] * 1000)} {noise(words)}"
    one = "w " * CHUNK_BYTES
    docs = [d for d in range(1, 200) if zlib.crc32(str(d).encode()) % 10][:2]
    got = ran(spark.createDataFrame([(docs[0], text), (docs[1], one)], "doc_id long, text string"))
    assert [r[:6] for r in got] == [(docs[0], 1, words, 3000, 3, 1_000_000), (docs[1], 1, 0, CHUNK_BYTES, 1, 1000 * CHUNK_BYTES)]
