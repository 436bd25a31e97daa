"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs (a text labelled good over a text labelled bad) train a linear score by logistic loss on
the difference of their features. The cut is a quantile of the training scores: among all quantiles the one
with the best balanced accuracy. The scores are mapped to 0..1 so that this cut lies at `threshold`.

Defined cases: a null text counts as empty; empty texts have the features of an empty text and are scored like any other;
rows with a null id are scored but never used for fitting; several labels of one id count as the lowest; without labels of
both kinds every score is 1. Only doc_id, text and held_out are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, WordHasher, cut, lean, padded, raw_text, slices, string_batch, words

N_BASE = 17


def _group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return run[bounds[1:]] - run[bounds[:-1]]


def _byte_classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)  # 0: other symbol
    kind[97:123] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    kind[[32, 9, 13]] = 4
    kind[10] = 5
    kind[128:] = 6
    kind[[44, 46, 59, 58, 39]] = 7
    kind[[33, 63]] = 8
    kind[[124, 60, 62, 123, 125, 91, 93, 92]] = 9
    return kind


KIND = _byte_classes()


def features(array: pa.Array, hasher: WordHasher) -> np.ndarray:
    """A row of features per text: shares of byte classes, word shapes, repetition and length."""
    data, offsets = raw_text(array)
    n = len(offsets) - 1
    length = np.diff(offsets).astype(np.float64)
    some = np.maximum(length, 1)
    kinds = KIND[data]
    out = np.zeros((n, N_BASE))
    for k in range(10):
        out[:, k] = _group_sums(kinds == k, offsets) / some
    buffer, starts = padded(LOWER[data] if len(data) else data, offsets)
    s, e = words(buffer, NOT_SPACE)
    doc = np.searchsorted(starts, s, side="right") - 1
    count = np.bincount(doc, minlength=n).astype(np.float64)
    many = np.maximum(count, 1)
    width = (e - s).astype(np.float64)
    out[:, 10] = np.bincount(doc, width, n) / many / 10
    out[:, 11] = np.sqrt(np.maximum(0, np.bincount(doc, width**2, n) / many - (np.bincount(doc, width, n) / many) ** 2)) / 10
    h = hasher.hashes(buffer, s, e) if len(s) else np.zeros(0, np.uint64)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.concatenate((at, [len(v)])))
    out[:, 12] = np.bincount(d[at], minlength=n) / many
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    out[:, 13] = top / many
    out[:, 14] = np.log1p(count) / 10
    out[:, 15] = np.log1p(np.bincount(doc, minlength=n) - np.bincount(d[at], minlength=n)) / 10
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, 16] = np.bincount(doc[1:][same], minlength=n) / many
    return np.concatenate((out, np.sqrt(out[:, :10]), out[:, 10:] ** 2), axis=1)


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    threshold: float
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights
        t = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + t, -60, 60)))


def fit_ranking(x: np.ndarray, label: np.ndarray, threshold: float = 0.3, pairs_per_row: int = 8, steps: int = 400, rate: float = 0.3, ridge: float = 1e-3, seed: int = 11) -> RankModel | None:
    """Bradley-Terry weights from preference pairs; None without both labels."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    rng = np.random.RandomState(seed)
    m = pairs_per_row * max(len(good), len(bad))
    difference = z[good[rng.randint(0, len(good), m)]] - z[bad[rng.randint(0, len(bad), m)]]
    w, velocity = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(difference @ w, -60, 60)))
        gradient = -(difference * p[:, None]).mean(0) + ridge * w
        velocity = 0.9 * velocity - rate * 0.1 * gradient
        w += velocity
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    ranked, bads = raw[order], (label[order] == 0)
    caught = np.cumsum(bads) / bads.sum()
    lost = np.cumsum(~bads) / (~bads).sum()
    quality = np.where(np.append(ranked[1:] > ranked[:-1], True), (caught + 1 - lost) / 2, -1)
    k = int(np.argmax(quality))
    cut = (ranked[k] + ranked[min(k + 1, len(ranked) - 1)]) / 2
    spread = max(1e-9, float(np.median(raw[good]) - np.median(raw[bad])))
    return RankModel(mean, scale, w, float(cut), 8.0 / spread, threshold, (k + 1) / len(ranked))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample: of each label the `per_label` ids lowest by hash, every row of them up to that number."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    # a share of each label by hash that holds enough ids, so that the ranking sees few more than are taken
    marks, span = cut(marks), 1 << 30
    count = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    share = lambda y: int(span * min(1.0, (1.2 * per_label + 400) / max(1, count.get(y, 0))))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("spot", "doc_id"))
    marks = marks.withColumn("spot", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(span))).where(F.col("spot") <= F.when(F.col("label") == 1, share(1)).otherwise(share(0)))
    marks = marks.withColumn("r", rank).where(F.col("r") <= per_label).select("doc_id", "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # at most 2 * per_label rows of 12 bytes
    width = N_BASE * 2

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                f = features(part.column("text"), hasher)
                yield pd.DataFrame({"doc_id": part.column("doc_id").to_pandas(), "label": part.column("label").to_pandas(), "x": list(f)})

    got = rows.mapInArrow(lambda it: (pa.RecordBatch.from_pandas(p, schema=_SAMPLE, preserve_index=False) for p in run(it)), "doc_id long, label int, x array<double>")
    spot = F.xxhash64("doc_id", F.col("x").cast("string"))
    got = got.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(spot))).where(F.col("r") <= per_label).orderBy("doc_id", spot).select("label", "x").toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, width) if got.num_rows else np.zeros((0, width))
    return x, np.asarray(got.column("label"))


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def score_quality(docs: DataFrame, model: RankModel | None) -> DataFrame:
    """Score each row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ranking, hasher = shared.value, WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                if ranking is None:
                    score = np.ones(part.num_rows)
                    cut = 0.0
                else:
                    score = ranking.score(features(part.column("text"), hasher))
                    cut = ranking.threshold
                yield string_batch(SCHEMA, doc_id=part.column("doc_id"), held_out=part.column("held_out"), score=score, predicted=(score >= cut).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: RankModel | None) -> DataFrame:
    """The rows of docs whose score reaches the cut, with all their columns."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ranking, hasher = shared.value, WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(ranking.score(features(part.column("text"), hasher)) >= ranking.threshold))

    return docs.mapInArrow(lean(run), docs.schema)
