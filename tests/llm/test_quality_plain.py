"""Features, weights and cut of the pairwise ranking against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import quality
from plumbline.llm.common import CHUNK_BYTES, WordHasher


def kind(b: int) -> int:
    if b >= 128:
        return 6
    c = chr(b)
    groups = ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, " \t\r"), (5, "\n"), (7, ",.;:'"), (8, "!?"), (9, "|<>{}[]\\"))
    return next((k for k, of in groups if c in of), 0)


def plain_features(text: str | None) -> list[float]:
    data = (text or "").encode()
    n, kinds = max(1, len(data)), Counter(map(kind, data))
    out = [kinds[k] / n for k in range(10)]
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    many, count = max(1, len(w)), Counter(w)
    widths = [len(x.encode()) for x in w]
    mean = sum(widths) / many
    out += [mean / 10, math.sqrt(max(0, sum(x * x for x in widths) / many - mean * mean)) / 10, len(count) / many, max(count.values(), default=0) / many, math.log1p(len(w)) / 10, math.log1p(len(w) - len(count)) / 10, sum(a == b for a, b in zip(w, w[1:], strict=False)) / many]
    return out + [math.sqrt(x) for x in out[:10]] + [x * x for x in out[10:]]


def test_features_equal_plain_counts():
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a", "The the THE. <b> 12,5!? {x}\\|", "Ünï ünï\r\ncödé\x0bé é", "x " * (CHUNK_BYTES // 2 + 9), "".join(chr(rng.choice([*range(9, 14), *range(32, 127), 233, 0x4E2D, 0x1F600])) for _ in range(3000))]
    got = quality.features(pa.array(texts), WordHasher())
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_features(text), abs=1e-12)


def test_weights_and_cut():
    rng = np.random.RandomState(4)
    x = rng.randn(240, 5) * [1, 10, 1, 0.1, 0]
    label = (x[:, 0] + 0.05 * x[:, 1] + 0.5 * rng.randn(240) > -0.3).astype(int)
    model = quality.fit_ranking(x, label, steps=4000)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    good, bad = z[label == 1], z[label == 0]
    # the loss over all pairs, ridge included, is near its least value: no small step of a weight lowers it by much
    apart = (good[:, None, :] - bad[None, :, :]).reshape(-1, 5)
    loss = lambda w: np.log1p(np.exp(-apart @ w)).mean() + 5e-4 * (w**2).sum()
    w = model.weights.copy()
    best = w.copy()
    for _ in range(3000):
        best -= 0.5 * (-(apart / (1 + np.exp(apart @ best))[:, None]).mean(0) + 1e-3 * best)
    assert loss(w) <= loss(best) + 0.01 and abs(w[4]) < 1e-9 and w[0] > 0 < w[1]
    # the cut has the best balanced accuracy of all places between two scores
    raw = z @ w
    balanced = lambda c: ((raw[label == 0] <= c).mean() + (raw[label == 1] > c).mean()) / 2
    edges = np.sort(raw)
    assert balanced(model.cut) == pytest.approx(max(balanced((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)))
    score = model.score(x)
    assert ((score >= model.threshold) == (raw >= model.cut)).all() and (np.argsort(score, kind="stable") == np.argsort(raw, kind="stable")).all()
    same = quality.fit_ranking(x, label, steps=4000)
    assert np.array_equal(same.weights, model.weights) and same.cut == model.cut


def test_ties_at_the_cut():
    """Equal scores fall on one side of the cut, whichever labels they have."""
    x = np.repeat([[0.0], [1.0], [2.0]], 20, axis=0)
    label = np.r_[np.zeros(20), np.tile([0, 1], 10), np.ones(20)].astype(int)
    model = quality.fit_ranking(x, label)
    said = model.score(x) >= model.threshold
    assert all(len(set(said[k : k + 20])) == 1 for k in (0, 20, 40)) and not said[0] and said[40]
