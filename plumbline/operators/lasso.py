"""L1 regularisation path with cross-validation from one Gram matrix per fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, features: Sequence[str], target: str, fold: Column) -> DataFrame:
    """(fold, x): 1, the features with mean 0 and deviation 1 over the whole table (constant ones 0), and the target less its mean. Nulls and nans count as 0."""
    fill = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    names = [*features, target]
    m = df.agg(*(f(fill(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = [F.when(F.lit((m[f"s{i}"] or 0.0) > 0), (fill(c) - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"] or 1.0)).otherwise(0.0) for i, c in enumerate(features)]
    return df.select(fold.cast("int").alias("fold"), F.array(F.lit(1.0), *scaled, fill(target) - F.lit(m[f"m{len(features)}"] or 0.0)).alias("x"))


def grams(rows: DataFrame, width: int, folds: int) -> np.ndarray:
    """x'x of each fold: (folds, width, width). A task gives one matrix a fold, whatever its rows."""

    def run(batches):
        total = np.zeros((folds, width, width))
        for batch in batches:
            x, f = np.asarray(batch.column("x").flatten()).reshape(-1, width), np.asarray(batch.column("fold"))
            for k in np.unique(f):
                own = x[f == k]
                total[k] += own.T @ own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "v"])

    got = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(folds * width * width)
    out[np.asarray(got.column("cell"))] = np.asarray(got.column("v"))
    return out.reshape(folds, width, width)


def descend(c: np.ndarray, b: np.ndarray, n: float, penalty: float, w: np.ndarray, most: int = 10_000, least: float = 1e-10) -> np.ndarray:
    """Weights of least |y - xw|^2 / 2n + penalty * |w| by coordinate descent, from the centred x'x = c and x'y = b."""
    w = w.copy()
    for _ in range(most):
        moved = 0.0
        for j in np.flatnonzero(np.diag(c) > 1e-12 * max(n, 1)):
            r = b[j] - c[j] @ w + c[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - n * penalty, 0.0) / c[j, j]
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved <= least * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def _centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    """(x'x, x'y, n, mean x, mean y) of one Gram matrix, with the means taken out."""
    n = g[0, 0]
    mean, mean_y = g[0, 1:-1] / n, g[0, -1] / n
    return g[1:-1, 1:-1] - n * np.outer(mean, mean), g[1:-1, -1] - n * mean * mean_y, n, mean, mean_y


@dataclass
class Path:
    penalties: np.ndarray
    errors: np.ndarray  # mean over the folds of the squared error on the fold left out
    weights: np.ndarray  # of the standardised features at `penalty`
    penalty: float


def path(g: np.ndarray, steps: int = 100, span: float = 1e-3) -> Path | None:
    """The penalties from the least that sets all weights to 0 down to `span` of it, their held-out errors, and the weights at the best; None without rows. Folds that are empty, or hold all rows, are left out."""
    whole = g.sum(0)
    if whole[0, 0] == 0:
        return None
    c, b, n, _, _ = _centred(whole)
    top = float(np.abs(b).max(initial=0) / n)
    penalties = np.geomspace(top, top * span, steps) if top > 0 else np.zeros(1)
    errors = []
    for out in g:
        if out[0, 0] == 0 or out[0, 0] == whole[0, 0]:
            continue
        ci, bi, ni, mean, mean_y = _centred(whole - out)
        w, own = np.zeros(len(bi)), []
        for penalty in penalties:
            w = descend(ci, bi, ni, penalty, w)
            v = np.concatenate(([mean @ w - mean_y], -w, [1.0]))  # y - prediction of a row (1, x, y)
            own.append(max(0.0, v @ out @ v) / out[0, 0])
        errors.append(own)
    errors = np.mean(errors, axis=0) if errors else np.zeros(len(penalties))
    best = int(np.argmin(errors))
    w = np.zeros(len(b))
    for penalty in penalties[: best + 1]:
        w = descend(c, b, n, penalty, w)
    return Path(penalties, errors, w, float(penalties[best]))


def components(g: np.ndarray) -> np.ndarray:
    """Shares of the variance that the principal components of the standardised features explain, greatest first."""
    values = np.sort(np.linalg.eigvalsh(_centred(g.sum(0))[0]))[::-1]
    return np.maximum(values, 0) / max(values.sum(), 1e-300)


def select_features(df: DataFrame, features: Sequence[str], target: str, by: Column, folds: int = 5) -> DataFrame:
    """(feature, coefficient, selected, penalty, error): weights of the standardised features at the penalty with the least held-out error. `by` deals rows into folds by its hash. An empty table gives an empty one."""
    rows = standardised(df, features, target, F.pmod(F.xxhash64(by), F.lit(folds)))
    found = path(grams(rows, len(features) + 2, folds))
    out = [] if found is None else [(f, float(w), bool(w != 0), found.penalty, float(found.errors.min())) for f, w in zip(features, found.weights, strict=True)]
    return df.sparkSession.createDataFrame(out, "feature string, coefficient double, selected boolean, penalty double, error double")


def explained(df: DataFrame, features: Sequence[str], target: str, most: int = 10) -> DataFrame:
    """(component, share, running) of the first principal components."""
    share = components(grams(standardised(df, features, target, F.lit(0)), len(features) + 2, 1))[:most]
    return df.sparkSession.createDataFrame([(i + 1, float(s), float(t)) for i, (s, t) in enumerate(zip(share, np.cumsum(share), strict=True))], "component int, share double, running double")
