"""Isolation forest: trees grown in parallel on bounded hash samples, path lengths of all rows, the flagged share by an exact quantile."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch

from .ranks import quantiles

NODE = "tree int, node int, feature int, split double, left int, right int, size long"


def mean_path(n) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows: what a leaf of n rows stands for."""
    n = np.asarray(n, np.float64)
    more = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> list[tuple]:
    """Nodes (feature, split, left, right, size) of one tree; leaves have the feature -1. A split takes a random feature that is not constant, at a random place between its least and greatest value."""
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        own = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if depth < deepest and len(open_):
            f = int(rng.choice(open_))
            split = rng.uniform(low[f], high[f])
            if not low[f] < split <= high[f]:
                split = high[f]
            small = x[rows, f] < split
            nodes[own][:2] = f, float(split)
            nodes[own][2] = add(rows[small], depth + 1)
            nodes[own][3] = add(rows[~small], depth + 1)
        return own

    add(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    """All trees in one set of arrays; left and right are places in it."""

    root: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    rows: int
    deepest: int

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the steps to a row's leaf and of what that leaf stands for."""
        total, own = np.zeros(len(x)), np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.deepest):
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                to = np.where(x[own, np.maximum(self.feature[node], 0)] < self.split[node], self.left[node], self.right[node])
                node = np.where(inner, to, node)
                total += inner
            total += self.leaf[node]
        return total / len(self.root)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-path length / mean path length): near 1 for rows that few cuts set apart, near 0.5 for ordinary ones."""
        return 2.0 ** (-self.path_lengths(x) / max(float(mean_path(self.rows)), 1e-12))


def matrix(df: DataFrame, features: Sequence[str], *also: str) -> DataFrame:
    """(also ..., x): the features as one array of doubles; nulls and nans are 0."""
    return df.select(*also, F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features)).alias("x"))


def tree_samples(df: DataFrame, row_id: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, spot, x): half as many rows again as a tree takes, chosen by hashes of id and seed; every tree's rows are a sample of the whole table without repetition. Of rows that share an id one counts."""
    share = min(1.0, 1.5 * sample / max(1, df.count()))
    slots = -(-trees * share // 1)
    width = trees * share / slots  # of a slot's hashes that choose a tree
    spot = F.pmod(F.xxhash64(row_id, "slot", F.lit(seed)), F.lit(1 << 50)) / F.lit(float(1 << 50))
    rows = df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(int(slots) - 1)))).withColumn("spot", spot).where(F.col("spot") < width)
    tree = F.least(F.floor((F.col("slot") + F.col("spot") / width) * (trees / slots)), F.lit(trees - 1)).cast("int")
    return rows.withColumn("tree", tree).groupBy("tree", row_id).agg(F.min_by("x", "spot").alias("x")).withColumn("spot", F.xxhash64(row_id, "tree", F.lit(seed + 1))).select("tree", "spot", "x")


def fit(df: DataFrame, row_id: str, features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> Forest | None:
    """The forest of a table; None for an empty one. What reaches the driver is at most trees * 2 * sample nodes."""
    rows = matrix(df, features, row_id)
    deepest = max(1, int(np.ceil(np.log2(max(2, sample)))))

    def one(key, group):
        first = group.sort_values("spot").head(sample)
        nodes = grow(np.stack(first["x"].to_numpy()), np.random.default_rng([seed, int(key[0])]), deepest)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "size"])
        return out.assign(tree=key[0], node=np.arange(len(out)))[["tree", "node", "feature", "split", "left", "right", "size"]]

    grown = tree_samples(rows, row_id, trees, sample, seed).groupBy("tree").applyInPandas(one, NODE).orderBy("tree", "node").toPandas()
    if not len(grown):
        return None
    root = np.flatnonzero(grown["node"].to_numpy() == 0)
    base = root[np.cumsum(grown["node"].to_numpy() == 0) - 1]
    leaf = np.where(grown["feature"] < 0, mean_path(grown["size"].to_numpy()), 0.0)
    place = lambda c: grown[c].to_numpy() + base
    return Forest(root, grown["feature"].to_numpy(), grown["split"].to_numpy(), place("left"), place("right"), leaf, int(grown["size"].to_numpy()[root].max()), deepest)


def scored(df: DataFrame, row_id: str, features: Sequence[str], forest: Forest) -> DataFrame:
    """(row_id, score) of every row."""
    shared, kind = df.sparkSession.sparkContext.broadcast(forest), df.schema[row_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.array(shared.value.scores(x))], names=[row_id, "score"])

    return matrix(df, features, row_id).mapInArrow(run, f"{row_id} {kind}, score double")


def anomalies(df: DataFrame, row_id: str, features: Sequence[str], contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(row_id, score, decision, flagged): flagged rows score above the exact (1 - contamination) quantile of all scores; decision is what is left up to it, below 0 if flagged.

    An empty table gives an empty one; equal rows have equal scores, so ties at the cut are not flagged; the same seed gives the same forest whatever the partitions.
    """
    forest = fit(df, row_id, features, trees, sample, seed)
    if forest is None:
        return df.select(row_id, F.lit(0.0).alias("score"), F.lit(0.0).alias("decision"), F.lit(False).alias("flagged"))
    path = scratch(df.sparkSession)
    scored(df, row_id, features, forest).write.parquet(path)
    scores = df.sparkSession.read.parquet(path)
    cut = quantiles(scores, [], "score", {"__cut": 1 - contamination})  # one row
    return scores.crossJoin(F.broadcast(cut)).select(row_id, "score", (F.col("__cut") - F.col("score")).alias("decision"), (F.col("score") > F.col("__cut")).alias("flagged"))
