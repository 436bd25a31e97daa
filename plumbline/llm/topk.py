"""Exact top-k inner-product search by distributed histogram selection.

Components become floor(scale * x). A block of queries is scored against every candidate. Each pass adds up one
histogram of scores per query over all partitions and narrows the query's interval to the bin that holds its k-th
best score, until the k-th score is known exactly. Then scores above it are kept, and of those equal to it the smallest ids
that are still needed.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; a query with fewer than k
candidates returns all; vectors meet only vectors of their own length; rows with a null id take no part; repeated rows of
an id are candidates each, and a query id that repeats is asked once (its first vector in component order). A candidate with the query's
own id is never returned. Only vec_id and embedding are read, so other columns cannot clash.

Scores of two vectors of a squared length below 2^61 (after scaling) fit a long. Pairs with a longer vector go another way: floating
bounds leave few candidates of each task, these get exact scores in Python integers, and the best of both ways are merged by exact
score. Such a score is null in the result where it does not fit a long; its rank counts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BINS = 256
#: Squared length from which a score need not fit a long.
LONG = 2.0**61
#: Added to exact scores for sorting them as text: beyond any sum of products of doubles of up to 2^500.
OFFSET, DIGITS = 1 << 1100, 276
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): whole-number components, as doubles, of the vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & fine)
    # from 2^52 on a double is a whole number
    whole = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: whole(F.lit(scale) * c.cast("double"))).alias("v"))


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def _matrix(batch: pa.RecordBatch, d: int, kind) -> np.ndarray:
    column = batch.column("v")
    return np.asarray(column.flatten(), np.float64).reshape(-1, d).astype(kind)


def _scores(batches, queries: tuple[np.ndarray, np.ndarray], kind, rows: int = 1024):
    """(scores as int64 with the query's own id left out by a mask, candidate ids) chunk by chunk."""
    ids, q = queries
    q = q.astype(kind)
    for batch in batches:
        own = batch.column("vec_id").to_numpy()
        m = _matrix(batch, q.shape[1], kind)
        for lo in range(0, len(own), rows):
            part = own[lo : lo + rows]
            s = m[lo : lo + rows] @ q.T
            yield s if kind is np.int64 else np.rint(s).astype(np.int64), part[:, None] == ids[None, :], part


def _search_block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, low: int, high: int, k: int, kind) -> DataFrame:
    """Top k of one block of queries against all vectors of its dimension; scores lie in [low, high]."""
    spark = vectors.sparkSession
    n = len(ids)
    lo, width = np.full(n, low, np.int64), np.full(n, max(1, -(-(high - low + 1) // BINS)), np.int64)
    span = np.full(n, high - low + 1, np.int64)
    above = np.zeros(n, np.int64)  # candidates with a score beyond the interval
    done = False
    while not done:
        state = spark.sparkContext.broadcast((ids, q, lo, width, span))

        def count(batches, state=state):
            i, vectors_, base, step, reach = state.value
            total = np.zeros((len(i), BINS), np.int64)
            row = np.arange(len(i)) * BINS
            for s, same, _ in _scores(batches, (i, vectors_), kind):
                b = (s - base) // step
                good = (s >= base) & (s - base < reach) & ~same
                total += np.bincount((b + row)[good], minlength=len(i) * BINS).reshape(-1, BINS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total.ravel()[at], pa.int64())})

        histogram = np.zeros(n * BINS, np.int64)
        got = vectors.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most queries of a block * BINS
        histogram[np.asarray(got.column("cell"))] = np.asarray(got.column("n"))
        histogram = histogram.reshape(n, BINS)
        from_top = above[:, None] + np.cumsum(histogram[:, ::-1], axis=1)[:, ::-1]  # candidates in this bin or beyond
        holds = from_top >= k
        bin_ = np.where(holds.any(1), BINS - 1 - np.argmax(holds[:, ::-1], axis=1), 0)
        few = ~holds.any(1)
        above = np.where(few, above, np.where(bin_ + 1 < BINS, np.take_along_axis(from_top, np.minimum(bin_ + 1, BINS - 1)[:, None], 1)[:, 0], above))
        lo = np.where(few, low, lo + bin_ * width)
        done = bool((width[~few] == 1).all()) if (~few).any() else True
        span = np.where(few, span, width)
        width = np.where(few, width, np.maximum(1, -(-width // BINS)))
    state = spark.sparkContext.broadcast((ids, q, lo))

    def pick(batches):
        i, vectors_, kth = state.value
        held: list[np.ndarray] = []
        size = 0

        def best(parts):
            t = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            t = t[np.lexsort((t[:, 1], -t[:, 2], t[:, 0]))]
            first = np.searchsorted(t[:, 0], t[:, 0])
            return t[np.arange(len(t)) - first < k]

        for s, same, own in _scores(batches, (i, vectors_), kind):
            a, b = np.nonzero((s >= kth) & ~same)
            held.append(np.stack((b, own[a], s[a, b]), axis=1))
            size += len(a)
            if size > 1 << 20:
                held = [best(held)]
                size = -len(held[0])
        t = best(held)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(i[t[:, 0]], pa.int64()), "vec_id": pa.array(t[:, 1], pa.int64()), "score": pa.array(t[:, 2], pa.int64())})

    found = vectors.mapInArrow(pick, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sortable(score: int) -> str:
    return f"{score + OFFSET:0{DIGITS}x}"


def _long_pairs(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, place, score): the best k of each task's candidates for each query by exact score; `place` sorts as the scores do."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def best(batches):
        own_ids, own_q = shared.value
        whole_q = [[int(x) for x in v] for v in own_q]
        length_q = np.sqrt((own_q**2).sum(1))
        held: list[list[tuple[int, int]]] = [[] for _ in own_ids]  # (-score, vec_id), best first
        for batch in batches:
            every, all_ids = _matrix(batch, own_q.shape[1], np.float64), batch.column("vec_id").to_numpy()
            for at in range(0, len(all_ids), 256):
                m, vec = every[at : at + 256], all_ids[at : at + 256]
                with np.errstate(all="ignore"):  # what overflows is not left out
                    about = own_q @ m.T
                    off = len(own_q[0]) * 2.0**-48 * np.outer(length_q, np.sqrt((m**2).sum(1)))
                    least = np.where(np.isnan(about - off), -np.inf, about - off)
                    most = np.where(np.isnan(about + off), np.inf, about + off)
                for j, own in enumerate(own_ids):
                    other = vec != own
                    n = int(other.sum())
                    if not n:
                        continue
                    floor = np.partition(least[j][other], max(0, n - k))[max(0, n - k)]
                    new = []
                    for c in np.flatnonzero(other & (most[j] >= floor)):
                        new.append((-sum(a * int(b) for a, b in zip(whole_q[j], m[c], strict=True)), int(vec[c])))
                    held[j] = sorted(held[j] + new)[:k]
        rows = [(int(i), v, -s) for i, own in zip(own_ids, held, strict=True) for s, v in own]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([_sortable(r[2]) for r in rows], pa.string()), pa.array([r[2] if -(1 << 63) <= r[2] < 1 << 63 else None for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "place", "score"])

    return vectors.mapInArrow(best, "query_id long, vec_id long, place string, score long")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, block: int = 4096) -> DataFrame:
    """The k best candidates of `vectors` for each row of `queries`, both (vec_id, embedding); queries go in blocks of `block`."""
    spark = vectors.sparkSession
    table = quantised(vectors, scale).withColumn("long", _square(F.col("v")) >= LONG)
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("long", _square(F.col("v")) >= LONG)
    out: list[DataFrame] = []
    sizes = asked.groupBy(F.size("v").alias("d"), "long").agg(F.count("*").alias("n")).collect()
    for d in sorted({r["d"] for r in sizes}):
        own = table.where(F.size("v") == d)
        short, many = own.where(~F.col("long")).drop("long"), own.where("long").drop("long")
        norm = lambda df: df.agg(F.max(F.when(~F.col("long"), _square(F.col("v")))).alias("m"), F.coalesce(F.bool_or("long"), F.lit(False)).alias("long")).first()
        mine = asked.where(F.size("v") == d)
        at, mine_at = norm(own), norm(mine)
        most, mine_most = at["m"] or 0.0, mine_at["m"] or 0.0
        reach = int(np.ceil(np.sqrt(most * mine_most))) + 1
        # the first kind in which all partial sums stay exact
        kind = np.float32 if max(most, mine_most) < 1 << 23 else np.float64 if reach < 1 << 52 else np.int64
        for far in (False, True):
            cuts = -(-sum(r["n"] for r in sizes if r["d"] == d and r["long"] == far) // block)
            chosen = mine.where(F.col("long") == far).drop("long")
            numbered = cut(chosen) if cuts > 1 else chosen
            for c in range(cuts):
                rows = (numbered.where(F.pmod(F.xxhash64("vec_id"), F.lit(cuts)) == c) if cuts > 1 else numbered).orderBy("vec_id").toArrow()  # one block
                if not rows.num_rows:
                    continue
                q, ids = np.asarray(rows.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d), np.asarray(rows.column("vec_id"))
                if far:
                    found = [_long_pairs(own.drop("long"), ids, q, k)]
                else:
                    found = [_search_block(short, ids, q, -reach, reach, k, kind)]
                    if not at["long"]:
                        out += found
                        continue
                    found = [found[0].withColumn("place", F.udf(lambda x: _sortable(x), "string")("score")).select("query_id", "vec_id", "place", "score"), _long_pairs(many, ids, q, k)]
                rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id"))
                merged = reduce(DataFrame.unionByName, found).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
                out.append(merged.select("query_id", "rank", "vec_id", "score"))
    if not out:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, out)
