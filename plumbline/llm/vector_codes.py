"""Product codes of whole-number vectors, with segment-mean lower bounds in front of exact distances.

Components become floor(4096 * x). A vector is cut into equal parts; each part has a codebook of 16 entries, which rounds of
assignment and componentwise floor means refine. The nearest entry of a part is found coarse to fine: the means of one, two, four ...
blocks and the norms of what the means leave over bound each distance from below; an entry whose bound lies above the exact distance
of a first guess is filtered out, with a margin for rounding, and the survivors get exact integer distances (ties: the lower index).
A round is one pass over the vectors; tasks give sums per entry and component only, so what reaches the driver is as large as the
codebooks, whatever the number of vectors.

Defined cases: vectors that are null, empty, or hold a null or non-finite component are dropped; vectors of different lengths have
codebooks of their own; a length that the number of parts does not divide is carried with null code, errors and digest. Start
entries are the smallest different vec_ids (of rows that repeat one: its smallest vector), fewer if there are fewer; a row with a
null vec_id is coded like any other but is no start entry. Distances and sums are exact whatever the size of the components; an
error or a sum of errors that does not fit a long is null. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors handled at once by the kernels.
ROWS = 4096
#: Of the squared norms of both sides; rounding of a bound is some 1e-14 of them.
MARGIN = 1e-9
#: Sums travel in limbs of this many bits, so that adding up 2^22 tasks stays within a long.
LIMB = 40
#: Labels whose error sums are broadcast (16 bytes each); beyond, the join is by salted keys.
MOST_LABELS, SALTS = 1 << 16, 64


def takes_part(x: Column) -> Column:
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def exact_ints(v: np.ndarray) -> np.ndarray:
    """Whole doubles as int64 where all of them are small, else as Python integers."""
    if not v.size or np.abs(v).max() < 2.0**62:
        return v.astype(np.int64)
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


@dataclass
class Codebook:
    """Entries of one part: exact integers and their doubles (entries x components)."""

    whole: np.ndarray

    def __post_init__(self):
        self.real = self.whole.astype(np.float64)
        self.levels = _levels(self.real)
        self.norm = np.sqrt((self.real**2).sum(1))
        self.reach = np.abs(self.real).max(1)


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block widths, block means, norms of the residuals) for one, two, four ... blocks, as long as blocks have two components."""
    m, out, blocks = x.shape[1], [], 1
    while blocks == 1 or 2 * blocks <= m:
        edge = np.arange(blocks + 1) * m // blocks
        width = np.diff(edge)
        mean = np.add.reduceat(x, edge[:-1], axis=1) / width
        rest = x - np.repeat(mean, width, axis=1)
        out.append((width, mean, np.sqrt((rest**2).sum(1))))
        blocks *= 2
    return out


def _bound(level_x, level_c, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of the pairs (i, j): means and residual norms apart are at least so far."""
    width, mean_x, rest_x = level_x
    _, mean_c, rest_c = level_c
    if len(width) == 1:  # all pairs
        return ((mean_x - mean_c.T) ** 2 * width[0] + (rest_x[:, None] - rest_c) ** 2).ravel()
    apart = mean_x[i] - mean_c[j]
    return np.einsum("ij,ij,j->i", apart, apart, width.astype(np.float64)) + (rest_x[i] - rest_c[j]) ** 2


def _distances(x: np.ndarray, reach: np.ndarray, book: Codebook, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs: in doubles or int64 where all sums stay exact, in Python integers where not."""
    most = x.shape[1] * (reach.max() + book.reach.max()) ** 2
    if most < 2.0**52:
        apart = x[i] - book.real[j]
        return np.einsum("ij,ij->i", apart, apart).astype(np.int64)
    far = x.shape[1] * (reach[i] + book.reach[j]) ** 2 >= 2.0**62
    out, near = np.empty(len(i), object), np.flatnonzero(~far)
    out[near] = ((x[i[near]].astype(np.int64) - book.whole[j[near]].astype(np.int64)) ** 2).sum(1)
    for k in np.flatnonzero(far):
        out[k] = sum((int(a) - int(b)) ** 2 for a, b in zip(x[i[k]], book.whole[j[k]], strict=True))
    return out


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry, exact squared distance, exact distances computed) for each row of whole doubles x."""
    n, k = len(x), len(book.whole)
    with np.errstate(all="ignore"):  # what overflows to inf or nan is not filtered
        levels = _levels(x)
        norm, reach = np.sqrt((x**2).sum(1)), np.abs(x).max(1)
        low = _bound(levels[0], book.levels[0], None, None)
        guess = np.argmin(np.where(np.isnan(low), np.inf, low).reshape(n, k), axis=1)
        top = _distances(x, reach, book, np.arange(n), guess).astype(np.float64)
        most = (top[:, None] + MARGIN * (norm[:, None] + book.norm[None, :]) ** 2).ravel()
        left = np.flatnonzero(~(low > most))
        i, j = left // k, left % k
        for level_x, level_c in zip(levels[1:], book.levels[1:], strict=True):
            ours = ~(_bound(level_x, level_c, i, j) > most[left])
            i, j, left = i[ours], j[ours], left[ours]
    d = _distances(x, reach, book, i, j)
    row = np.searchsorted(i, np.arange(n))
    least = np.minimum.reduceat(d, row)
    hit = np.flatnonzero(d == least[i])  # pairs come by row, then entry
    first = hit[np.searchsorted(i[hit], np.arange(n))]
    return j[first], least, np.diff(np.append(row, len(i)))


def _by_length(batches, rows: int = ROWS):
    """(sub-batch, its vectors as whole doubles) with one length each."""
    for batch in batches:
        size = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
        for d in np.unique(size):
            own = batch.filter(pa.array(size == d))
            for lo in range(0, own.num_rows, rows):
                part = own.slice(lo, rows)
                yield part, np.floor(SCALE * np.asarray(part.column("embedding").flatten(), np.float64).reshape(-1, d))


def start_entries(vectors: DataFrame, parts: int, entries: int) -> dict[int, list[Codebook]]:
    """The codebooks of the first vec_ids for each length: at most `entries` rows of a length reach the driver."""
    size = F.size("embedding").alias("d")
    rows = vectors.where(F.col("vec_id").isNotNull()).where(F.size("embedding") % parts == 0).select(size, "vec_id", "embedding")

    def few(batches):
        held: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for d in np.unique(batch.column("d")):
                own = batch.filter(pc.equal(batch.column("d"), int(d)))
                ids = np.unique(own.column("vec_id"))[:entries]
                best = held.setdefault(int(d), {})
                some = own.filter(pc.is_in(own.column("vec_id"), pa.array(ids, pa.int64())))
                for i, v in zip(some.column("vec_id").to_pylist(), some.column("embedding").to_pylist(), strict=True):
                    best[i] = min(best.get(i, tuple(v)), tuple(v))
                held[int(d)] = dict(sorted(best.items())[:entries])
        for d, best in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(best), pa.int32()), "vec_id": pa.array(list(best), pa.int64()), "embedding": pa.array([list(v) for v in best.values()], pa.list_(pa.float64()))})

    got = rows.mapInArrow(few, "d int, vec_id long, embedding array<double>").groupBy("d", "vec_id").agg(F.min("embedding").alias("embedding"))
    got = got.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("vec_id"))).where(F.col("r") <= entries).orderBy("d", "vec_id").collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["d"], []).append(np.floor(SCALE * np.array(r["embedding"], np.float64)))
    return {d: [Codebook(exact_ints(x)) for x in np.split(np.stack(v), parts, axis=1)] for d, v in by.items()}


def _limbs(total: int) -> list[int]:
    out = []
    while not -(1 << LIMB) <= total < 1 << LIMB:
        out.append(total & (1 << LIMB) - 1)
        total >>= LIMB
    return [*out, total]


def refine(vectors: DataFrame, books: dict[int, list[Codebook]]) -> dict[int, list[Codebook]]:
    """One round: every part goes to its nearest entry, used entries become the floor of the mean of their parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        total: dict[int, list] = {}
        for _, v in _by_length(batches):
            d = v.shape[1]
            if d not in shared.value:
                continue
            own = total.setdefault(d, [[[0] * (1 + len(b.whole[0])) for _ in b.whole] for b in shared.value[d]])
            for p, (x, book) in enumerate(zip(np.split(v, len(shared.value[d]), axis=1), shared.value[d], strict=True)):
                index, _, _ = nearest(x, book)
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                whole = exact_ints(x[order])
                small = whole.dtype != object and np.abs(x).max() * len(x) < 2.0**62
                added = np.add.reduceat(whole if small else whole.astype(object), at, axis=0)
                for e, n, s in zip(used, np.diff(np.append(at, len(x))), added, strict=True):
                    own[p][e] = [a + int(b) for a, b in zip(own[p][e], (n, *s), strict=True)]
        cells = [(d, p, e, c, k, limb) for d, own in total.items() for p, es in enumerate(own) for e, cs in enumerate(es) if cs[0] for c, x in enumerate(cs) for k, limb in enumerate(_limbs(x))]
        yield pa.RecordBatch.from_pydict({name: pa.array([c[i] for c in cells], pa.int64()) for i, name in enumerate(("d", "p", "e", "c", "k", "v"))})

    got = vectors.select("embedding").mapInArrow(sums, "d long, p long, e long, c long, k long, v long").groupBy("d", "p", "e", "c", "k").agg(F.sum("v").alias("v")).toArrow()
    total: dict[tuple, int] = {}
    for d, p, e, c, k, v in zip(*(got.column(n).to_pylist() for n in ("d", "p", "e", "c", "k", "v")), strict=True):
        total[d, p, e, c] = total.get((d, p, e, c), 0) + (v << LIMB * k)
    shared.unpersist()
    out = {}
    for d, own in books.items():
        out[d] = []
        for p, book in enumerate(own):
            m = book.whole.shape[1]
            rows = [[total.get((d, p, e, c + 1), 0) // n for c in range(m)] if (n := total.get((d, p, e, 0), 0)) else [int(x) for x in old] for e, old in enumerate(book.whole)]
            small = max(abs(x) for r in rows for x in r) < 1 << 62
            out[d].append(Codebook(np.array(rows, np.int64 if small else object)))
    return out


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b.whole for x in row).encode()).hexdigest()


CODED = "vec_id long, label int, code string, error decimal(38,0), codebooks_sha256 string"


def assign(vectors: DataFrame, books: dict[int, list[Codebook]]) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of each vector by its nearest entries."""
    shared = vectors.sparkSession.sparkContext.broadcast((books, {d: digest(b) for d, b in books.items()}))

    def run(batches):
        own, digests = shared.value
        for part, v in _by_length(batches):
            d, n = v.shape[1], part.num_rows
            code, error, name = [None] * n, [None] * n, None
            if d in own:
                found = [nearest(x, book)[:2] for x, book in zip(np.split(v, len(own[d]), axis=1), own[d], strict=True)]
                code = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
                error = [e if e < 10**38 else None for e in (sum(map(int, row)) for row in zip(*(e for _, e in found), strict=True))]
                name = digests[d]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error, pa.decimal128(38, 0)), pa.array([name] * n, pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return vectors.mapInArrow(lean(run), CODED)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors of (vec_id, embedding, label) that take part."""
    x = F.col("embedding")
    rows = vectors.where(takes_part(x)).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    books = start_entries(rows, parts, entries)
    for _ in range(rounds):
        books = refine(rows, books)
    coded = cut(assign(rows, books))
    # a sum is null if an error of its label is
    whole = F.count("*") == F.count(F.when(F.col("code").isNull() | F.col("error").isNotNull(), 1))
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.when(whole, F.sum("error")).alias("label_error"))
    sums = cut(sums)
    if sums.count() <= MOST_LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("__label")), "left")
    else:
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
        spread = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = coded.withColumn("__own", salt).join(spread, (F.col("__own") == F.col("__salt")) & F.col("label").eqNullSafe(F.col("__label")), "left")
    fits = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return joined.select("vec_id", "code", fits("error").alias("error"), F.when(F.col("code").isNotNull(), fits("label_error")).alias("label_error"), "codebooks_sha256")
