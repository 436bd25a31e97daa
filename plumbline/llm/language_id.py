"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 0 to `order`). A byte that a context has
not seen is coded by an escape and then by the next shorter context, with the symbols of the longer
context excluded. The statistics are frozen after fitting, so the code length of a byte depends only on
its context and is read from a table; a text goes to the language with the shortest code.

Defined cases: a null text, an empty text and a text without a letter give `und` with score 0; repeated rows give
repeated results; a null id is never used for fitting; with no labelled row every text gives `und`.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut, lean, padded, raw_text, slices, string_batch

UNDETERMINED = "und"


@dataclass
class ContextTrees:
    """Frozen code lengths: `context` maps the last `order` symbols to a row, `bits[row * alphabet + symbol]` has a column per language."""

    languages: list[str]
    symbol: np.ndarray
    alphabet: int
    order: int
    context: np.ndarray
    bits: np.ndarray


def fold(buffer: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the Latin-1 letters of UTF-8 (C3 80..9E)."""
    out = LOWER[buffer]
    if len(out) > 1:
        up = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def _codes(symbols: np.ndarray, order: int, alphabet: int) -> np.ndarray:
    """Number of the `order` symbols before each position from `order` on."""
    n = len(symbols) - order
    code = np.zeros(n, np.int64)
    for k in range(order):
        code = code * alphabet + symbols[k : k + n]
    return code


def fit_trees(texts: dict[str, list[str]], order: int = 3, table_bytes: int = 48 << 20) -> ContextTrees:
    """Context trees from labelled texts; the longest contexts are kept by count while the table fits `table_bytes`."""
    languages = sorted(texts)
    buffers = []
    for name in languages:
        data, offsets = raw_text(pa.array(texts[name], pa.string()))
        buffers.append(fold(padded(data, offsets, lead=order, tail=0)[0]))
    seen = np.bincount(np.concatenate(buffers) if buffers else np.zeros(0, np.uint8), minlength=256) > 0
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    streams = [symbol[b] for b in buffers]

    room = max(1, table_bytes // (4 * a * max(1, len(languages))))
    levels: list[np.ndarray] = [np.zeros(1, np.int64)]
    left = room - 1
    for k in range(1, order + 1):
        every = [np.unique(_codes(s, k, a), return_counts=True) for s in streams]
        codes = np.concatenate([c for c, _ in every]) if every else np.zeros(0, np.int64)
        uniq, at = np.unique(codes, return_inverse=True)
        count = np.bincount(at, np.concatenate([n for _, n in every]), len(uniq)) if len(uniq) else np.zeros(0)
        keep = np.sort(uniq[np.lexsort((uniq, -count))[: max(0, left)]])
        if k > 1:  # a context is kept only with its suffix
            keep = keep[np.isin(keep % a ** (k - 1), levels[k - 1])]
        levels.append(keep)
        left -= len(keep)

    start = np.cumsum([0] + [len(x) for x in levels])
    bits = np.zeros((start[-1], a, max(1, len(languages))), np.float32)
    for j, s in enumerate(streams):
        above = None
        for k, codes in enumerate(levels):
            n = np.zeros((len(codes), a))
            if len(s) > k:
                ctx = _codes(s, k, a)
                row = np.searchsorted(codes, ctx)
                row[row == len(codes)] = 0
                hit = codes[row] == ctx if len(codes) else np.zeros(len(ctx), bool)
                np.add.at(n, (row[hit], s[k:][hit]), 1)
            if k == 0:
                base = np.full((1, a), 1.0 / a)
                parent_n, parent_x, up = np.zeros((1, a)), base, np.zeros(1, np.int64)
            else:
                up = np.searchsorted(levels[k - 1], codes % a ** (k - 1)) if k > 1 else np.zeros(len(codes), np.int64)
                parent_n, parent_x = above[:2]
            mine, theirs = n > 0, parent_n[up]
            free = np.where(mine, 0.0, theirs)
            total, kinds = free.sum(1, keepdims=True), (free > 0).sum(1, keepdims=True)
            if k == 0:
                x = parent_x * a / np.maximum(1, a - mine.sum(1, keepdims=True))
            else:
                x = np.where(free > 0, free, kinds * parent_x[up]) / np.maximum(1, total + kinds)
                x = np.where(total + kinds == 0, parent_x[up], x)
            size, q = n.sum(1, keepdims=True), mine.sum(1, keepdims=True)
            p = np.where(mine, n, q * x) / np.maximum(1, size + q)
            p = np.where(size == 0, above[2][up] if k else base, p)
            bits[start[k] : start[k + 1], :, j] = -np.log2(np.maximum(p, 1e-12))
            above = (np.where(size == 0, parent_n[up], n), np.where(size == 0, parent_x[up], x), p)
    table = np.zeros(1, np.int32)
    for k in range(1, order + 1):
        table = np.tile(table, a)  # the new symbol is the oldest and so the most significant
        table[levels[k]] = start[k] + np.arange(len(levels[k]))
    return ContextTrees(languages, symbol, a, order, table.astype(np.int32), bits.reshape(start[-1] * a, -1))


def code_lengths(model: ContextTrees, array: pa.Array) -> np.ndarray:
    """Bits of each text under each language."""
    data, offsets = raw_text(array)
    n, m = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, m))
    if not len(data):
        return out
    buffer, starts = padded(data, offsets, lead=model.order, tail=0)
    s = model.symbol[fold(buffer)].astype(np.int32)
    full = np.flatnonzero(np.diff(offsets))
    a, k = model.alphabet, model.order
    code = s[: len(s) - k].copy()
    for j in range(1, k):
        code *= a
        code += s[j : len(s) - k + j]
    row = model.context[code] * a + s[k:]
    # the positions of padding have a code too: it is left out by summing from each document's start to its end
    for j in range(m):
        run = np.concatenate(([0.0], np.cumsum(model.bits[row, j], dtype=np.float64)))
        out[full, j] = run[starts[full] - k + np.diff(offsets)[full]] - run[starts[full] - k]
    return out


#: A sampled window has this many code points at least; with very many languages the number of windows falls instead.
LEAST_WINDOW = 64
#: The counts of up to so many languages are broadcast (a name and a number each).
BROADCAST_LANGUAGES = 100_000


def sample(docs: DataFrame, per_language: int = 400, sample_bytes: int = 64 << 20) -> dict[str, list[str]]:
    """A labelled sample of at most `sample_bytes` in which every language takes part with an equal share: of each of the
    `per_language` rows lowest by a hash of id and text one window, at a place that the hash chooses in the whole text. Rows that repeat
    id and text count once. More than sample_bytes / 256 languages exceed the bound by one window each."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n"))
    counts = cut(counts)
    languages = counts.count()
    if not languages:
        return {}
    share = sample_bytes // 4 // languages
    window = max(LEAST_WINDOW, share // per_language)
    most = max(1, min(per_language, share // window))
    span = 1 << 30
    spot = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(span))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(18)), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    near = rows.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "lang").where(spot <= span * F.least(F.lit(1.0), (2.0 * most + 20) / F.col("n")))
    near = near.select("lang", spot.alias("spot"), "doc_id", F.substring("text", place, F.lit(window)).alias("text")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spot", "doc_id", "text"))
    got: dict[str, list[str]] = {}
    for r in near.withColumn("r", rank).where(F.col("r") <= most).select("lang", "text").collect():
        got.setdefault(r[0], []).append(r[1])
    return got


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("code_bits", pa.float64())])


def identify(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """Predict the language of each row of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        names = np.array([*trees.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in slices(batch, "text"):
                bits = code_lengths(trees, part.column("text"))
                letters = np.asarray(part.column("letters").fill_null(False).to_numpy(zero_copy_only=False), bool)
                if not trees.languages:
                    letters[:] = False
                if bits.shape[1] == 0:
                    bits = np.zeros((len(bits), 1))
                best = bits.argmin(1)
                least = bits.min(1, keepdims=True)
                score = 1.0 / np.exp2(np.maximum(least - bits, -1000.0)).sum(1)
                yield string_batch(SCHEMA, doc_id=part.column("doc_id"), held_out=part.column("held_out"), lang_pred=names[np.where(letters, best, -1)].tolist(), score=np.where(letters, score, 0.0), code_bits=np.where(letters, least[:, 0], 0.0))

    letters = F.col("text").rlike(r"\p{L}").alias("letters")
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text", letters).mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, code_bits double")
