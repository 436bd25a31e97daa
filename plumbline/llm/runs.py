"""Periodic runs of words by a suffix tree with smaller-half leaf lists.

The suffixes of all documents of a chunk are sorted together (prefix doubling over word hashes; each document ends with a mark of
its own, so no prefix crosses documents), and the intervals of the common-prefix array are the inner nodes of the suffix tree. At
each node of depth D the leaf lists of all children but the largest are walked: leaf i is a tandem repeat of root D if leaf i + D
(for a leaf as the second copy: i - D) lies below the node, and a branching one if the word after it breaks the period. Each run
ends with exactly one branching repeat of its smallest period; rotating that to the left as long as the words agree gives the
whole run, and repeats whose root is a multiple are merged into it.

Defined cases: a null, empty or blank text has no words and no runs; a null id counts as an id outside the planted tenth; repeated
rows each give a row. Only doc_id and text are read, so other columns cannot clash. Words are compared by 64-bit hashes. A
document is handled whole, with memory in proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, U64, WordHasher, lean, mix, padded, raw_text, slices, string_batch, words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4


def suffix_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their ranks, common prefix with the suffix before) of a sequence that ends with a unique key; ties are refined alone."""
    n = len(key)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is the place of its first member
    rank = np.empty(n, np.int64)
    rank[order] = head
    ranks, width = [rank.astype(np.int32)], 1
    while True:
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
        who = order[tied]
        at = rank[who] * n + rank[who + width]
        by = np.argsort(at)
        order[tied], at = who[by], at[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = at[1:] != at[:-1]
        new[tied] |= fresh
        head = np.maximum.accumulate(np.where(new[tied], tied, 0))
        rank[order[tied]] = head
        ranks.append(rank.astype(np.int32))
        width *= 2
    common = np.zeros(n, np.int64)
    some = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[some - 1].copy(), order[some].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a] == ranks[k][b]
        step = np.where(same, 1 << k, 0)
        a += step
        b += step
    common[some] = b - order[some]
    return order, rank, common


def _nearest(value: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each place with a positive value the nearest one in direction `step` with a smaller (or equal, if not strict) value; both ends hold 0."""
    to = np.clip(np.arange(len(value)) + step, 0, len(value) - 1)
    open_ = np.flatnonzero(value > 0)
    while len(open_):
        there, own = value[to[open_]], value[open_]
        open_ = open_[(there >= own) if strict else (there > own)]
        to[open_] = to[to[open_]]
    return to


def branching_repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, root length) of the branching tandem repeats of a sequence that ends with a unique key."""
    order, rank, common = suffix_order(key)
    n = len(key)
    value = np.append(common, 0)
    inner = np.flatnonzero(value > 0)
    nothing = np.zeros(0, np.int64)
    if not len(inner):
        return nothing, nothing
    value[0] = value[n] = 0
    low, high, after = _nearest(value, -1, True), _nearest(value, 1, True), _nearest(value, 1, False)
    left, right, depth = low[inner], high[inner], value[inner]
    # inner nodes by (left end, depth); the first boundary of each closes its first child
    by = np.lexsort((inner, depth, left))
    node_start = np.ones(len(by), bool)
    node_start[1:] = (left[by[1:]] != left[by[:-1]]) | (depth[by[1:]] != depth[by[:-1]])
    node = np.cumsum(node_start) - 1
    first = by[node_start]
    child_lo = np.concatenate((left[first], inner[by]))
    child_hi = np.concatenate((inner[first], after[inner[by]]))
    parent = np.concatenate((np.arange(len(first)), node))
    size = child_hi - child_lo
    most = np.zeros(len(first), np.int64)
    np.maximum.at(most, parent, size)
    # all children but one of the largest
    large = np.flatnonzero(size == most[parent])
    keep = np.ones(len(size), bool)
    seen = np.full(len(first), -1)
    seen[parent[large]] = large
    keep[seen] = False
    lo, sizes, up = child_lo[keep], size[keep], parent[keep]
    total = int(sizes.sum())
    leaf = order[np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]
    up = np.repeat(up, sizes)
    d, a, b = depth[first][up], left[first][up], right[first][up]
    out_i, out_d = [], []
    for sign in (1, -1):
        other = leaf + sign * d
        good = (other >= 0) & (other < n)
        place = rank[np.where(good, other, 0)]
        good &= (place >= a) & (place < b)
        i = np.where(sign == 1, leaf, other)[good]
        root = d[good]
        broken = key[i + root] != key[np.minimum(i + 2 * root, n - 1)]
        out_i.append(i[broken])
        out_d.append(root[broken])
    pairs = np.unique(np.concatenate(out_i) * (n + 1) + np.concatenate(out_d))
    return pairs // (n + 1), pairs % (n + 1)


def maximal_runs(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (start, length, smallest period) of all runs, ordered; `start` is the first place of each place's document, keys of documents end with unique marks."""
    i, d = branching_repeats(key)
    # a long enough run goes on to the left of its last two copies: few random repeats pass a few words of that
    need = np.maximum(LEAST_LENGTH, LEAST_EXPONENT * d) - 2 * d
    ok = i - need >= start[i]
    i, d, need = i[ok], d[ok], need[ok]
    for k in (1, 2, 3, 4, 6, 8, 12, 16):
        k_ = np.minimum(k, need)
        ok = key[i - k_] == key[i - k_ + d]
        i, d, need = i[ok], d[ok], need[ok]
    end = i + 2 * d
    out, reach, last = [], 0, -1
    for j in np.lexsort((d, end)):
        e, q, p = int(end[j]), int(d[j]), int(i[j])
        if e != last:
            reach, last = 0, e
        if 2 * q <= reach:  # its root repeats a shorter one
            continue
        low, hi, step = int(start[p]), p, 64
        while hi > low:  # rotate to the left in growing steps
            lo = max(low, hi - step)
            differ = np.flatnonzero(key[lo:hi] != key[lo + q : hi + q])
            if len(differ):
                hi = lo + int(differ[-1]) + 1
                break
            hi, step = lo, step * 4
        if e - hi >= max(LEAST_LENGTH, LEAST_EXPONENT * q):
            out.append((hi, e - hi, q))
            reach = max(reach, e - hi)
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the documents whose tail is made periodic; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def strongest(runs: np.ndarray) -> tuple:
    """(start, length, period) of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:  # runs come by start, then period
            best = (s, n, q)
    return best


def _chunk(ids: list, array: pa.Array, hasher: WordHasher) -> pa.RecordBatch:
    data, offsets = raw_text(array)
    buffer, starts = padded(data, offsets)
    s, e = words(buffer, NOT_SPACE)
    n_docs = len(offsets) - 1
    doc = np.searchsorted(starts, s, side="right") - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))
    source = np.arange(len(s))  # the word that stands at each place
    for k in range(n_docs):
        if tail := planted(ids[k], int(count[k])):
            a, p = tail
            place = np.arange(a, count[k])
            source[first[k] + place] = first[k] + a + (place - a) % p
    word = hasher.hashes(buffer, s, e)[source] if len(s) else np.zeros(0, U64)
    # one mark after each document; words of different documents differ
    key = np.zeros(len(s) + n_docs, U64)
    at = np.arange(len(s)) + doc
    key[at] = mix(word + mix(doc.astype(U64) + U64(1)))
    marks = first[1:] + np.arange(n_docs)
    key[marks] = mix(np.arange(n_docs, dtype=U64) + U64(0x5851F42D4C957F2D))
    origin = (first[:-1] + np.arange(n_docs))[np.searchsorted(marks, np.arange(len(key)))]
    found = maximal_runs(key, origin)
    owner = np.searchsorted(marks, found[:, 0])
    dropped = np.zeros(len(key) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(dropped)[at] == 0)
    # the kept words with one space after each
    w = source[kept]
    width = e[w] - s[w] + 1
    ends = np.cumsum(width)
    gather = np.repeat(s[w] - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)
    text = buffer[np.minimum(gather, len(buffer) - 1)]
    text[ends - 1] = 32
    text = text.tobytes()
    bound = np.concatenate(([0], ends))[np.searchsorted(doc[kept], np.arange(n_docs + 1))]
    per_doc = np.searchsorted(owner, np.arange(n_docs + 1))
    rows = []
    for k in range(n_docs):
        runs = found[per_doc[k] : per_doc[k + 1]] - [[int(first[k] + k), 0, 0]]
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
        best = strongest(runs) or (None, None, None)
        body = text[bound[k] : max(bound[k], bound[k + 1] - 1)]
        rows.append((ids[k], len(runs), *best, 1000 * best[1] // best[2] if len(runs) else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(body).hexdigest()))
    return string_batch(SCHEMA, **{f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): its runs and the digest of its text without their repetitions."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                yield _chunk(part.column("doc_id").to_pylist(), part.column("text"), hasher)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
