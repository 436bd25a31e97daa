"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `width` successive words (a shorter item is one window). The words of a
window are ordered by rarity in the documents, counted over all of them; since the whole window must be contained, its
rarest word is a necessary prefix. Document words join the windows on that prefix word; the word's place in the window
bounds where the window can start and end inside the document, and what remains is verified word by word.

The benchmark is read in blocks of bounded bytes (`block_bytes`), each joined with all documents; only a block is ever
broadcast. Defined cases: null texts have no words; items without words, null items and null item ids have no window;
repeated document rows each get their row, repeated item ids count once; a null doc_id is carried through. Only
doc_id and text (item_id and text) are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U64, WordHasher, lean, padded, raw_text, rolling, slices, string_batch, words

WIDTH = 10
_NOTHING = hashlib.sha256(b"").hexdigest()


def split_words(array: pa.Array, hasher: WordHasher):
    """(buffer, start, end, hash, first word of each document and the total) of all words."""
    data, offsets = raw_text(array)
    buffer, starts = padded(LOWER[data] if len(data) else data, offsets)
    s, e = words(buffer, ALNUM) if len(buffer) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = hasher.hashes(buffer, s, e) if len(s) else np.zeros(0, U64)
    first = np.searchsorted(s, np.concatenate((starts, [len(buffer) + 1])))
    return buffer, s, e, h, first


def block_words(items: list[tuple[str, str]]) -> np.ndarray:
    """Sorted hashes of the words of a block."""
    return np.unique(split_words(pa.array([t for _, t in items], pa.string()), WordHasher())[3])


class WindowIndex:
    """The windows of a block of items, listed under their rarest word."""

    def __init__(self, items: list[tuple[str, str]], vocabulary: np.ndarray, counts: np.ndarray, width: int):
        buffer, s, e, h, first = split_words(pa.array([t for _, t in items], pa.string()), WordHasher())
        self.ids = [i for i, _ in items]
        windows: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.items: list[set[int]] = []
        token, offset, length, whole = [], [], [], []
        rarity = counts[np.searchsorted(vocabulary, h)] if len(h) else np.zeros(0, np.int64)
        for i in range(len(items)):
            lo, hi = int(first[i]), int(first[i + 1])
            m = min(width, hi - lo)
            if m == 0:
                continue
            hashes = rolling(h[lo:hi], m)
            for k in range(hi - lo - m + 1):
                a = lo + k
                text = b" ".join(buffer[s[x] : e[x]].tobytes() for x in range(a, a + m))
                w = windows.get(text)
                if w is None:
                    w = windows[text] = len(self.words)
                    self.words.append(text)
                    self.items.append(set())
                    j = min(range(m), key=lambda x: (rarity[a + x], h[a + x], x))
                    token.append(h[a + j])
                    offset.append(j)
                    length.append(m)
                    whole.append(hashes[k])
                self.items[w].add(i)
        token = np.array(token, U64)
        order = np.argsort(token, kind="stable")
        self.window = order
        self.offset, self.length, self.whole = (np.array(x)[order] if len(x) else np.zeros(0, np.int64) for x in (offset, length, whole))
        self.tokens, self.at = np.unique(token[order], return_index=True)
        self.at = np.append(self.at, len(order))

    def find(self, array: pa.Array, hasher: WordHasher, most: int = 1 << 20):
        """(words per document, window occurrences as (first word, words, document, window))."""
        buffer, s, e, h, first = split_words(array, hasher)
        n_words = np.diff(first)
        out: list[tuple[int, int, int, int]] = []
        if not len(h) or not len(self.tokens):
            return n_words, out
        i = np.searchsorted(self.tokens, h)
        i[i == len(self.tokens)] = 0
        pos = np.flatnonzero(self.tokens[i] == h)
        group = i[pos]
        doc = np.searchsorted(first, pos, side="right") - 1
        size = self.at[group + 1] - self.at[group]
        sums = np.cumsum(size)
        hashes: dict[int, np.ndarray] = {}
        lo = 0
        while lo < len(pos):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + most, side="right")))
            take = np.repeat(np.arange(lo, hi), size[lo:hi])
            within = np.arange(len(take)) - np.repeat(sums[lo:hi] - size[lo:hi] - (sums[lo - 1] if lo else 0), size[lo:hi])
            entry = self.at[group[take]] + within
            begin, d, m = pos[take] - self.offset[entry], doc[take], self.length[entry]
            fits = (begin >= first[d]) & (begin + m <= first[d + 1])
            begin, d, m, entry = begin[fits], d[fits], m[fits], entry[fits]
            for width in np.unique(m):
                if width not in hashes:
                    hashes[width] = rolling(h, int(width))
                its = np.flatnonzero(m == width)
                its = its[hashes[width][begin[its]] == self.whole[entry[its]].astype(U64)]
                for x in its:
                    b, w = int(begin[x]), int(self.window[entry[x]])
                    if b" ".join(buffer[s[y] : e[y]].tobytes() for y in range(b, b + int(width))) == self.words[w]:
                        out.append((b - int(first[d[x]]), int(width), int(d[x]), w))
            lo = hi
        return n_words, out


def spans_of(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (first word, words) runs as disjoint [start, end)."""
    merged: list[list[int]] = []
    for b, m in sorted(found):
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b + m)
        else:
            merged.append([b, b + m])
    return [(a, b) for a, b in merged]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // block_bytes))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def build_index(docs: DataFrame, block: DataFrame, width: int) -> WindowIndex:
    """The index of one block; its words are counted over all documents."""
    items = sorted((r[0], r[1]) for r in block.collect())  # one block: bounded bytes
    vocabulary = block_words(items)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known, hasher = shared.value, WordHasher()
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = split_words(part.column("text"), hasher)[3]
                if len(h) and len(known):
                    i = np.searchsorted(known, h)
                    i[i == len(known)] = 0
                    total += np.bincount(i[known[i] == h], minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    counts = np.zeros(len(vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per word of the block
        counts[r[0]] = r[1]
    return WindowIndex(items, vocabulary, counts, width)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
PARTS = "doc_id long, text_md5 string, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = 16 << 20) -> DataFrame:
    """Overlap of each row of (doc_id, text) with the items of (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = item_blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, blocks[0], width))

        def run(batches):
            index, hasher = shared.value, WordHasher()
            for batch in batches:
                for part in slices(batch, "text"):
                    n_words, found = index.find(part.column("text"), hasher)
                    n = part.num_rows
                    hit, n_items, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), [_NOTHING] * n
                    for d, (spans, ids) in by_document(index, found).items():
                        hit[d], n_items[d] = sum(b - a for a, b in spans), len(ids)
                        digest[d] = hashlib.sha256(",".join(ids).encode()).hexdigest()
                    yield string_batch(SCHEMA, doc_id=part.column("doc_id"), n_words=n_words, n_hit=hit, n_items=n_items, items_sha256=digest, contaminated=hit > 0)

        return docs.mapInArrow(lean(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")

    each = [_parts(docs, build_index(docs, block, width)) for block in blocks]
    rows = reduce(DataFrame.unionByName, each).groupBy("doc_id", "text_md5", "n_words").agg(F.count("*").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x.s, x.e - 1)))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("copies") / len(blocks)).cast("int"))))
    return rows.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def by_document(index: WindowIndex, found: list[tuple[int, int, int, int]]) -> dict[int, tuple[list[tuple[int, int]], list[str]]]:
    got: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for b, m, d, w in found:
        spans, ids = got.setdefault(d, ([], set()))
        spans.append((b, m))
        ids.update(index.ids[i] for i in index.items[w])
    return {d: (spans_of(spans), sorted(ids)) for d, (spans, ids) in got.items()}


def _parts(docs: DataFrame, index: WindowIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own, hasher = shared.value, WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, found = own.find(part.column("text"), hasher)
                by = by_document(own, found)
                frame = pd.DataFrame({"n_words": n_words, "spans": [[{"s": a, "e": b} for a, b in by.get(d, ([], []))[0]] for d in range(part.num_rows)], "items": [by.get(d, ([], []))[1] for d in range(part.num_rows)]})
                kinds = [pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_md5"), *(pa.array(frame[c].tolist(), k) for c, k in zip(frame, kinds, strict=True))], names=["doc_id", "text_md5", "n_words", "spans", "items"])

    return docs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).mapInArrow(lean(run), PARTS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs without any window of an item, with all their columns."""
    out = docs
    for block in item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, block, width))

        def run(batches, shared=shared):
            index, hasher = shared.value, WordHasher()
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for _, _, d, _ in index.find(part.column("text"), hasher)[1]]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
