"""Quality rules: base counts of a text, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word n-grams (one and two words) are counted: one over all documents, one over the trusted ones.
Both are smoothed by the same pseudo-mass, so the ratio of a bucket is log((t + a) / (r * T / R + a)) with t, r its counts and T, R
the totals. The score of a document is the mean ratio of its n-grams, and every document at or above one threshold is kept. The
threshold lies where, on labelled documents that took no part in the counts, the share of bad ones caught less `loss_weight` times
the share of good ones lost is greatest (ties: the middle). Scores meet the threshold through a histogram, never as a list.

Defined cases: a null text has no words; a text without words has the score 0 and fails the base rules; repeated rows each count
and each get a row; several labels of one id count as the lowest, null labels and ids as none; without trusted documents, or
without both kinds among the documents for the threshold, only the base rules decide. Only doc_id and text are read. Every labelled
id outside the unread fold takes part, however many there are: the texts of a fold meet them in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, U64, WordHasher, crc_mod, cut, lean, mix, padded, raw_text, rolling, shuffles_dropped, slices, string_batch, words

BUCKETS = 1 << 16
#: Added to each bucket's expected and found number of trusted n-grams.
PSEUDO = 4.0
#: Labels are dealt by crc32 of the id mod 5: one part is never read, one sets the threshold, the others count.
FOLDS, UNSEEN, THRESHOLD_FOLD = 5, 0, 4
#: Bins of the threshold's histogram a unit of score, and the score beyond which all count alike.
STEPS, WIDEST = 1024, 12
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Texts:
    """Counts of each text of a chunk, and its n-gram buckets with their documents."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    bucket: np.ndarray
    owner: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def _found_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def analysed(array: pa.Array, hasher: WordHasher) -> Texts:
    data, offsets = raw_text(array)
    buffer, starts = padded(data, offsets, fill=10)
    n = len(offsets) - 1
    s, e = words(buffer, NOT_SPACE)
    of = lambda at: np.searchsorted(starts, at, side="right") - 1
    doc = of(s)
    count = lambda which: np.bincount(which, minlength=n)
    inside = NOT_SPACE[buffer]
    chars = count(of(np.flatnonzero(inside & ((buffer & 0xC0) != 0x80))))
    symbols = count(of(np.flatnonzero(SYMBOLS[buffer])))
    # lines, each ended by a line feed (the separator is one)
    line_end = np.flatnonzero(buffer == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    have = np.concatenate(([0], np.cumsum(inside)))
    full = have[line_end] > have[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_doc = of(line_start)
    apart = mix(np.arange(n, dtype=U64) + U64(1))
    lines = hasher.hashes(buffer, line_start, line_end) if len(line_start) else np.zeros(0, U64)
    dups = count(line_doc[_found_before(mix(lines + apart[line_doc]))])
    h = hasher.hashes(buffer, s, e) if len(s) else np.zeros(0, U64)
    # three-word windows inside one document that are found at least twice
    at = np.flatnonzero(doc[2:] == doc[:-2])
    key = mix(rolling(h, 3)[at] + apart[doc[at]])
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(s), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    grams = np.concatenate((mix(h), mix(rolling(h, 2)[pair] + U64(1))))
    return Texts(count(doc), chars, symbols, dups, count(doc[covered]), (grams & U64(BUCKETS - 1)).astype(np.int64), np.concatenate((doc, doc[pair])))


def likelihood_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's probability among trusted documents to that among all."""
    return np.log((trusted + PSEUDO) / (raw * (trusted.sum() / max(1, raw.sum())) + PSEUDO))


def scores(texts: Texts, ratios: np.ndarray) -> np.ndarray:
    n = len(texts.n_words)
    return np.bincount(texts.owner, ratios[texts.bucket], n) / np.maximum(1, np.bincount(texts.owner, minlength=n))


def best_cut(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, loss_weight: float) -> float | None:
    """The threshold from counts of good and bad documents by score bin; None unless both are there."""
    if not good.sum() or not bad.sum():
        return None
    edge = np.arange(-WIDEST * STEPS, WIDEST * STEPS + 2)
    below = lambda n: np.concatenate(([0], np.cumsum(np.bincount(bins + WIDEST * STEPS, n, len(edge) - 1)))) / n.sum()
    gain = np.round(below(bad) - loss_weight * below(good), 9)
    best = np.flatnonzero(gain == gain.max())
    run = best[: np.flatnonzero(np.append(np.diff(best) > 1, True))[0] + 1]  # the first stretch of equal gain
    return float(edge[run[len(run) // 2]]) / STEPS


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, fold) of every labelled id outside the unread fold."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    return marks.withColumn("fold", crc_mod(F.col("doc_id"), FOLDS).cast("int")).where(F.col("fold") != UNSEEN)


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of the ids of `marks`; the texts need no sorting."""
    return rows.join(marks.hint("shuffle_hash"), "doc_id")


@dataclass
class Rule:
    ratios: np.ndarray | None
    threshold: float | None


def _counted(texts: DataFrame) -> np.ndarray:
    """The n-grams of all texts by bucket."""

    def count(batches):
        hasher, total = WordHasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(analysed(part.column("text"), hasher).bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(got.column("bucket"))] = np.asarray(got.column("n"))
    return out


def fit_rule(docs: DataFrame, labels: DataFrame, loss_weight: float = 10.0) -> Rule:
    """Ratios from all documents and all trusted ones among them, and the threshold from all labelled ones of its fold."""
    marks = cut(labelled(labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tries = F.col("fold") == THRESHOLD_FOLD
    fold = crc_mod(F.col("doc_id"), FOLDS)
    with shuffles_dropped(docs.sparkSession):
        trusted = _counted(_marked(rows.where((fold != UNSEEN) & (fold != THRESHOLD_FOLD)), marks.where(F.col("good") & ~tries)))
    if not trusted.sum():
        return Rule(None, None)
    ratios = likelihood_ratios(_counted(rows), trusted)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def place(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                t = analysed(part.column("text"), hasher)
                step = np.clip(np.floor(scores(t, shared.value) * STEPS), -WIDEST * STEPS, WIDEST * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(step), part.column("good")], names=["step", "good"]).filter(pa.array(~t.failed))

    with shuffles_dropped(docs.sparkSession):
        tried = _marked(rows.where(fold == THRESHOLD_FOLD), marks.where(tries)).select("text", "good")
        found = tried.mapInArrow(lean(place), "step int, good boolean").groupBy("step").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).toArrow()  # at most the histogram's bins
    column = lambda name: np.asarray(found.column(name)).astype(np.int64)
    return Rule(ratios, best_cut(column("step"), column("good"), column("bad"), loss_weight))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def judge(docs: DataFrame, rule: Rule) -> DataFrame:
    """The counts, the score and the verdict of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(rule)

    def run(batches):
        hasher, rule = WordHasher(), shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                t = analysed(part.column("text"), hasher)
                score = np.zeros(part.num_rows) if rule.ratios is None else scores(t, rule.ratios)
                kept = ~t.failed if rule.threshold is None else ~t.failed & (score >= rule.threshold)
                yield string_batch(SCHEMA, doc_id=part.column("doc_id"), n_words=t.n_words, word_chars=t.word_chars, n_symbols=t.n_symbols, n_dup_lines=t.n_dup_lines, n_repeat_words=t.n_repeat_words, base_failed=t.failed, kept=kept, score=score)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
