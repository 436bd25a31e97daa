"""Language-model scores by prediction by partial matching, with frozen statistics of the training rows.

The model is a byte-context trie of order `order` with an end-of-text symbol. In a context a seen symbol has
probability n / (N + q) and an escape q / (N + q), N its count and q its different symbols; after an escape the next
shorter context is used with the symbols of the longer one excluded. A text's score is the sum of log10 probabilities of
its bytes and its end. Beside it a unigram word model with add-one smoothing gives the base score.

Nothing of corpus size is broadcast or collected. Documents are dealt into blocks of bounded bytes. Each block asks
once for its different words and byte runs; the requests go to bins (a word by its hash, a byte run by the last two bytes of
its context, so that all its contexts down to order 2 meet there), the bins add up the training counts, and the answers
return to the block. Orders 0 and 1 are a fixed table of 257 x 257 counts.

Words are compared by 64-bit hashes inside their bin. Defined cases: a null text is empty and has the end token only; rows with a null
id are scored but never trained on; repeated rows count and are scored each; without training rows the byte model is
uniform. Only doc_id, text and the training flag are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, WordHasher, cut, lean, mix, padded, raw_text, shuffle_partitions, slices, words

END = 256
SYMBOLS = 257
BLOCK_BYTES = 6 << 20
BIN_REQUESTS = 1_500_000
#: Requests of a text byte, roughly: only for choosing the number of bins.
REQUESTS_PER_BYTE = 0.09
_ZSTD = "zstd"


def pack(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + pa.Codec(_ZSTD, 1).compress(np.ascontiguousarray(a).tobytes(), asbytes=True) if len(a) else (0).to_bytes(8, "little")


def unpack(b, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.Codec(_ZSTD).decompress(b[8:], n * np.dtype(kind).itemsize, asbytes=True), kind) if n else np.zeros(0, kind)


def split_keys(codes: np.ndarray) -> bytes:
    """Sorted codes as differences."""
    return pack(np.diff(codes, prepend=codes[:1] * 0))


def symbol_stream(array: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, length): each text with `order` end symbols before and one after; first is the place of its first coded symbol."""
    data, offsets = raw_text(array)
    buffer, starts = padded(data, offsets, lead=order, tail=1)
    s = buffer.astype(np.int16)
    ends = starts + np.diff(offsets)
    for k in range(order):
        s[starts - 1 - k] = END
    s[ends] = END
    return s, starts, np.diff(offsets) + 1


def pair_counts(docs: DataFrame, train: Column) -> tuple[int, int, np.ndarray]:
    """(bytes of all texts, training rows, counts of (byte before, byte) in training rows)."""

    def run(batches):
        total, size, rows = np.zeros(SYMBOLS * SYMBOLS, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                flag = np.asarray(part.column("train").to_numpy(zero_copy_only=False), bool)
                size += len(raw_text(part.column("text"))[0])
                chosen = part.filter(pa.array(flag)).column("text")
                rows += len(chosen)
                if len(chosen):
                    s, first, length = symbol_stream(chosen, 1)
                    code = s[:-1].astype(np.int32) * SYMBOLS + s[1:]
                    keep = np.ones(len(code), bool)
                    keep[(first + length - 1)[:-1]] = False  # from one text's end to the next one's lead
                    total += np.bincount(code[keep], minlength=SYMBOLS * SYMBOLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(np.concatenate(([-2, -1], at)), pa.int64()), "n": pa.array(np.concatenate(([size, rows], total[at])), pa.int64())})

    got = docs.select("text", train.alias("train")).mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 257 * 257 + 2 rows at most
    code, n = np.asarray(got.column("code"), np.int64), np.asarray(got.column("n"), np.int64)
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    pairs[code[code >= 0]] = n[code >= 0]
    return int(n[code == -2].sum()), int(n[code == -1].sum()), pairs.reshape(SYMBOLS, SYMBOLS)


def byte_runs(s: np.ndarray, places: np.ndarray, order: int, dense: int = 1 << 25) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ids): the sorted codes of the runs of order + 1 symbols that end at the places, and each place's index in them."""
    ids = np.zeros(len(places), np.int32)
    codes = np.zeros(1, np.int64)
    for k in range(order, -1, -1):
        key = ids.astype(np.int64) * SYMBOLS + s[places - k]
        size = len(codes) * SYMBOLS
        if size <= dense:
            there = np.zeros(size, bool)
            there[key] = True
            found = np.flatnonzero(there)
            place = np.zeros(size, np.int32)
            place[found] = np.arange(len(found), dtype=np.int32)
            ids = place[key]
        else:
            found, ids = np.unique(key, return_inverse=True)
            ids = ids.astype(np.int32)
        codes = codes[found // SYMBOLS] * SYMBOLS + found % SYMBOLS
    return codes, ids


def text_words(array: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all words."""
    data, offsets = raw_text(array)
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    buffer, starts = padded(LOWER[data], offsets)
    s, e = words(buffer, NOT_SPACE)
    return (hasher.hashes(buffer, s, e), np.searchsorted(starts, s, side="right") - 1) if len(s) else (np.zeros(0, U64), np.zeros(0, np.int64))


class Requests:
    """The different words and byte runs of one block in the order in which its bins answer."""

    def __init__(self, array: pa.Array, order: int, bins: int):
        h, self.word_text = text_words(array, WordHasher())
        self.words, self.word_at = np.unique(h, return_inverse=True)
        word_bin = (mix(self.words ^ U64(0x51ED270B)) % U64(bins)).astype(np.int64)
        self.word_order = np.argsort(word_bin, kind="stable")
        self.word_bounds = np.searchsorted(word_bin[self.word_order], np.arange(bins + 1))
        s, first, length = symbol_stream(array, order)
        self.length = length
        places = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        self.codes, self.run_at = byte_runs(s, places, order)
        run_bin = (mix((self.codes // SYMBOLS % (SYMBOLS * SYMBOLS)).astype(U64) + U64(1)) % U64(bins)).astype(np.int64)
        self.run_order = np.argsort(run_bin, kind="stable")
        self.run_bounds = np.searchsorted(run_bin[self.run_order], np.arange(bins + 1))

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words and runs."""
        n_words = np.bincount(self.word_at[train[self.word_text]], minlength=len(self.words))
        chosen = np.repeat(train, self.length)
        return n_words, np.bincount(self.run_at[chosen], minlength=len(self.codes))


def _ask(order: int, bins: int):
    def run(batches):
        for block, texts, train in _blocks(batches):
            r = Requests(texts, order, bins)
            n_words, n_runs = r.counts(train)
            w, c, nw, nr = r.words[r.word_order], r.codes[r.run_order], n_words[r.word_order], n_runs[r.run_order]
            small = np.uint32 if max(nw.max(initial=0), nr.max(initial=0)) < 1 << 32 else np.uint64
            rows = [(block, k, w[r.word_bounds[k] : r.word_bounds[k + 1]].tobytes(), pack(nw[r.word_bounds[k] : r.word_bounds[k + 1]].astype(small)), split_keys(c[r.run_bounds[k] : r.run_bounds[k + 1]]), pack(nr[r.run_bounds[k] : r.run_bounds[k + 1]].astype(small)), small is np.uint64) for k in range(bins) if r.word_bounds[k] < r.word_bounds[k + 1] or r.run_bounds[k] < r.run_bounds[k + 1]]
            for lo in range(0, len(rows), 512):
                part = list(zip(*rows[lo : lo + 512], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), *(pa.array(x, pa.binary()) for x in part[2:6]), pa.array(part[6], pa.bool_())], names=["block", "bin", "words", "word_n", "runs", "run_n", "wide"])

    return run


def _blocks(batches):
    """(block, texts, training flags) of rows sorted by block."""
    held, block = [], None
    for batch in batches:
        numbers = batch.column("block").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and numbers[a] != block:
                yield _block(block, held)
                held = []
            block = int(numbers[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield _block(block, held)


def _block(block: int, held: list[pa.RecordBatch]):
    table = pa.Table.from_batches(held).select(["text", "train"]).combine_chunks()
    return block, table.column("text").combine_chunks().cast(pa.large_string()), np.asarray(table.column("train").to_numpy(), bool)


def log_probabilities(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each run of sorted `codes`, given the counts of all runs with these last two context symbols."""
    n0 = pairs.sum(0)
    total, kinds = n0.sum(), np.count_nonzero(n0)
    symbol = codes % SYMBOLS
    if total == 0:
        return np.full(len(codes), -np.log10(SYMBOLS))
    x = np.full(len(codes), 1.0 / max(1, SYMBOLS - kinds))
    n = n0[symbol].astype(np.float64)
    p = np.where(n > 0, n, kinds * x) / (total + kinds)
    above_codes, above_n = np.arange(SYMBOLS, dtype=np.int64), n0
    seen = counts > 0
    for k in range(1, order + 1):
        if k == 1:
            level_codes = np.flatnonzero(pairs)
            level_n = pairs.ravel()[level_codes]
        elif k == order:
            level_codes, level_n = codes[seen], counts[seen]
        else:
            level_codes, at = np.unique(codes[seen] % SYMBOLS ** (k + 1), return_inverse=True)
            level_n = np.bincount(at, counts[seen], len(level_codes)).astype(np.int64)
        context, first = np.unique(level_codes // SYMBOLS, return_index=True)
        edges = np.append(first, len(level_codes))
        sums = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[edges])  # noqa: B023, E731
        size, q = sums(level_n), np.diff(edges)
        # what the shorter context holds besides the symbols seen here
        shorter = level_codes % SYMBOLS**k
        at = np.searchsorted(above_codes, shorter)
        free = -sums(above_n[at]).astype(np.float64)
        if k == 1:
            free += total
            q_free = kinds - q
        else:
            a_context, a_first = np.unique(above_codes // SYMBOLS, return_index=True)
            a_edges = np.append(a_first, len(above_codes))
            a_size = np.diff(np.concatenate(([0], np.cumsum(above_n)))[a_edges])
            up = np.searchsorted(a_context, context % SYMBOLS ** (k - 1))
            free += a_size[up]
            q_free = np.diff(a_edges)[up] - q
        own = codes // SYMBOLS % SYMBOLS**k
        c = np.searchsorted(context, own)
        c[c == len(context)] = 0
        known = (context[c] == own) if len(context) else np.zeros(len(codes), bool)
        if not known.any():
            break
        room = free[c] + q_free[c]
        escape = np.where(n > 0, n, q_free[c] * x) / np.maximum(room, 1)
        escape = np.where(room == 0, x, escape)
        full = codes % SYMBOLS ** (k + 1)
        i = np.searchsorted(level_codes, full)
        i[i == len(level_codes)] = 0
        here = np.where(known & (level_codes[i] == full), level_n[i], 0).astype(np.float64)
        p = np.where(known, np.where(here > 0, here, q[c] * escape) / (size[c] + q[c]), p)
        x = np.where(known, escape, x)
        n = np.where(known, here, 0.0)
        above_codes, above_n = level_codes, level_n
    return np.log10(p)


def _answer(pairs_shared, order: int):
    def bin_rows(number: int, rows: list):
        words_ = [np.frombuffer(r[1], U64) for r in rows]
        runs = [np.cumsum(unpack(r[3], np.int64)) for r in rows]
        kinds = [np.uint64 if r[5] else np.uint32 for r in rows]
        uniq, at = np.unique(np.concatenate(words_), return_inverse=True)
        n = np.zeros(len(uniq), np.int64)
        np.add.at(n, at, np.concatenate([unpack(r[2], k).astype(np.int64) for r, k in zip(rows, kinds, strict=True)]))
        codes, spot = np.unique(np.concatenate(runs), return_inverse=True)
        m = np.zeros(len(codes), np.int64)
        np.add.at(m, spot, np.concatenate([unpack(r[4], k).astype(np.int64) for r, k in zip(rows, kinds, strict=True)]))
        score = log_probabilities(codes, m, pairs_shared.value, order).astype(np.float32) if len(codes) else np.zeros(0, np.float32)
        out = []
        a = b = 0
        for r, w, c in zip(rows, words_, runs, strict=True):
            out.append((r[0], number, pack(n[at[a : a + len(w)]]), pack(score[spot[b : b + len(c)]])))
            a, b = a + len(w), b + len(c)
        out.append((-1 - number, number, int(n.sum()).to_bytes(8, "little"), int(np.count_nonzero(n)).to_bytes(8, "little")))
        for lo in range(0, len(out), 256):
            part = list(zip(*out[lo : lo + 256], strict=True))
            yield pa.RecordBatch.from_pydict({"block": pa.array(part[0], pa.int64()), "bin": pa.array(part[1], pa.int64()), "word_n": pa.array(part[2], pa.binary()), "run_p": pa.array(part[3], pa.binary())})

    def run(batches):
        number, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "bin", "words", "word_n", "runs", "run_n", "wide")]
            for block, k, *rest in zip(*columns, strict=True):
                if k != number:
                    if rows:
                        yield from bin_rows(number, rows)
                    number, rows = k, []
                rows.append((block, *rest))
        if rows:
            yield from bin_rows(number, rows)

    return run


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("stat_n", pa.int64()), ("stat_v", pa.int64())])


def _score(order: int, bins: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:  # the sums of a bin
            rows = right.to_pydict()
            none = [None] * right.num_rows
            sums = [int.from_bytes(x, "little") for x in rows["word_n"]], [int.from_bytes(x, "little") for x in rows["run_p"]]
            return pa.table({f.name: pa.array(v, f.type) for f, v in zip(SCORED, (*[none] * 6, *sums), strict=True)})
        texts = left.column("text").combine_chunks().cast(pa.large_string())
        r = Requests(texts, order, bins)
        by = sorted(zip(right.column("bin").to_pylist(), right.column("word_n").to_pylist(), right.column("run_p").to_pylist(), strict=True))
        c = np.zeros(len(r.words), np.int64)
        c[r.word_order] = np.concatenate([unpack(w, np.int64) for _, w, _ in by])
        p = np.zeros(len(r.codes))
        p[r.run_order] = np.concatenate([unpack(x, np.float32) for _, _, x in by])
        n = left.num_rows
        mine = c[r.word_at]
        n_words = np.bincount(r.word_text, minlength=n)
        known = np.bincount(r.word_text, mine > 0, n)
        logs = np.bincount(r.word_text, np.log10(mine + 1.0), n)
        run_sums = np.concatenate(([0.0], np.cumsum(p[r.run_at])))
        ends = np.cumsum(r.length)
        score = run_sums[ends] - run_sums[ends - r.length]
        none = pa.nulls(n, pa.int64())
        return pa.table([left.column("doc_id").combine_chunks(), left.column("held_out").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(score), none, none], schema=SCORED)

    return run


def score_texts(docs: DataFrame, held_out: Column, order: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text); rows that are held out, and those without an id, are not trained on."""
    spark = docs.sparkSession
    train = F.col("doc_id").isNotNull() & ~F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), train.alias("train"))
    size, n_train, pairs = pair_counts(rows, F.col("train"))
    blocks = max(1, -(-size // block_bytes))
    bins = max(shuffle_partitions(spark), -(-int(size * REQUESTS_PER_BYTE) // BIN_REQUESTS))
    spread = max(shuffle_partitions(spark), blocks // 8)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(spread, "block")
    asked = dealt.select("block", "text", "train").sortWithinPartitions("block").mapInArrow(lean(_ask(order, bins)), "block long, bin long, words binary, word_n binary, runs binary, run_n binary, wide boolean")
    asked = asked.repartition(shuffle_partitions(spark), "bin").sortWithinPartitions("bin", "block")
    answers = asked.mapInArrow(lean(_answer(spark.sparkContext.broadcast(pairs), order)), "block long, bin long, word_n binary, run_p binary").repartition(spread, "block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, stat_n long, stat_v long"
    out = cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, bins), schema))
    stats = out.where(F.col("stat_n").isNotNull()).agg(F.coalesce(F.sum("stat_n"), F.lit(0)), F.coalesce(F.sum("stat_v"), F.lit(0))).first()
    n, v = int(stats[0]) + n_train, int(stats[1]) + (1 if n_train else 0)
    bottom = float(np.log10(float(n + v + 1)))
    tokens = F.col("n_tokens") + 1
    return out.where(F.col("stat_n").isNull()).select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + (1 if n_train else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(n_train + 1.0)) - tokens * bottom).alias("base_score"), "score",
    )
