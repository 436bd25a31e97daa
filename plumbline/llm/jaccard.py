"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct word shingles, named by a 128-bit digest; equal sets are one node. The join is exact:

1. Signatures. Two sets of at most r tokens with Jaccard >= 0.8 differ in at most D = 2r/9 tokens, so of D + 1 + e parts of
   the hash range at least e + 1 are the same in both. Each set emits a digest of every strong part (one with a token
   that is not frequent) for its own size class and the next; a set with more than e weak parts also emits its
   prefix tokens (frequent ones ordered last), so that a pair whose equal parts are all weak still meets.
2. Groups. Under each signature every set is held against one lead (never all pairs), the set of the most signatures, as the likeliest
   original; links are verified exactly and their connected sets form the groups, which are dealt into blocks of a few sets.
3. Matrix. Each block keeps the union of its tokens. Where sets of different components share a signature, a set is held against the unions
   of the other group's blocks: its overlap with a union bounds its overlap with every member. Only blocks that reach the bound are
   opened, and their members of fitting size are verified exactly. As only components are asked for, a set stops at its first link
   into the group's component: each round opens more blocks for the sets that are still outside, first in the group that
   fills most of a signature, then in all others of several blocks. No pair is left undecided unless it is needless.
4. Loose sets. Groups of one block do not meet one by one: their sets are dealt, linked or not, into cells by the signature that
   most of them share, and a set asks a cell. The cell knows the tokens that most of its sets have and, for each other token, which sets
   have it: near copies of one original that are not near one another have few of those in common, and make no pair.

Frequent tokens come from a bounded sample and only steer the signatures: any choice gives the same result. Defined cases: null
texts and texts without words are empty and linked with nothing; a document of fewer words than the shingle is one shingle; null ids get the
component of their set but never name one; repeated rows get a row each. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U64, WordHasher, cut, few_rows, lean, mix, padded, raw_text, rolling, shuffle_partitions, slices, words
from .components import components

SHINGLE = 5
#: Bytes of a signature inside its bucket; the bucket number adds to them.
SIG_BYTES = 5
BUCKET_SIGNATURES = 1_000_000
HOT_TOKENS = 1 << 18
#: Rows of ids of sets and a few longs that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets of a block of a group, and how many times more blocks each round opens.
BLOCK_SETS, BLOCK_GROWTH = 16, 4
#: Sets of a cell of small groups, and their tokens, about.
CELL_SETS, CELL_TOKENS = 256, 1 << 20
#: Tokens of a strong part, at least; one of them must not be frequent.
STRONG = 1
#: A group whose union is larger is always opened.
UNION_TOKENS = 4_000_000


def shingle_sets(array: pa.Array, hasher: WordHasher, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): the sorted distinct shingle hashes of each text."""
    data, offsets = raw_text(array)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    buffer, starts = padded(LOWER[data], offsets)
    s, e = words(buffer, NOT_SPACE)
    if not len(s):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    h = hasher.hashes(buffer, s, e)
    first = np.searchsorted(s, np.concatenate((starts, [len(buffer) + 1])))
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    tokens = rolling(h, width)
    inside = doc[: len(tokens)] == doc[width - 1 :][: len(tokens)] if len(tokens) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < width))
    tokens, owner = tokens[inside], doc[: len(inside)][inside]
    if len(short):
        more = np.array([mix(rolling(h[first[i] : first[i + 1]], int(count[i])) + U64(int(count[i])))[0] for i in short], U64)
        tokens, owner = np.concatenate((tokens, more)), np.concatenate((owner, short))
    order = np.argsort(tokens, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(n + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def digests(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set as two signed longs."""
    return tuple(mix(_sums(mix(tokens ^ U64(c)), bounds)).view(np.int64) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))


def set_ids(tokens: np.ndarray, bounds: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """The names by which sets are joined: the first half of the digest, but the second where sets share the first."""
    a, b = digests(tokens, bounds)
    return np.where(np.isin(a, clash), b, a) if len(clash) else a


@lru_cache
def size_classes(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, parts, weak parts allowed) of each size class, up to a class beyond `top`."""
    r, m, e = [4], [1], [0]
    while r[-1] <= top or len(r) < 3 or r[-2] <= top:
        size = max(r[-1] + 1, r[-1] * 5 // 4)
        low = r[-1] + 1
        least = 2 * size // 9 + 1
        slack = 1
        for _ in range(20):
            parts = least + slack
            mean = parts * sum(comb(low, j) * (1 / parts) ** j * (1 - 1 / parts) ** (low - j) for j in range(STRONG))
            slack = int(np.ceil(mean + 1.5 * np.sqrt(mean) + 0.5))
        r.append(size)
        m.append(least + slack)
        e.append(slack)
    return np.array(r), np.array(m), np.array(e)


def signatures(tokens: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, owner) of the sets; owner is the position of the set."""
    size = np.diff(bounds)
    if not len(tokens):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    r, m, e = size_classes(int(size.max()))
    own = np.searchsorted(r, size)
    owner = np.repeat(np.arange(len(size)), size)
    cold = np.ones(len(tokens), bool)
    if len(hot):
        i = np.searchsorted(hot, tokens)
        i[i == len(hot)] = 0
        cold = hot[i] != tokens
    inner, spread = mix(tokens ^ U64(0xA4093822299F31D0)), tokens >> U64(32)
    out, owners = [], []
    for step in (0, 1):
        k = own + step
        parts = np.where(size > 0, m[k], 0)
        base = np.concatenate(([0], np.cumsum(parts)))
        part = base[owner] + ((spread * parts[owner].astype(U64)) >> U64(32)).astype(np.int64)
        # tokens are sorted, so the parts of a set are runs
        begin = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        strong = (np.diff(np.concatenate(([0], np.cumsum(cold)))[begin]) > 0) & (np.diff(begin) >= STRONG)
        at = begin[:-1][strong]
        number, who = part[at] - base[owner[at]], owner[at]
        value = _sums(inner, begin)[strong]
        out.append(mix(value + mix(k[who].astype(U64) * U64(1 << 32) + number.astype(U64))))
        owners.append(who)
        weak = parts - np.bincount(who, minlength=len(size))
        many = np.flatnonzero((weak > e[k]) & (size > 0))
        if len(many):
            n = size[many]
            prefix = n - -(-4 * n // 5) + 1
            # the order of the prefix filter: frequent tokens last
            every = np.repeat(bounds[many] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            every = every[np.lexsort((every, ~cold[every], owner[every]))]
            take = every[np.repeat((np.cumsum(n) - n) - (np.cumsum(prefix) - prefix), prefix) + np.arange(prefix.sum())]
            who = np.repeat(many, prefix)
            out.append(mix(inner[take] + mix(k[who].astype(U64) * U64(1 << 32) + U64(0xFFFFFFFF))))
            owners.append(who)
    return np.concatenate(out), np.concatenate(owners)


INFO = "doc_id long, n long, id long, twin long"


def set_names(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n, id, twin): size and digest of each row's set."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = shingle_sets(part.column("text"), hasher, width)
                a, b = digests(tokens, bounds)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": pa.array(np.diff(bounds), pa.int64()), "id": pa.array(a), "twin": pa.array(b)})

    return docs.mapInArrow(lean(run), INFO)


def frequent_tokens(docs: DataFrame, width: int, most: int = HOT_TOKENS, share: float = 0.125, least: int = 3) -> np.ndarray:
    """Sorted tokens that at least `least` sets of a hash sample of the documents hold; the `most` most frequent ones."""
    limit = int(share * (1 << 30))

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = shingle_sets(part.column("text"), hasher, width)
                names = digests(tokens, bounds)[0]
                _, at = np.unique(names, return_index=True)
                keep = np.zeros(len(names), bool)
                keep[at] = True
                tokens = np.sort(tokens[np.repeat(keep, np.diff(bounds))])
                uniq, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_pydict({"t": pa.array(uniq.view(np.int64)), "n": pa.array(n, pa.int64())})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < limit).select("text")
    counts = some.mapInArrow(lean(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counts.orderBy(F.desc("n"), "t").limit(most).select("t").toArrow()
    return np.sort(np.asarray(got.column("t"), np.int64).view(U64))


def shared_signatures(docs: DataFrame, hot: np.ndarray, n_tokens: int, width: int, clash: np.ndarray) -> DataFrame:
    """(sig, id): the signatures of several sets, each with every set under it once."""
    spark = docs.sparkSession
    buckets = max(1, -(-int(0.7 * n_tokens) // BUCKET_SIGNATURES), shuffle_partitions(spark))
    shared = spark.sparkContext.broadcast(hot)

    def emit(held: list):
        sig, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (sig >> U64(40)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        sig, ids, bucket = sig[order], ids[order], bucket[order]
        at = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        short = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES])
        blobs = [short[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        names = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at[:-1]], pa.int64()), "sigs": pa.array(blobs, pa.binary()), "ids": pa.array(names, pa.binary())})

    def split(batches):
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = shingle_sets(part.column("text"), hasher, width)
                names = set_ids(tokens, bounds, clash)
                sig, who = signatures(tokens, bounds, shared.value)
                _, at = np.unique(names, return_index=True)  # copies inside a chunk need no second entry
                once = np.zeros(len(names), bool)
                once[at] = True
                sig, who = sig[once[who]], who[once[who]]
                if len(sig):
                    held.append((sig, names[who]))
                    size += len(sig)
                if size > 1_500_000:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def gather(batches):
        state = Bucket()
        for batch in batches:
            numbers = batch.column("bucket").to_numpy()
            sigs, ids = batch.column("sigs"), batch.column("ids")
            for i, number in enumerate(numbers):
                if number != state.number:
                    yield from state.done()
                    state = Bucket(int(number))
                state.add(sigs[i].as_buffer(), ids[i].as_buffer())
                if state.size > 1_500_000:
                    yield from state.compact()
        yield from state.done()

    rows = docs.select("text").mapInArrow(lean(split), "bucket long, sigs binary, ids binary")
    rows = rows.repartition(shuffle_partitions(spark) * max(1, round(buckets / shuffle_partitions(spark) / 4)), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lean(gather), "sig long, id long")


class Bucket:
    """Signatures of one bucket; `compact` leaves one entry per signature, so memory follows their number, not that of the rows."""

    def __init__(self, number: int = -1):
        self.number, self.held, self.size = number, [], 0
        self.sig, self.first, self.told = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, sigs, ids) -> None:
        s = np.frombuffer(sigs, np.uint8).reshape(-1, SIG_BYTES)
        wide = np.zeros((len(s), 8), np.uint8)
        wide[:, :SIG_BYTES] = s
        self.held.append((wide.view(U64)[:, 0], np.frombuffer(ids, np.int64)))
        self.size += len(s)

    def compact(self):
        if not self.held:
            return
        sig = np.concatenate([self.sig, *(s for s, _ in self.held)])
        ids = np.concatenate([self.first, *(i for _, i in self.held)])
        state = np.zeros(len(sig), np.int8)  # 0: new, 1: known first set, 2: known and told
        state[: len(self.sig)] = 1 + self.told
        self.held = []
        order = np.lexsort((ids, state == 0, sig))
        sig, ids, state = sig[order], ids[order], state[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(sig)))
        first = np.repeat(ids[at], size)
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        other = fresh & (ids != first)
        several = np.add.reduceat(other, at) > 0
        other[at] = several & (state[at] < 2)  # the first set is told with the second one
        rest = np.flatnonzero(other)
        self.sig, self.first, self.told, self.size = sig[at], ids[at], several | (state[at] == 2), 0
        key = mix(sig[rest] + mix(np.full(len(rest), self.number, np.int64).view(U64) + U64(1))).view(np.int64)
        for lo in range(0, len(rest), 1 << 17):
            part = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_pydict({"sig": pa.array(key[part]), "id": pa.array(ids[rest[part]])})

    def done(self):
        yield from self.compact()


def _bits(ids: DataFrame, column: str, count: int) -> tuple[int, np.ndarray]:
    """A bit table of hashed values, of 64 bits a value but at most 2^30 bits."""
    power = int(min(30, max(12, np.ceil(np.log2(max(1, count) * 64)))))
    spot = F.shiftrightunsigned(F.xxhash64(column), 64 - power)
    words_ = ids.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << (power - 6), np.int64)
    table[np.asarray(words_.column("w"))] = np.asarray(words_.column("b"))
    return power, table.view(U64)


def token_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, clash: np.ndarray) -> DataFrame:
    """(id, n, sketch, tokens): the sets of the wanted ids, read from one row of each; tokens are packed 64-bit hashes, the sketch has the upper 32 bits of each."""
    need = cut(wanted.join(nodes.select("id", "doc_id"), "id"))
    count = need.count()
    power, table = _bits(need, "doc_id", count)
    shared = docs.sparkSession.sparkContext.broadcast((power, table))

    def run(batches):
        hasher = WordHasher()
        bits = shared.value[1]
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            hit = (bits[spot >> 6] >> (spot & 63).astype(U64)) & U64(1)
            for part in slices(batch.filter(pa.array(hit.astype(bool))), "text"):
                tokens, bounds = shingle_sets(part.column("text"), hasher, width)
                names = set_ids(tokens, bounds, clash)
                each = [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sketches = [np.unique((t >> U64(32)).astype(np.uint32)).tobytes() for t in each]
                yield pa.RecordBatch.from_pydict({"id": pa.array(names), "doc_id": part.column("doc_id"), "n": pa.array(np.diff(bounds), pa.int64()), "sketch": pa.array(sketches, pa.binary()), "tokens": pa.array([t.tobytes() for t in each], pa.binary())})

    spot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - power)
    # equal ids of documents are asked for after the join: a key of both columns would cost a second shuffle
    row = F.col("__doc").bitwiseXOR(F.col("doc_id")) == 0
    sets = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", spot.alias("spot")).mapInArrow(lean(run), "id long, doc_id long, n long, sketch binary, tokens binary")
    chosen = cut(sets.withColumnRenamed("doc_id", "__doc").join(_told(need), "id").where(row).select("id", "n", "sketch", "tokens"))
    # only repeated rows give a set twice
    again = cut(chosen.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    if not again.limit(1).count():
        return chosen
    once = chosen.join(_told(again), "id", "left_semi").dropDuplicates(["id"])
    return cut(chosen.join(_told(again), "id", "left_anti").union(once))


def _told(rows: DataFrame) -> DataFrame:
    """rows, a written table, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of members of the sorted array x that the sorted array y holds."""
    if not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _wanted(sets: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """The sets that the pairs name, so that only they are shuffled; more than BROADCAST_IDS of them are left to the join itself."""
    ids = pairs.select(F.col(column).alias("id")).distinct()
    return sets.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_IDS else sets


def _with_sets(rows: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """rows, a written table, with the columns of their sets, which `key` names in both: few rows are sent to the sets, so that no set is shuffled for them."""
    if rows.count() <= BROADCAST_IDS:
        return sets.join(F.broadcast(rows), key)
    ids = rows.select(key).distinct()
    return rows.join(sets.join(F.broadcast(ids), key, "left_semi") if ids.count() <= BROADCAST_IDS else sets, key)


def pruned(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y), a written table, that their sketches do not rule out: similar sets of a and b tokens leave at most a - 4 (a + b) / 9 tokens of x outside y, and shortened tokens never count more."""
    one = _with_sets(pairs, sets.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx")), "x")
    both = one.where(F.col("nx").isNotNull()).join(_wanted(sets, pairs, "y").select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy")), "y")
    fit = both.where((F.col("nx") * 5 >= F.col("ny") * 4) & (F.col("ny") * 5 >= F.col("nx") * 4))

    def run(batches):
        for batch in few_rows(batches, "sx"):
            n, m = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            left, right = batch.column("sx"), batch.column("sy")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint32), np.frombuffer(right[i].as_buffer(), np.uint32)
                common = _common(x, y) if len(x) <= len(y) else _common(y, x)
                least = 4 * (n[i] + m[i])
                good[i] = 9 * (len(x) - common) <= 9 * n[i] - least and 9 * (len(y) - common) <= 9 * m[i] - least
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(good))

    return fit.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(lean(run), "x long, y long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= 80 * union; pairs are a written table."""
    one = _with_sets(pairs, sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx")), "x")
    both = one.join(_wanted(sets, pairs, "y").select(F.col("id").alias("y"), F.col("tokens").alias("ty")), "y")

    def run(batches):
        for batch in few_rows(batches, "tx"):
            left, right = batch.column("tx"), batch.column("ty")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
                common = _common(x, y) if len(x) <= len(y) else _common(y, x)
                good[i] = 100 * common >= 80 * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(good))

    return both.select("x", "y", "tx", "ty").mapInArrow(lean(run), "x long, y long")


def opened(asked: DataFrame, sets: DataFrame, unions: DataFrame) -> DataFrame:
    """(id, label, most) where the union of the group does not rule out every member; `most` is the largest size of a member that could still be similar. A group too large for a union is opened."""
    one = _with_sets(asked, sets.select("id", F.col("n").alias("nx"), F.col("sketch").alias("sx")), "id")
    both = one.where(F.col("nx").isNotNull()).join(unions.select("label", "tokens"), "label")

    def run(batches):
        for batch in few_rows(batches, "tokens"):
            n = batch.column("nx").to_numpy()
            left, right = batch.column("sx"), batch.column("tokens")
            most = 5 * n // 4
            for i in range(batch.num_rows):
                if right[i].is_valid:
                    x, y = np.frombuffer(left[i].as_buffer(), np.uint32), np.frombuffer(right[i].as_buffer(), np.uint32)
                    # a member of b tokens leaves at most a - 4 (a + b) / 9 tokens of the set outside
                    most[i] = min(most[i], (5 * n[i] - 9 * (len(x) - _common(x, y))) // 4)
            good = pa.array(5 * most >= 4 * n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(most)], names=["id", "label", "most"]).filter(good)

    return both.select("id", "label", "nx", "sx", "tokens").mapInArrow(lean(run), "id long, label long, most long")


def _unions(members: DataFrame) -> DataFrame:
    """(label, tokens): union of the sketches of each group of (label, tokens); null where it is too large to hold."""

    def merge(held: dict):
        for label, sets in held.items():
            union = np.unique(np.concatenate(sets)) if sets is not None else None
            yield label, None if union is None or len(union) > UNION_TOKENS else union.tobytes()

    def out(held: dict):
        rows = list(merge(held))
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            yield pa.RecordBatch.from_pydict({"label": pa.array([r[0] for r in part], pa.int64()), "tokens": pa.array([r[1] for r in part], pa.binary())})

    def partial(batches):
        held, size = {}, 0
        for batch in batches:
            for label, t in zip(batch.column("label").to_pylist(), batch.column("tokens"), strict=True):
                if not t.is_valid:
                    held[label] = None
                elif held.setdefault(label, []) is not None:
                    held[label].append(np.frombuffer(t.as_buffer(), np.uint32).copy())
                    size += len(held[label][-1])
                if size > 4_000_000:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    def final(batches):
        label_, sets, size = None, [], 0
        for batch in batches:
            for label, t in zip(batch.column("label").to_pylist(), batch.column("tokens"), strict=True):
                if label != label_:
                    if label_ is not None:
                        yield from out({label_: sets})
                    label_, sets, size = label, [], 0
                if not t.is_valid or sets is None:
                    sets = None
                    continue
                sets.append(np.frombuffer(t.as_buffer(), np.uint32).copy())
                size += len(sets[-1])
                if size > 2 * UNION_TOKENS:
                    union = np.unique(np.concatenate(sets))
                    sets, size = (None, 0) if len(union) > UNION_TOKENS else ([union], len(union))
        if label_ is not None:
            yield from out({label_: sets})

    some = members.select("label", "tokens").mapInArrow(lean(partial), "label long, tokens binary")
    return some.repartition(shuffle_partitions(members.sparkSession), "label").sortWithinPartitions("label").mapInArrow(lean(final), "label long, tokens binary")


def _links_to_leads(members: DataFrame) -> DataFrame:
    """Pairs (x, y) to test: each set with two leads of the signatures it shares; under each signature the set of the most signatures leads, as the likeliest original of a family of copies."""
    degree = cut(members.groupBy("id").agg(F.count("*").alias("degree")))
    named = members.join(_told(degree), "id")
    heads = named.groupBy("sig").agg(F.min_by("id", F.struct(-F.col("degree"), F.xxhash64("id"))).alias("lead"))
    order = F.xxhash64("lead", "id")
    best = named.join(heads, "sig").where(F.col("id") != F.col("lead")).groupBy(F.col("id").alias("y")).agg(F.min_by("lead", order).alias("a"), F.max_by("lead", order).alias("b"))
    pairs = best.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("x"), "y")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links (x, y) have joined their components."""
    a, b = labels.select(F.col("id").alias("x"), F.col("label").alias("lx")), labels.select(F.col("id").alias("y"), F.col("label").alias("ly"))
    edges = links.join(a, "x").join(b, "y").select(F.col("lx").alias("x"), F.col("ly").alias("y"))
    new = components(edges).select(F.col("node").alias("label"), F.col("label").alias("__new"))
    return cut(labels.join(new, "label", "left").withColumn("label", F.coalesce("__new", "label")).drop("__new"))


def _grouped(labels: DataFrame) -> DataFrame:
    """labels with their group (the component so far, from here on fixed), its number of blocks and the set's block; `cell` names group and block."""
    blocks = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    return cut(labels.join(blocks, "label").withColumn("group", F.col("label")).withColumn("cell", F.xxhash64("group", block)))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, id, n, label, group, blocks) of the signatures that still hold several components."""
    named = members.join(_told(labels.select("id", "n", "label", "group", "blocks")), "id")
    mixed = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high")).select("sig")
    return cut(named.join(mixed, "sig", "left_semi"))


def _ask_largest(named: DataFrame) -> DataFrame:
    """(id, group): each set with the group that fills most of a signature it shares."""
    sizes = named.groupBy("sig", "group").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    largest = sizes.groupBy("sig").agg(F.max(F.struct("n", "group", "blocks")).alias("most")).select("sig", F.col("most.group").alias("other"), F.col("most.blocks").alias("of"))
    return cut(named.join(largest, "sig").where(F.col("group") != F.col("other")).select("id", F.col("other").alias("group"), F.col("of").alias("blocks")).distinct())


def _fits(least: str, most: str) -> Column:
    """Whether a set of n tokens can be similar to one of the sizes between two."""
    return (F.col("n") * 5 >= F.col(least) * 4) & (F.col(most) * 5 >= F.col("n") * 4)


def _ask_all(named: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, group): each set with every group of several blocks and another component under a signature it shares that has members of fitting size there, from the side of the smaller group; `asked` ones are done."""
    others = named.where("blocks > 1").groupBy("sig", F.col("group").alias("other"), F.col("label").alias("component"), F.col("blocks").alias("of")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    first = (F.col("blocks") < F.col("of")) | ((F.col("blocks") == F.col("of")) & (F.col("group") < F.col("other")))
    both = named.join(others, "sig").where((F.col("label") != F.col("component")) & first & _fits("least", "most"))
    return cut(both.select("id", F.col("other").alias("group"), F.col("of").alias("blocks")).distinct().join(asked, ["id", "group"], "left_anti"))


def _cells(loose: DataFrame) -> DataFrame:
    """loose (sig, id, n, label) with the cell of each set: sets of the same largest signature, a few in each cell."""
    many = loose.groupBy("sig").agg(F.count("*").alias("many"))
    homes = loose.join(many, "sig").groupBy("id").agg(F.max_by("sig", F.struct("many", "sig")).alias("home"), F.first("n").alias("n"))
    full = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / CELL_SETS, F.sum("n") / CELL_TOKENS)).cast("int").alias("cells"))
    cell = F.xxhash64("home", F.pmod(F.xxhash64("id", F.lit(11)), F.col("cells"))).alias("cell")
    return cut(loose.join(homes.join(full, "home").select("id", cell), "id"))


def _indexed(members: DataFrame) -> DataFrame:
    """One row for each cell of (cell, id, label, n, tokens): its sets, the tokens that most of them have (`common`; `known`: how many of these a set has) and the others, each with the set that has it (`rare`, `who`)."""
    numbers = ("ids", "labels", "sizes", "lengths", "known")
    kind = "cell long, " + ", ".join(f"{c} binary" for c in (*numbers, "common", "rare", "who"))

    def packed(cell: int, rows: list) -> pa.RecordBatch:
        *who, sets = zip(*rows, strict=True)
        length = np.array([len(t) for t in sets], np.int64)
        owner, tokens = np.repeat(np.arange(len(sets), dtype=np.int32), length), np.concatenate(sets)
        union, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        frequent = (2 * n > len(sets))[at]
        order = np.argsort(tokens[~frequent], kind="stable")
        columns = [*(np.array(x, np.int64) for x in who), length, np.bincount(owner[frequent], minlength=len(sets)).astype(np.int64), union[2 * n > len(sets)], tokens[~frequent][order], owner[~frequent][order]]
        return pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip((*numbers, "common", "rare", "who"), columns, strict=True)})

    def run(batches):
        cell, held = None, []
        for batch in batches:
            for c, *row, t in zip(*(batch.column(x).to_pylist() for x in ("cell", "id", "label", "n")), batch.column("tokens"), strict=True):
                if c != cell and held:
                    yield packed(cell, held)
                    held = []
                cell = c
                held.append((*row, np.frombuffer(t.as_buffer(), np.uint32).copy()))
        if held:
            yield packed(cell, held)

    some = members.select("cell", "id", "label", "n", "tokens").repartition(shuffle_partitions(members.sparkSession), "cell").sortWithinPartitions("cell")
    return some.mapInArrow(lean(run), kind)


def _cell_pairs(asks: DataFrame, sets: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs (x, y) of a set of `asks` (id, label, cell) and a set of its cell that has another label and that the index does not rule out, by the bound of `pruned`."""
    one = _with_sets(asks.withColumnRenamed("label", "mine"), sets.select("id", F.col("n").alias("nx"), F.col("sketch").alias("sx")), "id")
    both = one.join(index, "cell")

    def run(batches):
        for batch in few_rows(batches, "rare"):
            ids, mine, n = (batch.column(c).to_numpy() for c in ("id", "mine", "nx"))
            for i in range(batch.num_rows):
                col = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                x, common, rare, who = col("sx", np.uint32), col("common", np.uint32), col("rare", np.uint32), col("who", np.int32)
                y, label, m, length, known = (col(c, np.int64) for c in ("ids", "labels", "sizes", "lengths", "known"))
                at = np.searchsorted(x, rare)
                at[at == len(x)] = 0
                shared = np.minimum(_common(x, common), known) + np.bincount(who[x[at] == rare], minlength=len(y))
                least = 4 * (n[i] + m)
                good = (label != mine[i]) & (9 * (len(x) - shared) <= 9 * n[i] - least) & (9 * (length - shared) <= 9 * m - least)
                if good.any():
                    near = y[good]
                    yield pa.RecordBatch.from_pydict({"x": pa.array(np.minimum(near, ids[i])), "y": pa.array(np.maximum(near, ids[i]))})

    return both.mapInArrow(lean(run), "x long, y long")


def _loose_linked(named: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels after the sets of groups of one block have met: each set asks every cell with sets of another component and of fitting size under a signature it shares; of two cells, the sets of one ask the other."""
    loose = _cells(named.where("blocks = 1").select("sig", "id", "n", "label"))
    others = loose.groupBy("sig", F.col("cell").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("low"), F.max("label").alias("high"))
    foreign = (F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))
    both = loose.join(others, "sig").where((F.col("cell") <= F.col("other")) & foreign & _fits("least", "most"))
    asks = cut(both.select("id", "label", F.col("other").alias("cell")).distinct())
    if not asks.limit(1).count():
        return labels
    held = cut(loose.select("id", "cell", "label").distinct())
    index = cut(_indexed(_with_sets(held, sets.select("id", "n", F.col("sketch").alias("tokens")), "id")))
    pairs = cut(_cell_pairs(asks, sets, index).distinct())
    new = cut(verified(cut(pruned(pairs, sets)), sets))
    return _merged(labels, new) if new.limit(1).count() else labels


def _answered(asks: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels after each set of `asks` has been held against its group: blocks of the group are opened, more in each round, until the set is in the group's component or no block is left."""
    need = cut(labels.join(asks.select("group").distinct(), "group", "left_semi").select("id", "cell"))
    unions = cut(_unions(_with_sets(need, sets.select("id", F.col("sketch").alias("tokens")), "id").select(F.col("cell").alias("label"), "tokens")))
    low, high = 0, 1
    while True:
        own, theirs = labels.select("id", "label"), labels.groupBy("group").agg(F.min("label").alias("component"))
        open_ = asks.where(F.col("blocks") > low).join(own, "id").join(theirs, "group").where(F.col("label") != F.col("component"))
        turn = F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("blocks")) - 1))
        cells = open_.select("id", "group", "blocks", turn.alias("turn")).select("id", F.xxhash64("group", F.pmod(F.xxhash64("id") + F.col("turn"), F.col("blocks")).cast("int")).alias("label"))
        cells = cut(cells)
        if not cells.limit(1).count():
            return labels
        hit = opened(cells, sets, unions).select(F.col("id").alias("x"), F.col("label").alias("cell"), "most")
        pairs = hit.join(labels.select(F.col("id").alias("y"), "n", "cell"), "cell").where((F.col("n") <= F.col("most")) & (F.col("x") != F.col("y"))).select("x", "y")
        new = cut(verified(cut(pruned(cut(pairs.distinct()), sets)), sets))
        if new.limit(1).count():
            labels = _merged(labels, new)
        low, high = high, high + BLOCK_GROWTH * (high - low)


def joined(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    info = cut(set_names(docs, width))
    n_tokens = int(info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    by = lambda rows: cut(rows.where(F.col("n") > 0).groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.min("twin").alias("a"), F.max("twin").alias("b"), F.count("*").alias("copies")))
    nodes = by(info)
    # about (sets / 2^32.5)^2 names of 64 bits are shared: those sets go by the other half of their digest
    clash = np.sort(np.asarray(nodes.where(F.col("a") != F.col("b")).select("id").toArrow().column("id"), np.int64))
    if len(clash):
        info = cut(info.withColumn("id", F.when(F.col("id").isin(clash.tolist()), F.col("twin")).otherwise(F.col("id"))))
        nodes = by(info)
    hot = frequent_tokens(docs, width)
    members = cut(shared_signatures(docs, hot, n_tokens, width, clash))
    known = nodes.where(F.col("doc_id").isNotNull())
    sets = token_sets(docs, known, members.select("id").distinct(), width, clash)
    labels = sets.select("id", "n", F.col("id").alias("label"))
    links = cut(verified(cut(pruned(cut(_links_to_leads(members)), sets)), sets))
    labels = _grouped(_merged(labels, links))
    named = _mixed(members, labels)
    asks = _ask_largest(named)
    labels = _answered(asks, labels, sets)
    named = _mixed(named.select("sig", "id"), labels)  # components only grow, so no other signatures are left
    labels = _answered(_ask_all(named, asks.select("id", "group")), labels, sets)
    labels = _loose_linked(named, labels, sets)

    at = nodes.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = at.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size"))
    placed = at.join(least, "label").where(F.col("size") > 1).select("id", "component_id")
    return info.join(placed, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
