"""Shared pieces of the training-data operators: session helpers and vectorised byte handling.

Texts reach numpy as one padded byte buffer per chunk: every document is followed by one
separator byte, so no word, window or context ever crosses from one document into the next.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is made only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Removes the shuffle files of a query when it has ended, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written between two collections of the driver's garbage.
TABLES_A_GC = 4
#: Percent of the driver's heap that stay free after such a collection, at most.
FREE_HEAP = 40
_written = itertools.count(1)
_tables: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables", default=None)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of each query that runs inside are removed when it has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and continue from its files: lineage ends there and any executor can read them."""
    path = f"{checkpoint_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if (tables := _tables.get()) is not None:
        tables.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if next(_written) % TABLES_A_GC == 0:
        released(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Collect the driver's garbage: a job of hundreds of small queries leaves so much of it that its heap grows to the limit, and Spark clears the broadcasts of ended queries only then."""
    gc.collect()
    _give_back()
    with heap_shrunk(spark):
        spark._jvm.System.gc()


@contextlib.contextmanager
def heap_shrunk(spark: SparkSession):
    """A collection inside leaves at most FREE_HEAP percent of the driver's heap free; the JVM's own 70 keep more than three times what is in use. A JVM without that flag goes by its own rule."""
    flag, before = "MaxHeapFreeRatio", None
    with contextlib.suppress(Py4JError):
        kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        bean = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        before = bean.getVMOption(flag).getValue()
        bean.setVMOption(flag, str(FREE_HEAP))
    try:
        yield
    finally:
        if before is not None:
            bean.setVMOption(flag, before)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def tables_dropped(spark: SparkSession):
    """The tables that cut() writes inside are deleted at the end: for use around a result that is written inside too."""
    mark = _tables.set([])
    try:
        yield
    finally:
        for path in _tables.get():
            delete(spark, path)
        _tables.reset(mark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run):
    """run(batches) that gives unused memory back to the system when its task ends: Python workers are used again by later stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def few_rows(batches, column: str, limit: int = 8 << 20):
    """Batches cut so that a binary column has about `limit` bytes in each (one row at least)."""
    for batch in batches:
        yield from slices(batch, column, limit)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by one aggregate."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Sub-batches of at most `limit` text bytes (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total = np.cumsum(lengths, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def raw_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def padded(data: np.ndarray, offsets: np.ndarray, lead: int = 0, tail: int = 1, fill: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Put `lead` fill bytes before and `tail` after each document; returns (buffer, starts)."""
    n = len(offsets) - 1
    starts = offsets[:-1] + lead + np.arange(n, dtype=np.int64) * (lead + tail)
    out = np.full(len(data) + n * (lead + tail), fill, np.uint8)
    mask = np.ones(len(out), bool)
    for k in range(lead):
        mask[starts - 1 - k] = False
    ends = starts + np.diff(offsets)
    for k in range(tail):
        mask[ends + k] = False
    out[mask] = data
    return out, starts


#: ASCII upper to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word when words are runs without ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word when words are runs of a-z, 0-9 and everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """64-bit hashes of all words of a buffer by one prefix sum of a keyed polynomial."""

    def __init__(self, seed: int = 1):
        rng = np.random.RandomState(seed)
        self.table = rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.root = U64(int(rng.randint(1 << 20, 1 << 62, dtype=np.int64)) * 8 + 3 & (1 << 64) - 1)
        self.inverse = U64(pow(int(self.root), -1, 1 << 64))
        self.size = 0

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES + (1 << 16))
            self.up = np.cumprod(np.full(self.size, self.root, U64))
            self.down = np.cumprod(np.full(self.size, self.inverse, U64))

    def hashes(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end) of the buffer; equal bytes have equal hashes wherever they stand."""
        self.grow(len(buffer) + 1)
        run = np.zeros(len(buffer) + 1, U64)
        np.cumsum(self.table[buffer] * self.up[: len(buffer)], out=run[1:])
        return mix((run[ends] - run[starts]) * self.down[starts])


def words(buffer: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of maximal runs of word bytes; the buffer ends with a separator."""
    inside = kind[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` successive word hashes (length len(h) - width + 1)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= _ODD
        out += h[k : k + n]
    return mix(out)


def string_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
