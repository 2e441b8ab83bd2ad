"""Vectorised text primitives shared by the operators of this subpackage.

Texts travel as Arrow string columns and are worked on as one byte array per
batch, so that no Python object is made per word.  A word is a run of bytes
outside space and \\t..\\r; null texts count as empty ones.
"""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Space, other control characters and ASCII punctuation.
LOOSE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        x = np.full(max(n, 1 << 16), base, U)
        x[0] = 1
        with np.errstate(over="ignore"):
            got = _powers[base] = np.cumprod(x, dtype=U)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(32))
        h = h * U(0xD6E8FEB86659FD93)
        h = h ^ (h >> U(32))
        h = h * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * P**place before each place; a difference, times P**-start, is a hash of the bytes between."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, U)
        sums[1:] = buf
        sums[1:] += U(1)
        sums[1:] *= powers(_P, len(buf))
        return np.cumsum(sums, out=sums)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit values, sorted, and the place of each value among them: np.unique with its inverse.

    One sort of the high bits of what values have above the least, with their places in the low ones, is several
    times as fast as a sort of places.  Values that share these high bits are then sorted among themselves.
    """
    n = len(x)
    if n < 2:
        return x.copy(), np.zeros(n, np.int64)
    both, low = x - x.min(), U((1 << (n - 1).bit_length()) - 1)
    both <<= U(64 - max(1, int(both.max()).bit_length()))
    both &= ~low
    both |= np.arange(n, dtype=U)
    both.sort()
    at, near = (both & low).view(np.int64), (both[1:] ^ both[:-1]) <= low
    new, s = np.ones(n, bool), x[at]
    np.not_equal(s[1:], s[:-1], out=new[1:])
    mixed = near & new[1:]
    if mixed.any():
        group = np.cumsum(np.append(0, ~near))
        some = np.zeros(int(group[-1]) + 1, bool)
        some[group[1:][mixed]] = True
        some = np.flatnonzero(some[group])
        at[some] = at[some][np.argsort(s[some], kind="stable")]
        s = x[at]
        np.not_equal(s[1:], s[:-1], out=new[1:])
    back = np.empty(n, np.int64)
    back[at] = np.cumsum(new) - 1
    return s[new], back


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most about `limit` bytes of text each (a longer row stands alone)."""
    if not batch.num_rows:
        return
    sizes = batch.column(column)
    sizes = np.frombuffer(text_array(sizes).buffers()[1], np.int64)[: len(sizes) + 1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def text_array(col: pa.Array) -> pa.LargeStringArray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if col.offset:
        col = pa.concat_arrays([col])
    if col.offset or len(col) == 0:
        col = pa.array(col.to_pylist(), pa.large_string())
    return col


class Texts:
    """Bytes of a column of texts with the bounds of each text, and its words on demand (or others that a caller sets as ws and we)."""

    space = None

    def __init__(self, col: pa.Array):
        col = text_array(col)
        offsets, data = col.buffers()[1:3] if len(col) else (None, None)
        ends = np.frombuffer(offsets, np.int64)[: len(col) + 1] if len(col) else np.zeros(1, np.int64)
        self.buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        self.lo, self.hi, self.n = ends[:-1], ends[1:], len(col)

    def words(self, space: np.ndarray = SPACE) -> "Texts":
        """Sets ws, we (bounds of each word in bytes) and first (n + 1 entries: index of each text's first word)."""
        buf = self.buf
        self.space, self.black = space, translated(buf, ~space).view(bool)
        black = self.black
        turn = np.zeros(len(buf) + 1, bool)
        if len(buf):
            turn[0], turn[-1] = black[0], black[-1]
            np.not_equal(black[1:], black[:-1], out=turn[1:-1])
        turns = np.flatnonzero(turn)
        # Where a text ends within black bytes, one word ends and another begins.
        edge = np.unique(self.lo[(self.lo > 0) & (self.lo < len(buf))])
        edge = edge[black[edge] & black[edge - 1]]
        if len(edge):
            turns = np.insert(turns, np.repeat(np.searchsorted(turns, edge), 2), np.repeat(edge, 2))
        self.ws, self.we = turns[::2], turns[1::2]
        self.first = np.concatenate([np.searchsorted(self.ws, self.lo), [len(self.ws)]]).astype(np.int64)
        return self

    @property
    def doc(self) -> np.ndarray:
        """Of each word, the text it is in."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self, buf: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of those in buf, if given, such as lower-cased ones)."""
        buf = self.buf if buf is None else buf
        if not len(self.ws):
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            if self.space is None:
                sums = prefix_sums(buf)
                h = sums[self.we] - sums[self.ws]
            else:
                # Sums of (byte + 1) * P**place from one word to the next, white bytes being 0 (as 255 is, which UTF-8 has not).
                terms = translated(buf, np.where(self.space, 0, np.arange(1, 257) & 255)).astype(U)
                terms *= powers(_P, len(buf))
                h = np.add.reduceat(terms, self.ws)
            h = h * powers(_PINV, len(buf) + 1)[self.ws]
        return mix(h ^ (self.we - self.ws).astype(U) * U(_Q))

    def shingles(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k successive words, and the index of the first word of each; none crosses a text."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            s = h[:n].copy()
            for j in range(1, k):
                s = s * U(_Q) + h[j : j + n]
        doc = self.doc
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return mix(s[at]), at


def translated(buf: np.ndarray, to: np.ndarray) -> np.ndarray:
    """to[byte] of each byte, one byte each."""
    return np.frombuffer(buf.tobytes().translate(to.astype(np.uint8).tobytes()), np.uint8)


_LOWER = np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return translated(buf, _LOWER)


def per_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values over each text, given n + 1 bounds."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of `length` from one of the starts."""
    step = np.zeros(n + length + 1, np.int64)
    np.add.at(step, starts, 1) if len(starts) < 64 else step.__iadd__(np.bincount(starts, minlength=len(step))[: len(step)])
    step[length:] -= step[:-length].copy()
    return np.cumsum(step)[:n] > 0


@lru_cache(maxsize=4)
def _packer(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@lru_cache(maxsize=1)
def _unpacker():
    import zstandard

    return zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray, level: int = 1) -> bytes:
    """Integers as compressed byte planes; sorted ones should be differenced first."""
    x = np.ascontiguousarray(x)
    if x.itemsize == 1:
        return _packer(level).compress(x.tobytes())
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros((x.itemsize, 0), np.uint8)
    return _packer(level).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_unpacker().decompress(b), np.uint8) if b else np.zeros(0, np.uint8)
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(k, -1).T).reshape(-1).view(dtype)


def crc_mod(doc_ids: list, m: int) -> np.ndarray:
    """crc32 of each id written as text, modulo m (null: as the empty text)."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % m for i in doc_ids], np.int64)


#: What an operator keeps in a Python worker between tasks, as functions that drop it; workers serve other operators next.
CACHES: list = []


def trim(powers: bool = True) -> None:
    """Gives free memory back; Python workers wait for their next task with what they hold."""
    if powers:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def trimmed(run, own=None):
    """A function over batches that gives memory back at its end, and first what other operators have kept; own: the cache that is its own."""

    def inner(batches):
        drop(own)
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def drop(own=None) -> None:
    for clear in CACHES:
        if clear is not own:
            clear()


def one(f):
    """A function of a group's table that gives memory back after each."""

    def run(table):
        drop()
        try:
            return f(table)
        finally:
            trim(False)

    return run


def two(f):
    """The same for two tables."""

    def run(left, right):
        drop()
        try:
            return f(left, right)
        finally:
            trim(False)

    return run


BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PIECE_BYTES = 1 << 18  # of texts that a stage of the pipeline has at work at once, with up to 100 times as much memory; larger pieces are no faster
BLOCK_BYTES = 3 << 20  # of texts in a block; some 100 times as much memory is at work on it
COPIES = 256  # of rows equal in id and text, how many may lie in one block


def id_types(docs: DataFrame, key: str) -> tuple[str, pa.DataType]:
    """The key's own type, in DDL and in Arrow; ids are passed on as they are."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    return kind.simpleString(), to_arrow_type(kind)


def buckets_of(blocks: int) -> int:
    """More blocks would make messages between blocks and buckets smaller, so buckets grow with the root of their number."""
    return min(blocks, max(256, math.isqrt(64 * blocks)))


class Dealt:
    """Rows (doc_id, __text) dealt to blocks of about BLOCK_BYTES by a hash of both.

    Rows equal in id and text would all fall in one block; of more than COPIES
    of them every COPIES go to a block of their own.  They are counted first,
    and only those are gathered, after Spark has merged them on the map side.
    """

    def __init__(self, docs: DataFrame, text: str, key: str, block_bytes: int | None = None):
        rows = docs.select(docs[f"`{key}`"].alias("doc_id"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("__text"))
        self.ddl, self.arrow = id_types(docs, key)
        keyed = rows.withColumn("__tkey", F.xxhash64("__text"))
        same = keyed.groupBy("doc_id", "__tkey").agg(F.count("*").alias("n"), F.sum(F.octet_length("__text")).alias("bytes"))
        total, most = same.agg(F.sum("bytes"), F.max("n")).first()
        self.blocks = int((total or 0) // (block_bytes or BLOCK_BYTES)) + 1
        self.buckets = buckets_of(self.blocks)
        self.parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total or 0) >> 26)
        rows = rows.withColumn("__salt", F.lit(0))
        if (most or 0) > COPIES:
            many = stored(same.where(F.col("n") > COPIES).select(F.col("doc_id").alias("__id"), F.col("__tkey").alias("__many")))
            on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tkey") == F.col("__many"))
            hot = keyed.join(many, on, "left_semi").groupBy("doc_id", "__text").agg(F.count("*").alias("n"))
            hot = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / COPIES).cast("int"))))
            hot = hot.withColumn("__i", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("__salt")).cast("int"))))
            rows = keyed.join(many, on, "left_anti").select("doc_id", "__text", F.lit(0).alias("__salt")).unionByName(hot.select("doc_id", "__text", "__salt"))
        block = F.pmod(F.xxhash64("doc_id", "__text", "__salt"), F.lit(self.blocks)).alias("__block")
        self.rows = rows.select("doc_id", "__text", block)

    def by_block(self):
        return self.rows.repartition(self.parts, "__block").groupBy("__block")

    def by(self, messages: DataFrame, column: str):
        """Messages to blocks or buckets, in as many partitions as the texts have."""
        return messages.repartition(self.parts, column).groupBy(column)


def bounded(spark: SparkSession) -> SparkSession:
    """For applications, not operators: sets the bytes of a batch that a Python worker gets, for plans that run after the call that made them."""
    spark.conf.set(BATCH_BYTES, BATCH)
    return spark


def scratch(spark: SparkSession, keep: bool = False) -> str:
    """A new folder below the one the cluster shares (spark.checkpoint.dir), removed when the application ends unless it is kept.

    Where that is unset, as in tests, a local session gets a temporary folder; a cluster has none that all can see, so it must be set.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "cloakframe-scratch")
    where = f"{top.rstrip('/')}/cloakframe-{uuid.uuid4().hex}"
    if not keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def stored(df: DataFrame, where: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    where = where or scratch(spark)
    # Shuffle files of this write go when it is done, and Python workers get small batches; the session's own settings come back.
    ours = {CLEAN_UP: "true", BATCH_BYTES: BATCH}
    was = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").parquet(where)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(where)


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a stored table that is not read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


