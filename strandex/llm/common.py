"""What the training-data operators share: the cluster's scratch folder, hashing of words, components of a link graph."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words in all contracts.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one under /tmp where that is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/strandex"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive lost executors, unlike cached or locally checkpointed blocks.

    Tables that the returned DataFrame still reads are left in place; the others are dropped as soon as nothing reads them.
    """

    #: Folders of all made inside the innermost cleared().
    roots: list[str] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if Scratch.roots is not None:
            Scratch.roots.append(self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        done = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go with the write that made them
        was = self.spark.conf.get(done)
        self.spark.conf.set(done, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(done, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def forget(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, as after save(); else they stay until the driver collects its
        garbage by itself, and a later step finds the disk full of them."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                delete(self.spark, path)


@contextmanager
def cleared(spark: SparkSession):
    """Deletes on leaving what each Scratch made inside has written: for steps whose result is saved elsewhere by then."""
    outer, Scratch.roots = Scratch.roots, []
    try:
        yield
    finally:
        mine, Scratch.roots = Scratch.roots, outer
        for root in mine:
            delete(spark, root)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches short enough, in rows and bytes, that rows with very long texts and packets fit in a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def tidy(run):
    """run, a function for mapInArrow, that gives the memory it freed back to the system when its task ends: workers wait for other tasks with
    little more than their caches."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidied


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once even if body uses it often."""
    return F.transform(F.array(value), body)[0]


# --- vectorised words and shingles -------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_P = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 modulo 2**64 and their inverses, kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            a = np.ones(m, np.uint64)
            k, step = 1, base
            while k < m:  # doubling: a[k:2k] = a[:k] * base**k
                a[k : 2 * k] = a[: max(0, min(k, m - k))] * np.uint64(step)
                k, step = 2 * k, step * step & MASK
            out.append(a)
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]; substring_hash reads any substring from it. data: uint8 or code points."""
    if data.dtype == np.uint8:
        v = _BYTE[data]
    else:
        v = mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v * powers(len(data))[0], out=h[1:])
    return h


def substring_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end): equal substrings get equal hashes wherever they stand."""
    inv = powers(len(h))[1]
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, words being runs of anything but the six ASCII spaces."""
    w = np.empty(len(data) + 2, np.int8)
    w[0] = w[-1] = 0
    w[1:-1] = _IS_WORD[data]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end (nulls as empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Parts of a batch with at most so many bytes of text each, or a single row: the temporary arrays stay small whatever the rows hold."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.zeros(len(col), np.int64)
    if len(col):
        _, off = texts_of(col)
        sizes = np.diff(off)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, row after row, and the row offsets in them. lower: A-Z count as a-z."""
    data, off = texts_of(column)
    if lower:
        data = _LOWER[data]
    n = len(off) - 1
    gap = np.full(len(data) + n, 32, np.uint8)  # a space after each row keeps words from running together
    row = np.repeat(np.arange(n), np.diff(off))
    gap[np.arange(len(data)) + row] = data
    s, e = word_spans(gap)
    words = substring_hash(prefix_hash(gap), s, e)
    return words, np.searchsorted(s, off + np.arange(n + 1))


# --- components ---------------------------------------------------------------------------------------------------


def _contract(batches):
    """Replaces each part's links by a star a component: as many rows at most, far fewer for dense groups."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(nodes), ids[: len(u)], ids[len(u) :])
        keep = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], names=["u", "v"])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (two bigint columns) that isn't the smallest of its component.

    Alternating large and small stars: each round is aggregations with partial sums and joins by node, so a node with many links is
    split by adaptive execution; the number of rounds follows the logarithm of the diameter. Each round's links are written to the
    shared folder. Null nodes and loops are ignored. An empty table gives an empty table.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(tidy(_contract), "u bigint, v bigint")
    e, seen = scratch.save(e.distinct(), "links"), None
    for _ in range(60):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        new = scratch.save(small, "links")
        state = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
        scratch.drop(e)
        e = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._scratch_path = e._scratch_path
    return out


# --- a filter of bounded size -------------------------------------------------------------------------------------


class KeyFilter:
    """A bit for each hashed key: 2**BITS bits whatever the number of keys. It lets every key through that it was built from and some others,
    so it only ever saves work before an exact join."""

    BITS = 24

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def place(cls, key: str, uniform: bool = False) -> Column:
        """Where a bigint key's bit is: of its hash, or of the key itself if it is a hash already."""
        return F.shiftrightunsigned(F.col(key) if uniform else F.xxhash64(F.col(key)), 64 - cls.BITS)

    @classmethod
    def of(cls, keys: DataFrame, uniform: bool = False) -> KeyFilter:
        """keys: one bigint column. What comes to the driver is at most 2**(BITS - 6) words of 64 bits."""
        at = keys.select(cls.place(keys.columns[0], uniform).alias("at"))
        masks = at.select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("m"))
        got = masks.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        words = np.zeros(1 << (cls.BITS - 6), np.int64)
        words[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return cls(words)

    def test(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1
