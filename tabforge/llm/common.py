"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path

# Words of the quality, Jaccard and mixing operators: runs of anything but ASCII
# white space. ``bytes.split()`` cuts UTF-8 text at exactly these characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_LIBC = ctypes.CDLL(None)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Odd 64-bit multipliers: the k-th word of an n-gram is multiplied by the k-th one.
NGRAM_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


#: Bytes of an Arrow batch. With Spark's default of 64 MB, long texts fill tens of MB in each of the JVM's and the
#: worker's buffers. The number of rows stays as the session has it.
ARROW_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, read in a session whose Arrow batches are short unless the user has set their size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b"):  # Spark's default
        spark.conf.set(key, str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(c, _UPPER, _LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts the lineage: later jobs, and tasks that run again after an executor is
    lost, see the same rows in the same files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark resolves names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches or arrays in short pieces, so that a task holds few texts and results as Python objects."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


def give_back() -> None:
    """Free memory goes back to the system: workers live on, and what they keep would add up over stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def histogram_chunks(counts: np.ndarray, chunk: int = 4096) -> tuple[list[int], list[bytes]]:
    """(start, packed counts) of the non-zero chunks of a histogram; see ``unpacked``."""
    at, blobs = [], []
    for i in range(0, len(counts), chunk):
        part = counts[i : i + chunk]
        if part.any():
            at.append(i)
            fits = part.min() >= 0 and next((k for k in ("<u1", "<u2", "<u4") if part.max() <= np.iinfo(k).max), None)
            blobs.append(part.astype(fits or "<i8").tobytes() + bytes([np.dtype(fits or "<i8").itemsize]))
    return at, blobs


def unpacked(blob: bytes) -> np.ndarray:
    """64-bit counts; a chunk's last byte is the width of those before it."""
    return np.frombuffer(blob, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[blob[-1]], (len(blob) - 1) // blob[-1]).astype(np.int64)


def add_chunks(chunks: DataFrame, bins: int, tasks: int = 16, combine: np.ufunc = np.add) -> np.ndarray:
    """Combine the chunks (at, counts) that partitions sent; the driver receives ``8 * bins`` bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = unpacked(blob)
                sums[at] = combine(sums[at], got) if at in sums else got
        packed = [histogram_chunks(v, len(v)) for v in sums.values()]
        ats, blobs = list(sums), [b[0] if b else np.zeros(1, "<u1").tobytes() + b"\1" for _, b in packed]
        yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int32()), pa.array(blobs, pa.binary())], ["at", "counts"])
        sums.clear()
        give_back()

    total = np.zeros(bins, np.int64)
    sent = chunks.select("at", "counts").repartition(tasks, "at")
    for row in sent.mapInArrow(add, "at int, counts binary").collect():
        got = unpacked(row["counts"])
        total[row["at"] : row["at"] + len(got)] = got
    return total


def histogram_sum(
    df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], bins: int
) -> np.ndarray:
    """Sum one fixed-size histogram per partition over all partitions.

    ``count`` turns a partition's batches into an int64 array of ``bins`` counts.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = histogram_chunks(count(batches))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["at", "counts"])

    return add_chunks(df.mapInArrow(parts, "at int, counts binary"), bins, tasks=min(16, -(-bins // 4096)))


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as a star forest: (node, smallest node it reaches)."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(parent.setdefault(x, x)), find(parent.setdefault(y, y))
            if x != y:
                parent[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = [x for x in parent if parent[x] != x]
        roots = pa.array([find(x) for x in nodes], kind)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), roots], ["hi", "lo"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b) that is not its component's smallest node.

    Alternating large-star and small-star steps: every step hangs each node's
    neighbours below the smallest of them, until nothing changes. Each step's edges are
    written to the shared folder; a node with many edges only adds rows to hash
    aggregates and equi-joins.
    """
    kind = edges.schema["a"].dataType.simpleString()
    ends = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b"), F.least("a", "b"))
    now = stored(ends.mapInArrow(_local_forest, f"hi {kind}, lo {kind}").distinct(), name)
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if row == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        mark = row
        both = now.select("hi", "lo").union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("least")).withColumn("least", F.least("hi", "least"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        large = large.where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi != lo")
        now = stored(small.union(least.select("hi", "least")).distinct(), name)
