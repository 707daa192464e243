"""Uniform shuffle into exact shards with a hypergeometric communication matrix.

Rows of P source partitions go to bins of exactly known sizes (a shard is a run of
bins, so that a shard of any size is sorted in bounded pieces). How many rows each
partition sends to each bin is drawn from the law that a uniform shuffle would
give: a matrix with the partitions' row counts and the bins' sizes as margins. The
steps are: permute each partition locally, cut it along its row of the matrix,
exchange, and permute each bin.

The matrix is never held. Partitions are split in halves along a binary tree; at a
node, the bins' rows are divided between the halves by multivariate hypergeometric
draws from the node's own random stream. A task walks from the root to its
partition, so all tasks agree on the draws, and it only needs the partitions' row
counts (eight bytes a task).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm.common import fresh_name, stored

_NUMPY_MOST = 10**9  # numpy's generators draw from populations below this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """One draw for populations of any size, by inversion around the mode."""
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = (good + 1) * (drawn + 1) // (total + 2)
    sd = np.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1)))
    reach = int(14 * sd) + 64  # beyond it no double-precision uniform falls
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)
    # log p(k+1) - log p(k), summed up from the left end
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return max(low, mode - reach) + int(min(at, len(weights) - 1))


def multivariate(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows come from each bin, without replacement."""
    total = int(sizes.sum())
    if total < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    if len(sizes) == 1:
        return np.array([drawn], np.int64)
    half = len(sizes) // 2
    left = int(sizes[:half].sum())
    take = hypergeometric(rng, left, total - left, drawn)
    return np.concatenate([multivariate(rng, sizes[:half], take), multivariate(rng, sizes[half:], drawn - take)])


def matrix_row(counts: np.ndarray, sizes: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """The partition's row of the communication matrix: rows it sends to each bin."""
    low, high, left = 0, len(counts), sizes
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        first = multivariate(rng, left, int(counts[low:mid].sum()))
        if partition < mid:
            high, left = mid, first
        else:
            low, left = mid, left - first
    return left


def bin_sizes(rows: int, shards: int, rows_per_bin: int) -> tuple[np.ndarray, int]:
    """(sizes of all bins, bins a shard): shards differ by one row at most, and so do a shard's bins."""
    each = max(1, -(-rows // (shards * rows_per_bin)))
    shard = rows // shards + (np.arange(shards) < rows % shards)
    return np.concatenate([n // each + (np.arange(each) < n % each) for n in shard]).astype(np.int64), each


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, rows_per_bin: int = 32_768) -> DataFrame:
    """Adds ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard) to every row.

    Every order of the rows is equally likely; shard sizes differ by one at most. Rows
    are placed by their number only: nulls, ties and repeated rows are rows like any
    other, and texts of any length move whole. Fewer rows than shards leave the last
    shards empty; an empty table gives an empty result. Input columns named shard or
    slot are replaced.
    """
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    place, key, bin_, order = (fresh_name(df, n) for n in ("place", "key", "bin", "order"))
    # Permute locally and write: a row's partition and place in it are then fixed, whatever is recomputed.
    local = df.select(*names, F.rand(seed).alias(key)).sortWithinPartitions(key)
    held = stored(local.select(*names, F.monotonically_increasing_id().alias(place)), "shuffle")
    found = held.groupBy(F.shiftright(F.col(place), 33).alias("p")).count().collect()  # one row a partition
    counts_of = dict(sorted((r["p"], r["count"]) for r in found))
    partitions, counts = list(counts_of), np.array(list(counts_of.values()), np.int64)
    sizes, each = bin_sizes(int(counts.sum()), shards, rows_per_bin)

    @F.arrow_udf("int")
    def bin_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.to_numpy(zero_copy_only=False)
            out = np.empty(len(at), np.int32)
            part = at >> 33
            for p in np.unique(part):
                if p not in rows:
                    rows = {p: np.cumsum(matrix_row(counts, sizes, bisect.bisect_left(partitions, p), seed))}
                own = part == p
                out[own] = np.searchsorted(rows[p], at[own] & ((1 << 33) - 1), side="right")
            yield pa.array(out)

    sent = held.withColumn(bin_, bin_of(place)).withColumn(order, F.xxhash64(F.lit(seed + 1), F.col(place)))
    inside = F.row_number().over(W.partitionBy(bin_).orderBy(order, place)).cast("long") - 1
    # A bin's start in its shard, from its number alone.
    shard = F.floor(F.col(bin_) / each).cast("int")
    rows = int(counts.sum())
    size = F.lit(rows // shards) + (shard < rows % shards).cast("long")
    k = F.pmod(F.col(bin_), F.lit(each)).cast("long")
    start = k * F.floor(size / each) + F.least(k, F.pmod(size, F.lit(each)))
    return sent.select(*names, shard.alias("shard"), (start + inside).alias("slot"))
