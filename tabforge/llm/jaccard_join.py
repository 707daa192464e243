"""N-gram Jaccard join as a blocked sparse product of the document-by-n-gram matrix.

Documents link when the Jaccard similarity of their sets of word n-grams reaches a
threshold. Equal sets are one row of the matrix. Columns stand in a global order,
rarest first (by a fixed-size count sketch over the whole table), and a row's
entries are cut to the prefix that any linked row must share: its first
``n - ceil(t n) + 1`` columns, and of these, for the smaller row of a pair, the
first ``n - ceil(2t n / (1 + t)) + 1``. Blocks of columns travel as packed arrays;
columns with a single row drop out inside their block.

The product is formed in two steps, and only links that connect something new are
needed:

1. In each column all rows are multiplied with one hub, the row in which the column
   stands first for its size: it has fewest n-grams of its own, as the text that the
   others are copies of. Groups of near copies hang together after this.
2. Columns that still hold different components are multiplied with themselves,
   keeping pairs of different components that pass the size bound and the positional
   bound (what may still follow the shared column must reach the overlap needed).

Candidate pairs first meet a bitmap bound: bit j of a row's bitmap is the parity of
its n-grams that hash to j, so the bits in which two bitmaps differ never outnumber
the n-grams in which the sets differ. What is left is multiplied out over all
columns, block by block, and pairs below the overlap that their sizes demand are
discarded. Every link is found, or its ends are connected by other links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import NGRAM_MULTIPLIERS, add_chunks, components, histogram_chunks, mixed, pieces, stored

_ENTRY = np.dtype([("h", "<u8"), ("d0", "<u8"), ("d1", "<u8"), ("n", "<u4"), ("p", "<u4")])


@dataclass(frozen=True)
class JaccardParams:
    """``entries``: prefix entries per block of columns. ``hot``: a column with more rows is split over blocks.

    ``bloom_bits``: size of the filter that keeps texts without candidates out of a shuffle.
    """

    words: int = 5
    percent: int = 75
    sketch_bits: int = 20
    entries: int = 250_000
    hot: int = 200_000
    bloom_bits: int = 1 << 23


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word k-grams; fewer words make one."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, len(h) if len(h) < k else 0, np.uint64)
    for i in range(n):
        out += h[i : i + len(out)] * (NGRAM_MULTIPLIERS[i % 5] + np.uint64(2 * (i // 5)))
    return np.unique(mixed(out))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parity(s: np.ndarray) -> bytes:
    """The set's bitmap: two to four bits an n-gram, a power of two."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the n-grams that are in one set only. The longer bitmap is folded to the shorter one."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ folded).sum())


def _as_binary(ids: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as 16-byte values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary())


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Overlap that two sets of these sizes need."""
    return F.ceil(percent * (a + b) / (100 + percent))


def _bloom_places(h: np.ndarray, bits: int) -> np.ndarray:
    """Four places of each 64-bit hash."""
    a, b = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    return np.concatenate([(a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(bits) for i in range(4)]).astype(np.int64)


class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, p: JaccardParams):
        self.p = p
        self.spark = docs.sparkSession
        self.texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
        keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
        self.rows, self.sketch = self._rows(keyed)

    def _rows(self, docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """(key, t, n, d, bitmap) of every document, written once, and the counts of all n-grams."""
        p, bins = self.p, 1 << self.p.sketch_bits
        kind = docs.schema["key"]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(bins, np.int64)
            names = ["key", "t", "n", "d", "bitmap", "at", "counts"]
            key_type = None
            for b in pieces(batches):
                sets = [shingles(t, p.words) for t in b.column(1).to_pylist()]
                if sets:
                    counts += np.bincount(_bucket(np.concatenate(sets), p.sketch_bits), minlength=bins)
                key_type = b.schema.field(0).type
                none = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([_parity(s) if len(s) else None for s in sets], pa.binary()),
                     pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
            at, blobs = histogram_chunks(counts)
            if key_type is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(at), key_type), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()),
                     pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names)

        schema = T.StructType([
            T.StructField("key", kind.dataType), T.StructField("t", T.LongType()), T.StructField("n", T.LongType()),
            T.StructField("d", T.BinaryType()), T.StructField("bitmap", T.BinaryType()), T.StructField("at", T.IntegerType()), T.StructField("counts", T.BinaryType()),
        ])
        both = stored(docs.mapInArrow(measure, schema), "jaccard-rows")
        sketch = add_chunks(both.where("at is not null"), bins)
        return both.where("n is not null").drop("at", "counts"), sketch

    def columns(self) -> DataFrame:
        """(h, d, n, p, hub, m): the prefix entries of all columns with two rows or more, written once.

        ``hub`` and its size ``m`` are null in columns that were dealt out by row.
        """
        p, sketch = self.p, np.minimum(self.sketch, 2**31 - 1).astype(np.int32)
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        self.blocks = blocks = max(1, -(-(total * (100 - p.percent) // 100) // p.entries))
        salts = max(1, -(-int(sketch.max(initial=0)) // p.hot))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            waiting: list[np.ndarray] = []

            def send() -> pa.RecordBatch:
                e = np.concatenate(waiting) if waiting else np.empty(0, _ENTRY)
                waiting.clear()
                # a column that may be hot is dealt out by row; its entries need no look at each other
                block = (e["h"] % np.uint64(blocks)).astype(np.int64)
                hot = sketch[_bucket(e["h"], p.sketch_bits)] > p.hot
                block[hot] = blocks + (e["d0"][hot] % np.uint64(salts)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                e, block = e[order], block[order]
                at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(e) else np.empty(0, np.int64)
                ends = np.r_[at[1:], len(e)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(block[at], pa.int64()),
                     pa.array([e[a:z].tobytes() for a, z in zip(at, ends, strict=False)], pa.binary())],
                    ["block", "entries"])

            for b in pieces(batches):
                for t in b.column(0).to_pylist():
                    s = shingles(t, p.words)
                    if not len(s) or (d := _digest(s)) in seen:
                        continue
                    seen.add(d)
                    n = len(s)
                    prefix = n + (-p.percent * n // 100) + 1
                    order = np.lexsort((s, sketch[_bucket(s, p.sketch_bits)]))[:prefix]
                    e = np.empty(prefix, _ENTRY)
                    e["h"], e["n"], e["p"] = s[order], n, np.arange(prefix)
                    e["d0"], e["d1"] = np.frombuffer(d, "<u8")
                    waiting.append(e)
                if sum(map(len, waiting)) > p.entries:
                    yield send()
            yield send()

        def keep(key: tuple, group: pa.Table) -> pa.Table:
            e = np.frombuffer(b"".join(group.column("entries").to_pylist()), _ENTRY)
            e = e[np.lexsort((e["d1"], e["d0"], e["h"]))]
            # a row seen by several tasks has equal entries
            e = e[np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["d0"][1:] != e["d0"][:-1]) | (e["d1"][1:] != e["d1"][:-1])]]
            cold = key[0].as_py() < blocks
            if cold:
                same = e["h"][1:] == e["h"][:-1]
                e = e[np.r_[False, same] | np.r_[same, False]]
            ids = np.stack([e["d0"], e["d1"]], axis=1)
            hub, m = pa.nulls(len(e), pa.binary()), pa.nulls(len(e), pa.int64())
            if cold and len(e):  # a hot column's rows are in several tasks, which cannot tell
                first = np.r_[True, e["h"][1:] != e["h"][:-1]]
                order = np.lexsort((e["d1"], e["d0"], e["p"] / e["n"], np.cumsum(first)))
                at = np.repeat(order[np.flatnonzero(first)], np.diff(np.r_[np.flatnonzero(first), len(e)]))
                hub, m = _as_binary(ids[at]), pa.array(e["n"][at].astype(np.int64))
            return pa.table({
                "h": e["h"].view("<i8"), "d": _as_binary(ids), "n": e["n"].astype(np.int64), "p": e["p"].astype(np.int64),
                "hub": hub, "m": m,
            })

        schema = "h long, d binary, n long, p long, hub binary, m long"
        packed = self.texts.select("text").mapInArrow(cut, "block long, entries binary")
        return stored(packed.groupBy("block").applyInArrow(keep, schema), "jaccard-columns")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(d, s): the packed n-gram set of every wanted d, written once."""
        p = self.p
        one = self.rows.groupBy("d").agg(F.min("t").alias("t"))  # texts with equal sets stand for each other
        texts = stored(one.join(wanted, "d", "left_semi").select("t").distinct(), "jaccard-wanted")

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(p.bloom_bits, bool)
            for b in pieces(batches):
                bits[_bloom_places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), p.bloom_bits)] = True
            at, blobs = histogram_chunks(np.packbits(bits, bitorder="little").view("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["at", "counts"])

        bits = add_chunks(texts.mapInArrow(mark, "at int, counts binary"), p.bloom_bits // 64, combine=np.bitwise_or)

        @F.arrow_udf("boolean")
        def may_want(t: pa.Array) -> pa.Array:
            places = _bloom_places(t.to_numpy(zero_copy_only=False).view(np.uint64), p.bloom_bits)
            hit = (bits[places >> 6] >> (places & 63)) & 1
            return pa.array(hit.reshape(4, -1).all(axis=0))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                sets = [shingles(t, p.words) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["d", "s"])

        found = self.texts.where("t is not null").where(may_want("t")).join(texts, "t", "left_semi")
        found = found.withColumn("u", F.hash("text")).dropDuplicates(["t", "u"])  # 96 bits tell texts apart
        packed = found.select("text").mapInArrow(pack, "d binary, s binary")
        return stored(packed.join(wanted, "d", "left_semi").dropDuplicates(["d"]), "jaccard-sets")

    def _within_bitmap_bound(self, pairs: DataFrame) -> DataFrame:
        percent = self.p.percent

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                a, b, m, n, x, y = (c.to_pylist() for c in batch.columns)
                keep = [
                    _differ_at_least(*maps) <= size - 2 * -(-percent * size // (100 + percent))
                    for maps, size in zip(zip(x, y, strict=True), map(sum, zip(m, n, strict=True)), strict=True)
                ]
                found = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found)], ["a", "b"])

        # rows with equal d have equal values
        maps = self.rows.where("d is not null").groupBy("d").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
        both = pairs.join(maps.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("y")), "b")
        both = both.join(maps.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("x")), "a")
        return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(bound, "a binary, b binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets overlap as much as their sizes demand."""
        percent = self.p.percent
        pairs = stored(self._within_bitmap_bound(pairs), "jaccard-pairs")
        wanted = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct()
        sets = self.sets(wanted)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                left, right = batch.column(2), batch.column(3)
                keep = np.zeros(len(a), bool)
                at = 0
                while at < len(a):  # rows of one a stand together: one row of the matrix times a block of others
                    end = at
                    while end < len(a) and a[end] == a[at]:
                        end += 1
                    row = np.frombuffer(left[at].as_py(), np.uint64)
                    others = [np.frombuffer(right[i].as_py(), np.uint64) for i in range(at, end)]
                    sizes = np.array([len(o) for o in others])
                    flat = np.concatenate(others)
                    place = np.minimum(np.searchsorted(row, flat), len(row) - 1)
                    overlap = np.add.reduceat((row[place] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
                    keep[at:end] = 100 * overlap >= percent * (len(row) + sizes - overlap)
                    at = end
                found = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found)], ["a", "b"])

        right = pairs.join(sets.select(F.col("d").alias("b"), F.col("s").alias("right")), "b")
        both = right.join(sets.select(F.col("d").alias("a"), F.col("s").alias("left")), "a")
        return stored(both.select("a", "b", "left", "right").mapInArrow(multiply, "a binary, b binary"), "jaccard-links")

    def hub_pairs(self, columns: DataFrame) -> DataFrame:
        """Step 1: (hub, row) of every column, where sizes allow a link."""
        place = F.struct((F.col("p") / F.col("n")).alias("place"), "d", "n")
        hot = columns.where("hub is null").drop("hub", "m")
        hubs = hot.groupBy("h").agg(F.min(place).alias("first"))
        hot = hot.join(hubs, "h").select("d", "n", F.col("first.d").alias("hub"), F.col("first.n").alias("m"))
        pairs = columns.where("hub is not null").select("d", "n", "hub", "m").union(hot)
        close = 100 * F.least("n", "m") >= self.p.percent * F.greatest("n", "m")
        return pairs.where((F.col("hub") != F.col("d")) & close).select(F.col("hub").alias("a"), F.col("d").alias("b")).distinct()

    def open_pairs(self, columns: DataFrame, linked: DataFrame) -> DataFrame:
        """Step 2: pairs of different components that share a column and pass all bounds."""
        percent = self.p.percent
        own = columns.drop("m").join(linked.withColumnRenamed("node", "d"), "d", "left")
        own = own.withColumn("component", F.coalesce("component", "d"))

        def multiply(group: pa.Table) -> pa.Table:
            """Whole columns of one block with themselves."""
            ids, d = np.unique(np.array(group.column("d").to_pylist(), "S16"), return_inverse=True)
            component = np.unique(np.array(group.column("component").to_pylist(), "S16"), return_inverse=True)[1]
            h, n, at = (group.column(c).to_numpy() for c in ("h", "n", "p"))
            order = np.lexsort((n, h))
            h, n, at, d, component = h[order], n[order], at[order], d[order], component[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            rows = np.diff(np.r_[first, len(h)])
            several = np.minimum.reduceat(component, first) != np.maximum.reduceat(component, first)
            end = np.repeat(first + rows, rows)
            small = at < n + (-2 * percent * n // (100 + percent)) + 1
            x = np.flatnonzero(np.repeat(several, rows))
            found = [np.empty((0, 2), np.int64)]
            step = 0
            while len(x):  # x with the row ``step`` places behind it, which is as large or larger
                step += 1
                x = x[x + step < end[x]]
                y = x + step
                near = 100 * n[x] >= percent * n[y]
                x, y = x[near], y[near]  # rows further behind are larger still
                reach = np.minimum(n[x] - at[x], n[y] - at[y]) >= -(-percent * (n[x] + n[y]) // (100 + percent))
                ok = reach & (component[x] != component[y]) & (small[x] | small[y] & (n[x] == n[y]))
                found.append(np.sort(np.stack([d[x[ok]], d[y[ok]]], axis=1), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            names = [[i.ljust(16, b"\0") for i in ids[side].tolist()] for side in pairs.T]
            return pa.table({"a": pa.array(names[0], pa.binary()), "b": pa.array(names[1], pa.binary())})

        cold = own.where("hub is not null").withColumn("block", F.pmod("h", F.lit(self.blocks)))
        cold = cold.select("block", "h", "d", "n", "p", "component").groupBy("block").applyInArrow(multiply, "a binary, b binary")

        hot = own.where("hub is null").drop("hub")
        several = hot.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        hot = stored(hot.join(several.where("low != high").select("h"), "h", "left_semi"), "jaccard-hot")
        small = F.col("p") < F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
        x = hot.where(small).select("h", *(F.col(c).alias(f"x_{c}") for c in ("d", "n", "p", "component")))
        y = hot.select("h", *(F.col(c).alias(f"y_{c}") for c in ("d", "n", "p", "component")))
        xn, yn = F.col("x_n"), F.col("y_n")
        bound = F.least(xn - F.col("x_p"), yn - F.col("y_p")) >= _needed(xn, yn, percent)
        fits = (F.col("x_component") != F.col("y_component")) & (xn <= yn) & (100 * xn >= percent * yn) & bound
        pairs = x.join(y, "h").where(fits)
        hot = pairs.select(F.least("x_d", "y_d").alias("a"), F.greatest("x_d", "y_d").alias("b"))
        return cold.union(hot).distinct()


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", params: JaccardParams | None = None
) -> DataFrame:
    """(key, n_shingles, component_id): one row for every row of ``docs``.

    ``component_id`` is the smallest key reachable by links, the row's own included.
    Rows with equal sets, repeated rows among them, are linked. Null texts and texts
    without words have an empty set, link with nothing and are their own component.
    Null keys never are the smallest; a component of null keys only has a null id. Texts
    of any length are read whole. An empty table gives an empty result. Extra columns are not read.
    """
    join = _Join(docs, key, text, params or JaccardParams())
    columns = join.columns()
    first = join.links(join.hub_pairs(columns))
    second = join.links(join.open_pairs(columns, components(first, "jaccard-hubs")))
    linked = components(first.union(second), "jaccard-components").withColumnRenamed("node", "d")
    rows = join.rows.join(linked, "d", "left").withColumn("component", F.coalesce("component", "d"))
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("key").alias("smallest"))
    found = rows.join(smallest, "component", "left")
    return found.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("d").isNull(), F.col("key")).otherwise(F.col("smallest")).alias("component_id"),
    )
