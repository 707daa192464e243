"""Decision trees, forests and extra trees of any depth.

The matrix is written once as packed blocks of rows. A tree's nodes that hold more than
``local_rows`` rows take distributed levels: one aggregate gives every feature's range in
each of them, a second the sums on the left of candidate cuts, for all trees of a group at
once. A cut is drawn between the node's own minimum and maximum (extra trees) or is the
best of evenly spaced ones. Rows are not moved for that: a task finds each row's node by
the trees so far. Nodes whose rows fit are then finished inside a task, rows grouped by
(tree, node), with exact cuts and no limit of depth.

A block holds each of its distinct rows (features and label) once, and for every row of the
table its weight, its key and its distinct row's number: a tree's sample is weights of
distinct rows, which is all that is routed and sent.

Every random choice is a hash of its seed, tree, node and row key, so that neither the
partitions nor a task that runs again change a tree. Fitted trees are packed arrays on the
driver, as in ``pyspark.ml``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.session import scratch_path
from tabforge.sources.files import read_text, write_text

BLOCK_ROWS = 16_384
#: Partitions that the written blocks are dealt over, at least (a small table may be read by one task).
WRITTEN_PARTS = 48
#: Bytes of an Arrow batch of rows on their way to the tasks that finish a node, at most about.
SENT_BYTES = 1 << 22
#: Even cuts of a large node's range, per feature.
EVEN_CUTS = 63
NO_CHILD = -1


def mixed(h: np.ndarray | int) -> np.ndarray:
    """64-bit hash of 64-bit numbers."""
    h = np.asarray(h).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(*parts: np.ndarray | int) -> np.ndarray:
    """One hash of several numbers or arrays."""
    out = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        with np.errstate(over="ignore"):
            out = mixed(out + np.asarray(p).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return out


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Hash as a number in (0, 1)."""
    return ((chain(*parts) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row, in an order that the rows decide, and every row's number among them.

    0.0 equals -0.0 and NaN equals NaN. Rows are ordered by hash and compared in full: equal hashes merge nothing else.
    """
    bits = np.where(np.isnan(rows), np.nan, rows + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (mixed(bits) * (chain(np.arange(rows.shape[1])) | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = (bits[order[1:]] != bits[order[:-1]]).any(axis=1)
    number = np.empty(len(rows), np.int32)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def matrix_of(lists: pa.ListArray) -> np.ndarray:
    """Lists of equal length as a matrix."""
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(len(lists), -1)


# Poisson(1) by inverse distribution: how often a bootstrap draws a row
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


@dataclass
class Tree:
    """Packed nodes, the root first. ``feature`` is NO_CHILD in a leaf; a row goes left where x <= threshold, and, if
    x is missing, where ``missing_left``. ``value``: class shares or a mean, a row a node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    missing_left: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if self.feature[0] != NO_CHILD else np.empty(0, np.int64)
        while len(rows):
            node = at[rows]
            v = x[rows, self.feature[node]]
            to_left = np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])
            at[rows] = np.where(to_left, self.left[node], self.right[node])
            rows = rows[self.feature[at[rows]] != NO_CHILD]
        return at

    def depth(self) -> int:
        deep = np.zeros(len(self.feature), int)
        for i, f in enumerate(self.feature):
            if f != NO_CHILD:
                deep[[self.left[i], self.right[i]]] = deep[i] + 1
        return int(deep.max())

    COLUMNS = {"feature": "<i4", "threshold": "<f8", "left": "<i4", "right": "<i4", "value": "<f8", "missing_left": "?"}

    def packed(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n), k).tobytes() for n, k in self.COLUMNS.items()}

    @classmethod
    def unpacked(cls, blobs: dict[str, bytes]) -> Tree:
        parts = {n: np.frombuffer(blobs[n], k) for n, k in cls.COLUMNS.items()}
        parts["value"] = parts["value"].reshape(len(parts["feature"]), -1)
        return cls(**parts)


class Growing:
    """A tree under construction."""

    def __init__(self, width: int):
        self.width = width
        self.feature, self.threshold, self.left, self.right, self.value, self.missing = [], [], [], [], [], []

    def add(self, value: np.ndarray) -> int:
        for column, v in ((self.feature, NO_CHILD), (self.threshold, np.nan), (self.left, NO_CHILD),
                          (self.right, NO_CHILD), (self.value, value), (self.missing, False)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, left: int, right: int, missing_left: bool = False) -> None:
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, left, right
        self.missing[node] = missing_left

    def graft(self, node: int, tree: Tree) -> None:
        """The node becomes the root of ``tree``."""
        place = [node, *range(len(self.feature), len(self.feature) + len(tree.feature) - 1)]
        for i, at in enumerate(place):
            if i:
                self.add(tree.value[i])
            self.value[at] = tree.value[i]
        for i, at in enumerate(place):
            if tree.feature[i] != NO_CHILD:
                self.split(at, int(tree.feature[i]), float(tree.threshold[i]), place[tree.left[i]], place[tree.right[i]],
                           bool(tree.missing_left[i]))

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int32), np.array(self.threshold, float), np.array(self.left, np.int32),
                    np.array(self.right, np.int32), np.array(self.value, float).reshape(len(self.feature), -1),
                    np.array(self.missing, bool))


# ----------------------------------------------------------------------- targets


def row_stats(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """What a node sums up: weight per class, or weight, weighted label and its square."""
    if classes:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y.astype(int)] = w
        return out
    return np.stack([w, w * y, w * y * y], axis=1)


def impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Gini impurity or squared error, times the weight, of sums along the last axis."""
    if classes:
        total = stats.sum(axis=-1)
        return total - (stats**2).sum(axis=-1) / np.where(total > 0, total, 1)
    return stats[..., 2] - stats[..., 1] ** 2 / np.where(stats[..., 0] > 0, stats[..., 0], 1)


def leaf_value(stats: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return stats / (stats.sum() or 1)
    return np.array([stats[1] / (stats[0] or 1)])


# ----------------------------------------------------------------- inside a task


def _cut_between(low: float, high: float) -> float:
    if not np.isfinite(low):  # missing on the left
        return low
    middle = low + (high - low) / 2
    return low if middle >= high else middle


def grow(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, *, classes: int, tries: int, random_cuts: bool, seed: tuple[int, ...],
    max_depth: int | None = None,
) -> Tree:
    """A tree to the end: leaves are pure or cannot be cut. Missing features count as the smallest value.

    ``tries`` features that differ within a node are compared there, in hashed order;
    ties go to the first of them and to the smaller cut.
    """
    out = Growing(classes or 1)
    x = np.where(np.isnan(x), -np.inf, x)
    stats = row_stats(y, w, classes)
    todo = [(np.arange(len(y)), out.add(leaf_value(stats.sum(axis=0), classes)), 0)]
    while todo:
        rows, node, depth = todo.pop()
        own, ys = x[rows], y[rows]
        if len(rows) < 2 or (ys == ys[0]).all() or depth == max_depth:
            continue
        low, high = own.min(axis=0), own.max(axis=0)
        differ = np.flatnonzero(low < high)
        order = differ[np.argsort(chain(*seed, node, differ), kind="stable")][:tries]
        total = stats[rows].sum(axis=0)
        best = None
        for f in order.tolist():
            if random_cuts:
                least = low[f] if np.isfinite(low[f]) else own[np.isfinite(own[:, f]), f].min()
                cuts = np.array([min(least + float(uniform(*seed, node, f, 1)) * (high[f] - least), np.nextafter(high[f], -np.inf))])
                left = stats[rows[own[:, f] <= cuts[0]]].sum(axis=0)[None]
            else:
                at = np.argsort(own[:, f], kind="stable")
                v = own[at, f]
                ends = np.flatnonzero(v[1:] > v[:-1])
                left = np.cumsum(stats[rows[at]], axis=0)[ends]
                cuts = ends
            loss = impurity(left, classes) + impurity(total - left, classes)
            k = int(loss.argmin())
            if best is None or loss[k] < best[0]:
                cut = float(cuts[k]) if random_cuts else _cut_between(v[ends[k]], v[ends[k] + 1])
                best = (loss[k], f, cut)
        if best is None:
            continue
        _, f, cut = best
        to_left = own[:, f] <= cut
        children = []
        for part in (rows[to_left], rows[~to_left]):
            children.append((part, out.add(leaf_value(stats[part].sum(axis=0), classes)), depth + 1))
        out.split(node, f, cut, children[0][1], children[1][1], missing_left=True)
        todo += children
    return out.tree()


# -------------------------------------------------------------------- distributed


@dataclass(frozen=True)
class ForestParams:
    """``tries``: features compared at a node, or "sqrt" or "all". ``local_rows``: distinct rows of a node that is
    finished inside a task. ``together``: trees that share passes over the data."""

    trees: int = 1
    tries: int | str = "all"
    bootstrap: bool = False
    random_cuts: bool = False
    max_depth: int | None = None
    seed: int = 42
    local_rows: int = 200_000
    together: int = 100

    def tried(self, features: int) -> int:
        return features if self.tries == "all" else max(1, int(features**0.5)) if self.tries == "sqrt" else int(self.tries)


BLOCK = "x binary, y binary, w binary, keys binary, number binary"


def write_blocks(train: DataFrame, *, key: str, features: str, label: str, weight: str | None) -> DataFrame:
    """``BLOCK``: packed blocks of rows, written once; a partition's last block may be short."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = matrix_of(part.column(0))
                y, w, keys = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                first, number = distinct_rows(np.column_stack([x, y]))
                blobs = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (x[first], y[first], w, keys, number)]
                yield pa.RecordBatch.from_arrays(blobs, ["x", "y", "w", "keys", "number"])

    spark = train.sparkSession
    path = scratch_path(spark, "matrix")
    w = F.col(weight) if weight else F.lit(1.0)
    slim = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                        w.cast("double").alias("w"), F.xxhash64(key).alias("keys"))
    parts = max(WRITTEN_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim.mapInArrow(pack, BLOCK).repartition(parts).write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Features and labels of distinct rows; weights, keys and distinct row of all rows."""
    for x, y, w, keys, number in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
        y = np.frombuffer(y)
        yield (np.frombuffer(x).reshape(len(y), -1), y, np.frombuffer(w), np.frombuffer(keys, np.int64).view(np.uint64),
               np.frombuffer(number, np.int32))


def _drawn(p: ForestParams, tree: int, keys: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row weights in a tree's own sample."""
    return w * np.searchsorted(_POISSON, uniform(p.seed, tree, keys, 7)) if p.bootstrap else w


class Forest:
    """Fits all trees of a forest over written blocks."""

    def __init__(self, blocks: DataFrame, classes: int, params: ForestParams):
        self.blocks, self.classes, self.p = blocks, classes, params
        first = blocks.select(F.octet_length("x"), F.octet_length("y")).first()
        self.features = first[0] // first[1] if first else 0
        self.width = classes or 3

    def fit(self) -> list[Tree]:
        if not self.features:
            raise ValueError("no rows to fit")
        out: list[Tree] = []
        for start in range(0, self.p.trees, self.p.together):
            out += self._fit_some(range(start, min(self.p.trees, start + self.p.together)))
        return out

    def _fit_some(self, trees: range) -> list[Tree]:
        tops = {t: Growing(self.classes or 1) for t in trees}
        opened = {t: {tops[t].add(np.zeros(self.classes or 1)): 0} for t in trees}  # node -> depth
        while True:
            large = self._large(tops, opened)
            if not large:
                break
            grown = {k: v for k, v in large.items() if self.p.max_depth is None or opened[k[0]][k[1]] < self.p.max_depth}
            cuts = dict.fromkeys(large) | (self._best_cuts(tops, grown) if grown else {})
            for (t, node), cut in cuts.items():
                depth = opened[t].pop(node)
                if cut is None:
                    tops[t].value[node] = leaf_value(large[t, node][0], self.classes)
                    continue
                left, right = (tops[t].add(np.zeros(self.classes or 1)) for _ in range(2))
                tops[t].split(node, *cut, left, right, missing_left=True)
                opened[t] |= {left: depth + 1, right: depth + 1}
        for t, node, tree in self._finished(tops, opened):
            tops[t].graft(node, tree)
        return [tops[t].tree() for t in trees]

    def _routed(self, tops: dict[int, Growing], opened: dict[int, set]):
        """A generator of (tree, node, x, y, weights) of distinct rows for the open nodes of a task's blocks."""
        p, frozen = self.p, {t: (g.tree(), np.array(sorted(opened[t]), np.int64)) for t, g in tops.items() if opened[t]}

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for x, y, w, keys, number in unpacked(b):
                    for i, (t, (tree, nodes)) in enumerate(frozen.items()):
                        if p.bootstrap or not i:
                            own = np.bincount(number, _drawn(p, t, keys, w), len(y))
                        at = tree.leaf_of(x)
                        for node in nodes.tolist():
                            rows = np.flatnonzero((at == node) & (own > 0))
                            if len(rows):
                                yield t, node, x[rows], y[rows], own[rows]

        return parts

    def _large(self, tops: dict[int, Growing], opened: dict[int, dict]) -> dict[tuple[int, int], tuple]:
        """(tree, node) -> (stats, least and largest value of each feature) of open nodes with too many distinct rows."""
        total = self.blocks.agg(F.sum(F.octet_length("y")) / 8).first()[0]
        if total <= self.p.local_rows:
            return {}
        parts, classes, width = self._routed(tops, opened), self.classes, self.width

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for t, node, x, y, w in parts(batches):
                low = np.where(np.isnan(x), np.inf, x).min(axis=0)
                high = np.where(np.isnan(x), -np.inf, x).max(axis=0)
                missing, stats = np.isnan(x).any(axis=0), row_stats(y, w, classes).sum(axis=0)
                if (t, node) in held:
                    h = held[t, node]
                    held[t, node] = [h[0] + len(y), h[1] + stats, np.minimum(h[2], low), np.maximum(h[3], high), h[4] | missing]
                else:
                    held[t, node] = [len(y), stats, low, high, missing]
            rows = [(t, n, f, h[0], float(h[2][f]), float(h[3][f]), bool(h[4][f]), *h[1].tolist())
                    for (t, n), h in held.items() for f in range(len(h[2]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

        sums = [f"s{i}" for i in range(width)]
        names = ["tree", "node", "feature", "n", "low", "high", "missing", *sums]
        kind = "tree long, node long, feature long, n long, low double, high double, missing boolean, " + ", ".join(f"{s} double" for s in sums)
        found = self.blocks.mapInArrow(ranges, kind).groupBy("tree", "node", "feature").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("missing").alias("missing"),
            *(F.sum(s).alias(s) for s in sums),
        )
        out: dict[tuple[int, int], tuple] = {}
        # a row for each feature of a large node: at most together * features * rows / local_rows * 2
        for r in found.where(F.col("n") > self.p.local_rows).collect():
            stats, low, high = out.setdefault((r["tree"], r["node"]), (np.zeros(width), np.full(self.features, np.inf), np.full(self.features, -np.inf)))
            stats[:] = [r[s] for s in sums]
            low[r["feature"]], high[r["feature"]] = r["low"], r["high"]
            if r["missing"]:  # counts as the smallest value
                low[r["feature"]] = -np.inf
        return out

    def _candidates(self, tree: int, node: int, stats: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        if impurity(stats, self.classes) <= 1e-12 * max(1.0, float(np.abs(stats).max())):
            return {}
        differ = np.flatnonzero(low < high)
        seed = (self.p.seed, tree, 11)
        out = {}
        for f in differ[np.argsort(chain(*seed, node, differ), kind="stable")][: self.p.tried(self.features)].tolist():
            least = low[f] if np.isfinite(low[f]) else min(0.0, high[f]) - 1.0
            if self.p.random_cuts:
                cut = least + float(uniform(*seed, node, f, 1)) * (high[f] - least)
                out[f] = np.array([min(cut, np.nextafter(high[f], -np.inf))])
            else:
                cuts = least + (high[f] - least) * np.arange(EVEN_CUTS) / EVEN_CUTS
                out[f] = np.unique(cuts[cuts < high[f]])
        return out

    def _best_cuts(self, tops: dict[int, Growing], large: dict[tuple[int, int], tuple]) -> dict[tuple[int, int], tuple | None]:
        """(feature, cut) of each large node, or None where nothing differs."""
        cuts = {k: self._candidates(*k, *v) for k, v in large.items()}
        parts, classes, width = self._routed(tops, {t: {n for u, n in large if u == t} for t in tops}), self.classes, self.width

        def sums_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for t, node, x, y, w in parts(batches):
                stats = row_stats(y, w, classes)
                for f, c in cuts[t, node].items():
                    place = np.searchsorted(c, np.where(np.isnan(x[:, f]), -np.inf, x[:, f]))  # left of all cuts from here on
                    bins = np.stack([np.bincount(place, stats[:, k], len(c) + 1) for k in range(stats.shape[1])], axis=1)
                    left = np.cumsum(bins, axis=0)[:-1]
                    held[t, node, f] = held.get((t, node, f), 0) + left
            rows = [(t, n, f, k, *s) for (t, n, f), left in held.items() for k, s in enumerate(left.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["tree", "node", "feature", "cut", *names])

        names = [f"s{i}" for i in range(width)]
        kind = "tree long, node long, feature long, cut long, " + ", ".join(f"{s} double" for s in names)
        found = self.blocks.mapInArrow(sums_left, kind).groupBy("tree", "node", "feature", "cut").agg(*(F.sum(s).alias(s) for s in names))
        best: dict[tuple[int, int], tuple] = {}
        # a row a candidate cut of a large node
        for r in found.toLocalIterator():
            k, left = (r["tree"], r["node"]), np.array([r[s] for s in names])
            rest = large[k][0] - left
            weight = [s.sum() if classes else s[0] for s in (left, rest)]
            if min(weight) > 1e-9 * max(weight):
                score = (float(impurity(left, classes) + impurity(rest, classes)), r["feature"], r["cut"])
                best[k] = min(best.get(k, score), score)
        return {k: (best[k][1], float(cuts[k][best[k][1]][best[k][2]])) if k in best else None for k in large}

    def _finished(self, tops: dict[int, Growing], opened: dict[int, dict]) -> Iterator[tuple[int, int, Tree]]:
        """(tree, node, subtree) of every open node, grown where its rows are gathered."""
        parts, p, classes, tries = self._routed(tops, opened), self.p, self.classes, self.p.tried(self.features)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for t, node, *columns in parts(batches):
                held.append((t, node, *(np.ascontiguousarray(c).tobytes() for c in columns)))
                size += sum(map(len, held[-1][2:]))
                if size > SENT_BYTES:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i > 1 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for b in batches:
                for t, node, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (t, node) != now and held:
                        yield grown(now, held)
                        held = []
                    now = (t, node)
                    held.append(blobs)
            if held:
                yield grown(now, held)

        def grown(at: tuple[int, int], held: list) -> pa.RecordBatch:
            x, y, w = (np.concatenate([np.frombuffer(h[i]) for h in held]) for i in range(3))
            x = x.reshape(len(y), -1)
            first, number = distinct_rows(np.column_stack([x, y]))
            order = np.lexsort((w, number))  # equal rows of several blocks; their order must not show in the sums
            w = np.bincount(number[order], w[order], len(first))
            limit = None if p.max_depth is None else p.max_depth - opened[at[0]][at[1]]
            tree = grow(x[first], y[first], w, classes=classes, tries=tries, random_cuts=p.random_cuts,
                        seed=(p.seed, at[0], at[1] + 1000), max_depth=limit)
            blobs = tree.packed()
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), *(pa.array([v], pa.binary()) for v in blobs.values())], ["tree", "node", *blobs])

        names = ["tree", "node", "x", "y", "w"]
        sent = self.blocks.mapInArrow(send, "tree long, node long, x binary, y binary, w binary")
        dealt = sent.repartition("tree", "node").sortWithinPartitions("tree", "node")
        rows = dealt.mapInArrow(finish, "tree long, node long, " + ", ".join(f"{c} binary" for c in Tree.COLUMNS)).collect()
        for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
            yield r["tree"], r["node"], Tree.unpacked({c: bytes(r[c]) for c in Tree.COLUMNS})


# -------------------------------------------------------------------------- model


@dataclass
class TreeModel:
    """Fitted trees. ``mean``: a forest, whose trees' values are averaged; else boosting, whose trees' values are added
    to ``base``, tree i to score i modulo their number."""

    trees: list[Tree]
    classes: int  # 0: regression
    mean: bool = True
    base: list[float] = field(default_factory=list)
    featuresCol: str = "features"

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.mean:
            return sum(t.value[t.leaf_of(x)] for t in self.trees) / len(self.trees)
        out = np.tile(np.array(self.base, float), (len(x), 1))
        for i, t in enumerate(self.trees):
            out[:, i % len(self.base)] += t.value[t.leaf_of(x), 0]
        return out

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        if self.mean:
            return raw
        if len(self.base) == 1:
            p = 1 / (1 + np.exp(-raw[:, 0]))
            return np.stack([1 - p, p], axis=1)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classes, the array ``probability``."""

        @F.arrow_udf("struct<prediction: double, probability: array<double>>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                x = matrix_of(b) if len(b) else np.zeros((0, 1))
                first, number = distinct_rows(x)  # equal rows are scored once
                raw = self.raw(x[first]) if len(b) else np.zeros((0, 1))
                p = self.probabilities(raw) if self.classes and len(b) else None
                best = raw[:, 0] if p is None else p.argmax(axis=1).astype(float)
                shares = pa.array([None] * len(b), pa.list_(pa.float64()))
                if p is not None:
                    ends = np.arange(len(b) + 1, dtype=np.int32) * p.shape[1]
                    shares = pa.ListArray.from_arrays(pa.array(ends), pa.array(p[number].ravel()))
                yield pa.StructArray.from_arrays([pa.array(best[number], pa.float64()), shares], ["prediction", "probability"])

        held = df.withColumn("__scored", score(vector_to_array(F.col(self.featuresCol))))
        out = held.withColumn("prediction", F.col("__scored.prediction"))
        if self.classes:
            out = out.withColumn("probability", F.col("__scored.probability"))
        return out.drop("__scored")

    def save(self, spark: SparkSession, path: str) -> None:
        kind = "tree int, " + ", ".join(f"{c} binary" for c in Tree.COLUMNS)
        rows = [(i, *map(bytearray, t.packed().values())) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/trees")
        write_text(spark, f"{path}/ensemble.json", json.dumps({"classes": self.classes, "mean": self.mean, "base": self.base}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        meta = json.loads(read_text(spark, f"{path}/ensemble.json"))
        return cls([Tree.unpacked({c: bytes(r[c]) for c in Tree.COLUMNS}) for r in rows], meta["classes"], meta["mean"], meta["base"])


@dataclass
class ForestEstimator:
    """Fits a :class:`TreeModel` on (key, features, label[, weight]); see :class:`Forest`."""

    params: ForestParams
    classes: int

    def fit_rows(self, train: DataFrame, *, key: str, label: str, weight: str | None = None, valid: str | None = None) -> TreeModel:
        """``valid`` is not looked at: forests fit all rows."""
        blocks = write_blocks(train, key=key, features="features", label=label, weight=weight)
        return TreeModel(Forest(blocks, self.classes, self.params).fit(), self.classes)
