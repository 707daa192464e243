"""Gradient boosting on a binned matrix.

Features are cut into at most 255 bins, and one for missing values. Rows of the same bins and
label are one row with their weight and number, and so are rows of the same bins where the
label is a number: their sums need no more than its mean. These blocks are kept by the executors. A round grows one tree for each score (one for a number or two
classes, K for K classes, softmax) from sums of gradients, hessians and rows by (node,
feature, bin), all scores in the same jobs. Of two children only the smaller one is summed
up, the other is its parent less that. Trees grow best split first up to a number of leaves
(the splits that may come next are evaluated together and kept only if their turn comes) or
level by level to a depth. At every cut missing values go to the side that gains more.

What a task needs besides its rows is the trees so far; a worker remembers the scores of
its blocks and brings them up to date, or computes them anew from the trees.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.trees import BLOCK_ROWS, NO_CHILD, Growing, Tree, TreeModel, distinct_rows, unpacked, write_blocks
from tabforge.session import scratch_path

BINS = 255
MISSING = 255
#: Rows of a task, at most about.
TASK_ROWS = 16_384
#: Tasks whose sums the driver adds up itself; those of more are added up on the executors first.
DIRECT_TASKS = 32


@dataclass(frozen=True)
class BoostParams:
    """``classes`` 0: regression. ``max_leaves`` grows best first, ``max_depth`` level by level. ``newton``: gains by
    hessians (else by rows). ``patience``: rounds without gain on held-out rows (weights below 0) before it stops."""

    classes: int
    rounds: int
    rate: float = 0.1
    max_leaves: int | None = None
    max_depth: int | None = None
    min_rows: int = 1
    newton: bool = True
    least_hessian: float = 1e-3
    patience: int | None = None
    tolerance: float = 1e-7

    @property
    def scores(self) -> int:
        return self.classes if self.classes > 2 else 1


# --------------------------------------------------------------------------- bins


def bin_edges(blocks: DataFrame, train: DataFrame, features: int) -> list[np.ndarray]:
    """Upper edges of every feature's bins: between all values where there are at most 255, else at quantiles."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.empty(0)] * features
        for b in batches:
            for x, *_ in unpacked(b):
                for f, own in enumerate(held):
                    if own is not None:
                        own = np.unique(np.concatenate([own, x[~np.isnan(x[:, f]), f]]))
                        held[f] = own if len(own) <= BINS else None
        rows = [(f, v) for f, own in enumerate(held) for v in ([None] if own is None else own.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["f", "v"])

    found = blocks.mapInArrow(values, "f long, v double").distinct()
    few = found.groupBy("f").agg(F.count("*").alias("n"), F.max(F.col("v").isNull()).alias("many")).collect()
    many = sorted(r["f"] for r in few if r["many"] or r["n"] > BINS)
    edges: list[np.ndarray] = [np.empty(0)] * features
    own: dict[int, list] = {}
    for r in found.where(~F.col("f").isin(many) if many else F.lit(True)).collect():  # at most 255 rows a feature
        own.setdefault(r["f"], []).append(r["v"])
    for f, v in own.items():
        v = np.sort(np.array(v))
        edges[f] = v[:-1] + (v[1:] - v[:-1]) / 2
    if many:
        long = train.select(F.posexplode(vector_to_array("features")).alias("f", "v"))
        long = long.where(F.col("f").isin(many) & ~F.isnan("v"))
        shares = [i / BINS for i in range(1, BINS)]
        for r in long.groupBy("f").agg(F.percentile_approx("v", shares, 20_000).alias("q")).collect():
            edges[r["f"]] = np.unique(np.array(r["q"]))
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(e, x[:, f]))
    return out


FOLDED = "bins binary, y binary, w binary, n binary"


def folded(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """One row for rows that boosting cannot tell apart, with their weight, number and, for a number, mean label.

    Rows that are only watched (weights below 0) keep their labels.
    """
    mean = (w > 0) & (classes == 0)
    first, number = distinct_rows(np.column_stack([bins, np.where(mean, 0, y), w > 0]).astype(float))
    weight = np.bincount(number, w, len(first))
    label = np.where(mean[first], np.bincount(number, w * y, len(first)) / weight, y[first])
    return bins[first], label, weight, np.bincount(number, n, len(first))


def _refolded(blocks: Iterator[tuple], classes: int) -> Iterator[tuple]:
    """Blocks folded together as long as a block's rows hold them."""
    held = None
    for block in blocks:
        if held is not None:
            block = folded(*map(np.concatenate, zip(held, block, strict=True)), classes)
        if len(block[1]) <= BLOCK_ROWS:
            held = block
            continue
        held = None
        yield block
    if held is not None:
        yield held


def fold_blocks(blocks: DataFrame, edges: list[np.ndarray], classes: int) -> DataFrame:
    """``FOLDED``: the binned rows, written once."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for b in batches:
                for x, y, w, _, number in unpacked(b):
                    bins = binned(x, edges)
                    sides = []
                    for side in (w > 0, w < 0):
                        n = np.bincount(number, side, len(y))
                        at = np.flatnonzero(n)
                        sides.append((bins[at], y[at], np.bincount(number, np.where(side, w, 0), len(y))[at], n[at]))
                    yield folded(*map(np.concatenate, zip(*sides, strict=True)), classes)

        for block in _refolded(parts(), classes):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in block], ["bins", "y", "w", "n"])

    path = scratch_path(blocks.sparkSession, "folded")
    blocks.mapInArrow(fold, FOLDED).write.parquet(path)
    return blocks.sparkSession.read.schema(FOLDED).parquet(path)


def leaf_of_bins(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """As ``Tree.leaf_of``, thresholds being bins."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins)) if tree.feature[0] != NO_CHILD else np.empty(0, np.int64)
    while len(rows):
        node = at[rows]
        v = bins[rows, tree.feature[node]]
        to_left = np.where(v == MISSING, tree.missing_left[node], v <= tree.threshold[node])
        at[rows] = np.where(to_left, tree.left[node], tree.right[node])
        rows = rows[tree.feature[at[rows]] != NO_CHILD]
    return at


# -------------------------------------------------------------------------- tasks

#: Scores of this worker's blocks: (fit, block) -> (trees applied, scores).
_SCORES: OrderedDict[tuple[str, bytes], tuple[int, np.ndarray]] = OrderedDict()
_REMEMBERED = 256


def _scores(fit: str, block: tuple, base: np.ndarray, trees: list[bytes]) -> np.ndarray:
    """Scores of a block after all trees; they follow from the trees and the block's bins alone."""
    name, bins = block[0], block[1]
    done, out = _SCORES.pop((fit, name), (0, None))
    out = np.tile(base, (len(bins), 1)) if out is None else out
    for i in range(done, len(trees)):
        tree = pickle.loads(trees[i])
        out[:, i % len(base)] += tree.value[leaf_of_bins(tree, bins), 0]
    _SCORES[fit, name] = (len(trees), out)
    while len(_SCORES) > _REMEMBERED:
        _SCORES.popitem(last=False)
    return out


def _probabilities(scores: np.ndarray, classes: int) -> np.ndarray:
    if classes == 2:
        return 1 / (1 + np.exp(-scores))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradients(scores: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What is missing to the label and the loss's curvature, a column a score."""
    if not classes:
        return (y[:, None] - scores) * w[:, None], np.tile(w[:, None], (1, scores.shape[1]))
    p = _probabilities(scores, classes)
    hit = y[:, None] == (np.arange(classes) if classes > 2 else np.array([1]))
    return (hit - p) * w[:, None], p * (1 - p) * w[:, None]


def _loss(scores: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> float:
    if not classes:
        return float((w * (y - scores[:, 0]) ** 2).sum())
    p = _probabilities(scores, classes)
    own = np.where(y == 1, p[:, 0], 1 - p[:, 0]) if classes == 2 else p[np.arange(len(y)), y.astype(int)]
    return float(-(w * np.log(np.maximum(own, 1e-300))).sum())


# ------------------------------------------------------------------------- driver


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool


def best_split(h: np.ndarray, p: BoostParams) -> Split | None:
    """The best cut of a node from its sums (feature, bin, [gradient, hessian, rows]); the first of equal ones."""
    total = h[0].sum(axis=0)
    mass = 1 if p.newton else 2

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.where(s[..., mass] > 0, s[..., mass], 1)

    left = np.cumsum(h[:, :MISSING], axis=1)
    sides = np.stack([left, left + h[:, MISSING][:, None]], axis=2)  # missing right, missing left
    rest = total - sides
    fits = np.ones(sides.shape[:-1], bool)
    for s in (sides, rest):
        fits &= (s[..., 2] >= max(p.min_rows, 1)) & (s[..., 1] >= p.least_hessian)
    fits[:, :, 1] &= (h[:, MISSING, 2] > 0)[:, None]
    gain = np.where(fits, worth(sides) + worth(rest) - worth(total), -np.inf)
    k = int(gain.argmax())
    f, cut, side = np.unravel_index(k, gain.shape)
    if not gain[f, cut, side] > 0:
        return None
    if not h[f, MISSING, 2]:  # none seen: later ones go where more rows went
        side = int(sides[f, cut, 0, 2] > rest[f, cut, 0, 2])
    return Split(float(gain.flat[k]), int(f), int(cut), bool(side))


class Round:
    """One score's tree of a round; sums are asked for from outside."""

    def __init__(self, p: BoostParams, sums: np.ndarray):
        self.p, self.tree = p, Growing(1)
        self.root = self.tree.add(np.zeros(1))
        self.sums = {self.root: sums}
        self.split: dict[int, Split | None] = {self.root: best_split(sums, p)}
        self.kept: set[int] = set()  # nodes whose split is part of the tree
        self.queue: list[tuple[float, int]] = []
        self.depth = {self.root: 0}
        self._enter(self.root)

    def _enter(self, node: int) -> None:
        s = self.split[node]
        if s is not None and (self.p.max_depth is None or self.depth[node] < self.p.max_depth):
            heapq.heappush(self.queue, (-s.gain, node))

    def _left(self) -> int:
        return (self.p.max_leaves or 1 << 30) - 1 - len(self.kept)

    def wanted(self) -> list[int]:
        """Take the splits whose turn has come; then the nodes whose smaller child's sums are needed to go on."""
        while self.queue and self._left():
            _, node = self.queue[0]
            if self.tree.feature[node] == NO_CHILD:
                break
            heapq.heappop(self.queue)
            self.kept.add(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                self._enter(child)
        if not self._left():
            return []
        new = [n for _, n in heapq.nsmallest(self._left(), self.queue) if self.tree.feature[n] == NO_CHILD]
        ask = []
        for node in new:
            s, h = self.split[node], self.sums[node]
            part = h[s.feature, : s.cut + 1, 2].sum() + (h[s.feature, MISSING, 2] if s.missing_left else 0)
            children = [self.tree.add(np.zeros(1)) for _ in range(2)]
            self.tree.split(node, s.feature, s.cut, *children, s.missing_left)
            for c in children:
                self.depth[c] = self.depth[node] + 1
            small = children[0] if 2 * part <= h[s.feature, :, 2].sum() else children[1]
            if h.shape[0] == 1:  # the only feature's sums are the node's own, cut in two
                own = h.copy()
                own[0, s.cut + 1 : MISSING] = 0
                if not s.missing_left:
                    own[0, MISSING] = 0
                self._born(node, children[0], own)
            elif self.p.max_depth is not None and self.depth[children[0]] == self.p.max_depth:
                self._last(node, children, s)
            else:
                ask.append((node, small))
        self.asked = dict(ask)
        return [small for _, small in ask] if ask else (self.wanted() if new else [])

    def _born(self, node: int, child: int, sums: np.ndarray) -> None:
        """A child's sums are known, and so its sibling's."""
        other = self.tree.left[node] + self.tree.right[node] - child
        self.sums[child], self.sums[other] = sums, self.sums.pop(node) - sums
        for c in (child, other):
            self.split[c] = best_split(self.sums[c], self.p)

    def _last(self, node: int, children: list[int], s: Split) -> None:
        """Leaves by depth need no more than their totals, which the split's feature has."""
        h = self.sums.pop(node)[s.feature : s.feature + 1]
        own = h.copy()
        own[0, s.cut + 1 : MISSING] = 0
        if not s.missing_left:
            own[0, MISSING] = 0
        for c, sums in zip(children, (own, h - own), strict=True):
            self.sums[c], self.split[c] = sums, None

    def answer(self, sums: dict[int, np.ndarray]) -> None:
        for node, small in self.asked.items():
            self._born(node, small, sums[small])

    def finished(self, scale: float) -> Tree:
        """The kept splits; a leaf's value is its gradients over its hessians, scaled."""
        out = Growing(1)
        totals: dict[int, np.ndarray] = {}

        def total(node: int) -> np.ndarray:
            if node not in totals:
                kids = (self.tree.left[node], self.tree.right[node])
                totals[node] = self.sums[node][0].sum(axis=0) if node in self.sums else total(kids[0]) + total(kids[1])
            return totals[node]

        def value(node: int) -> np.ndarray:
            t = total(node)
            return np.array([scale * t[0] / t[1] if t[1] > 0 else 0.0])

        todo = [(self.root, out.add(value(self.root)))]
        while todo:
            node, at = todo.pop()
            if node in self.kept:
                s = self.split[node]
                kids = [(c, out.add(value(c))) for c in (self.tree.left[node], self.tree.right[node])]
                out.split(at, s.feature, s.cut, kids[0][1], kids[1][1], s.missing_left)
                todo += kids
        return out.tree()


def fit_boosting(train: DataFrame, p: BoostParams, *, key: str, label: str, weight: str | None = None) -> TreeModel:
    """Boost over (key, features, label[, weight]); rows whose weight is below 0 are only watched for stopping."""
    blocks = write_blocks(train, key=key, features="features", label=label, weight=weight)
    first = blocks.select(F.octet_length("x"), F.octet_length("y")).first()
    if first is None:
        raise ValueError("no rows to fit")
    features = first[0] // first[1]
    edges = bin_edges(blocks, train, features)

    blocks = fold_blocks(blocks, edges, p.classes)

    def prepared(rows: Iterator) -> Iterator[tuple]:
        def parts() -> Iterator[tuple]:
            for r in rows:
                y, w, n = (np.frombuffer(bytes(r[c])) for c in ("y", "w", "n"))
                yield np.frombuffer(bytes(r["bins"]), np.uint8).reshape(len(y), -1), y, w, n

        for block in _refolded(parts(), p.classes):
            yield hashlib.sha1(block[0].tobytes() + block[1].tobytes()).digest(), *block

    rows = blocks.agg(F.sum(F.octet_length("y") / 8)).first()[0] or 0
    tasks = int(max(1, -(-rows // TASK_ROWS)))  # small tables take few tasks a job, as a round is a few short jobs
    data = blocks.rdd.coalesce(tasks).mapPartitions(prepared).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _boost(data, p, edges)
    finally:
        data.unpersist()


def _boost(data: RDD, p: BoostParams, edges: list[np.ndarray]) -> TreeModel:
    classes, fit = p.classes, hashlib.sha1(pickle.dumps((id(data), p))).hexdigest()

    def label_sums(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        out = np.zeros(max(classes, 2))
        for _, _, y, w, _ in rows:
            w = np.maximum(w, 0)
            out += np.bincount(y.astype(int), w, classes) if classes else [w.sum(), (w * y).sum()]
        yield out

    sums = _added(data.mapPartitions(label_sums), np.add)
    if not classes:
        base = np.array([sums[1] / (sums[0] or 1)])
    elif classes == 2:
        base = np.array([np.log(max(sums[1], 1e-12) / max(sums[0], 1e-12))])
    else:
        base = np.log(np.maximum(sums / sums.sum(), 1e-12))
    scale = p.rate * ((classes - 1) / classes if classes > 2 and not p.newton else 1)
    trees: list[bytes] = []
    best, since = np.inf, 0
    for _ in range(p.rounds):
        root = {k: (None, [0]) for k in range(p.scores)}
        found, loss, held = _sums(data, p, fit, base, trees, root, len(edges))
        if p.patience is not None and held > 0:
            since = 0 if loss / held < best - p.tolerance else since + 1
            best = min(best, loss / held)
            if since >= p.patience:
                break
        growing = {k: Round(p, found[k, 0]) for k in range(p.scores)}
        while True:
            ask = {k: (r.tree.tree(), nodes) for k, r in growing.items() if (nodes := r.wanted())}
            if not ask:
                break
            found = _sums(data, p, fit, base, trees, ask, len(edges))[0]
            for k, (_, nodes) in ask.items():
                growing[k].answer({n: found[k, n] for n in nodes})
        trees += [pickle.dumps(growing[k].finished(scale)) for k in range(p.scores)]
    model = []
    for blob in trees:
        t = pickle.loads(blob)
        real = [edges[f][int(c)] if f != NO_CHILD and c < len(edges[f]) else np.inf for f, c in zip(t.feature, t.threshold, strict=True)]
        model.append(Tree(t.feature, np.array(real), t.left, t.right, t.value, t.missing_left))
    return TreeModel(model, classes, mean=False, base=base.tolist())


def _added(parts: RDD, add: Callable):
    return parts.treeReduce(add, depth=1 if parts.getNumPartitions() <= DIRECT_TASKS else 2)


def _sums(
    data: RDD, p: BoostParams, fit: str, base: np.ndarray, trees: list[bytes], ask: dict[int, tuple[Tree | None, list[int]]],
    features: int,
) -> tuple[dict[tuple[int, int], np.ndarray], float, float]:
    """(score, node) -> sums by feature and bin of its rows; the held-out rows' loss and weight."""
    places = {(k, n): i for i, (k, n) in enumerate((k, n) for k, (_, nodes) in ask.items() for n in nodes)}
    asked = [(k, pickle.dumps(tree), nodes) for k, (tree, nodes) in ask.items()]
    watch = p.patience is not None and None in (t for t, _ in ask.values())
    shape = (len(places), features, BINS + 1, 3)
    classes, already = p.classes, list(trees)

    def part(rows: Iterator[tuple]) -> Iterator[tuple]:
        out, loss = np.zeros(shape), np.zeros(2)
        grown = [(k, pickle.loads(tree), nodes) for k, tree, nodes in asked]
        for block in rows:
            _, bins, y, w, n = block
            scores = _scores(fit, block, base, already)
            if watch and (w < 0).any():
                out_of = w < 0
                loss += [_loss(scores[out_of], y[out_of], -w[out_of], classes), -w[out_of].sum()]
            fitted = w > 0
            g, h = _gradients(scores, y, np.maximum(w, 0), classes)
            for k, tree, nodes in grown:
                at = np.zeros(len(y), np.int64) if tree is None else leaf_of_bins(tree, bins)
                local = np.full(1 if tree is None else len(tree.feature), -1)
                local[nodes] = np.arange(len(nodes))
                rows_in = np.flatnonzero(fitted & (local[at] >= 0))
                if not len(rows_in):
                    continue
                start = places[k, nodes[0]]
                slot, size = local[at[rows_in]] * (BINS + 1), len(nodes) * (BINS + 1)
                for f in range(features):
                    cell = slot + bins[rows_in, f]
                    for c, v in enumerate((g[rows_in, k], h[rows_in, k], n[rows_in])):
                        out[start : start + len(nodes), f, :, c] += np.bincount(cell, v, size).reshape(len(nodes), BINS + 1)
        yield out, loss

    total, loss = _added(data.mapPartitions(part), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return {at: total[i] for at, i in places.items()}, float(loss[0]), float(loss[1])


@dataclass
class BoostEstimator:
    """Fits by :func:`fit_boosting`; ``valid``: a boolean column of rows that are held out for stopping."""

    params: BoostParams

    def fit_rows(self, train: DataFrame, *, key: str, label: str, weight: str | None = None, valid: str | None = None) -> TreeModel:
        p, w = self.params, F.col(weight) if weight else F.lit(1.0)
        if p.patience is not None and valid:
            train = train.withColumn("__weight", F.when(F.col(valid), -w).otherwise(w))
            weight = "__weight"
        return fit_boosting(train, p, key=key, label=label, weight=weight)
