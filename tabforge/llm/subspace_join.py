"""Near-duplicate embeddings by a subspace pigeonhole join.

Two unit vectors with cosine c are sqrt(2 - 2c) apart. Vectors are rotated by a
seeded orthogonal matrix and split into low-dimensional blocks; each block gets the
share of the squared distance that it has of the dimensions. When the whole distance
is within its budget, some block's distance is within the block's. So each block is
range-joined on its own, and the union of what is found is verified exactly.

Range join: a block's space is cut into cubes a few radii wide. A vector is at home
in one cube and probes those lexicographically greater ones that its ball touches,
so a pair within the radius meets exactly once per block: in the greater of its two
home cubes. Only coordinates of the block travel, in packed arrays. Vectors that
have a partner within the radius are then gathered with their full coordinates,
groups over ``tile`` vectors as pairs of tiles, and verified by matrix products. A
pair counts in its first block within budget, and only in the cube where it meets
there; so nothing has to be deduplicated, and no pair leaves a task: a tile sends
counts per vector and a spanning forest of its links.

Equal vectors are one vector with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import add_chunks, components, histogram_chunks, mixed, pieces, stored


@dataclass(frozen=True)
class SubspaceParams:
    """``cube``: width in radii, over 2. ``entries``: cube entries per task. ``hot``: cubes that may hold more go straight to tiles."""

    cosine: float = 0.98
    block_dims: int = 8
    cube: float = 4.0
    seed: int = 5
    entries: int = 250_000
    hot: int = 100_000
    sketch_bits: int = 18
    tile: int = 512


class Subspaces:
    """Rotation, blocks and cubes for vectors of one length."""

    def __init__(self, d: int, p: SubspaceParams):
        self.p, self.d = p, d
        q, r = np.linalg.qr(np.random.default_rng([p.seed, d]).standard_normal((d, d)))
        self.rotation = q * np.sign(np.diag(r))
        self.blocks = np.array_split(np.arange(d), -(-d // p.block_dims))
        budget = 2 - 2 * p.cosine
        # a little more than the exact budgets, so that rounding loses nothing
        self.radius2 = [budget * len(b) / d * (1 + 1e-9) + 1e-12 for b in self.blocks]

    def homes(self, x: np.ndarray, k: int) -> np.ndarray:
        width = self.p.cube * np.sqrt(self.radius2[k])
        return np.floor(x[:, self.blocks[k]] / width).astype(np.int64)

    def key(self, label: np.ndarray, k: int, cubes: np.ndarray) -> np.ndarray:
        """64-bit key of label, vector length, block and cube."""
        h = mixed(label ^ np.uint64((self.d << 20) + k + 1))
        for column in cubes.T:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        return h

    def meeting_key(self, label: np.ndarray, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Key of the greater one of two home cubes, row by row."""
        differ = a != b
        first = differ.argmax(axis=1)
        rows = np.arange(len(a))
        a_greater = differ.any(axis=1) & (a[rows, first] > b[rows, first])
        return self.key(label, k, np.where(a_greater[:, None], a, b))

    def cubes(self, x: np.ndarray, label: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, cube keys, at home) of block ``k``: homes, then the greater cubes that balls touch."""
        home = self.homes(x, k)
        yield np.arange(len(x)), self.key(label, k, home), True
        radius2 = self.radius2[k]
        width = self.p.cube * np.sqrt(radius2)
        inside = x[:, self.blocks[k]] - home * width
        up = inside > width / 2
        gap2 = np.where(up, width - inside, inside) ** 2
        step = np.where(up, 1, -1)
        dims = home.shape[1]
        reach = radius2 * (1 + 1e-9)
        # sets of dimensions in which a ball leaves its cube; the first one must lead upwards
        stack = [((j,), np.flatnonzero(up[:, j] & (gap2[:, j] <= reach))) for j in range(dims)]
        while stack:
            chosen, rows = stack.pop()
            if not len(rows):
                continue
            moved = home[rows].copy()
            moved[:, chosen] += step[rows][:, chosen]
            yield rows, self.key(label[rows], k, moved), False
            spent = gap2[rows][:, chosen].sum(axis=1)
            for j in range(chosen[-1] + 1, dims):
                stack.append(((*chosen, j), rows[spent + gap2[rows, j] <= reach]))


@lru_cache(maxsize=16)
def subspaces(d: int, p: SubspaceParams) -> Subspaces:
    return Subspaces(d, p)


def _unit(v: list | None) -> np.ndarray | None:
    """The vector at length one, or None for one that links with nothing."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most
    return x / np.linalg.norm(x)


def _entry(dims: int) -> np.dtype:
    """A vector in a cube. Single precision is enough to look for partners; ``verified`` has all digits."""
    return np.dtype([("g", "<u8"), ("i", "S16"), ("home", "?"), ("x", "<f4", (dims,))])


def hash_of(i: bytes) -> int:
    """A number from an id whose trailing zeros were cut."""
    return int.from_bytes(i[:8].ljust(8, b"\0"), "little")


def _label_hash(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "little")


def _vectors_of(batch: pa.RecordBatch, p: SubspaceParams) -> Iterator[tuple]:
    """(subspaces, ids, label hashes, rotated) per vector length of a batch of (d, label, x)."""
    ids = batch.column(0).to_pylist()
    labels = np.array([_label_hash(x) for x in batch.column(1).to_pylist()], np.uint64)
    raw = [np.frombuffer(b, "<f8") for b in batch.column(2).to_pylist()]
    lengths = np.array([len(x) for x in raw])
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        space = subspaces(int(d), p)
        x = np.stack([raw[i] for i in own])
        yield space, [ids[i] for i in own], labels[own], _rotated(x, space)


def _rotated(x: np.ndarray, space: Subspaces) -> np.ndarray:
    """Rotate row by row, so that a vector's coordinates do not depend on its neighbours."""
    return np.stack([row @ space.rotation for row in x]) if len(x) else x


def _near_any(x: np.ndarray, home: np.ndarray, radius2: float) -> np.ndarray:
    """Rows with a partner within the radius; of two rows, one must be at home."""
    hit = np.zeros(len(x), bool)
    at_home = np.flatnonzero(home)
    for a in range(0, len(at_home), 256):
        rows = at_home[a : a + 256]
        for b in range(0, len(x), 2048):
            near = ((x[rows, None, :] - x[None, b : b + 2048, :]) ** 2).sum(axis=2) <= radius2
            own = (rows >= b) & (rows < b + 2048)
            near[own, rows[own] - b] = False
            hit[rows] |= near.any(axis=1)
            hit[b : b + 2048] |= near.any(axis=0)
    return hit


class _Join:
    def __init__(self, p: SubspaceParams):
        self.p = p

    def groups(self, vectors: DataFrame) -> DataFrame:
        """(g, d): vectors that have a partner within the radius in cube g, or stand in a hot cube; written once."""
        p, bins = self.p, 1 << self.p.sketch_bits

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(bins, np.int64)
            for b in pieces(batches, 1024):
                for space, _, labels, x in _vectors_of(b, p):
                    for k in range(len(space.blocks)):
                        for _, keys, _ in space.cubes(x, labels, k):
                            np.add.at(counts, (keys >> np.uint64(64 - p.sketch_bits)).astype(np.int64), 1)
            at, blobs = histogram_chunks(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], ["at", "counts"])

        sketch = add_chunks(vectors.mapInArrow(count, "at int, counts binary"), bins)
        parts = max(1, -(-int(sketch.sum()) // p.entries))
        hot = sketch > p.hot

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1024):
                rows: list[tuple] = []
                for space, ids, labels, x in _vectors_of(b, p):
                    packed = np.array(ids, "S16")
                    for k, own in enumerate(space.blocks):
                        made = []
                        for at, keys, home in space.cubes(x, labels, k):
                            e = np.empty(len(at), _entry(len(own)))
                            e["g"], e["i"], e["home"], e["x"] = keys, packed[at], home, x[at][:, own]
                            made.append(e)
                        e = np.concatenate(made)
                        # a cube that may be hot is dealt out by vector; its entries need no look at each other
                        part = (e["g"] % np.uint64(parts)).astype(np.int64)
                        is_hot = hot[(e["g"] >> np.uint64(64 - p.sketch_bits)).astype(np.int64)]
                        part[is_hot] = parts + np.array([hash_of(i) % parts for i in e["i"][is_hot].tolist()], np.int64)
                        order = np.argsort(part, kind="stable")
                        e, part = e[order], part[order]
                        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                        for a, z in zip(starts, [*starts[1:], len(e)], strict=True):
                            rows.append((int(part[a]), space.d, k, e[a:z].tobytes()))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "dims", "block", "entries"])

        def find(key: tuple, group: pa.Table) -> pa.Table:
            g_out, d_out = [], []
            dims, block = group.column("dims").to_numpy(), group.column("block").to_numpy()
            blobs = group.column("entries").to_pylist()
            for d, k in sorted(set(zip(dims.tolist(), block.tolist(), strict=True))):
                space = subspaces(d, p)
                own = np.flatnonzero((dims == d) & (block == k))
                e = np.frombuffer(b"".join(blobs[i] for i in own), _entry(len(space.blocks[k])))
                e = e[np.argsort(e["g"], kind="stable")]
                hit = np.full(len(e), key[0].as_py() >= parts)
                edges = np.flatnonzero(np.r_[True, e["g"][1:] != e["g"][:-1], True])
                for a, z in zip(edges, edges[1:], strict=False):
                    if z - a > 1 and not hit[a] and e["home"][a:z].any():
                        hit[a:z] = _near_any(e["x"][a:z], e["home"][a:z], space.radius2[k] * (1 + 1e-4) + 1e-6)
                g_out.append(e["g"][hit].view("<i8"))
                d_out += [i.ljust(16, b"\0") for i in e["i"][hit].tolist()]
            g = np.concatenate(g_out) if g_out else np.empty(0, np.int64)
            return pa.table({"g": pa.array(g, pa.int64()), "d": pa.array(d_out, pa.binary())})

        dealt = vectors.mapInArrow(deal, "part long, dims int, block int, entries binary")
        found = dealt.groupBy("part").applyInArrow(find, "g long, d binary")
        return stored(found.distinct(), "subspace-groups")

    def verified(self, groups: DataFrame, vectors: DataFrame) -> DataFrame:
        """(d, n, other): links of d (weighted by the partners' counts), or an edge to ``other`` with n = 0."""
        p = self.p
        sizes = groups.groupBy("g").agg(F.count("*").alias("size"))
        tiles = groups.join(sizes, "g").withColumn("tiles", F.ceil(F.col("size") / p.tile).cast("int"))
        mine = F.pmod(F.xxhash64("d", "g"), F.col("tiles")).cast("int")
        tiles = tiles.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiles = tiles.select("g", "d", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
        full = tiles.join(vectors, "d")

        def verify(key: tuple, group: pa.Table) -> pa.Table:
            g, i, j = (k.as_py() for k in key)
            names, mine = group.column("d").to_pylist(), group.column("mine").to_numpy()
            labels = np.unique(np.array(group.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
            hashes = np.array([_label_hash(x) for x in group.column("label").to_pylist()], np.uint64)
            weight = group.column("m").to_numpy()
            raw = [np.frombuffer(b, "<f8") for b in group.column("x").to_pylist()]
            lengths = np.array([len(x) for x in raw])
            count = np.zeros(len(names), np.int64)
            parent = list(range(len(names)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for kind in np.unique(np.stack([lengths, labels], axis=1), axis=0):
                own = np.flatnonzero((lengths == kind[0]) & (labels == kind[1]))
                space = subspaces(int(kind[0]), p)
                x = np.stack([raw[r] for r in own])
                turned = _rotated(x, space)
                left, right = np.flatnonzero(mine[own] == i), np.flatnonzero(mine[own] == j)
                for a in range(0, len(left), 64):
                    rows = left[a : a + 64]
                    u, v = np.nonzero(x[rows] @ x[right].T >= p.cosine)
                    u, v = rows[u], right[v]
                    once = u < v if i == j else np.ones(len(u), bool)
                    u, v = u[once], v[once]
                    keep, earlier = np.zeros(len(u), bool), np.zeros(len(u), bool)
                    for k, dims in enumerate(space.blocks):
                        near = ((turned[u][:, dims] - turned[v][:, dims]) ** 2).sum(axis=1) <= space.radius2[k]
                        first = np.flatnonzero(near & ~earlier)
                        earlier |= near
                        if len(first):
                            at = space.meeting_key(
                                hashes[own][u[first]], k, space.homes(turned[u[first]], k), space.homes(turned[v[first]], k)
                            )
                            keep[first] = at.view("<i8") == g
                    u, v = own[u[keep]], own[v[keep]]
                    np.add.at(count, u, weight[v])
                    np.add.at(count, v, weight[u])
                    for s, t in zip(u.tolist(), v.tolist(), strict=True):
                        s, t = root(s), root(t)
                        if s != t:
                            parent[max(s, t)] = min(s, t)
            linked = np.flatnonzero(count)
            return pa.table({
                "d": pa.array([names[r] for r in linked], pa.binary()), "n": pa.array(count[linked], pa.int64()),
                "other": pa.array([names[root(r)] for r in linked], pa.binary()),
            })

        found = full.groupBy("g", "i", "j").applyInArrow(verify, "d binary, n long, other binary")
        return stored(found, "subspace-links")


def link_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", params: SubspaceParams | None = None
) -> DataFrame:
    """(key, n_links, component_id, kept): one row for every row of ``rows``.

    Rows link when their labels are equal and not null, their vectors have the same
    length, and the cosine reaches the limit. Vectors that are null, empty or zero, or
    hold null or non-finite components, link with nothing and are their own component.
    Rows with equal vectors, repeated rows among them, are linked and count for each
    other. ``kept`` is true where the key is its component's smallest, so rows that
    repeat that key are all kept; a null key is never smallest nor kept. An empty table
    gives an empty result. Extra columns are not read.
    """
    p = params or SubspaceParams()

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1024):
            labels = b.column(2).to_pylist()
            units = [None if x is None else _unit(v) for v, x in zip(b.column(1).to_pylist(), labels, strict=True)]
            blobs = [None if u is None else (u + 0.0).tobytes() for u in units]
            ids = [
                None if u is None else hashlib.blake2b(x.encode() + b"\0" + u, digest_size=16).digest()
                for u, x in zip(blobs, labels, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(labels, pa.string()), pa.array(blobs, pa.binary())],
                ["key", "d", "label", "x"],
            )

    source = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    kind = rows.schema[key].dataType.simpleString()
    units = stored(source.mapInArrow(normalise, f"key {kind}, d binary, label string, x binary"), "subspace-rows")
    vectors = units.where("d is not null").groupBy("d").agg(
        F.min("label").alias("label"), F.min("x").alias("x"), F.count("*").alias("m")
    )
    vectors = stored(vectors, "subspace-vectors")
    join = _Join(p)
    found = join.verified(join.groups(vectors.select("d", "label", "x")), vectors)
    linked = components(found.select(F.col("d").alias("a"), F.col("other").alias("b")), "subspace-components")
    counts = found.groupBy("d").agg(F.sum("n").alias("n"))
    classes = vectors.select("d", "m").join(counts, "d", "left").join(linked.withColumnRenamed("node", "d"), "d", "left")
    classes = classes.select(
        "d", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "d").alias("component")
    )
    every = units.select("key", "d").join(classes, "d", "left")
    smallest = every.where("component is not null").groupBy("component").agg(F.min("key").alias("smallest"))
    out = every.join(smallest, "component", "left")
    component = F.when(F.col("d").isNull(), F.col("key")).otherwise(F.col("smallest"))
    return out.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
