"""Exact k-nearest neighbours as tiles of blocks.

Rows are packed into blocks that hold each of their distinct vectors once; of equal
training vectors a block keeps the ids that can be among the nearest (the smallest).
The product of training and query rows is cut into tiles, a tile is one task's work:
it holds at most about ``TILE_BYTES`` of training vectors, cuts them into cells around
some of them and lets the query blocks stream by. A query looks into its own cell first;
then the triangle inequality tells which other cells can hold a neighbour, and there a
matrix product whose rounding error is bounded tells which rows can. For those the
distance is computed as the sum of squares in the order of the components, so that
neither blocks nor tiles change a result (ties go to the smaller id). Nothing is capped.

What is shuffled are the training blocks once for each of the query's parts, the query
blocks once for each of the training parts, and ``k`` rows a query and training part. Parts
are as few as ``TILES`` tasks and the tiles' memory allow. On data without clusters the
work itself approaches all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.trees import distinct_rows, matrix_of
from tabforge.session import scratch_path

#: Tiles that the work is cut into, about, and the training rows' parts among them, unless memory wants more.
TILES, PARTS = 64, 8
#: Bytes of training vectors that a part is worth.
PART_BYTES = 1 << 18
#: Bytes of a tile's training vectors, about.
TILE_BYTES = 1 << 25
#: Distinct vectors of a block.
BLOCK_VECTORS = 1024
#: Training rows of a cell, about.
CELL_ROWS = 256
MAX_PIVOTS = 1024


def _codes(ids: pa.Array) -> np.ndarray:
    """Each id's place in ascending order."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def _fewest(number: np.ndarray, ids: pa.Array, most: int | None) -> np.ndarray:
    """Rows by number and then by id; of each number the ``most`` smallest ids."""
    rows = np.lexsort((_codes(ids), number))
    if most is None:
        return rows
    own = number[rows]
    return rows[np.arange(len(rows)) - np.searchsorted(own, own) < most]


def _packed(df: DataFrame, most: int | None, width: int) -> DataFrame:
    """(grp, x, number, ids): blocks of (id, vec, grp); ``number`` is the place of each id's vector in ``x``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def blocks(x: np.ndarray, ids: pa.Array) -> Iterator[tuple]:
        first, number = distinct_rows(x)
        rows = _fewest(number, ids, most)
        for at in range(0, len(first), BLOCK_VECTORS):
            own = rows[slice(*np.searchsorted(number[rows], [at, at + BLOCK_VECTORS]))]
            yield x[first[at : at + BLOCK_VECTORS]].tobytes(), (number[own] - at).astype(np.int32).tobytes(), ids.take(pa.array(own))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, vecs, grp = b.columns
            if vecs.null_count:
                raise ValueError("vectors must not be null")
            x = matrix_of(vecs)
            if x.shape[1] != width:
                raise ValueError("vectors of different lengths")
            groups = grp.dictionary_encode()
            code = groups.indices.to_numpy(zero_copy_only=False)
            for g in np.unique(code).tolist():
                rows = np.flatnonzero(code == g)
                for vectors, number, own in blocks(x[rows], ids.take(pa.array(rows))):
                    columns = [groups.dictionary.slice(g, 1), pa.array([vectors], pa.binary()), pa.array([number], pa.binary()),
                               pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
                    yield pa.RecordBatch.from_arrays(columns, ["grp", "x", "number", "ids"])

    return df.select("id", "vec", "grp").mapInArrow(pack, f"grp {kinds['grp']}, x binary, number binary, ids array<{kinds['id']}>")


class Cells:
    """A tile's training rows."""

    def __init__(self, x: np.ndarray, ids: pa.Array, need: int, most_cells: int):
        first, number = distinct_rows(x)
        self.centers = x[first[: max(1, min(most_cells, len(first) // CELL_ROWS))]]  # by hash: as good as drawn
        rows = _fewest(number, ids, need)
        x, self.ids, self.need = x[rows], ids.take(pa.array(rows)), need
        self.code = _codes(self.ids)
        self.centers = np.where(np.isfinite(self.centers), self.centers, 0.0)
        own = np.concatenate([self._nearest(x[at : at + 8192]) for at in range(0, len(x), 8192)])
        self.cells = []
        for c, center in enumerate(self.centers):
            at = np.flatnonzero(own == c)
            if len(at):
                u = x[at] - center
                u2 = np.einsum("ij,ij->i", u, u)
                self.cells.append((c, at, x[at], u, u2, float(np.sqrt(u2.max())), float(np.abs(x[at]).max(initial=0.0))))

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        near = np.einsum("ij,ij->i", self.centers, self.centers) - 2 * x @ self.centers.T
        return np.where(np.isnan(near), np.inf, near).argmin(axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, training row, distance): the ``need`` nearest of each, or all if there are fewer."""
        n, dim = q.shape
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        bound = np.full(n, np.inf)  # distance of the last one found, once there are enough
        own = self._nearest(q)
        big, eps = np.abs(q).max(axis=1, initial=0.0), np.finfo(float).eps
        for first_pass in (True, False):
            for c, at, x, u, u2, radius, x_big in self.cells:
                rows = np.flatnonzero((own == c) == first_pass)
                if not len(rows):
                    continue
                v = q[rows] - self.centers[c]
                v2 = np.einsum("ij,ij->i", v, v)
                far = np.sqrt(v2)
                # what rounding can do to a distance, with room to spare
                loose = 16 * (dim + 8) * eps * (far + radius + big[rows] + x_big)
                can = ~(far - radius - loose > bound[rows])
                rows, v, v2, far, loose = rows[can], v[can], v2[can], far[can], loose[can]
                if not len(rows):
                    continue
                d2 = u2 - 2 * v @ u.T + v2[:, None]
                slack = 16 * (dim + 8) * eps * (v2 + radius * radius) + 2 * loose * (far + radius) + loose * loose
                limit = bound[rows] ** 2 + slack
                hit = ~(d2 > limit[:, None])
                if hit.sum() > 4 * self.need * len(rows) and len(at) > self.need:
                    kth = np.partition(np.where(np.isnan(d2), np.inf, d2), self.need - 1, axis=1)[:, self.need - 1]
                    hit = ~(d2 > np.minimum(limit, kth + 2 * slack)[:, None])
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                gap = q[rows[i]] - x[j]
                gap *= gap
                dist = np.sqrt(gap.cumsum(axis=1)[:, -1]) if dim else np.zeros(len(i))
                changed = np.zeros(n, bool)
                changed[rows[i]] = True
                held = changed[found[0]]
                r, t, d = (np.concatenate([a[held], b]) for a, b in zip(found, (rows[i], at[j], dist), strict=True))
                order = np.lexsort((self.code[t], d, r))
                r, t, d = r[order], t[order], d[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < self.need
                last = place == self.need - 1
                bound[r[last]] = np.where(np.isnan(d[last]), np.inf, d[last])
                found = [np.concatenate([a[~held], b[keep]]) for a, b in zip(found, (r, t, d), strict=True)]
        return found[0], found[1], found[2]


def knn(query: DataFrame, train: DataFrame, k: int, *, id_col: str = "id", vec_col: str = "features",
        exclude_self: bool = False, max_pivots: int = MAX_PIVOTS, group_col: str | None = None) -> DataFrame:
    """(q_id, t_id, dist, rank) for the k nearest training rows of every query row.

    With ``group_col`` neighbours must share the group (e.g. same-class
    neighbours for SMOTE); a null group has none. Groups are assumed few (classes).
    ``max_pivots``: cells of a tile, at most. Vectors must have one length; a distance that is no number comes last.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    g = F.col(group_col) if group_col else F.lit(0)
    tr, qu = (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), g.alias("grp"))
              .where(F.col("grp").isNotNull()) for df in (train, query))
    st = tr.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("d0"), F.max(F.size("vec")).alias("d1")).first()
    if st["d0"] != st["d1"]:
        raise ValueError("vectors of different lengths")
    least = k + (1 if exclude_self else 0)
    if st["n"] < least:
        raise ValueError(f"k={k} neighbours requested but only {st['n']} training rows")
    groups = tr.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    small = [r["grp"] for r in groups.where(F.col("n") < least).limit(5).collect()]
    if small:
        raise ValueError(f"groups with fewer than {least} training rows: {small}")
    need = k  # rows that a query may have to pass over: those with its own id
    if exclude_self:
        need += tr.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    spark, width = tr.sparkSession, st["d0"]
    packed = _packed(tr, need, width)
    path = scratch_path(spark, "knn-blocks")
    packed.write.parquet(path)
    blocks = spark.read.schema(packed.schema).parquet(path)
    sizes = blocks.groupBy("grp").agg(F.sum(F.octet_length("x") + F.octet_length("number") * 2 * width).alias("bytes"))
    n_groups = sizes.count()
    wanted = F.greatest(F.least(F.lit(PARTS), F.ceil(F.col("bytes") / PART_BYTES)), F.ceil(F.col("bytes") / TILE_BYTES), F.lit(1))
    parts = sizes.select("grp", wanted.cast("int").alias("nt"))
    parts = parts.withColumn("nq", F.greatest(F.lit(1), F.ceil(F.lit(TILES) / n_groups / F.col("nt"))).cast("int"))
    tiles = parts.agg(F.sum(F.col("nt").cast("long") * F.col("nq"))).first()[0]
    parts = F.broadcast(parts)  # a row a group

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    t_ids, q_ids = packed.schema["ids"].dataType, f"array<{qu.schema['id'].dataType.simpleString()}>"
    left = blocks.join(parts, "grp").select("grp", F.pmod(F.xxhash64("x", "number"), "nt").cast("int").alias("ts"), all_of("nq").alias("qs"),
                                            F.lit(0).alias("side"), "x", "number", F.col("ids").alias("t_ids"),
                                            F.lit(None).cast(q_ids).alias("q_ids"))
    right = _packed(qu, None, width).join(parts, "grp").select(
        "grp", all_of("nt").alias("ts"), F.pmod(F.xxhash64("x", "number"), "nq").cast("int").alias("qs"), F.lit(1).alias("side"),
        "x", "number", F.lit(None).cast(t_ids).alias("t_ids"), F.col("ids").alias("q_ids"))
    dealt = left.unionByName(right).repartition(int(min(tiles, 4096)), "grp", "ts", "qs").sortWithinPartitions("grp", "ts", "qs", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cells = None, [], None
        for b in batches:
            for i, (*tile, side) in enumerate(zip(*(b.column(c).to_pylist() for c in ("grp", "ts", "qs", "side")), strict=True)):
                if tile != now:
                    now, held, cells = tile, [], None
                x = np.frombuffer(b.column("x")[i].as_buffer()).reshape(-1, width)
                number = np.frombuffer(b.column("number")[i].as_buffer(), np.int32)
                if side == 0:
                    held.append((x[number], b.column("t_ids").slice(i, 1).flatten()))
                    continue
                if cells is None:
                    if not held:
                        continue  # no training block fell into this part
                    cells = Cells(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), need, max_pivots)
                    held = []
                row, near, dist = cells.nearest(x)
                order = np.argsort(row, kind="stable")
                row, near, dist = row[order], near[order], dist[order]
                ends = np.searchsorted(row, [number, number + 1])
                n = ends[1] - ends[0]  # of each id
                at = np.repeat(ends[0] - np.cumsum(n) + n, n) + np.arange(n.sum())
                own = b.column("q_ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([own.take(pa.array(np.repeat(np.arange(len(number)), n))),
                                                  cells.ids.take(pa.array(near[at])), pa.array(dist[at])], ["q_id", "t_id", "dist"])

    kinds = [d.schema["id"].dataType.simpleString() for d in (qu, tr)]
    pairs = dealt.mapInArrow(search, f"q_id {kinds[0]}, t_id {kinds[1]}, dist double")
    if exclude_self:
        pairs = pairs.where(F.col("q_id") != F.col("t_id"))
    w = Window.partitionBy("q_id").orderBy("dist", "t_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_weights(nn: DataFrame) -> DataFrame:
    """Inverse-distance weights; when any neighbour is at distance 0, only
    those vote (weight 1 each)."""
    w = Window.partitionBy("q_id")
    has_zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(w) == 1
    return nn.withColumn("w", F.when(has_zero, F.when(F.col("dist") == 0, 1.0).otherwise(0.0))
                         .otherwise(1.0 / F.col("dist")))


def knn_classify(nn: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """(q_id, prediction, probs map) by weighted vote; ties → smallest label."""
    j = neighbour_weights(nn).join(labels.select(F.col("t_id"), F.col(label_col).alias("_lab")), on="t_id")
    votes = j.groupBy("q_id", "_lab").agg(F.sum("w").alias("vw"))
    return votes.groupBy("q_id").agg(
        F.min_by("_lab", F.struct((-F.col("vw")).alias("nv"), F.col("_lab").alias("l"))).alias("prediction"),
        F.map_from_entries(F.collect_list(F.struct(F.col("_lab").cast("string"), F.col("vw")))).alias("_votes"),
        F.sum("vw").alias("_tot"),
    ).select("q_id", "prediction", F.transform_values("_votes", lambda k, v: v / F.col("_tot")).alias("probs"))


def knn_regress(nn: DataFrame, targets: DataFrame, target_col: str = "target") -> DataFrame:
    """(q_id, prediction) = weighted mean of neighbour targets."""
    j = neighbour_weights(nn).join(targets.select(F.col("t_id"), F.col(target_col).cast("double").alias("_y")), on="t_id")
    return j.groupBy("q_id").agg((F.sum(F.col("w") * F.col("_y")) / F.sum("w")).alias("prediction"))
