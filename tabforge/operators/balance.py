"""Class rebalancing: balanced class weights and SMOTE oversampling.

SMOTE raises every minority class to the majority size. Synthetic row ``j`` of
class ``y`` takes base row ``hash43(y:j) mod n_y`` (position by id), its
``1 + hash44(y:j) mod k``-th nearest same-class neighbour (exact kNN, ties by
id) and ``u = hash45(y:j) / 2^32``: ``x + u · (neighbour − x)``. All choices are
portable hashes, so the synthetic rows do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tabforge.functions.columns import hash32
from tabforge.functions.stats import with_position
from tabforge.operators.knn import knn
from tabforge.operators.split import class_counts

# Salts of the three SMOTE hashes.
SALT_BASE, SALT_NEIGHBOUR, SALT_GAP = 43, 44, 45


def smote(df: DataFrame, *, id_col: str, label_col: str, vec_col: str, k: int = 5, task_type: str = "classification"
          ) -> DataFrame:
    """Synthetic minority rows: (label, j, base_id, nb_id, u, vec).

    All classes are handled together: one same-class kNN (grouped by label),
    one position pass (grouped by label), and synthetic row indices from one
    partitioned range (a hot class never generates its rows in a single task)."""
    if task_type == "regression":
        raise ValueError("SMOTE cannot be applied to regression")
    spark = df.sparkSession
    counts = dict(class_counts(df, label_col))
    n_max = max(counts.values())
    needs = {y: n_max - n for y, n in counts.items() if n < n_max}
    label_type = df.schema[label_col].dataType.simpleString()
    if not needs:
        return spark.createDataFrame([], f"{label_col} {label_type}, j long, base_id long, nb_id long, u double, "
                                         f"{vec_col} array<double>")
    small = {y: counts[y] for y in needs if counts[y] <= k}
    if small:
        raise ValueError(f"classes {sorted(map(str, small))} have <= k={k} rows; SMOTE needs more")
    minority = df.where(F.col(label_col).isin(list(needs))).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("y"))
    nn = knn(minority, minority, k, id_col="id", vec_col="vec", exclude_self=True, group_col="y")
    pos = with_position(minority.select("id", "y"), ["y"], ["id"], out="pos", max_rows=max(counts[y] for y in needs))
    # Synthetic row ids 0..total-1 come from a partitioned range; per-class
    # offsets (one value per class) map an id to its class and its j.
    order = sorted(needs, key=lambda v: str(v))
    offsets = [0]
    for y in order:
        offsets.append(offsets[-1] + needs[y])
    ids = spark.range(offsets[-1]).withColumn("_i", F.col("id").cast("double"))
    bucket = Bucketizer(splits=[float(o) for o in offsets] + [float("inf")], inputCol="_i", outputCol="_b")
    labels = F.array(*[F.lit(y) for y in order])
    n_ys = F.array(*[F.lit(counts[y]) for y in order])
    starts = F.array(*[F.lit(o) for o in offsets[:-1]])
    b = F.col("_b").cast("int") + 1
    gen = bucket.transform(ids).select(F.element_at(labels, b).alias("y"), F.element_at(n_ys, b).cast("long").alias("n_y"),
                                       (F.col("id") - F.element_at(starts, b) + 1).alias("j"))
    key = F.concat(F.col("y").cast("string"), F.lit(":"), F.col("j").cast("string"))
    gen = gen.select("y", "j", (hash32(key, SALT_BASE) % F.col("n_y")).alias("pos"),
                     (1 + hash32(key, SALT_NEIGHBOUR) % k).alias("rank"),
                     (hash32(key, SALT_GAP) / F.lit(4294967296.0)).alias("u"))
    vec = minority.select("id", "vec")
    g = (gen.join(pos, on=["y", "pos"]).withColumnRenamed("id", "base_id")
         .join(nn.select(F.col("q_id").alias("base_id"), "rank", F.col("t_id").alias("nb_id")), on=["base_id", "rank"])
         .join(vec.select(F.col("id").alias("base_id"), F.col("vec").alias("x")), on="base_id")
         .join(vec.select(F.col("id").alias("nb_id"), F.col("vec").alias("nb")), on="nb_id"))
    syn = F.zip_with("x", "nb", lambda a, b: a + F.col("u") * (b - a))
    return g.select(F.col("y").alias(label_col), "j", "base_id", "nb_id", "u", syn.alias(vec_col))


def smote_resample(df: DataFrame, *, id_col: str, label_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """Training rows plus synthetic rows. Whole-number ids stay what they are, and a
    synthetic row's is a negative 64-bit hash of (label, j); other ids become
    text, and a synthetic row's is ``synthetic:label:j``. Either way ids are deterministic."""
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("_key"), label_col, F.col(vec_col).cast("array<double>").alias(vec_col))
    # the kNN needs whole-number ids: a hash of the key does, and the key itself where it is one
    whole = isinstance(kind, IntegralType)
    number = F.col("_key").cast("long") if whole else F.xxhash64("_key")
    syn = smote(rows.withColumn("_number", number), id_col="_number", label_col=label_col, vec_col=vec_col, k=k)
    label, j = F.col(label_col).cast("string"), F.col("j")
    syn_id = -F.abs(F.xxhash64(label, j)) - 1 if whole else F.concat_ws(":", F.lit("synthetic"), label, j)
    key = F.col("_key").cast("long" if whole else "string")
    return rows.select(key.alias(id_col), label_col, vec_col).unionByName(syn.select(syn_id.alias(id_col), label_col, vec_col))
